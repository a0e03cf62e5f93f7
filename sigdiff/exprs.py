"""Scalar functions of signals as column expressions (F1-F16)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed names of colours in profiles.
COLOURS = ("red", "green", "blue", "yellow", "magenta", "cyan", "aqua", "aquamarine", "orange", "purple", "gray", "grey", "null")
#: Fixed coefficients of the flat-top window, of alternating sign.
FLAT_TOP = (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)
#: Fixed factors by which amplitudes are raised after a window (n rectangle, t Tukey, f flat-top, h Hann, m Hamming).
WINDOW_FACTORS = {"n": 1.0, "t": 1.2122, "f": 4.63899, "h": 1.99986, "m": 1.85196}


def almost_equal(a: Column, b: Column, tol: float = 1e-5) -> Column:
    """of equal sign: the same, the same but for rounding of doubles, or absolute values less than tol apart."""
    near = F.abs(a - b) <= 2.220446049250313e-16 * F.greatest(F.abs(a), F.abs(b))
    return (a == b) | near | (F.abs(F.abs(a) - F.abs(b)) < tol)


def round_half_away(x: Column, places: int) -> Column:
    """F2."""
    p = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def magnitude(re: Column, im: Column, enbw: Column) -> Column:
    """F3."""
    return 2 * F.sqrt(re * re + im * im) / enbw


def phase(re: Column, im: Column) -> Column:
    """degrees."""
    return F.degrees(F.atan2(im, re))


def decibels(m: Column, zero: Column) -> Column:
    """null if the magnitude is 0 or above the zero reference."""
    return F.when((m > 0) & (m <= zero), 20 * F.log10(m / zero))


def from_decibels(db: Column, zero: Column) -> Column:
    return zero * F.pow(F.lit(10.0), db / 20)


def hertz(bin_: Column, boxsize_ms: Column) -> Column:
    """F6."""
    return bin_ * 1000.0 / boxsize_ms


def frames_to_seconds(frames: Column, ms_per_frame: Column) -> Column:
    """F7."""
    return frames * ms_per_frame / 1000.0


def seconds_to_frames(seconds: Column, ms_per_frame: Column) -> Column:
    """F7 from here on."""
    return seconds * 1000.0 / ms_per_frame


def seconds_to_samples(seconds: Column, rate: Column) -> Column:
    return F.floor(seconds * rate)


def samples_to_seconds(samples: Column, rate: Column) -> Column:
    return samples / rate


def frames_to_samples(frames: Column, ms_per_frame: Column, rate: Column) -> Column:
    return seconds_to_samples(frames_to_seconds(frames, ms_per_frame), rate)


def samples_to_frames(samples: Column, ms_per_frame: Column, rate: Column) -> Column:
    return seconds_to_frames(samples_to_seconds(samples, rate), ms_per_frame)


def samples_to_bytes(samples: Column, channels: Column, bits: Column) -> Column:
    return samples * channels * bits / 8


def bytes_to_samples(size: Column, channels: Column, bits: Column) -> Column:
    return size * 8 / channels / bits


def amplitude_difference(ref: Column, comp: Column) -> Column:
    """F8: positive where the comparison is louder."""
    return F.abs(ref) - F.abs(comp)


def phase_difference(ref: Column, comp: Column) -> Column:
    """wrapped to (-180, 180]."""
    d = comp - ref
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def cents(a: Column, b: Column) -> Column:
    """F10."""
    return 1200 * F.log2(a / b)


def weight(x: Column, curve: int) -> Column:
    """of x in [0, 1], lifted to [0.15, 1]."""
    curves = (
        lambda: F.lit(1.0),
        lambda: F.sqrt(x),
        lambda: 10 * F.pow(x, 3) - 15 * F.pow(x, 4) + 6 * F.pow(x, 5),
        lambda: x,
        lambda: x * x,
        lambda: 17 * F.pow(x, 16) - 16 * F.pow(x, 17),
    )
    return curves[curve]() * 0.85 + 0.15


def log_axis(hz: Column, end_hz: float) -> Column:
    """F12."""
    return end_hz / math.log10(end_hz) * F.log10(hz)


def display_name(name: Column) -> Column:
    """F15."""
    return F.translate(name, "_", " ")


def colour(name: Column) -> Column:
    """the colour that a profile's word means (a d before it is its dark shade), null for other words."""
    bare = F.regexp_replace(F.lower(name), "^d(?=[a-z])", "")
    one = F.when(bare.isin("aqua", "aquamarine"), "cyan").when(bare == "grey", "gray").otherwise(bare)
    return F.when(bare.isin(*COLOURS), one)


def window_factor(kind: str) -> float:
    """the fixed factor of a window."""
    return WINDOW_FACTORS[kind]


def correction_factor(w: Column) -> Column:
    """size / sum of an array of coefficients."""
    return F.size(w) / F.aggregate(w, F.lit(0.0), lambda s, x: s + x)


def imbalance_pct(db: Column) -> Column:
    """F16."""
    return 100 * (F.pow(F.lit(10.0), db / 20) - 1)


def window_value(i: Column, n: Column, kind: str) -> Column:
    """coefficient i of a symmetric window of n."""
    turn = 2 * math.pi * i / (n - 1)
    if kind == "h":
        return 0.5 - 0.5 * F.cos(turn)
    if kind == "m":
        return 0.54 - 0.46 * F.cos(turn)
    if kind == "f":
        a = FLAT_TOP
        return a[0] - a[1] * F.cos(turn) + a[2] * F.cos(2 * turn) - a[3] * F.cos(3 * turn) + a[4] * F.cos(4 * turn)
    if kind == "t":
        edge = 0.65 * (n - 1) / 2
        near = F.least(i, n - 1 - i)
        return F.when(near < edge, 0.5 * (1 + F.cos(math.pi * (near / edge - 1)))).otherwise(1.0)
    return F.lit(1.0)
