"""Options that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompareOptions:
    window: str = "n"  # n rectangle, t Tukey, h Hann, m Hamming, f flat-top
    top: int = 2000
    start_hz: float = 1.0
    end_hz: float = 20000.0
    significance: float = -66.0
    match_db: float = 1.0
    high_difference_db: float = 6.0
    high_difference_pct: float = 50.0
    weight: int = 0
    period: int = 4
    range_db: float = 18.0
    auto_significance: bool = True
    normalise: str = "frequency"  # frequency, average, time or none
    ignore_floor: bool = False
    pad_to_longest: bool = False
    align_hz: int = 0  # k: bins at multiples of 1 / k hertz; 0 leaves them
    balance: bool = True  # scale the louder channel down by the balance block
    align_clock: bool = False  # transform the faster clock's recording again at the slower clock's rate
    clock_seconds: int = 1  # k: the clock is measured to 1 / k hertz
    adjust_rates: str = "none"  # none, ref, comp or both: sample rates from the distance of both trains
    ignore_framerate: bool = False  # compare recordings whose frame rate is more than 1 % off
    sync_tolerance: int = 0
    recentre: bool = False
    use_extra: bool = True
    flatten: bool = False


#: The values that options may have.
CHOICES = {"normalise": ("frequency", "average", "time", "none"), "adjust_rates": ("none", "ref", "comp", "both"), "window": ("n", "t", "h", "m", "f")}


def checked(o: CompareOptions) -> CompareOptions:
    """o; raises ValueError for a value that no option has."""
    for name, choices in CHOICES.items():
        if getattr(o, name) not in choices:
            raise ValueError(f"{name} is one of {', '.join(choices)}, not {getattr(o, name)!r}")
    return o


#: Fixed values of the method: decibels, hertz and shares that results depend on.
COMP_MARGIN_DB = 20.0
SILENCE_LIMIT_DB = -220.0
SIGNIFICANT_DB = -66.0
LOUDEST_FLOOR_DB = -40.0
NORMALISE_DB = 30.0
REVERSED_DB = 8.5
TOLERANCE_HZ = 1e-5
LINE_BINS = 8
CENTS_LIMIT = 0.25
