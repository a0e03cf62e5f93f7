"""A gated recurrent layer in numpy, with its gradients, for many sequences side by side.

Gates z, r and candidate n of a step, from the input's projection x (its three parts) and the state h:
z = s(x_z + (hU)_z), r = s(x_r + (hU)_r), n = tanh(x_n + r (hU)_n), h' = n + z (h - n).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The next state; x: (sequences, 3 units)."""
    k = h.shape[1]
    g = h @ u
    zr = x[:, : 2 * k] + g[:, : 2 * k]
    zr *= 0.5
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    n = g[:, 2 * k :]
    n *= zr[:, k:]
    n += x[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= zr[:, :k]
    out += n
    return out


def forward(x: np.ndarray, u: np.ndarray, h: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """States after each step, and what backward() needs. x: (steps, sequences, 3 units); where mask (steps, sequences) is 0 the state stays."""
    k = h.shape[1]
    states, cache = np.empty((*x.shape[:2], k), x.dtype), []
    for t in range(len(x)):
        g = h @ u
        zr = x[t, :, : 2 * k] + g[:, : 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :k], zr[:, k:]
        n = r * g[:, 2 * k :]
        n += x[t, :, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new = h + mask[t][:, None] * (new - h)
        cache.append((h, z, r, n, g[:, 2 * k :], None if mask is None else mask[t][:, None]))
        h = states[t] = new
    return states, cache


def backward(d_states: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, given those of the states."""
    k = u.shape[0]
    dx = np.zeros((*d_states.shape[:2], 3 * k), d_states.dtype)
    du = np.zeros_like(u)
    dh = np.zeros_like(d_states[0])
    for t in range(len(cache) - 1, -1, -1):
        h, z, r, n, gn, m = cache[t]
        dh = dh + d_states[t]
        dnew = dh if m is None else dh * m
        stay = 0 if m is None else dh - dnew
        dz, dr, dn = dx[t, :, :k], dx[t, :, k : 2 * k], dx[t, :, 2 * k :]
        keep = 1 - z
        np.multiply(dnew, keep, out=dn)
        keep *= z
        keep *= h - n
        np.multiply(dnew, keep, out=dz)
        dn *= 1 - n * n
        np.multiply(dn, gn, out=dr)
        dr *= r * (1 - r)
        dg = dx[t].copy()
        dg[:, 2 * k :] *= r
        du += h.T @ dg
        dh = dnew * z + dg @ u.T + stay
    return dx, du


# ---- the same with the gates apart: x (3, steps, sequences, units) and u (3, units, units), so that each gate's numbers lie together ----


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """z and r, n, (hU)_n and the next state of a step; x: (3, sequences, units)."""
    g = np.matmul(h, u)
    zr, gn = g[:2], g[2]
    zr += x[:2]
    np.negative(zr, out=zr)
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the gate's right value
        np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    n = zr[1] * gn
    n += x[2]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[0]
    new += n
    return zr, n, gn, new


def step_apart(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The next state; x: (3, sequences, units)."""
    return _gates(x, h, u)[3]


def forward_apart(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step, and what backward_apart() needs."""
    states, cache = np.empty(x.shape[1:], x.dtype), []
    for t in range(x.shape[1]):
        zr, n, gn, new = _gates(x[:, t], h, u)
        cache.append((h, zr, n, gn))
        h = states[t] = new
    return states, cache


def backward_apart(d_states: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, given those of the states."""
    dx = np.empty((3, *d_states.shape), d_states.dtype)
    du = np.zeros_like(u)
    dh = np.zeros_like(d_states[0])
    ut = np.ascontiguousarray(u.transpose(0, 2, 1))
    dg = np.empty((3, *dh.shape), dh.dtype)
    for t in range(len(cache) - 1, -1, -1):
        h, (z, r), n, gn = cache[t]
        dh += d_states[t]
        dn = dg[2]
        keep = 1 - z
        np.multiply(dh, keep, out=dn)
        keep *= z
        keep *= h - n
        np.multiply(dh, keep, out=dg[0])
        slope = n * n
        np.subtract(1, slope, out=slope)
        dn *= slope
        np.subtract(1, r, out=slope)
        slope *= r
        slope *= gn
        np.multiply(dn, slope, out=dg[1])
        dx[:, t] = dg
        dn *= r
        du += np.matmul(h.T, dg)
        dh *= z
        back = np.matmul(dg, ut)
        dh += back[0]
        dh += back[1]
        dh += back[2]
    return dx, du


class Adam:
    """Steps for dense arrays, kept by name."""

    def __init__(self, rate: float):
        self.rate, self.at, self.state = rate, 0, {}

    def __call__(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.at += 1
        for name, g in grads.items():
            m, v = self.state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            change = g - m
            change *= 0.1
            m += change
            np.multiply(g, g, out=change)
            change -= v
            change *= 0.01
            v += change
            below = v / (1 - 0.99**self.at)
            np.sqrt(below, out=below)
            below += 1e-7
            np.divide(m, 1 - 0.9**self.at, out=change)
            change *= self.rate
            change /= below
            params[name] -= change


class RowSteps:
    """Steps for a few rows of a large table, each weight at its own rate."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.seen = table, rate, np.full(table.shape, 1e-5, table.dtype)

    def __call__(self, rows: np.ndarray, grads: np.ndarray) -> None:
        unique, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), grads.shape[1]), self.table.dtype)
        np.add.at(total, inverse, grads)
        self.seen[unique] += total * total
        self.table[unique] -= self.rate * total / np.sqrt(self.seen[unique])
