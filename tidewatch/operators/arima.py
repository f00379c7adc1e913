"""ARIMA models by their exact likelihood: a Kalman filter that runs over many series at once.

A series is differenced d times; what is left is an autoregressive moving-average process in state-space form that starts
from its stationary distribution. The variance, and for d = 0 the mean, are solved for inside the likelihood, so the
search is over the coefficients alone. Coefficients are made of partial autocorrelations between -1 and 1, hence always
stationary and invertible.
"""

from __future__ import annotations

from itertools import product

import numpy as np

#: Values of a slice of series that are filtered together, padded to the longest of them.
CELLS = 500_000
_STEPS = np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])


def stable(free: np.ndarray) -> np.ndarray:
    """Stationary autoregressive coefficients (a row a series) from unbounded numbers."""
    partial, out = np.tanh(np.clip(free, -6, 6)), np.zeros_like(free)
    for j in range(free.shape[1]):
        before = out[:, :j].copy()
        out[:, :j] = before - partial[:, j : j + 1] * before[:, ::-1]
        out[:, j] = partial[:, j]
    return out


def _stationary(phi: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The covariance (r, r, series) of the states of stationary processes; phi (r, series), noise like the result."""
    r, k = phi.shape
    if phi[1:].any():
        step = np.zeros((k, r, r))
        step[:, :, 0] = phi.T
        step[:, np.arange(r - 1), np.arange(1, r)] = 1
        both = np.einsum("kij,klm->kiljm", step, step).reshape(k, r * r, r * r)
        return np.linalg.solve(np.eye(r * r) - both, noise.reshape(r * r, k).T[:, :, None])[:, :, 0].T.reshape(r, r, k)
    cov = np.zeros((r + 1, r + 1, k))  # one autoregressive term: from the last state on, each follows from those behind it
    for i in reversed(range(r)):
        for j in reversed(range(max(1, i), r)):
            cov[i, j] = cov[j, i] = (phi[0] * cov[0, j + 1] if i == 0 else 0) + cov[i + 1, j + 1] + noise[i, j]
    cov[0, 0] = (2 * phi[0] * cov[0, 1] + cov[1, 1] + noise[0, 0]) / (1 - phi[0] ** 2)
    return cov[:r, :r]


def _stepped(phi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The transition of states that lie along the first axis: a share of the first, and the next one."""
    out = phi * x[0]
    out[:-1] += x[1:]
    return out


def innovations(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors (series, columns, times) and their variances in units of the noise's (series, times).

    The columns of a series share its coefficients. Once no variance changes any more, only the states go on. Series lie along the
    last axis inside, so that each step is a few sums of long rows.
    """
    k, columns, times = w.shape
    p, q = phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    share, load = np.zeros((r, k)), np.zeros((r, k))
    share[:p] = phi.T
    load[0], load[1 : q + 1] = 1, theta.T
    noise = load[:, None] * load
    cov = _stationary(share, noise)
    by_time = np.ascontiguousarray(w.transpose(2, 1, 0))
    state, error, scale = np.zeros((r, columns, k)), np.empty_like(by_time), np.ones((times, k))
    across = share[:, None]
    gain, steady = None, False
    for t in range(times):
        np.subtract(by_time[t], state[0], out=error[t])
        scale[t] = cov[0, 0]
        if not steady:
            moved = _stepped(across, cov)
            gain = moved[:, 0] / cov[0, 0]
            new = _stepped(across, moved.transpose(1, 0, 2)) + noise - gain[:, None] * (gain * cov[0, 0])
            steady, cov = bool(np.abs(new - cov).max() < 1e-14), new
        state = _stepped(across, state)
        state += gain[:, None] * error[t]
    return error.transpose(2, 1, 0), scale.T


def likelihood(w: np.ndarray, held: np.ndarray, phi: np.ndarray, theta: np.ndarray, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, mean and errors of each series (a row, true in ``held`` up to its length) at given coefficients."""
    columns = np.stack([w, held.astype(float)], 1) if centred else w[:, None, :]
    error, scale = innovations(columns, phi, theta)
    weight, n = held / scale, held.sum(1)
    mean = (error[:, 0] * error[:, 1] * weight).sum(1) / (error[:, 1] ** 2 * weight).sum(1) if centred else np.zeros(len(w))
    own = error[:, 0] - mean[:, None] * error[:, 1] if centred else error[:, 0]
    variance = np.maximum((own**2 * weight).sum(1) / n, 1e-300)
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + (np.log(scale) * held).sum(1)), mean, own


def _search(w: np.ndarray, held: np.ndarray, p: int, q: int, centred: bool, rounds: int = 60) -> np.ndarray:
    """The free numbers of each series' most likely coefficients: quasi-Newton steps, each series with its own curvature."""
    k, m = len(w), p + q
    n = held.sum(1)

    def cost(points: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        free = points.reshape(-1, m)
        many, own = len(points), w[rows]
        found = likelihood(np.tile(own, (many, 1)), np.tile(held[rows], (many, 1)), stable(free[:, :p]), -stable(free[:, p:]), centred)[0]
        return -found.reshape(many, len(own)) / n[rows]

    starts = np.array(list(product((-0.5, 0.1, 0.6), repeat=m)) if m <= 3 else [[0.1] * m])
    first = np.concatenate([cost(np.broadcast_to(s, (1, k, m)).copy()) for s in starts])
    x, value = starts[first.argmin(0)].astype(float), first.min(0)
    done, shift = x.copy(), 1e-5 * np.eye(m)
    # series that are still searched: their rows, curvatures, slopes and points of the round before, rounds since they got better
    rows, curve, old_slope, old_x, stuck = np.arange(k), np.tile(np.eye(m), (k, 1, 1)), None, None, np.zeros(k, int)
    for _ in range(rounds):
        at = cost(np.concatenate([x[None] + shift[:, None], x[None] - shift[:, None]]), rows)
        slope = ((at[:m] - at[m:]) / 2e-5).T
        if old_slope is not None:
            s, y = x - old_x, slope - old_slope
            sy = (s * y).sum(1)
            good = sy > 1e-14
            rho = np.where(good, 1 / np.where(good, sy, 1), 0)
            left = np.eye(m) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
            new = left @ curve @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
            curve = np.where(good[:, None, None], new, np.eye(m))
        way = -(curve @ slope[:, :, None])[:, :, 0]
        uphill = (way * slope).sum(1) >= 0
        way[uphill] = -slope[uphill]
        tried = x[None] + _STEPS[:, None, None] * np.clip(way, -2, 2)[None]
        at = cost(np.clip(tried, -6, 6), rows)
        best = at.argmin(0)
        better = at.min(0) < value - 1e-13
        old_x, old_slope = x, slope
        x = np.where(better[:, None], np.clip(tried[best, np.arange(len(rows))], -6, 6), x)
        value = np.minimum(value, at.min(0))
        done[rows] = x
        stuck = np.where(better, 0, stuck + 1)
        on = stuck < 2  # twice from the same point, the second time down the slope: the third would be the same
        if not better.any() or not on.any():
            break
        rows, x, value, curve, old_slope, old_x, stuck = rows[on], x[on], value[on], curve[on], old_slope[on], old_x[on], stuck[on]
    return done


def _slices(series: list[np.ndarray], cells: int) -> list[list[int]]:
    """Positions of series of like length; padded, a slice has at most so many values (or is one series)."""
    out: list[list[int]] = []
    for i in sorted(range(len(series)), key=lambda i: -len(series[i])):
        if not out or len(series[out[-1][0]]) * (len(out[-1]) + 1) > cells:
            out.append([])
        out[-1].append(i)
    return out


def _padded(series: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(series[i]) for i in rows)
    w, held = np.zeros((len(rows), longest)), np.zeros((len(rows), longest), bool)
    for k, i in enumerate(rows):
        w[k, : len(series[i])], held[k, : len(series[i])] = series[i], True
    return w, held


def fit_many(series: list[np.ndarray], p: int, d: int, q: int) -> list[tuple[float, list[float], float | None, float | None]]:
    """mean, coefficients (0, autoregressive, moving-average), deviation of the one-step errors and log likelihood of each series.

    A series with at most 2 (p + q) + 2 values after differencing has neither deviation nor likelihood.
    """
    diffs = [np.diff(x, d) if d else x for x in series]
    out: list[tuple[float, list[float], float | None, float | None]] = [(float(x.mean()) if not d and len(x) else 0.0, [0.0] * (1 + p + q), None, None) for x in diffs]
    enough = [i for i, y in enumerate(diffs) if len(y) > 2 * (p + q) + 2]
    for part in _slices([diffs[i] for i in enough], CELLS // 16):
        rows = [enough[j] for j in part]
        w, held = _padded(diffs, rows)
        unit = np.sqrt((w**2).sum(1) / held.sum(1))
        unit = np.where(unit > 0, unit, 1.0)
        free = _search(w / unit[:, None], held, p, q, d == 0) if p + q else np.zeros((len(rows), 0))
        phi, theta = stable(free[:, :p]), -stable(free[:, p:])
        loglik, mean, error = likelihood(w, held, phi, theta, d == 0)
        for k, i in enumerate(rows):
            out[i] = (float(mean[k]), [0.0, *phi[k].tolist(), *theta[k].tolist()], float(error[k, held[k]].std()), float(loglik[k]))
    return out


def errors_many(series: list[np.ndarray], means: list[float], betas: list[np.ndarray], p: int, d: int, q: int) -> list[np.ndarray]:
    """One-step errors of each series under its own model; d fewer than it has values."""
    diffs = [np.diff(x, d) if d else x - m for x, m in zip(series, means, strict=True)]
    out = [np.zeros(0)] * len(series)
    some = [i for i, y in enumerate(diffs) if len(y)]
    for part in _slices([diffs[i] for i in some], CELLS):
        rows = [some[j] for j in part]
        w, held = _padded(diffs, rows)
        beta = np.array([betas[i] for i in rows], float)
        error = innovations(w[:, None, :], beta[:, 1 : 1 + p], beta[:, 1 + p :])[0][:, 0]
        for k, i in enumerate(rows):
            out[i] = error[k, held[k]]
    return out
