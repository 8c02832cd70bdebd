"""Kernels over sample arrays that recur along time, as vectorised functions: mel spectra and monotonic alignment."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


@lru_cache(maxsize=8)
def mel_filters(n_fft: int, n_mels: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangular filters of equal area on the mel scale, which is linear up to 1 kHz and logarithmic above."""
    step, knee = 200.0 / 3, 1000.0
    slope = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, knee) / knee) / slope)
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp(slope * (m - knee / step)))
    edges = to_hz(np.linspace(to_mel(np.float64(low)), to_mel(np.float64(high)), n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, *, n_fft: int, hop: int, n_mels: int, rate: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Log mel magnitudes (n_mels, frames): reflected at both ends, Hann windows, floor 1e-5."""
    pad = (n_fft - hop) // 2
    x = np.pad(np.asarray(samples, np.float64), pad, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = mel_filters(n_fft, n_mels, rate, low, high or rate / 2) @ np.sqrt(power + 1e-6).T
    return np.log(np.maximum(mel, 1e-5))


def mel_spectrum(samples: Column | str, **shape) -> Column:
    """``log_mel`` of each array, a row a mel band; null for null and for fewer samples than the reflection needs."""

    def run(values: pd.Series) -> pd.Series:
        least = (shape["n_fft"] - shape["hop"]) // 2 + 1
        return pd.Series([None if v is None or len(v) < max(least, shape["hop"]) else log_mel(v, **shape).tolist() for v in values])

    return F.pandas_udf(run, "array<array<double>>")(samples)


def monotonic_path(value: np.ndarray) -> np.ndarray:
    """The token of each frame on the best monotonic path through (tokens, frames): from the first token to the last, each
    frame the token of the one before or the next. Of equal ways the one that stays. At least as many frames as tokens."""
    n, t = value.shape
    best = np.full((n, t), -np.inf)
    best[0] = np.cumsum(value[0])
    for j in range(1, t):
        stay, move = best[1:, j - 1], best[:-1, j - 1]
        best[1:, j] = value[1:, j] + np.maximum(stay, move)
    path, i = np.empty(t, np.int64), n - 1
    for j in range(t - 1, -1, -1):
        path[j] = i
        if i and j and (i == j or best[i, j - 1] < best[i - 1, j - 1]):
            i -= 1
    return path


def alignment(values: Column | str) -> Column:
    """``monotonic_path`` of each array of rows (tokens) of frames; null for null, no rows, or fewer frames than tokens."""

    def run(rows: pd.Series) -> pd.Series:
        good = lambda v: v is not None and len(v) and len(v[0]) >= len(v)
        return pd.Series([monotonic_path(np.array([np.asarray(r) for r in v], np.float64)).tolist() if good(v) else None for v in rows])

    return F.pandas_udf(run, "array<bigint>")(values)


def likelihoods(frames: np.ndarray, means: np.ndarray, log_scales: np.ndarray) -> np.ndarray:
    """Log densities (..., tokens, frames) of frames under each token's normal distributions with independent entries, as four
    products: no difference is made for a pair."""
    inverse = np.exp(-2 * log_scales)
    own = (-0.5 * np.log(2 * np.pi) - log_scales - 0.5 * means**2 * inverse).sum(-1)
    turned = np.swapaxes(frames, -1, -2)
    return -0.5 * inverse @ turned**2 + (means * inverse) @ turned + own[..., None]


def monotonic_paths(value: np.ndarray, tokens: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """``monotonic_path`` of each matrix of (rows, tokens, frames), of which only so many tokens and frames count: the token of
    each frame, -1 beyond the frames. All rows take a step of the programme together."""
    rows, n, t = value.shape
    value = np.where((np.arange(n) < tokens[:, None])[:, :, None], value, 0.0)
    best, moved = np.full((rows, n), -np.inf), np.zeros((t, rows, n), bool)
    best[:, 0] = value[:, 0, 0]
    for j in range(1, t):
        before = np.concatenate([np.full((rows, 1), -np.inf), best[:, :-1]], axis=1)
        moved[j] = before > best  # a way that cannot be stayed on counts as -inf: it is left
        best = value[:, :, j] + np.maximum(best, before)
    path, i, row = np.full((rows, t), -1), tokens - 1, np.arange(rows)
    for j in range(t - 1, -1, -1):
        on = j < frames
        path[on, j] = i[on]
        i = i - (on & moved[j, row, i] if j else on & False)
    return path


#: Cells of the matrices that are worked on together, about.
CELLS = 1 << 21


def gaussian_alignment(frames: Column | str, means: Column | str, log_scales: Column | str) -> Column:
    """(path, durations): the best monotonic path of the frames (rows of entries) through tokens with means and logarithms of
    scales, and the frames of each token. Null for null, no tokens, or fewer frames than tokens. Texts of padded length are
    cut to their own before (``slice``)."""

    def stacked(values: list, n: int, d: int) -> np.ndarray:
        out = np.zeros((len(values), n, d))
        for k, v in enumerate(values):
            out[k, : len(v)] = v
        return out

    def run(z: pd.Series, m: pd.Series, s: pd.Series) -> pd.DataFrame:
        made: list[tuple] = [(None, None)] * len(z)
        dense = [None if any(x is None for x in row) else [np.array([np.asarray(r, np.float64) for r in x]) for x in row] for row in zip(z, m, s, strict=True)]
        good = sorted((k for k, x in enumerate(dense) if x is not None and 0 < len(x[1]) <= len(x[0]) and len(x[1]) == len(x[2])), key=lambda k: (dense[k][0].shape, len(dense[k][1])))
        while good:
            d = dense[good[-1]][0].shape[1]
            part, cells = [], 0
            while good and dense[good[-1]][0].shape[1] == d and (not part or cells < CELLS):
                part.append(good.pop())
                cells += len(dense[part[0]][0]) * max(len(dense[k][1]) for k in part[-1:])
            t, n = np.array([len(dense[k][0]) for k in part]), np.array([len(dense[k][1]) for k in part])
            value = likelihoods(stacked([dense[k][0] for k in part], t.max(), d), stacked([dense[k][1] for k in part], n.max(), d), stacked([dense[k][2] for k in part], n.max(), d))
            for k, path, a, b in zip(part, monotonic_paths(value, n, t), t, n, strict=True):
                made[k] = (path[:a].tolist(), np.bincount(path[:a], minlength=b).tolist())
        return pd.DataFrame(made, columns=["path", "durations"])

    return F.pandas_udf(run, "path array<bigint>, durations array<bigint>")(frames, means, log_scales)
