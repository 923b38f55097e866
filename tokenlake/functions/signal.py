"""Signal functions that need an FFT or a filter: numpy over Arrow batches."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=8)
def _kernel(up: int, down: int, width: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int]:
    """Windowed-sinc kernels, one per output phase: (up x taps, half the taps before the centre)."""
    base = min(up, down) * rolloff
    half = int(np.ceil(width * down / base))
    taps = np.arange(-half, half + down) / down
    t = np.clip((np.arange(up)[:, None] * -1 / up + taps[None, :]) * base, -width, width)
    window = np.cos(t * np.pi / width / 2) ** 2
    return np.sinc(t) * window * base / down, half


def resampled(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """A 1-D signal at another rate; as it is where the rates agree."""
    samples = np.asarray(samples, dtype=np.float64)
    if samples.ndim != 1:
        raise ValueError(f"expected a 1-D waveform, got {samples.shape}")
    if source == target or not len(samples):
        return samples
    common = gcd(source, target)
    down, up = source // common, target // common
    kernel, half = _kernel(up, down)
    padded = np.pad(samples, (half, half + down))
    windows = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::down]
    out = (windows @ kernel.T).reshape(-1)
    return out[: -(-len(samples) * up // down)]


@lru_cache(maxsize=4)
def _mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), n_mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[:-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(samples: np.ndarray, rate: int = 16_000, n_fft: int = 1024, hop: int = 256, n_mels: int = 80, eps: float = 1e-5) -> np.ndarray:
    x = np.asarray(samples, dtype=np.float64)
    x = np.pad(x, n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.log(np.abs(np.fft.rfft(frames * window)) @ _mel_bank(rate, n_fft, n_mels) + eps)


def mel_distance(reference, estimate) -> float:
    n = min(len(reference), len(estimate))
    if not n:
        raise ValueError("empty signal after alignment")
    return float(np.abs(log_mel(reference[:n]) - log_mel(estimate[:n])).mean())


def resample(column, source: int, target: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: resampled(s, source, target), na_action="ignore")

    return run(column)


def aligned(reference, estimate, source: int = 24_000, target: int = 16_000):
    """(reference, estimate at the reference's rate), both cut to the shorter: what every signal metric takes."""
    other = resample(estimate, source, target)
    n = F.least(F.size(reference), F.size(other))
    return F.slice(F.transform(reference, lambda x: x.cast("double")), F.lit(1), n), F.slice(other, F.lit(1), n)


@F.pandas_udf(T.DoubleType())
def mel_l1(reference: pd.Series, estimate: pd.Series) -> pd.Series:
    return pd.Series([mel_distance(r, e) if r is not None and e is not None else None for r, e in zip(reference, estimate, strict=True)])
