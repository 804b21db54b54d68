"""Frame features of waveforms: mel-frequency cepstra with their differences, and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mel(hz):
    return 2595.0 * np.log10(1.0 + np.asarray(hz, float) / 700.0)


def mel_bank(mels: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters (mels, bins) up to half the rate."""
    points = 700.0 * (10 ** (np.linspace(_mel(0), _mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))


def cosine_basis(n: int, mels: int) -> np.ndarray:
    """Orthonormal type-2 cosine transform (n, mels)."""
    k, m = np.arange(n)[:, None], np.arange(mels)[None, :]
    d = np.cos(np.pi / mels * (m + 0.5) * k) * np.sqrt(2.0 / mels)
    d[0] /= np.sqrt(2.0)
    return d


def differences(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Slope of a regression over ``reach`` frames on either side, edges repeated."""
    p = np.pad(x, ((0, 0), (reach, reach)), mode="edge")
    n = x.shape[1]
    total = sum(i * (p[:, reach + i : reach + i + n] - p[:, reach - i : reach - i + n]) for i in range(1, reach + 1))
    return total / (2 * sum(i * i for i in range(1, reach + 1)))


def mfcc(wave: np.ndarray, rate: int, coefficients: int = 13, mels: int = 40, n_fft: int = 640) -> np.ndarray:
    """(3 * coefficients, frames): cepstra, first and second differences; frames hop by n_fft / 2."""
    wave = np.asarray(wave, float)
    hop = n_fft // 2
    if len(wave) < 2:
        return np.zeros((3 * coefficients, 0))
    padded = np.pad(wave, n_fft // 2, mode="reflect" if len(wave) > n_fft // 2 else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    level = 10 * np.log10(np.maximum(power @ mel_bank(mels, n_fft, rate).T, 1e-10))
    level = np.maximum(level, level.max() - 80)
    c = cosine_basis(coefficients, mels) @ level.T
    first = differences(c)
    return np.concatenate([c, first, differences(first)])


def resample(wave: np.ndarray, source: int, target: int) -> np.ndarray:
    """Windowed-sinc interpolation to another rate."""
    wave = np.asarray(wave, float)
    if source == target or not len(wave):
        return wave
    n = int(np.ceil(len(wave) * target / source))
    cut = min(1.0, target / source)
    width = int(np.ceil(6 / cut))
    at = np.arange(n) * source / target
    near = np.floor(at).astype(int)[:, None] + np.arange(-width, width + 1)[None, :]
    far = at[:, None] - near
    weight = cut * np.sinc(cut * far) * np.where(np.abs(far) <= width, np.cos(np.pi * far / (2 * width)) ** 2, 0)
    inside = (near >= 0) & (near < len(wave))
    return (wave[np.clip(near, 0, len(wave) - 1)] * weight * inside).sum(1)


def mfcc_frames(wave: Column, rate: int, **more) -> Column:
    """Features of an array column, one inner array a frame."""

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda w: None if w is None else mfcc(w, rate, **more).T.tolist())

    return run(wave)


def resampled(wave: Column, source: Column, target: int = 16_000) -> Column:
    """Waveforms at ``target``, each from its own rate."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if w is None or s is None else resample(w, int(s), target).tolist() for w, s in zip(x, r)], dtype=object)

    return run(wave, source)
