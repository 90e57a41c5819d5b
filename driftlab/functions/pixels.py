"""Pixel operations on images held as height x width x 3 arrays, for Arrow UDFs: the degradations themselves.

Images are decoded elsewhere (Spark's image source, or a decoder of the user's). JPEG is simulated by the standard
luminance quantization of 8x8 cosine transforms, so results are close to an encoder's, not bit-identical with one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The luminance table of the JPEG standard (annex K).
QUANTIZATION = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
], float).reshape(8, 8)
LUMA = np.array([0.299, 0.587, 0.114])
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, math.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * math.pi / 16))


def jpeg(x: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((QUANTIZATION * scale + 50) / 100), 1, 255)
    h, w, c = x.shape
    padded = np.pad(x.astype(float) - 128, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, c).transpose(0, 2, 4, 1, 3)
    coefficients = np.round((_DCT @ blocks @ _DCT.T) / table) * table
    out = (_DCT.T @ coefficients @ _DCT).transpose(0, 3, 1, 4, 2).reshape(padded.shape)[:h, :w]
    return np.clip(np.round(out + 128), 0, 255).astype(np.uint8)


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = x.astype(float)
    for axis in (0, 1):
        pad = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="reflect" if out.shape[axis] > r else "edge")
        out = sum(w * np.take(pad, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with samples at pixel centres."""
    out = x.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        f = (at - lo).reshape([-1 if a == axis else 1 for a in range(3)])
        out = np.take(out, lo, axis) * (1 - f) + np.take(out, np.minimum(lo + 1, n - 1), axis) * f
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def resize_round_trip(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = x.shape[:2]
    return resized(resized(x, max(1, round(h * scale)), max(1, round(w * scale))), h, w)


def add_noise(x: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    noisy = x / 255 + np.random.default_rng(seed).normal(0, sigma, x.shape)
    return np.round(np.clip(noisy, 0, 1) * 255).astype(np.uint8)


def center_crop(x: np.ndarray, fraction: float) -> np.ndarray:
    h, w = x.shape[:2]
    a, b = max(1, round(h * fraction)), max(1, round(w * fraction))
    top, left = (h - a) // 2, (w - b) // 2
    return x[top : top + a, left : left + b]


def color_jitter(x: np.ndarray, strength: float, seed: int) -> np.ndarray:
    """Brightness, contrast and saturation, each times a number drawn from 1 - strength to 1 + strength."""
    b, c, s = np.random.default_rng(seed).uniform(1 - strength, 1 + strength, 3)
    out = np.clip(x * b, 0, 255)
    out = np.clip((out - (out @ LUMA).mean()) * c + (out @ LUMA).mean(), 0, 255)
    grey = (out @ LUMA)[..., None]
    return np.round(np.clip((out - grey) * s + grey, 0, 255)).astype(np.uint8)


def fit_square(x: np.ndarray, size: int) -> np.ndarray:
    """Shortest side to size, then the centre."""
    h, w = x.shape[:2]
    k = size / min(h, w)
    y = resized(x, max(size, round(h * k)), max(size, round(w * k)))
    top, left = (y.shape[0] - size) // 2, (y.shape[1] - size) // 2
    return y[top : top + size, left : left + size]


def long_side_cap(x: np.ndarray, most: int) -> np.ndarray:
    h, w = x.shape[:2]
    k = most / max(h, w)
    return x if k >= 1 else resized(x, max(1, round(h * k)), max(1, round(w * k)))


def normalize(x: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    return (x / 255 - np.array(mean)) / np.array(std)


def apply_steps(x: np.ndarray, steps: Sequence[tuple[str, float | int | None]], seed: int, jitter: float = 0.2, crop: float = 0.8) -> np.ndarray:
    """The steps of a view in their order; what draws numbers draws them from the seed of the path and view."""
    for op, p in steps:
        x = {
            "jpeg": lambda: jpeg(x, p), "blur": lambda: blur(x, p), "resize": lambda: resize_round_trip(x, p), "noise": lambda: add_noise(x, p, seed),
            "jitter": lambda: color_jitter(x, jitter, seed), "crop80": lambda: center_crop(x, crop),
        }[op]()
    return x


def pixel_view(image: Column, height: Column, width: Column, seed: Column, steps: Sequence[tuple[str, float | int | None]]) -> Column:
    """A view of raw RGB bytes as struct<height, width, data>; null where the bytes don't make an image of that size."""

    def run(data: pd.Series, h: pd.Series, w: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, a, b, k in zip(data, h, w, s):
            if raw is None or pd.isna(a) or pd.isna(b) or len(raw) != a * b * 3 or not raw:
                rows.append((None, None, None))
                continue
            y = apply_steps(np.frombuffer(raw, np.uint8).reshape(int(a), int(b), 3), steps, int(k))
            rows.append((y.shape[0], y.shape[1], y.tobytes()))
        return pd.DataFrame(rows, columns=["height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})

    return F.pandas_udf(run, "height int, width int, data binary")(image, height, width, seed)


def saturation(x: np.ndarray, size: int = 64) -> float:
    y = resized(x, size, size).astype(float) / 255
    top, low = y.max(axis=2), y.min(axis=2)
    return float(((top - low) / (top + 1e-6)).mean())


def image_facts(images: DataFrame) -> DataFrame:
    """images (path, height, width, data) with mean saturation, bytes a pixel, and a 16 x 16 grey vector for probes; null for what is no image."""

    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, a, b in zip(data, h, w):
            if raw is None or pd.isna(a) or pd.isna(b) or len(raw) != a * b * 3 or not raw:
                rows.append((None, None))
                continue
            x = np.frombuffer(raw, np.uint8).reshape(int(a), int(b), 3)
            rows.append((saturation(x), (resized(x, 16, 16) @ LUMA / 255).ravel().tolist()))
        return pd.DataFrame(rows, columns=["saturation", "grey"])

    return images.withColumn("facts", F.pandas_udf(run, "saturation double, grey array<double>")("data", "height", "width")).select("*", "facts.*").drop("facts")
