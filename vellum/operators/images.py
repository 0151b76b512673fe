"""Image operators on the rows of Spark's ``image`` source, in NumPy over Arrow batches.

An image is the source's struct: height, width, nChannels and data, rows from the top, channels in the order blue, green, red(,
alpha). Rows whose image is damaged are dropped by the source. Detectors and engines are parameters; without one an operator
says so when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "height int, width int, nChannels int, data binary"


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """origin, height, width, nChannels, data."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder)
    return rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def luminance(pixels: np.ndarray) -> float:
    """Mean of ITU-R 601 luma; one channel is its own luma."""
    p = pixels[..., :3].astype(np.float64)
    return float((p @ [0.114, 0.587, 0.299]).mean() if pixels.shape[2] >= 3 else p.mean())


def autocontrast(pixels: np.ndarray, cutoff: float = 1.0) -> np.ndarray:
    """Each channel stretched to 0-255, without ``cutoff`` percent at either end; alpha stays."""
    out = pixels.copy()
    for c in range(min(3, pixels.shape[2])):
        hist = np.bincount(pixels[..., c].ravel(), minlength=256).cumsum()
        cut = hist[-1] * cutoff / 100
        lo, hi = int(np.searchsorted(hist, cut, side="right")), int(np.searchsorted(hist, hist[-1] - cut))
        if hi > lo:
            table = np.clip((np.arange(256) - lo) * 255.0 / (hi - lo), 0, 255).astype(np.uint8)
            out[..., c] = table[pixels[..., c]]
    return out


def _blur(p: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    out = p
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, mode="edge")
        out = sum(k * np.take(wide, range(i, i + p.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def enhance(pixels: np.ndarray, cutoff: float = 1.0, contrast: float = 1.35, brightness: float = 1.08, sharpness: float = 1.1) -> np.ndarray:
    """Autocontrast, contrast about the mean luma, brightness, then unsharp masking; alpha stays."""
    colour = slice(0, min(3, pixels.shape[2]))
    out = autocontrast(pixels, float(np.clip(cutoff, 0, 20)))
    p = out[..., colour].astype(np.float64)
    mean = round(luminance(out))
    p = np.clip(mean + (p - mean) * max(0.1, contrast), 0, 255)
    p = np.clip(p * max(0.1, brightness), 0, 255)
    smooth = _blur(p, np.array([1, 2, 1]) / 4)
    out[..., colour] = np.clip(smooth + (p - smooth) * max(0.0, sharpness), 0, 255).round().astype(np.uint8)
    return out


def denoise(pixels: np.ndarray, method: str = "median") -> np.ndarray:
    """A 3 x 3 median, or a Gaussian of radius 1. Gives three channels."""
    p = pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
    if method == "median":
        wide = np.pad(p, ((1, 1), (1, 1), (0, 0)), mode="edge")
        views = [wide[i : i + p.shape[0], j : j + p.shape[1]] for i in range(3) for j in range(3)]
        return np.median(np.stack(views), axis=0).astype(np.uint8)
    kernel = np.exp(-(np.arange(-3, 4) ** 2) / 2)
    return np.clip(_blur(p.astype(np.float64), kernel / kernel.sum()), 0, 255).round().astype(np.uint8)


def watermark_mask(pixels: np.ndarray, threshold: int = 200) -> np.ndarray:
    """Pixels brighter than the threshold, closed by a 3 x 3 square."""
    p = pixels[..., :3].astype(np.float64)
    grey = p @ [0.114, 0.587, 0.299] if pixels.shape[2] >= 3 else p[..., 0]

    def spread(m: np.ndarray, fill: bool, op) -> np.ndarray:
        wide = np.pad(m, 1, constant_values=fill)
        return op.reduce([wide[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)])

    return spread(spread(grey > threshold, False, np.logical_or), True, np.logical_and)


def rotate(pixels: np.ndarray, angle: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    return np.ascontiguousarray(np.rot90(pixels, k=-(angle // 90) % 4))


def transform_images(images: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``images`` with each image changed, and luminance_before and luminance_after."""

    @F.pandas_udf(f"{IMAGE}, luminance_before double, luminance_after double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            rows = []
            for h, w, c, data in zip(*batch, strict=True):
                old = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
                new = change(old)
                rows.append((*new.shape, new.tobytes(), round(luminance(old), 4), round(luminance(new), 4)))
            yield pd.DataFrame(rows, columns=["height", "width", "nChannels", "data", "luminance_before", "luminance_after"])

    keep = [c for c in images.columns if c not in ("height", "width", "nChannels", "data")]
    return images.withColumn("_i", run("height", "width", "nChannels", "data")).select(*keep, "_i.*")


def orient(images: DataFrame, detector: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``images`` turned upright by a detector's angle; 0 without one."""
    return transform_images(images, lambda p: rotate(p, detector(p) if detector else 0))


def recognize(images: DataFrame, engine: Callable[[np.ndarray], list[tuple[str, float]]], key: str = "origin") -> DataFrame:
    """key, line, text, confidence: what an engine reads in each image; corpus.ocr_summary joins the lines."""

    @F.pandas_udf("array<struct<text:string,confidence:double>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in parts:
            yield pd.Series([[{"text": t, "confidence": s} for t, s in engine(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c))] for h, w, c, d in zip(*batch, strict=True)])

    found = images.select(key, F.posexplode(run("height", "width", "nChannels", "data")).alias("line", "r"))
    return found.select(key, "line", "r.text", "r.confidence")
