"""Images as Arrow-batched functions: what column arithmetic can't express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Encodings of raw images: channels, bytes a sample, order that gives RGB.
ENCODINGS = {
    "rgb8": (3, 1, (0, 1, 2)), "bgr8": (3, 1, (2, 1, 0)), "rgba8": (4, 1, (0, 1, 2)), "bgra8": (4, 1, (2, 1, 0)), "mono8": (1, 1, (0, 0, 0)),
    "8UC1": (1, 1, (0, 0, 0)), "8UC3": (3, 1, (2, 1, 0)), "mono16": (1, 2, (0,)), "16UC1": (1, 2, (0,)), "32FC1": (1, 4, (0,)),
}


def raw_pixels(data: bytes, height: int, width: int, step: int, encoding: str, big_endian: bool = False) -> np.ndarray:
    """Rows of a raw image without their padding; the length must fit exactly."""
    channels, size, order = ENCODINGS[encoding]
    if step < width * channels * size or len(data) != step * height:
        raise ValueError("the data do not fill the image")
    rows = np.frombuffer(data, dtype=np.uint8).reshape(height, step)[:, : width * channels * size]
    kind = {1: "u1", 2: "u2", 4: "f4"}[size]
    pixels = np.ascontiguousarray(rows).view((">" if big_endian else "<") + kind).reshape(height, width, channels)
    return pixels[:, :, list(order)] if size == 1 else pixels[:, :, 0].astype(kind)


def resized(image: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    """Scaled to fit, then padded with zeros around the centre."""
    h, w = image.shape[:2]
    scale = min(height / h, width / w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    at = [(np.arange(n) + 0.5) / n * m - 0.5 for n, m in ((nh, h), (nw, w))]
    if nearest:
        ys, xs = (np.clip(np.round(a), 0, m - 1).astype(int) for a, m in zip(at, (h, w), strict=True))
        small = image[ys][:, xs]
    else:
        lo = [np.clip(np.floor(a), 0, m - 1).astype(int) for a, m in zip(at, (h, w), strict=True)]
        hi = [np.minimum(x + 1, m - 1) for x, m in zip(lo, (h, w), strict=True)]
        fy, fx = (np.clip(a - x, 0, 1) for a, x in zip(at, lo, strict=True))
        fy, fx = fy.reshape(-1, 1, *[1] * (image.ndim - 2)), fx.reshape(1, -1, *[1] * (image.ndim - 2))
        f = image.astype(np.float64)
        top, low = (f[y][:, lo[1]] * (1 - fx) + f[y][:, hi[1]] * fx for y in (lo[0], hi[0]))
        small = np.round(top * (1 - fy) + low * fy).astype(image.dtype)
    out = np.zeros((height, width, *image.shape[2:]), dtype=image.dtype)
    y, x = (height - nh) // 2, (width - nw) // 2
    out[y : y + nh, x : x + nw] = small
    return out


def resize_pad(height: int, width: int):
    """Column function of (payload, height, width) of RGB images."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([resized(np.frombuffer(d, dtype=np.uint8).reshape(a, b, 3), height, width).tobytes() for d, a, b in zip(data, h, w, strict=True)])

    return run


def noisy(sigma: float, seed: int):
    """Column function of (payload, key): Gaussian noise, the same for the same key."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for d, k in zip(data, key, strict=True):
            x = np.frombuffer(d, dtype=np.uint8)
            noise = np.random.default_rng([seed, int(k) & 0x7FFFFFFF]).normal(0, sigma, len(x))
            out.append(np.clip(x + noise, 0, 255).astype(np.uint8).tobytes())
        return pd.Series(out)

    return run


def jittered(brightness: float, contrast: float, seed: int):
    """Column function of (payload, key): brightness and contrast drawn for each key."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for d, k in zip(data, key, strict=True):
            x = np.frombuffer(d, dtype=np.uint8).astype(np.float64)
            b, c = 1 + np.random.default_rng([seed, int(k) & 0x7FFFFFFF]).uniform(-1, 1, 2) * (brightness, contrast)
            out.append(np.clip((x * b - x.mean()) * c + x.mean(), 0, 255).astype(np.uint8).tobytes())
        return pd.Series(out)

    return run


def depth_colours(metres: np.ndarray, furthest: float = 15.0) -> np.ndarray:
    """Near is bright: a ramp from black over red and yellow to white; 0 stays black."""
    t = 1 - np.clip(np.nan_to_num(metres, nan=0.0), 0, furthest) / furthest
    rgb = np.stack([np.clip(3 * t, 0, 1), np.clip(3 * t - 1, 0, 1), np.clip(3 * t - 2, 0, 1)], axis=-1)
    rgb[np.nan_to_num(metres, nan=0.0) <= 0] = 0
    return np.round(rgb * 255).astype(np.uint8)
