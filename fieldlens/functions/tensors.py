"""Model input tensors out of pixel arrays: resizing as two banded matrices, padding, scaling; numpy in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

PAD = 114.0  # grey of the border round a letterboxed image
_KERNELS: dict[str, tuple[float, Callable]] = {
    "linear": (1.0, lambda x: np.maximum(1 - np.abs(x), 0)),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
}


@functools.lru_cache(256)
def resize_matrix(size: int, target: int, kernel: str = "linear", smooth: bool = False) -> np.ndarray:
    """(target, size) weights of a one-dimensional resize about pixel centres; rows sum to 1 and hold a narrow band.

    Places outside take the edge pixel for ``linear`` without ``smooth``. With ``smooth`` a shrinking resize widens the kernel by the scale.
    """
    reach, weight = _KERNELS[kernel]
    scale = size / target
    centre = (np.arange(target) + 0.5) * scale - 0.5
    if kernel == "linear" and not smooth:
        at = np.clip(centre, 0, size - 1)
        first = np.minimum(np.floor(at).astype(int), max(size - 2, 0))
        out = np.zeros((target, size))
        rows = np.arange(target)
        out[rows, first] = 1 - (at - first)
        out[rows, np.minimum(first + 1, size - 1)] += at - first
        return out
    stretch = max(scale, 1.0) if smooth else 1.0
    out = weight((np.arange(size)[None, :] - centre[:, None]) / stretch)
    out[np.abs(np.arange(size)[None, :] - centre[:, None]) > reach * stretch] = 0
    return out / out.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int, kernel: str = "linear", smooth: bool = False) -> np.ndarray:
    """A (rows, columns, channels) image: rows matrix x image x columns matrix."""
    down, across = resize_matrix(image.shape[0], height, kernel, smooth), resize_matrix(image.shape[1], width, kernel, smooth)
    return np.einsum("yr,rcd,xc->yxd", down, image, across, optimize=True)


def _tensor(make: Callable[[np.ndarray], np.ndarray]):
    """Arrow UDF (pixels row by row with channels together, height, width) to a flat channels-first array; NULL in, NULL out.

    Images of a batch may differ in size; a number of pixels that is no multiple of height x width fails the query.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(pixels: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        out = []
        for p, h, w in zip(pixels, height.to_pylist(), width.to_pylist()):
            if not p.is_valid or h is None or w is None:
                out.append(None)
                continue
            flat = np.asarray(p.values, float)
            if not h * w or len(flat) % (h * w):
                raise ValueError(f"{len(flat)} values are no image of {h} x {w} pixels")
            out.append(make(flat.reshape(h, w, -1)).transpose(2, 0, 1).ravel())
        return pa.array(out, pa.list_(pa.float64()))

    return run


def letterbox_tensor(height: int, width: int, pad: float = PAD, full: float = 255.0, rounded: bool = True):
    """Scaled to fit with its shape kept, centred on a border of ``pad``, divided by ``full``. ``rounded``: pixels are whole numbers before."""

    def make(image: np.ndarray) -> np.ndarray:
        scale = min(width / image.shape[1], height / image.shape[0])
        h, w = int(image.shape[0] * scale), int(image.shape[1] * scale)
        out = np.full((height, width, image.shape[2]), pad)
        top, left = (height - h) // 2, (width - w) // 2
        inner = resized(image, h, w)
        out[top:top + h, left:left + w] = np.rint(inner) if rounded else inner
        return out / full

    return _tensor(make)


def peak_normalised_tensor(side: int, mean: Sequence[float] = (0.5,), std: Sequence[float] = (1.0,), kernel: str = "lanczos"):
    """Resized to a square, divided by its largest value (at least 1e-6), then mean and deviation of each channel."""
    return _tensor(lambda image: _standard(_by_peak(resized(image, side, side, kernel, True)), mean, std))


def square_tensor(side: int, mean: Sequence[float], std: Sequence[float], full: float = 255.0, kernel: str = "lanczos"):
    """Resized to a square whatever its shape, divided by ``full``, then mean and deviation of each channel."""
    return _tensor(lambda image: _standard(resized(image, side, side, kernel, True) / full, mean, std))


def _by_peak(image: np.ndarray) -> np.ndarray:
    return image / max(float(image.max()), 1e-6)


def _standard(image: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    return (image - np.asarray(mean)) / np.asarray(std)
