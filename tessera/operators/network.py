"""Inference of feed-forward networks: numpy layers over batches (n, channels, rows, cols), run in Arrow batches.

A model is a list of layers with their weights; it is sent to executors once and its size is that of the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

Layer = Callable[[np.ndarray], np.ndarray]


def conv2d(weights: np.ndarray, bias: np.ndarray, stride: int = 1, pad: int = 0) -> Layer:
    """Weights (out, in, rows, cols)."""

    def run(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        win = np.lib.stride_tricks.sliding_window_view(x, weights.shape[2:], axis=(2, 3))[:, :, ::stride, ::stride]
        return np.einsum("nchwij,ocij->nohw", win, weights, optimize=True) + bias[None, :, None, None]

    return run


def _pool(size: int, stride: int, how: str) -> Layer:
    return lambda x: getattr(np.lib.stride_tricks.sliding_window_view(x, (size, size), axis=(2, 3))[:, :, ::stride, ::stride], how)(axis=(4, 5))


def max_pool(size: int, stride: int | None = None) -> Layer:
    return _pool(size, stride or size, "max")


def avg_pool(size: int, stride: int | None = None) -> Layer:
    return _pool(size, stride or size, "mean")


def global_avg_pool() -> Layer:
    return lambda x: x.mean(axis=(2, 3))


def dense(weights: np.ndarray, bias: np.ndarray) -> Layer:
    """Weights (out, in)."""
    return lambda x: x.reshape(len(x), -1) @ weights.T + bias


def batch_norm(mean: np.ndarray, var: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> Layer:
    k = gain / np.sqrt(var + eps)

    def run(x: np.ndarray) -> np.ndarray:
        s = (1, -1) + (1,) * (x.ndim - 2)
        return x * k.reshape(s) + (shift - mean * k).reshape(s)

    return run


def relu(slope: float = 0.0) -> Layer:
    return lambda x: np.where(x > 0, x, slope * x)


def sigmoid() -> Layer:
    return lambda x: 1 / (1 + np.exp(-x))


def tanh() -> Layer:
    return np.tanh


def softmax() -> Layer:
    def run(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return run


def flatten() -> Layer:
    return lambda x: x.reshape(len(x), -1)


def residual(*layers: Layer) -> Layer:
    return lambda x: x + forward(list(layers), x)


def forward(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for f in layers:
        x = f(x)
    return x


def predict(df: DataFrame, layers: list[Layer], shape: tuple[int, int, int], scale: float = 1 / 255, img: str = "img", key: str = "img_id") -> DataFrame:
    """(key, output array<double>) of packed images (channels, rows, cols) scaled by ``scale``."""
    model = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(layers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = cloudpickle.loads(model.value)
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, *shape) * scale
            out = forward(net, x).reshape(n, -1) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], [key, "output"])

    return df.select(key, img).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, output array<double>")
