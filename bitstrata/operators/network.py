"""Scoring patches with a small convolutional network, in numpy, batch by batch.

Three 3x3 convolutions (channels C -> k -> 2k -> 2k, zero padding, ReLU), the mean over all
cells, and a linear layer to 256 symbols.  Weights are a dictionary of arrays, kept as one
compressed file; they are what is broadcast, about 90 kB for the usual k = 16.
Training is not part of the engine: a table of counts (`model`) stands in its place, and
weights trained elsewhere are read from a file.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = 256
LAYERS = ("conv1", "conv2", "conv3")


def shapes(channels: int, base: int = 16) -> dict[str, tuple[int, ...]]:
    return {
        "conv1.weight": (base, channels, 3, 3), "conv1.bias": (base,), "conv2.weight": (2 * base, base, 3, 3), "conv2.bias": (2 * base,),
        "conv3.weight": (2 * base, 2 * base, 3, 3), "conv3.bias": (2 * base,), "head.weight": (SYMBOLS, 2 * base), "head.bias": (SYMBOLS,),
    }


def parameters(channels: int, base: int = 16) -> int:
    return sum(int(np.prod(s)) for s in shapes(channels, base).values())


def random_weights(channels: int, base: int = 16, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(size=s) / np.sqrt(max(1, np.prod(s[1:])))).astype(np.float32) for k, s in shapes(channels, base).items()}


def pack_weights(weights: dict[str, np.ndarray], **settings: str) -> bytes:
    """Weights and settings (feature and target mode, patch shape) as one file."""
    out = io.BytesIO()
    np.savez_compressed(out, **weights, **{f"setting.{k}": np.array(v) for k, v in settings.items()})
    return out.getvalue()


def unpack_weights(raw: bytes) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Settings that a file lacks are strict features and raw targets; shapes that don't fit are an error."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        weights = {k: f[k] for k in f.files if not k.startswith("setting.")}
        settings = {"feature_mode": "strict", "target_mode": "raw"} | {k[8:]: str(f[k]) for k in f.files if k.startswith("setting.")}
    base, channels = weights["conv1.weight"].shape[:2]
    if {k: v.shape for k, v in weights.items()} != shapes(channels, base):
        raise ValueError("the file's arrays are not those of the network")
    return weights, settings


def _convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, channels, height, width) -> the same with the layer's channels."""
    n, c, h, width = x.shape
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    near = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))  # n, c, h, w, 3, 3
    flat = near.transpose(0, 2, 3, 1, 4, 5).reshape(n * h * width, c * 9)
    return np.maximum(flat @ w.reshape(len(w), -1).T + b, 0).reshape(n, h, width, len(w)).transpose(0, 3, 1, 2)


def probabilities(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """(n, 256) of features (n, channels, height, width)."""
    for layer in LAYERS:
        x = _convolve(x, weights[f"{layer}.weight"], weights[f"{layer}.bias"])
    z = x.mean((2, 3)) @ weights["head.weight"].T + weights["head.bias"]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def features(value: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Four channels of patches (n, height, width): value / 255, usable, in context, put in place."""
    return np.stack([value / 255.0, kind > 0, kind == 1, kind == 2], 1).astype(np.float32)


def predict(patches: DataFrame, raw: bytes, shape: tuple[int, int] = (9, 17), batch: int = 1024) -> DataFrame:
    """(p, t, s, probs) of patch rows (p, t, s, value array, kind array)."""
    shared = patches.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = unpack_weights(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                x = features(*(part.column(c).flatten().to_numpy().reshape(-1, *shape) for c in (3, 4)))
                p = probabilities(x, weights)
                off = pa.array(np.arange(len(p) + 1, dtype=np.int32) * SYMBOLS)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(off, pa.array(p.astype(np.float32).ravel()))], names=["p", "t", "s", "probs"])

    return patches.select("p", "t", "s", "value", "kind").mapInArrow(run, "p int, t int, s int, probs array<float>")


def top5(probs: Column) -> Column:
    """Symbols of the five largest probabilities, of equal ones the higher symbol first."""
    ranked = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("k"), (-i).alias("j"))))
    return F.transform(F.slice(ranked, 1, 5), lambda r: -r.j)


def entropy(probs: Column) -> Column:
    """In bits."""
    return F.aggregate(probs, F.lit(0.0).cast("double"), lambda a, x: a - F.when(x > 0, x.cast("double") * F.log2(x.cast("double"))).otherwise(F.lit(0.0)))


def scored(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, top1, top5, bits, perplexity, proxy_bytes) of predictions against labels (p, t, s, symbol); nulls without rows."""
    x = predicted.join(labels, ["p", "t", "s"])
    p = F.greatest(F.element_at("probs", F.col("symbol").cast("int") + 1).cast("double"), F.lit(1e-9))
    best = top5(F.col("probs"))
    x = x.select(p.alias("p"), (F.element_at(best, 1) == F.col("symbol")).cast("int").alias("one"), F.array_contains(best, F.col("symbol")).cast("int").alias("five"))
    s = x.agg(F.count("*").alias("n"), F.avg("one").alias("top1"), F.avg("five").alias("top5"), F.avg(-F.log2("p")).alias("bits"))
    return s.withColumn("perplexity", F.pow(F.lit(2.0), "bits")).withColumn("proxy_bytes", F.ceil(F.col("bits") * F.col("n") / 8))
