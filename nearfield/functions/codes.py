"""Compressed vectors: ternary bit planes, sign bits, int8 and float16."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Metric
from .distance import Vector, vector


def words_per_plane(dimensions: int) -> int:
    """64-bit words that hold one bit for each dimension."""
    return (dimensions + 63) >> 6


def bit_plane(values: Column, dimensions: int, holds) -> Column:
    """array<long> with bit d % 64 of word d // 64 set where holds(element d)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(first: int, last: int) -> Column:
        bit = lambda i: F.when(holds(F.get(values, i)), F.call_function("shiftleft", one, i - first)).otherwise(none)
        return F.aggregate(F.transform(F.sequence(F.lit(first), F.lit(last)), bit), none, lambda s, x: s.bitwiseOR(x))

    return F.array(*(word(w, min(dimensions, w + 64) - 1) for w in range(0, dimensions, 64)))


def ternary_encode(v: Vector, dimensions: int) -> Column:
    """struct<pos, neg: array<long>>: the signs of the elements; zero is in neither plane."""
    values = vector(v)
    planes = F.struct(bit_plane(values, dimensions, lambda x: x > 0).alias("pos"), bit_plane(values, dimensions, lambda x: x < 0).alias("neg"))
    return F.when(values.isNotNull(), F.when(F.size(values) == dimensions, planes).otherwise(F.raise_error(F.lit("vector of another dimension"))))


def _overlap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def ternary_dot(a: Column, b: Column) -> Column:
    """Agreeing minus opposing signs of two codes, by population counts; equals the sum of sign products."""
    pos, neg = "pos", "neg"
    return _overlap(a[pos], b[pos]) - _overlap(a[pos], b[neg]) - _overlap(a[neg], b[pos]) + _overlap(a[neg], b[neg])


def approximate_distance(a: Column, b: Column, metric: str | Metric) -> Column:
    """Distance from two ternary codes: -s for ip, 1 - s for cosine, with s the raw count; L2 has none."""
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        raise ValueError("ternary codes do not approximate L2")
    s = ternary_dot(a, b).cast("double")
    return -s if metric is Metric.IP else 1.0 - s


def int8_encode(v: Vector) -> Column:
    """Elements held to [-1, 1], times 127, truncated."""
    return F.transform(vector(v), lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127).cast("tinyint"))


def int8_decode(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def sign_bits(v: Vector, dimensions: int) -> Column:
    """array<long>: one bit for each element, set where it is above zero."""
    values = vector(v)
    return F.when(values.isNotNull(), bit_plane(values, dimensions, lambda x: x > 0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def float16_round_trip(v: Column | str) -> Column:
    """Elements as they come back from 16-bit floats; Spark has no such type."""

    @F.arrow_udf("array<float>")
    def half(values: pa.Array) -> pa.Array:
        flat = values.values.cast(pa.float32())
        rounded = pa.array(flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32), mask=flat.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(values.offsets, rounded, mask=values.is_null() if values.null_count else None)

    return half(v)


def ternary_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes of many vectors (n x dims) as n x words uint64, for the graph kernel."""
    words = words_per_plane(x.shape[1])

    def pack(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 64 * words), np.uint8)
        wide[:, : x.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    return pack(x > 0), pack(x < 0)


def ternary_scores(pos: np.ndarray, neg: np.ndarray, q_pos: np.ndarray, q_neg: np.ndarray) -> np.ndarray:
    count = lambda a, b: np.bitwise_count(a & b).sum(-1, dtype=np.int64)
    return count(pos, q_pos) - count(pos, q_neg) - count(neg, q_pos) + count(neg, q_neg)


class EdgeCodes:
    """Codes of many vectors (n x dims) by which a graph's walk is ordered; all but ternary approximate the metric's distance."""

    def __init__(self, kind: str, x: np.ndarray, metric: Metric):
        self.kind, self.metric, self.dims = kind, metric, x.shape[1]
        norms = np.sqrt((x**2).sum(1, keepdims=True))
        unit = x / np.where(norms == 0, 1, norms) if metric is Metric.COSINE else x
        if kind == "ternary":
            self.planes = ternary_planes(x)
        elif kind == "1bit":
            self.planes = ternary_planes(x)[:1]
        elif kind == "float16":
            self.values, self.scale = unit.astype(np.float16), 1.0
        else:  # int8: elements as a share of the largest, which is kept
            self.scale = float(np.abs(unit).max(initial=0)) / 127 or 1.0
            self.values = np.round(unit / self.scale).astype(np.int8)

    @classmethod
    def of(cls, kind: str, x: np.ndarray, metric: Metric) -> EdgeCodes | None:
        return None if kind == "none" else cls(kind, x, metric)

    def measure(self, query: np.ndarray):
        """A function from rows to their approximate distances to the query."""
        q = np.asarray(query, np.float64)
        if self.kind in ("ternary", "1bit"):
            own = ternary_planes(q[None])
            if self.kind == "1bit":  # the angle, from the share of differing signs
                return lambda rows: 1 - np.cos(np.pi * np.bitwise_count(self.planes[0][rows] ^ own[0]).sum(-1, dtype=np.int64) / self.dims)

            def signs(rows: np.ndarray) -> np.ndarray:
                s = ternary_scores(self.planes[0][rows], self.planes[1][rows], *own).astype(float)
                return -s if self.metric is Metric.IP else 1 - s

            return signs
        if self.metric is Metric.COSINE:
            q = q / (np.sqrt((q**2).sum()) or 1)

        def decoded(rows: np.ndarray) -> np.ndarray:
            x = self.values[rows].astype(np.float64) * self.scale
            if self.metric is Metric.L2:
                return np.sqrt(((x - q) ** 2).sum(1))
            return -(x @ q) if self.metric is Metric.IP else 1 - x @ q

        return decoded
