"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of every window of w
consecutive hashes the smallest is kept, the rightmost among equals, with its
position. Any passage of w + k - 1 code points that two texts share therefore
shares a kept hash. All texts of a slice are hashed as one flat array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, buckets_for, key_frame, ranges, slices, text_list

GRAM, WINDOW = 16, 35
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAST = np.uint64(0xFFFFFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 21


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of every run of `gram` codes: differences of one running sum, times the power for the position, then mixed."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, n), dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers(_BASE, n - gram + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h >> np.uint64(32)


def _window_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every `window` consecutive keys, by doubling."""
    out, width = keys, 1
    while 2 * width <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < window:
        out = np.minimum(out[: len(out) - (window - width)], out[window - width :])
    return out


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes (uint32) and their positions of all texts, flat, and where each text's begin (one more than texts).

    A text shorter than a gram is one gram (padded with a code that no text
    has); an empty text keeps nothing.
    """
    hashes: list[np.ndarray] = []
    places: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for a, b in slices(texts, PIECE):
        part = texts[a:b]
        length = np.fromiter(map(len, part), np.int64, len(part))
        grams = np.where(length > 0, np.maximum(length - gram + 1, 1), 0)
        room = np.where(length > 0, np.maximum(grams, window) + gram - 1, 0)  # codes each text takes up
        starts = np.concatenate(([0], np.cumsum(room)))
        codes = np.full(int(starts[-1]), 0x110000, np.uint32)
        codes[ranges(starts[:-1], length)] = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            continue
        h = _gram_hashes(codes, gram)
        at = np.arange(len(h), dtype=np.uint64)
        key = (h << np.uint64(32)) | (_LAST - at)  # among equal hashes the rightmost is least
        valid = np.zeros(len(h), bool)
        valid[ranges(starts[:-1], grams)] = True
        key[~valid] = _NONE
        least = _window_min(key, window)
        windows = np.where(grams > 0, np.maximum(grams - window, 0) + 1, 0)
        kept = least[ranges(starts[:-1], windows)]
        owner = np.repeat(np.arange(len(part)), windows)
        fresh = np.ones(len(kept), bool)
        fresh[1:] = kept[1:] != kept[:-1]
        kept, owner = kept[fresh], owner[fresh]
        hashes.append((kept >> np.uint64(32)).astype(np.uint32))
        places.append((_LAST - (kept & _LAST)).astype(np.int64) - starts[owner])
        counts[a:b] = np.bincount(owner, minlength=len(part))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return flat, place, np.concatenate(([0], np.cumsum(counts)))


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """Jaccard likeness of the i-th fingerprint of a and of b; two empty ones are alike."""
    n = len(a[2]) - 1
    tag = lambda x: np.unique((np.repeat(np.arange(n, dtype=np.uint64), np.diff(x[2])) << np.uint64(32)) | x[0].astype(np.uint64))
    count = lambda x: np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)
    left, right = tag(a), tag(b)
    both = count(np.intersect1d(left, right, assume_unique=True))
    either = count(left) + count(right) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def shifted(x: tuple, last: tuple) -> tuple:
    """The fingerprints from the second on, then the only one of last."""
    cut = int(x[2][1])
    return np.concatenate((x[0][cut:], last[0])), np.concatenate((x[1][cut:], last[1])), np.concatenate((x[2][1:] - cut, [x[2][-1] - cut + last[2][-1]]))


def to_hex(x: tuple) -> list[str]:
    """The kept hashes in order of position, 8 hex digits each."""
    text = x[0].astype(">u4").tobytes().hex()
    return [text[8 * a : 8 * b] for a, b in zip(x[2][:-1].tolist(), x[2][1:].tolist())]


def fingerprint_table(df: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """key, fingerprint (hex), positions for every row; null text counts as empty."""
    frame = key_frame(df, key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fingerprints(text_list(batch.column(1)), gram, window)
            positions = pa.ListArray.from_arrays(pa.array(x[2], pa.int32()), pa.array(x[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(x)), positions], [key, "fingerprint", "positions"])

    return frame.mapInArrow(run, f"`{key}` {kind}, fingerprint string, positions array<int>")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to it and to the next text.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, positions. Rows follow each other in ascending key
    (null first), rows of one key by text; the last row's next is the first.
    A single row is its own next. Null text counts as empty; an empty table
    gives an empty result; extra columns are not read.

    Texts move once. Range bounds (one key for each part) come from the keys
    alone; the first row of each part also goes to the part before it, where
    it closes the chain of neighbours.
    """
    frame = key_frame(df, key, text).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    keys = frame.select("k").repartitionByRange(buckets_for(frame, 8), "k").withColumn("part", F.spark_partition_id())
    bounds = keys.groupBy("part").agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("null")).collect()  # one row a part
    edges = sorted(r[1] for r in bounds if r[1] is not None)  # the least key of each part
    has_null = any(r[2] for r in bounds)
    count = max(len(edges), 1)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its part; rows with a part's least key once more to the part before, behind its own rows (turn 1)."""
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid())
            part, head = np.zeros(batch.num_rows, np.int32), ~known
            if known.any():
                values = np.array(ids.drop_null().to_pylist())
                part[known] = np.searchsorted(edges[1:], values, "right")
                head[known] = (values == np.array(edges)[part[known]]) & ~((part[known] == 0) & has_null)
            twice = np.flatnonzero(head)
            out = batch.take(pa.array(np.concatenate((np.arange(batch.num_rows), twice))))
            target = np.concatenate((part, (part[twice] - 1) % count)).astype(np.int32)
            turn = np.concatenate((np.zeros(batch.num_rows, np.int32), np.ones(len(twice), np.int32)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(target), pa.array(turn)], ["k", "t", "part", "turn"])

    dealt = frame.mapInArrow(deal, f"k {kind}, t string, part int, turn int").repartition(count, "part")
    sorted_rows = dealt.withColumn("sha", F.sha2("t", 256)).sortWithinPartitions("part", "turn", F.col("k").asc_nulls_first(), "sha").drop("sha")

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (key, text, part): waits for its next
        closed = -1  # the part whose copied first row has come
        keys: list = []
        texts: list[str] = []
        nexts: list[str] = []

        def out() -> pa.RecordBatch:
            changed = [edited(t, n) for t, n in zip(texts, nexts)]
            own, new, following = (fingerprints(x, gram, window) for x in (texts, changed, nexts))
            positions = pa.ListArray.from_arrays(pa.array(own[2], pa.int32()), pa.array(own[1], pa.int32()))
            columns = [
                pa.array(keys, type=arrow_key[0]),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(to_hex(own)),
                pa.array(to_hex(new)),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, following)),
                positions,
            ]
            keys.clear(), texts.clear(), nexts.clear()
            return pa.RecordBatch.from_arrays(columns, [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])

        arrow_key: list = [None]
        size = 0
        for batch in batches:
            arrow_key[0] = batch.column(0).type
            for k, t, part, turn in zip(*(c.to_pylist() for c in batch.columns)):
                if closed == part:  # further copies of the head
                    continue
                if held is not None:
                    keys.append(held[0]), texts.append(held[1]), nexts.append(t)
                    size += len(t)
                held = None if turn else (k, t)
                if turn:
                    closed = part
                if size > SLICE_CHARS:
                    yield out()
                    size = 0
        if keys:
            yield out()

    return sorted_rows.mapInArrow(chain, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")

