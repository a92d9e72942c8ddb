"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over chunks of 12 bytes that overlap by
8 and cover the whole document; each filter's largest response anywhere is
kept, and a logistic unit combines them into one probability. A chunk is three
blocks of 4 bytes, so a filter is three small matrix products that are added
with an offset.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, held_out, key_frame, map_batches, ranges
from .rules import labelled_rows

BLOCK, PARTS = 4, 3
PAD = 256
SLICE_BYTES = 1 << 19


@dataclass
class ByteNet:
    """embed (257 x d), filters (PARTS x BLOCK*d x f), bias (f), weight (f), offset."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    @classmethod
    def new(cls, dims: int = 8, filters: int = 24, seed: int = 5) -> ByteNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, dims)).astype(np.float32)
        embed[PAD] = 0
        scale = (1 / (PARTS * BLOCK * dims)) ** 0.5
        return cls(embed, rng.normal(0, scale, (PARTS, BLOCK * dims, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, filters).astype(np.float32), 0.0)

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts, each padded to whole blocks and two more, first block of each text, chunks of each."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        chunks = np.maximum(-(-length // BLOCK), 1)
        blocks = chunks + PARTS - 1
        first = np.cumsum(blocks) - blocks
        codes = np.full(int(blocks.sum()) * BLOCK, PAD, np.int16)
        codes[ranges(first * BLOCK, length)] = np.frombuffer(b"".join(texts), np.uint8)
        return codes, first, chunks

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that begins at each block (the last two have none)."""
        x = self.embed[codes].reshape(len(codes) // BLOCK, -1)
        n = len(x) - PARTS + 1
        y = x[:n] @ self.filters[0]
        for k in range(1, PARTS):
            y += x[k : k + n] @ self.filters[k]
        return y

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, the block where it is, and the codes."""
        codes, first, chunks = self.layout(texts)
        y = self.responses(codes)
        at = ranges(first, chunks)
        starts = np.cumsum(chunks) - chunks
        y = y[at]
        return np.maximum.reduceat(y, starts, axis=0), (y, at, starts, chunks), codes

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; memory is bounded by slices and, in a long text, by pieces."""
        top = np.full((len(texts), self.filters.shape[2]), -np.inf, np.float32)
        batch: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal batch, owner, size
            if batch:
                np.maximum.at(top, np.array(owner), self.pooled(batch)[0])
                batch, owner, size = [], [], 0

        overlap = BLOCK * (PARTS - 1)
        for i, t in enumerate(texts):
            if len(t) > SLICE_BYTES:  # pieces overlap, so that no chunk is lost; pad chunks only at the text's own end
                for a in range(0, len(t), SLICE_BYTES):
                    piece = t[a : a + SLICE_BYTES + overlap]
                    if a + SLICE_BYTES < len(t):
                        codes = np.frombuffer(piece[: len(piece) // BLOCK * BLOCK], np.uint8).astype(np.int16)
                        top[i] = np.maximum(top[i], self.responses(codes).max(0))
                    else:
                        batch, owner = batch + [piece], owner + [i]
                        flush()
                continue
            batch.append(t), owner.append(i)
            size += len(t)
            if size > SLICE_BYTES:
                flush()
        flush()
        z = np.maximum(top + self.bias, 0) @ self.weight + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def train(self, texts: list[bytes], marks: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 9) -> ByteNet:
        """Adam on the log loss, classes weighted to equal halves; the largest responses alone carry gradients."""
        rng = np.random.default_rng(seed)
        share = marks.mean() if len(marks) else 0.0
        if not len(marks) or share in (0.0, 1.0):
            self.weight[:] = 0
            self.offset = 0.0 if not len(marks) else (6.0 if share == 1.0 else -6.0)
            return self
        costs = np.where(marks == 1, 0.5 / share, 0.5 / (1 - share))
        names = ("embed", "filters", "bias", "weight")
        params = {k: getattr(self, k) for k in names} | {"offset": np.zeros(1, np.float32)}
        mean = {k: np.zeros_like(v) for k, v in params.items()}
        spread = {k: np.zeros_like(v) for k, v in params.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                top, (y, at, starts, chunks), codes = self.pooled([texts[i] for i in pick])
                act = np.maximum(top + self.bias, 0)
                z = act @ self.weight + params["offset"][0]
                err = ((1 / (1 + np.exp(-z)) - marks[pick]) * costs[pick] / len(pick)).astype(np.float32)
                d_act = err[:, None] * self.weight[None] * (top + self.bias > 0)
                grad = {"weight": act.T @ err, "offset": np.array([err.sum()], np.float32), "bias": d_act.sum(0)}
                # where each text's largest responses stand
                where = np.stack([at[s + y[s : s + c].argmax(0)] for s, c in zip(starts.tolist(), chunks.tolist())])
                d_filters, d_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
                shape = self.filters.shape
                for k in range(PARTS):
                    own = codes.reshape(-1, BLOCK)[where + k]  # texts x filters x BLOCK
                    x = self.embed[own].reshape(len(pick), shape[2], shape[1])
                    d_filters[k] = np.einsum("tf,tfd->df", d_act, x)
                    d_x = d_act[:, :, None] * self.filters[k].T[None]
                    np.add.at(d_embed, own.ravel(), d_x.reshape(-1, self.embed.shape[1]))
                grad |= {"filters": d_filters + 1e-5 * self.filters, "embed": d_embed}
                step += 1
                lr = rate * (1 - epoch / epochs) + 1e-4
                for k, v in params.items():
                    mean[k] += 0.1 * (grad[k] - mean[k])
                    spread[k] += 0.001 * (grad[k] ** 2 - spread[k])
                    v -= lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
        self.offset = float(params["offset"][0])
        return self


def fit_net(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 2000, longest: int = 20_000, train_keys: Callable | None = None) -> ByteNet:
    """Trains on at most most_labelled labelled texts of keys that train_keys admits.

    A text of over `longest` characters teaches by an excerpt of that length,
    from a place that its key's hash chooses, which bounds what comes to the
    driver.
    """
    found = labelled_rows(df, labels, label, most_labelled, key, text, train_keys)
    room = F.greatest(F.length("text") - longest, F.lit(0)) + 1
    excerpt = F.col("text").substr((F.pmod("place", room.cast("long")) + 1).cast("int"), F.lit(longest))
    sample = found.select("place", excerpt.alias("text"), "mark").orderBy("place", "text", "mark").limit(most_labelled).collect()
    texts = [r["text"].encode("utf-8", "replace") for r in sample]
    return ByteNet.new().train(texts, np.array([r["mark"] for r in sample], np.float32))


def not_held_out(key: str):
    return ~held_out(key, 5, 0)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, train_keys: Callable | None = not_held_out, **fit) -> DataFrame:
    """key, held_out, score, predicted for every row.

    Labels of held-out keys are never read. Null text counts as empty, which is
    scored like any text; equal texts get equal scores. With no labelled rows,
    or labels of one class, every score is the same. An empty table gives an
    empty result; extra columns are not read.
    """
    net = fit_net(df, labels, key, text, train_keys=train_keys, **fit)
    frame = key_frame(df, key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = net.score(bytes_list(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["k", "score", "predicted"])

    scored = map_batches(frame, f"k {kind}, score double, predicted int", run)
    return scored.select(F.col("k").alias(key), held_out("k", 5, 0).alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, train_keys: Callable | None = not_held_out, **fit) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    net = fit_net(df, labels, key, text, train_keys=train_keys, **fit)
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(net.score(bytes_list(batch.column(at))) >= threshold))

    return map_batches(df, df.schema, run)
