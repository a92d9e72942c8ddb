"""Quality rules: text statistics, hard limits, and an isolation forest over the statistics.

The forest isolates documents by random splits of their statistics; a short
mean path means an anomaly. Its threshold is calibrated on labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_frame, map_batches, stored, text_list

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bad rows among those a forest is grown on: two or three in a tree's sample of 256, as rare as anomalies must be.
BAD_SHARE = 0.01
#: Kolmogorov-Smirnov coefficient of the 0.1 % level: statistics that differ by less do not tell good from bad.
CRITICAL = 1.95
#: Of so many labelled rows, by their keys' hashes, one calibrates the threshold and the others grow the forest.
FOLDS = 3
#: Good rows that the trees draw from: as many as all trees draw together. Leading bits of a feature, and bins of scores, by which all labelled rows are counted.
POOL, BIN_BITS, SCORE_BINS = 25_600, 20, 1 << 16
FEATURES = tuple(f"f{i}" for i in range(6))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")
MARKS, CAPITALS = b"!?.,;:|-\"'()", bytes(range(65, 91))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many positions lie in windows that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = (key ^ wide[j : j + n] * _MIX[j % len(_MIX)]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if any((ids[a + j] != ids[b + j]).any() for j in range(window)):  # two windows with one hash: count by the words themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + window].tolist()), []).append(i)
        hit = np.array([i for v in seen.values() if len(v) > 1 for i in v], np.int64)
    else:
        hit = np.union1d(a, b)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, ...]:
    """STATS of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space alone
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeats = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    repeated = repeated_words(ids) if len(seen) < len(words) else 0
    marks, capitals = (len(raw) - len(raw.translate(None, c)) for c in (MARKS, CAPITALS))
    return len(words), chars, symbols, repeats, repeated, marks, capitals


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that do not grow with the length of a text, from rows of STATS."""
    s = stats.astype(np.float64)
    words = np.maximum(s[:, 0], 1)
    chars = np.maximum(s[:, 1], 1)
    return np.stack([s[:, 1] / words, np.log1p(100 * s[:, 2] / chars), np.log1p(100 * s[:, 3] / words), s[:, 4] / words, np.log1p(20 * s[:, 5] / chars), np.log1p(20 * s[:, 6] / chars)], 1)


@dataclass
class IsolationForest:
    """Trees as flat arrays: split feature (-1: leaf), split value, left child (right is next), and depth plus expected rest at leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    size: int
    columns: tuple[int, ...]
    threshold: float = 1.0

    @staticmethod
    def rest(n: np.ndarray | float):
        """Mean path length of an unsuccessful search among n."""
        n = np.asarray(n, np.float64)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, columns: tuple[int, ...] | None = None) -> IsolationForest:
        """Grows each tree on `sample` rows of x, splitting the given columns only."""
        rng = np.random.default_rng(seed)
        columns = tuple(range(x.shape[1])) if columns is None else columns
        x = x[:, columns]
        size = min(sample, len(x))
        limit = int(np.ceil(np.log2(max(size, 2))))
        nodes = 2 ** (limit + 2)
        feature = np.full((trees, nodes), -1, np.int16)
        value, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        left = np.zeros((trees, nodes), np.int32)
        for t in range(trees):
            free = 1
            todo = [(0, rng.choice(len(x), size, replace=False), 0)]
            while todo:
                node, rows, level = todo.pop()
                part = x[rows]
                low, high = part.min(0), part.max(0)
                usable = np.flatnonzero(high > low)
                if level >= limit or len(rows) <= 1 or not len(usable):
                    depth[t, node] = level + float(cls.rest(len(rows)))
                    continue
                f = int(rng.choice(usable))
                cut = rng.uniform(low[f], high[f])
                goes_left = part[:, f] <= cut
                feature[t, node], value[t, node], left[t, node] = f, cut, free
                todo += [(free, rows[goes_left], level + 1), (free + 1, rows[~goes_left], level + 1)]
                free += 2
        return cls(feature, value, left, depth, size, columns)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies."""
        x = x[:, self.columns]
        total = np.zeros(len(x))
        for f, v, left, depth in zip(self.feature, self.value, self.left, self.depth):
            at = np.zeros(len(x), np.int32)
            while True:
                split = f[at]
                inner = np.flatnonzero(split >= 0)
                if not len(inner):
                    break
                here = at[inner]
                at[inner] = left[here] + (x[inner, split[inner]] > v[here])
            total += depth[at]
        return 2 ** (-total / len(self.feature) / max(float(self.rest(self.size)), 1e-9))

    def calibrate(self, low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float = 50.0) -> float:
        """Sets the threshold with the best share of bad rows rejected, less `cost` times the share of good ones, and returns that.

        Given are bins of scores in ascending order: their least and greatest
        score and how many good and bad rows they hold. The threshold lies half
        way between two scores. If none is worth its cost, or all rows are of
        one class, nothing is rejected.
        """
        self.threshold = 1.0
        if not good.sum() or not bad.sum():
            return 0.0
        worth = 1 - np.cumsum(bad) / bad.sum() - cost * (1 - np.cumsum(good) / good.sum())
        best = int(len(worth) - 1 - worth[::-1].argmax())
        if worth[best] <= 0:
            return 0.0
        self.threshold = float((high[best] + low[best + 1]) / 2)  # the last bin rejects nothing, so it is never best here
        return float(worth[best])


def labelled_rows(df: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """place, text, mark of the documents of at most `most` labelled keys: those whose hash (place) is smallest, so that the same input gives the same ones."""
    marks = key_frame(labels, key, label).toDF("k", "mark").where("mark is not null and k is not null")
    if keep is not None:
        marks = marks.where(keep("k"))
    marks = marks.groupBy("k").agg(F.max("mark").alias("mark"))  # one mark a document
    marks = marks.orderBy(F.xxhash64("k"), "k").limit(most)  # top-k: bounded, so it may be broadcast
    docs = key_frame(df, key, text).toDF("k", "text").where("text is not null")
    return docs.join(F.broadcast(marks), "k").select(F.xxhash64("k").alias("place"), "text", F.col("mark").cast("int").alias("mark"))


def labelled_features(df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """place, good and the features f0, f1, ... of every labelled document that passes the hard limits; texts are not shuffled."""
    marks = key_frame(labels, key, label).toDF("k", "mark").where("mark is not null and k is not null")
    if keep is not None:
        marks = marks.where(keep("k"))
    marks = marks.groupBy("k").agg(F.max("mark").alias("mark"))  # one mark a document
    docs = key_frame(df, key, text).toDF("k", "text").where("text is not null and k is not null")
    kind = docs.schema["k"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([text_stats(t) for t in text_list(batch.column(1))], np.int64).reshape(-1, len(STATS))
        able = np.flatnonzero(~base_failures(stats))
        x = features(stats[able])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(able)), *(pa.array(c) for c in x.T)], ["k", *FEATURES])

    known = map_batches(docs, f"k {kind}, " + ", ".join(f"{c} double" for c in FEATURES), run)
    return known.join(marks, "k").select(F.xxhash64("k").alias("place"), (F.col("mark") == 1).alias("good"), *FEATURES)


def _grown(marked: bool) -> Column:
    """Labelled rows that grow the forest, of one mark; the others calibrate it."""
    return (F.pmod("place", F.lit(FOLDS)) != FOLDS - 1) & (F.col("good") == marked)


def apart(rows: DataFrame) -> list[float]:
    """Largest gap between the distribution functions of good and bad rows in each feature, over all growing rows, counted by the leading BIN_BITS bits of its floats."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([c.to_numpy() for c in batch.columns[1:]], 1).astype(np.float32)
        bins = np.ascontiguousarray(x).view(np.uint32) >> np.uint32(32 - BIN_BITS)  # features are not negative, so their bits are in order
        good = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), x.shape[1])
        column = np.tile(np.arange(x.shape[1], dtype=np.int32), len(x))
        return pa.RecordBatch.from_arrays([pa.array(column), pa.array(bins.ravel().astype(np.int32)), pa.array(good)], ["f", "bin", "good"])

    binned = map_batches(rows.where(_grown(True) | _grown(False)).select("good", *FEATURES), "f int, bin int, good boolean", run)
    found = binned.groupBy("f", "bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("f", "bin").toArrow()
    f, good, bad = (found.column(c).to_numpy() for c in ("f", "good", "bad"))
    out = []
    for j in range(len(FEATURES)):
        n, m = (np.cumsum(c[f == j]) for c in (good, bad))
        out.append(float(np.abs(n / n[-1] - m / m[-1]).max()))
    return out


def scored(rows: DataFrame, forests: list[IsolationForest]) -> list[np.ndarray]:
    """For each forest, of all calibrating rows by their scores' SCORE_BINS: least and greatest score, good rows, bad rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
        score = np.concatenate([forest.score(x) for forest in forests])
        which = np.repeat(np.arange(len(forests), dtype=np.int32), len(x))
        good = np.tile(batch.column(0).to_numpy(zero_copy_only=False), len(forests))
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array((score * SCORE_BINS).astype(np.int32)), pa.array(score), pa.array(good)], ["which", "bin", "score", "good"])

    spare = rows.where(F.pmod("place", F.lit(FOLDS)) == FOLDS - 1).select("good", *FEATURES)
    binned = map_batches(spare, "which int, bin int, score double, good boolean", run).groupBy("which", "bin")
    found = binned.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("which", "bin").toArrow()
    which = found.column("which").to_numpy()
    table = np.stack([found.column(c).to_numpy().astype(np.float64) for c in ("low", "high", "good", "bad")], 1)
    return [table[which == i] for i in range(len(forests))]


def fit_forest(df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", cost: float = 50.0, keep=None) -> IsolationForest:
    """Grows forests on all labelled rows but one in FOLDS, on which it chooses among them and calibrates the threshold.

    Rows that fail the hard limits are left out of both: they are rejected
    anyway. A forest sees good rows with a share BAD_SHARE of bad ones, so that
    bad rows are rare there as anomalies must be; its trees draw a few hundred
    rows each, as the method has it, from up to POOL good rows, as many as all
    trees draw together. Statistics in which good and bad rows differ
    (Kolmogorov-Smirnov, CRITICAL) are taken in order of that difference: the
    first alone, the first two, and so on; of these forests the one whose
    threshold is worth most stays, and of equal ones that with fewest
    statistics. All counts, the differences and the threshold are of every
    labelled row. With labels of one class nothing is an anomaly. keep: a
    condition on keys whose labels are read.
    """
    rows = stored(labelled_features(df, labels, label, key, text, keep), "labelled")
    n, m = rows.agg(F.count_if(_grown(True)), F.count_if(_grown(False))).first()
    best, worth = IsolationForest.fit(np.zeros((2, len(FEATURES))), trees=1), 0.0
    if not n or not m:
        return best

    def first(marked: bool, most: int) -> np.ndarray:
        found = rows.where(_grown(marked)).orderBy("place", *FEATURES).limit(most).toArrow()
        return np.stack([found.column(c).to_numpy() for c in FEATURES], 1)

    far = apart(rows)
    columns = [j for j in np.argsort(far)[::-1].tolist() if far[j] >= CRITICAL * ((n + m) / (n * m)) ** 0.5]
    if not columns:
        return best
    grown = np.concatenate((first(True, POOL), first(False, max(1, int(BAD_SHARE * min(n, POOL))))))
    forests = [IsolationForest.fit(grown, columns=tuple(columns[: j + 1])) for j in range(len(columns))]
    for forest, counts in zip(forests, scored(rows, forests)):
        own = forest.calibrate(*counts.T, cost)
        if own > worth:
            best, worth = forest, own
    return best


def base_failures(stats: np.ndarray) -> np.ndarray:
    """base_failed of each row of STATS."""
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def judged(texts: list[str], forest: IsolationForest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """STATS rows, base_failed, anomaly score, kept."""
    stats = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(STATS))
    failed = base_failures(stats)
    score = forest.score(features(stats))
    return stats, failed, score, ~failed & (score <= forest.threshold)


def apply_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """key, the statistics, base_failed, anomaly and kept for every row.

    Null text counts as empty, which has no words and fails. Repeated rows get
    the same verdict. Without labelled rows only the hard limits reject. An
    empty table gives an empty result; extra columns are not read.
    """
    forest = fit_forest(df, labels, key=key, text=text, **fit)
    frame = key_frame(df, key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, failed, score, kept = judged(text_list(batch.column(1)), forest)
        columns = [batch.column(0), *(pa.array(stats[:, i]) for i in range(len(STATS))), pa.array(failed), pa.array(score), pa.array(kept)]
        return pa.RecordBatch.from_arrays(columns, [key, *STATS, "base_failed", "anomaly", "kept"])

    return map_batches(frame, f"`{key}` {kind}, {', '.join(f'{s} long' for s in STATS)}, base_failed boolean, anomaly double, kept boolean", run)


def keep_by_rules(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None, **fit) -> DataFrame:
    """The rows that the rules keep, with all their columns. The forest is fitted on the labelled rows of known, or of df."""
    forest = fit_forest(df if known is None else known, labels, key=key, text=text, **fit)
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = judged(text_list(batch.column(at)), forest)[3]
        return batch.filter(pa.array(kept))

    return map_batches(df, df.schema, run)
