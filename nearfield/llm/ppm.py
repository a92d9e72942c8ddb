"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts. The longest contexts hold the counts of
the training texts; a shorter context counts a symbol once for each longer
context that has seen it. A symbol is coded in the longest context that has
seen it; each longer one codes an escape, and the symbols it has seen are
excluded below (method D: a symbol seen c times of n has (2c - 1) / 2n, the
escape d / 2n for d distinct symbols). So each run of `order` + 1 symbols has
one probability, and a text's score is a sum over its runs.

Nothing of the trie is gathered in one place. A bucket of consecutive texts
counts its distinct runs and cuts them into cells by a hash of the `shared`
nearest bytes. All buckets' cells of one number meet: there the counts are
summed, that part of the trie is laid out, each run is coded once, and every
cell goes back to its bucket with probabilities in place of counts. There are
more cells for larger inputs, and beyond some size they are told apart by four
bytes rather than three. Only the orders below `shared`, whose size is checked,
are sent to all. Symbols are the 256 bytes, an end (256), and a start that only
contexts have (257).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_CHARS, held_out, input_bytes, key_frame, stored

ORDER = 5
END, START = 256, 257
BITS, MASK = 9, 511
#: Orders below this are sent to all executors, in tables of MOST_SENT rows at most (texts have far fewer).
SHARED, MOST_SENT = 3, 1 << 23
#: Cells of an input of up to CELL_BYTES * CELLS bytes of files; larger ones have more, and from DEEP cells on one more shared order.
CELLS, CELL_BYTES, DEEP, MOST_CELLS = 1024, 32 << 20, 1 << 13, 1 << 18
BUCKET_BYTES = 14 << 20
CHUNK_BYTES = 1 << 20


def runs(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Run of every symbol of all texts as one number, nearest byte first and the symbol last, and symbols in each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    lead = bytes(order)
    flat = np.frombuffer(b"".join(lead + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    room = sizes + order
    first = np.cumsum(room) - room
    flat[(first[:, None] + np.arange(order)).ravel()] = START
    flat[first + room - 1] = END
    key = np.zeros(len(flat), np.int64)
    for j in range(1, order + 1):  # j symbols back
        key[order:] |= flat[order - j : -j] << (BITS * (order - j + 1))
    key |= flat
    keep = np.ones(len(flat), bool)
    keep[(first[:, None] + np.arange(order)).ravel()] = False
    return key[keep], sizes


def _uniq(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with their (weighted) counts."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    if weight is None:
        return x[first], np.diff(np.append(first, len(x)))
    return x[first], np.add.reduceat(weight[order], first) if len(x) else weight


def _lower(keys: np.ndarray) -> np.ndarray:
    """(context, symbol) with the farthest byte of the context dropped."""
    return (keys >> (2 * BITS) << BITS) | (keys & MASK)


class Level:
    """All (context, symbol) counts of one order: sorted keys, and per context total and distinct."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.int64)
        context = keys >> BITS
        first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), context[1:] != context[:-1])))
        self.contexts = context[first]
        self.total = np.add.reduceat(self.counts, first) if len(keys) else self.counts
        self.distinct = np.diff(np.append(first, len(keys)))

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """Number of each context, or -1."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)


def short_levels(keys: np.ndarray, counts: np.ndarray, shared: int = SHARED) -> list[Level]:
    """Orders 0 to shared - 1 from the highest one's (context, symbol) counts."""
    at = np.argsort(keys)
    levels = [Level(keys[at], counts[at])]
    for _ in range(shared - 1):
        levels.insert(0, Level(*_uniq(_lower(levels[0].keys))))
    return levels


def code(keys: np.ndarray, counts: np.ndarray, short: list[Level], order: int = ORDER) -> np.ndarray:
    """log10 probability of each distinct run; counts are its uses in training (0 for a run to be coded only).

    All runs whose contexts share their len(short) nearest bytes must be there;
    short has the orders below that of the whole corpus.
    """
    seen, shared = counts > 0, len(short)
    levels: list[Level | None] = [None] * (order + 1)
    top, count = keys[seen], counts[seen]
    at = np.argsort(top)
    top, count = top[at], count[at]
    levels[order] = Level(top, count)
    for j in range(order - 1, shared - 1, -1):
        top, count = _uniq(_lower(top))
        levels[j] = Level(top, count)
    levels[:shared] = short
    log = np.zeros(len(keys))
    todo = np.arange(len(keys))
    query = keys
    parent = np.full(len(keys), -1)  # the next longer context's number, -1 if it was never seen
    above: Level | None = None
    lost_total = lost_distinct = None
    for j in range(order, -1, -1):
        level = levels[j]
        node = level.context(query >> BITS)
        total = np.where(node >= 0, level.total[node] if len(level.total) else 0, 0)
        distinct = np.where(node >= 0, level.distinct[node] if len(level.distinct) else 0, 0)
        if above is not None and len(above.keys):
            # what the longer context has seen is excluded here: its symbols' counts at this level
            inner = level.count(_lower(above.keys))
            sums = np.add.reduceat(inner, np.searchsorted(above.keys, above.contexts << BITS))
            has = parent >= 0
            total = total - np.where(has, sums[parent], 0)
            distinct = distinct - np.where(has, above.distinct[parent], 0)
        own = level.count(query)
        hit = own > 0
        log[todo[hit]] += np.log10((2 * own[hit] - 1) / (2 * total[hit]))
        miss = ~hit
        escape = miss & (distinct > 0)
        log[todo[escape]] += np.log10(distinct[escape] / (2 * total[escape]))
        todo, query, parent = todo[miss], _lower(query[miss]), node[miss]
        above = level
        if not len(todo):
            break
    if len(todo):  # never seen: even odds among the symbols that order 0 lacks
        log[todo] -= np.log10(max(1, 257 - len(short[0].keys)))
    return log


def _pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """runs() of consecutive texts, about SLICE_CHARS bytes at a time, with the first and last text; a longer text comes in several parts."""
    a = size = 0
    for i, t in enumerate(texts):
        if len(t) > SLICE_CHARS:
            if a < i:
                yield *runs(texts[a:i], order), a, i
            for at in range(0, len(t) + 1, SLICE_CHARS):
                back = min(order, at)
                keys, sizes = runs([t[at - back : at + SLICE_CHARS]], order)
                cut = None if at + SLICE_CHARS > len(t) else -1  # the end comes once
                keys = keys[back:cut]  # the bytes before a part are its context alone
                yield keys, np.array([len(keys)]), i, i + 1
            a, size = i + 1, 0
            continue
        size += len(t)
        if size > SLICE_CHARS or i == len(texts) - 1:
            yield *runs(texts[a : i + 1], order), a, i + 1
            a, size = i + 1, 0


def cells_for(size: int) -> tuple[int, int]:
    """Number of cells, a power of two, and how many nearest bytes tell them apart, for an input of so many bytes of files."""
    cells = CELLS
    while cells * CELL_BYTES < size and cells < MOST_CELLS:
        cells *= 2
    return cells, SHARED + (cells >= DEEP)


def _cells(keys: np.ndarray, order: int, cells: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted runs by cell (then run), and where each cell begins (one more than cells)."""
    near = (keys >> (BITS * (order - shared + 1))).astype(np.uint64)
    cell = ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    at = np.argsort(cell, kind="stable")
    return at, np.searchsorted(cell[at], np.arange(cells + 1))


def _pack(values: np.ndarray) -> bytes:
    """Non-negative int64 as byte planes, high bytes first, so that zeros stand together."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _found(texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]]:
    """Sorted distinct runs of texts; and of each of _pieces: its own distinct runs, the place of each symbol's run among them, sizes, first and last text."""
    parts = []
    for keys, sizes, a, b in _pieces(texts, order):
        own, place = np.unique(keys, return_inverse=True)
        parts.append((own, place.astype(np.int32), sizes, a, b))
    return np.unique(np.concatenate([x[0] for x in parts])) if parts else np.zeros(0, np.int64), parts


class _Bucket:
    """Consecutive texts of one task: their runs and words with uses in training, and the texts themselves, compressed."""

    def __init__(self, number: int, order: int, cells: int, shared: int):
        self.number, self.order, self.cut = number, order, (cells, shared)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.taught, self.words = Counter(), Counter()
        self.ends = self.size = 0

    def add(self, texts: list[bytes], skip: list[bool]) -> None:
        for s in (False, True):
            own = [t for t, k in zip(texts, skip) if k is s]
            for t in own:
                (self.words if s else self.taught).update(t.split())
            for keys, _, _, _ in _pieces(own, self.order):
                new, n = np.unique(keys, return_counts=True)
                self.parts.append((new, 0 * n if s else n))
                # as a binary counter: each run is merged a few times, however many parts come
                while len(self.parts) > 1 and 2 * len(self.parts[-1][0]) >= len(self.parts[-2][0]):
                    self._merge()
        self.ends += skip.count(False)
        self.size += sum(map(len, texts))

    def _merge(self) -> None:
        (x, m), (y, n) = self.parts.pop(), self.parts.pop()
        self.parts.append(_uniq(np.concatenate((x, y)), np.concatenate((m, n))))

    def rows(self) -> Iterator[pa.RecordBatch]:
        while len(self.parts) > 1:
            self._merge()
        runs, uses = self.parts.pop() if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at, first = _cells(runs, self.order, *self.cut)
        runs, uses = runs[at], uses[at]
        cells = np.flatnonzero(first[:-1] < first[1:]).tolist()
        yield _rows(self.number, cell=cells, runs=[_steps(runs[first[c] : first[c + 1]]) for c in cells], uses=[_pack(uses[first[c] : first[c + 1]]) for c in cells])
        for w in self.words:
            self.taught.setdefault(w, 0)
        # no word is empty: it stands for the end of a text
        names, numbers = [b"", *self.taught], [self.ends, *self.taught.values()]
        for a in range(0, len(names), 1 << 18):
            yield _rows(self.number, word=names[a : a + (1 << 18)], n=numbers[a : a + (1 << 18)])


class _Logs(dict):
    """Log probability of each word; any other word has that of the unseen."""

    def __init__(self, unseen: float, known: Iterable[tuple[bytes, float]]):
        super().__init__(known)
        self.unseen = unseen

    def __missing__(self, word: bytes) -> float:
        return self.unseen


_COLUMNS = (("cell", pa.int32()), ("runs", pa.binary()), ("uses", pa.binary()), ("word", pa.binary()), ("n", pa.int64()), ("texts", pa.binary()))


def _rows(bucket: int, **columns) -> pa.RecordBatch:
    """Rows of one bucket; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    arrays = [pa.array(np.full(size, bucket, np.int64)), *(pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _COLUMNS)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *(c for c, _ in _COLUMNS)])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, cut: tuple[int, int] | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, score_per_symbol for every row.

    A-Z count as a-z in both scores. Null text is empty: it has one token, the
    end. Held-out texts teach nothing. Repeated rows each teach and are each
    scored; an empty table gives an empty result; extra columns are not read.
    Without training texts the base score is 0 and every symbol has even odds.
    A bucket is BUCKET_BYTES of texts or one longer text; a task's memory grows
    with that. cut: how many cells, a power of two, and how many nearest bytes
    tell them apart; else chosen by the size of the input (cells_for).
    """
    cells_n, shared = cut or cells_for(input_bytes(df))
    if not max(1, shared) <= order <= 6:
        raise ValueError(f"order must be {shared} to 6")
    if cells_n < 2 or cells_n & (cells_n - 1):
        raise ValueError("the number of cells must be a power of two")
    docs = key_frame(df, key, text).select(F.col(key).alias("k"), held_out(key, 7, 2).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    kind = docs.schema["k"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a bucket holds: its cells, its words, and its texts as compressed chunks."""
        task, number = TaskContext.get().partitionId(), 0
        bucket = _Bucket(task << 20, order, cells_n, shared)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            skip = batch.column(1).to_pylist()
            a = size = 0
            for i, t in enumerate(raw):
                size += len(t)
                if size < CHUNK_BYTES and i < len(raw) - 1:
                    continue
                sink = pa.BufferOutputStream()
                part = batch.slice(a, i + 1 - a)
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield _rows(bucket.number, texts=[zstandard.compress(sink.getvalue(), 3)])
                bucket.add([x.lower() for x in raw[a : i + 1]], skip[a : i + 1])
                a, size = i + 1, 0
                if bucket.size >= BUCKET_BYTES:
                    yield from bucket.rows()
                    number += 1
                    bucket = _Bucket((task << 20) + number, order, cells_n, shared)
        if bucket.size or bucket.ends or bucket.words or bucket.parts:
            yield from bucket.rows()

    held = stored(docs.mapInArrow(count, "bucket long, cell int, runs binary, uses binary, word binary, n long, texts binary"), "counts")
    cells = held.where(F.col("cell").isNotNull()).select("bucket", "cell", "runs", "uses")
    words = held.where(F.col("word").isNotNull()).select("bucket", "word", "n")
    chunks = held.where(F.col("texts").isNotNull()).select("bucket", "texts")

    def short_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct trained runs of order `shared` in each cell."""
        for batch in batches:
            for runs, uses in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.cumsum(_unpack(runs))[_unpack(uses) > 0]
                for _ in range(order - shared):
                    keys = np.unique(_lower(keys))
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], ["run"])

    # (shared - 1 nearest bytes, symbol) with the number of bytes before them that saw it: bounded by the alphabet
    low = F.shiftleft(F.shiftright("run", 2 * BITS), BITS).bitwiseOR(F.col("run").bitwiseAND(F.lit(MASK)))
    pairs = stored(cells.select("runs", "uses").mapInArrow(short_runs, "run long").distinct().groupBy(low.alias("key")).agg(F.count("*").alias("n")), "short")
    if (n := pairs.count()) > MOST_SENT:
        raise ValueError(f"order {shared - 1} has {n} rows, too many to send to all: cut with fewer nearest bytes")
    pairs = pairs.toArrow()
    short = short_levels(pairs.column("key").to_numpy().astype(np.int64), pairs.column("n").to_numpy().astype(np.int64), shared)
    sent = df.sparkSession.sparkContext.broadcast([(x.keys, x.counts) for x in short])

    def coded(group: pa.Table) -> pa.Table:
        """One cell of all buckets: counts summed, runs coded, probabilities back to each bucket."""
        own = [np.cumsum(_unpack(x)) for x in group.column("runs").to_pylist()]
        keys, uses = _uniq(np.concatenate(own), np.concatenate([_unpack(x) for x in group.column("uses").to_pylist()]))
        log = code(keys, uses, [Level(*x) for x in sent.value], order)
        return pa.table([group.column("bucket"), group.column("cell"), pa.array([log[np.searchsorted(keys, x)].astype("<f8").tobytes() for x in own], pa.binary())], ["bucket", "cell", "logs"])

    logs = cells.groupBy("cell").applyInArrow(coded, "bucket long, cell int, logs binary")

    # a word's uses in all buckets; a bucket that alone has a word knows its count already
    every = Window.partitionBy("word")  # a row for each bucket at most
    summed = words.withColumn("total", F.sum("n").over(every)).withColumn("buckets", F.count("*").over(every))
    first = F.row_number().over(Window.partitionBy("word").orderBy("bucket")) == 1
    summed = stored(summed.withColumn("first", first).where(F.col("first") | (F.col("buckets") > 1)), "words")
    tokens, kinds = (int(x or 0) for x in summed.where("first and total > 0").agg(F.sum("total"), F.count("*")).first())
    common = summed.where("buckets > 1")
    scale = tokens + 1 + kinds

    empty = {"cell": "int", "logs": "binary", "word": "binary", "total": "long", "texts": "binary"}
    wide = lambda d, *own: d.select("bucket", *(F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    answers = wide(logs, "cell", "logs").unionByName(wide(common, "word", "total")).unionByName(wide(chunks, "texts"))

    def read(group: pa.Table) -> pa.Table:
        """One bucket: its texts with the probabilities of their runs and the counts of their words."""
        table = pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x)).read_all() for x in group.column("texts").drop_null().to_pylist()])
        texts = [t.lower() for t in table.column("t").to_pylist()]
        table = table.select(["k", "held_out"])
        # each word's count in all training texts, and then its probability
        number: Counter = Counter()
        skip = table.column("held_out").to_pylist()
        for t, s in zip(texts, skip):
            if not s:
                number.update(t.split())
        number[b""] = skip.count(False)
        own = group.select(["word", "total"]).filter(pc.is_valid(group.column("word")))
        number |= dict(zip(own.column("word").to_pylist(), own.column("total").to_pylist()))
        number = +number  # words of held-out texts alone are as good as unseen
        unseen = math.log10(1 / scale)
        logs = _Logs(unseen, zip(number, np.log10((np.fromiter(number.values(), np.float64, len(number)) + 1) / scale).tolist()))
        base, hits, n_tokens = [], [], []
        for t in texts:
            found = list(map(logs.__getitem__, t.split()))
            found.append(logs[b""])
            n_tokens.append(len(found))
            base.append(math.fsum(found))
            hits.append(len(found) - found.count(unseen))
        del number, logs, own
        runs, parts = _found(texts, order)
        at, first = _cells(runs, order, cells_n, shared)
        log = np.zeros(len(runs))
        own = group.select(["cell", "logs"]).filter(pc.is_valid(group.column("cell")))
        del group
        for c, x in zip(own.column("cell").to_pylist(), own.column("logs")):
            log[at[first[c] : first[c + 1]]] = np.frombuffer(x.as_buffer(), "<f8")
        del own, at
        scores = np.zeros(len(texts))
        for known, place, sizes, a, b in parts:
            scores[a:b] += np.add.reduceat(log[np.searchsorted(runs, known)][place], np.cumsum(sizes) - sizes)
        columns = [table.column("k"), table.column("held_out"), *(pa.array(x, pa.int64()) for x in (n_tokens, hits, [tokens] * len(texts))), pa.array(base, pa.float64()), pa.array(scores), pa.array(list(map(len, texts)), pa.int64())]
        return pa.table(columns, ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    out = answers.groupBy("bucket").applyInArrow(read, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return out.withColumn("score_per_symbol", F.col("score") / (F.col("n_bytes") + 1)).withColumnRenamed("k", key)
