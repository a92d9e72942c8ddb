"""Pieces the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _give_back() -> None:
    """Has this process return large arrays to the system once they are freed, as workers are kept for other tasks.

    glibc else raises the size from which it maps memory, up to 32 MB, and keeps
    what lies below; Arrow's own pool keeps pages too. Elsewhere nothing is done.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


_give_back()

#: Characters of text that one vectorised pass holds at a time.
SLICE_CHARS = 1 << 20
#: Bytes of a row group of intermediate tables: a task that reads or writes one holds a row group's texts in the heap.
ROW_GROUP_BYTES = 8 << 20


def model_path(model: str) -> str:
    """The path of a tokenizer's file: as given, or, of a bare name, where this machine has it."""
    return model if "/" in model else public_tokenizers.path(model)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master, where all is one machine, a temporary one if that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("nearfield.sharedDir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("nearfield.sharedDir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/nearfield-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder, in small row groups, and reads it back, which cuts the lineage and runs each Python stage once."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes bytes to a shared file, has every executor fetch it, and returns the name for SparkFiles.get."""
    path = new_path(spark, name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def input_bytes(df: DataFrame) -> int:
    """Size of the input's files as Spark estimates it, 0 where it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size > 1 << 55 else size


def buckets_for(df: DataFrame, mb: int = 16, most: int = 20_000) -> int:
    """How many buckets give each about mb megabytes of the input's files, up to `most`; never under the session's shuffle partitions.

    What works through a bucket does so in slices, so `most` bounds the driver's
    lists and tasks without a task's memory growing.
    """
    size = input_bytes(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-size // (mb << 20))))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most `most` characters together, or one longer text."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def text_list(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def bytes_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def key_frame(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that clashing extra columns do no harm."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    number = 0
    while len(out) < n:
        if (name := f"own_{number}") not in taken:
            out.append(name)
        number += 1
    return out


def map_batches(df: DataFrame, schema: T.StructType | str, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function from one batch to one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := per_batch(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def may_be_among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is in wanted's column of that name, and up to an eighth of the others; df is not shuffled.

    Keys are looked up in a bitmap of their hashes, of 8 to 16 bits a key.
    """
    bits = max(1 << 16, 1 << (8 * max(wanted.count(), 1) - 1).bit_length())
    place = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for p in np.unique(at >> 16).tolist():
                parts.setdefault(p, np.zeros(1 << 16, bool))[at[at >> 16 == p] & 0xFFFF] = True
        for p, hit in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(hit, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    bitmap = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for row in wanted.select(place.alias("place")).repartition(F.shiftright("place", 16)).mapInArrow(marked, "part long, bits binary").toLocalIterator():
        bitmap[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    name = put_file(df.sparkSession, "keys", bitmap.tobytes())
    width = len(df.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.memmap(SparkFiles.get(name), np.uint8, "r")
        for batch in batches:
            at = batch.column(width).to_numpy()
            kept = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            yield kept.select(list(range(width)))

    return df.withColumn("__place", place).mapInArrow(run, df.schema)


def held_out(key: str, folds: int, fold: int):
    """crc32 of the key as text, modulo folds, equals fold; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def segment_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """First position of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed table from distinct keys (not negative) to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.row = np.full(1 << bits, -1, np.int64)
        rows, slot = np.arange(len(keys)), self._slot(keys)
        while len(rows):
            free = self.key[slot] < 0
            self.key[slot[free]], self.row[slot[free]] = keys[rows[free]], rows[free]
            lost = self.row[slot] != rows
            rows, slot = rows[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, or -1."""
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.row[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.key[slot[open_]]
            match = held == keys[open_]
            out[open_[match]] = self.row[slot[open_[match]]]
            open_ = open_[~match & (held >= 0)]
        return out


class Numbered(dict):
    """A number for each key, in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class WordStore:
    """Ids of words that came before, so that each distinct word is encoded once.

    A key that does not begin with a space stands for a word with the
    tokenizer's own space before it; a space and then any text stands for that
    text. When the store holds over `most` words, those that came in one call
    only leave.
    """

    def __init__(self, most: int = 350_000):
        self.most = most
        self.words = Numbered()
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.calls = np.zeros(0, np.int32)

    def _thin(self) -> None:
        keep = np.flatnonzero(self.calls > 1)
        if 2 * len(keep) > self.most:
            keep = np.zeros(0, np.int64)
        names = list(self.words)
        self.words = Numbered({names[i]: n for n, i in enumerate(keep.tolist())})
        sizes = np.diff(self.starts)[keep]
        self.flat = self.flat[ranges(self.starts[keep], sizes)]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.calls = np.ones(len(keep), np.int32)

    def gather(self, texts: Iterable[list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, each given as a list of keys, and where each text's begin."""
        if len(self.words) > self.most:
            self._thin()
        number, before = self.words.__getitem__, len(self.words)
        at = [np.fromiter(map(number, keys), np.int32, len(keys)) for keys in texts]
        counts = np.fromiter(map(len, at), np.int64, len(at))
        at = np.concatenate(at) if at else np.zeros(0, np.int32)
        if len(self.words) > before:
            flat, starts = encode(list(islice(self.words, before, None)))  # a dict keeps the order of insertion
            self.starts = np.concatenate((self.starts, starts[1:] + len(self.flat)))
            self.flat = np.concatenate((self.flat, flat))
            self.calls = np.concatenate((self.calls, np.zeros(len(self.words) - before, np.int32)))
        self.calls += np.bincount(at, minlength=len(self.words)) > 0
        first = self.starts[at]
        sizes = self.starts[at + np.int32(1)] - first
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[ranges(first, sizes)], ends[np.concatenate(([0], np.cumsum(counts)))]


def in_slices(texts: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 4 * SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, flat ids, starts) for consecutive slices of texts."""
    for a, b in slices(texts, most):
        yield a, b, *encode(texts[a:b])
