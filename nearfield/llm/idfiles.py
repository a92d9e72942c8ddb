"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

A block holds the ids of consecutive documents. Its header lists the ids by
falling frequency in the block; each id is written as its place in that list,
in 1 to 4 bytes, with the lengths of four ids in one control byte. Blocks carry
all that is needed to read them, so they are written and read independently.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WordStore, buckets_for, key_frame, model_path, ranges, stored, text_list

BLOCK_IDS = 1 << 22
SLICE = 6 << 20
JOINT = 40
#: Most blocks whose starts are sent to all executors; those of more are joined as Spark chooses.
MOST_SENT = 1 << 20
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)  # control byte -> four lengths
#: Texts with a space at an end or beside white space, with rare white space, or empty.
_ODD = "^$|^ | $|  | [\\n\\t\\r]|[\\n\\t\\r] |[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Header (distinct ids by falling frequency, then value), control bytes, data bytes."""
    if not len(ids):
        return b"", b"", b""
    uses = np.bincount(ids)
    distinct = np.flatnonzero(uses)
    distinct = distinct[np.lexsort((distinct, -uses[distinct]))]
    place = np.zeros(len(uses), np.int32)
    place[distinct] = np.arange(len(distinct))
    value = place[ids]
    extra = (value > 0xFF).view(np.uint8)
    for b in (16, 24):
        if len(distinct) > 1 << b:
            extra = extra + (value >= 1 << b)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ids) + 1)
    data = np.zeros(int(ends[-1]), np.uint8)
    at = ends - extra - 1
    data[at] = value & 0xFF
    for b in range(1, int(extra.max()) + 1):
        has = np.flatnonzero(extra >= b)
        data[at[has] + b] = (value[has] >> (8 * b)) & 0xFF
    return distinct.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ids(header: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ids of a block: lengths by table lookup, bytes gathered, places turned back into ids."""
    if not count:
        return np.zeros(0, np.uint32)
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    if int(at[-1] + size[-1]) != len(raw):
        raise ValueError("data bytes do not match the control bytes")
    value = raw[at].astype(np.int64)
    for b in range(1, int(size.max())):
        has = np.flatnonzero(size > b)
        value[has] |= raw[at[has] + b].astype(np.int64) << (8 * b)
    return np.frombuffer(header, "<u4")[value]


class WordCachedTokenizer:
    """The tokenizers library behind a store of words.

    A single space between two characters that are no white space always begins
    a new word of the byte-level pre-tokenizer, so texts are cut there and each
    distinct word is encoded once.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(self.library.get_vocab_size())])
        self.store = WordStore()

    def _library(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the store's keys, and where each one's begin.

        Words with a space before are encoded JOINT at a time as one text: each
        of them begins with the only id that begins with a space.
        """
        bare = np.fromiter((k[:1] != " " for k in keys), bool, len(keys))
        joint, alone = np.flatnonzero(bare), [np.flatnonzero(~bare)]
        order, ids, sizes = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        groups = [joint[i : i + JOINT] for i in range(0, len(joint), JOINT)]
        texts = [" " + " ".join([keys[i] for i in g.tolist()]) for g in groups]
        for group, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            found = np.array(e.ids, np.int32)
            cuts = np.flatnonzero(self.spaced[found])
            if len(cuts) == len(group):
                order.append(group), ids.append(found), sizes.append(np.diff(np.append(cuts, len(found))))
            else:
                alone.append(group)
        rest = np.concatenate(alone)
        for i, e in zip(rest.tolist(), self.library.encode_batch_fast([keys[i][1:] if keys[i][:1] == " " else " " + keys[i] for i in rest.tolist()], add_special_tokens=False)):
            order.append(np.array([i])), ids.append(np.array(e.ids, np.int32)), sizes.append(np.array([len(e.ids)]))
        size, flat = np.zeros(len(keys), np.int64), np.concatenate(ids)
        got, at = np.concatenate(sizes), np.zeros(len(keys), np.int64)
        if order:
            place = np.concatenate(order)
            size[place], at[place] = got, np.cumsum(got) - got
        return flat[ranges(at, size)], np.concatenate(([0], np.cumsum(size)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin (one more than texts)."""
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD).to_numpy(zero_copy_only=False).tolist()
        return self.store.gather(map(self._keys, texts, odd), self._library)

    @staticmethod
    def _keys(text: str, odd: bool) -> list[str]:
        """The text's words as the store's keys; the first has no space before it."""
        if odd:
            return [" " * (1 + (i > 0)) + w for i, w in enumerate(_BOUNDARY.split(text))] if text else []
        words = text.split(" ")
        words[0] = " " + words[0]
        return words


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer(model: str) -> WordCachedTokenizer:
    if model not in _tokenizers:
        _tokenizers[model] = WordCachedTokenizer(model_path(model))
    return _tokenizers[model]


def write_ids(df: DataFrame, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """Writes the ids of all texts as blocks in ascending key and returns the table of blocks as read from its files.

    Rows of one key follow each other by text, so repeated rows are all
    written; null keys come first; null text is empty. A block has part and
    block (its place), keys, lengths, and the three streams. Files are cut
    where range partitions are, so parts are in the order of keys. An empty
    table gives no block; extra columns are not read.
    """
    frame = key_frame(df, key, text).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    rows = frame.repartitionByRange(buckets_for(frame, 8), "k").sortWithinPartitions("k", "t")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            all_keys, all_lengths, all_ids = pa.concat_arrays(keys), np.concatenate(lengths), np.concatenate(ids)
            header, control, data = pack_ids(all_ids)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            keys.clear(), lengths.clear(), ids.clear()
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), one(all_keys), one(pa.array(all_lengths, pa.int64())), *(pa.array([x], pa.binary()) for x in (header, control, data)), pa.array([len(all_ids)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "keys", "lengths", "header", "control", "data", "n_ids"])

        for batch in batches:
            texts = text_list(batch.column(1))
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE):
                    chars += len(texts[to])
                    to += 1
                flat, starts = encode(texts[at:to])
                if end_id is not None:
                    flat = np.insert(flat, starts[1:], end_id)
                    starts = starts + np.arange(len(starts))
                keys.append(batch.column(0).slice(at, to - at)), lengths.append(np.diff(starts)), ids.append(flat)
                held += len(flat)
                at = to
                if held >= BLOCK_IDS:
                    yield out()
                    held, number = 0, number + 1
        if keys:
            yield out()

    return stored(rows.mapInArrow(blocks, f"part int, block int, keys array<{kind}>, lengths array<long>, header binary, control binary, data binary, n_ids long"), "ids")


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block, start: how many ids all blocks before hold; sums over parts (a row each), then inside parts."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = totals.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))


def read_ids(blocks: DataFrame, key: str = "doc_id", per_document: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """key, start, n_tokens and ids (or per_document(ids) as `value`) of every document in the blocks.

    Each written row gives one row, repeated ones too; no blocks give none.
    """
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    starts = block_starts(blocks)
    if blocks.count() <= MOST_SENT:
        starts = F.broadcast(starts)
    located = blocks.join(starts, ["part", "block"]).select("start", "keys", "lengths", "header", "control", "data", "n_ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, keys, lengths, header, control, data, n = (batch.column(c)[i] for c in range(7))
                ids = unpack_ids(header.as_py(), control.as_py(), data.as_py(), n.as_py())
                sizes = np.asarray(lengths.values.to_numpy(zero_copy_only=False))
                ends = np.cumsum(sizes)
                begins = ends - sizes
                if per_document:
                    last = pa.array([per_document(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(begins + start.as_py(), pa.int64()), pa.array(sizes, pa.int64()), last], [key, "start", "n_tokens", "value" if per_document else "ids"])

    tail = "value long" if per_document else "ids array<int>"
    return located.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, {tail}")


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
