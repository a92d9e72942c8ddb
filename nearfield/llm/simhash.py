"""SimHash near-duplicate groups by tiled exact comparison.

Distinct fingerprints are dealt to groups by keys that any two linked ones
share; inside a group they are ordered by population count and compared tile
by tile with exclusive-or and bit counts, skipping tile pairs whose counts
differ beyond the radius. A large group is cut into tiles whose pairs are
separate tasks, so no task holds an unbounded group. Each group gives the links
of a spanning forest, not its pairs; connected components join the forests.

Two kinds of keys: `blocks` cut the fingerprint into more blocks of bits than
the radius, and any linked pair agrees in all but `radius` of them: with one
block more than the radius in one, with more blocks in several at once, whose
longer keys make smaller groups (exact for every pair either way). The number
of blocks follows the number of fingerprints. `sketch` uses
bands of minimum hashes of the shingles, for wide fingerprints whose radius is
too large for blocks. With `sketch` the radius only forms clusters: inside each
the documents are linked by the exact Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, free_names, key_frame, map_batches, may_be_among, ranges, segment_starts, stored

SEED = 42
TILE = 1024
#: Fingerprints that a block key should have on average, at most; most blocks beyond the radius.
GROUP, MOST_MORE = 64, 4
FOREST_LINKS = 1 << 18
#: Links of one node that may meet in one task; with more links in all, so many that at most MOST_HUBS nodes have more.
HUB, MOST_HUBS = 256, 20_000
#: Most rows that are sent to all executors to find the documents that go or are compared; more are joined as Spark chooses.
MOST_SENT = 1 << 18
BANDS, BAND_ROWS = 16, 4
#: Most rows and bytes of text in a tile of documents whose shingle sets are compared.
SET_ROWS, SET_BYTES = 256, 8 << 20
#: Most entries of the inverted index that one step counts.
POSTINGS = 1 << 20
_rng = np.random.default_rng(20240229)
_LANES = _rng.integers(0, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 2**63, 64, dtype=np.int64).astype(np.uint64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words, space-joined, A-Z lower-cased; fewer words make one shingle."""
    parts = text.lower().split()  # bytes: ASCII case and white space alone
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    x = (h ^ _SALTS[lane]) * _LANES[lane]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bit_majority(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """lanes 64-bit words; a bit is 1 if it is set in over half the hashes. Lane 0 takes the hashes as they are."""
    out = np.zeros(lanes, np.uint64)
    if not len(h):
        return out
    for lane in range(lanes):
        x = h if lane == 0 else _mixed(h, lane)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 16):  # bounded, however long the text
            ones += np.unpackbits(np.ascontiguousarray(x[a : a + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each band of minimum hashes; texts without shingles share one key of their own."""
    if not len(h):
        return np.arange(bands, dtype=np.int64)
    least = np.array([((h ^ _SALTS[i]) * _LANES[i]).min() for i in range(bands * rows)], np.uint64).reshape(bands, rows)
    key = np.full(bands, 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ least[:, r]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key.astype(np.int64)


def fingerprint_rows(df: DataFrame, key: str, text: str, words: int, lanes: int, sketch: bool) -> DataFrame:
    """k, fp (binary, 8 bytes a lane), and with sketch the text's hashes, the band keys and a digest s of the shingle set, for every row; null text counts as empty.

    With sketch, repeated shingles count once.
    """
    frame = key_frame(df, key, text).toDF("k", "text")
    kind = frame.schema["k"].dataType.simpleString()
    if sketch:
        frame = frame.withColumns(text_hashes("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, bands, digests = [], [], []
        for t in bytes_list(batch.column(1)):
            h = shingle_hashes(t, words)
            if sketch:
                h = np.unique(h)
            fps.append(bit_majority(h, lanes).astype(">u8").tobytes())
            if sketch:
                bands.append(band_keys(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
        columns = [batch.column(0), pa.array(fps, pa.binary())]
        if sketch:
            flat = np.concatenate(bands)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat)))
            columns += [pa.array(digests, pa.binary()), batch.column(2), batch.column(3)]
        return pa.RecordBatch.from_arrays(columns, ["k", "fp", "bands", "s", "h1", "h2"][: len(columns)])

    return map_batches(frame, f"k {kind}, fp binary" + ", bands array<long>, s binary, h1 long, h2 long" * sketch, run)


def text_hashes(text: str) -> dict[str, Column]:
    """Two hashes that, with the key, tell documents apart; null text counts as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {"h1": F.xxhash64(body), "h2": F.xxhash64(F.lit(1), body)}


def block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal blocks, from the low bits up."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def blocks_for(rows: int, radius: int, bits: int = 64) -> int:
    """How many blocks: the fewest, beyond the radius, that leave GROUP of so many fingerprints with one key on average."""
    most = min(radius + MOST_MORE, bits)
    return next((n for n in range(radius + 1, most) if rows >> (bits * (n - radius) // n) <= GROUP), max(most, radius + 1))


def block_keys(number: Column, bits: int, blocks: int, radius: int) -> list[Column]:
    """A key for each choice of blocks - radius blocks: their bits, and the choice's place."""
    bounds = block_bounds(bits, blocks)
    choices = list(combinations(bounds, blocks - radius))
    out = []
    for place, choice in enumerate(choices):
        key, at = F.lit(0).cast("long"), 0
        for shift, width in choice:
            key = key + F.shiftleft(F.shiftrightunsigned(number, shift).bitwiseAND(F.lit((1 << width) - 1)), at)
            at += width
        out.append(F.xxhash64(key, F.lit(place)) if at > 56 else key * len(choices) + place)
    return out


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] in place; a root is its tree's least member."""
    while True:
        ra, rb = parent[a], parent[b]
        low = np.minimum(ra, rb)
        if (ra == rb).all():
            return
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def tile_links(fps: np.ndarray, radius: int, side: np.ndarray | None = None, step: int = 512) -> np.ndarray:
    """Least linked member of each row of fps (n x lanes); with side, only pairs of different sides are compared.

    Rows are ordered by population count; blocks of rows whose counts differ
    beyond the radius are not compared.
    """
    n = len(fps)
    weight = np.bitwise_count(fps).sum(1, dtype=np.int64)
    order = np.argsort(weight, kind="stable")
    x, w = fps[order], weight[order]
    s = side[order] if side is not None else None
    parent = np.arange(n)
    for a in range(0, n, step):
        b = min(n, a + step)
        end = int(np.searchsorted(w, w[b - 1] + radius, "right"))
        for c in range(a, end, step):
            d = min(n, c + step)
            if w[c] - w[b - 1] > radius:
                break
            apart = np.zeros((b - a, d - c), np.uint16)
            for lane in range(fps.shape[1]):
                apart += np.bitwise_count(x[a:b, None, lane] ^ x[None, c:d, lane])
            near = apart <= radius
            if s is not None:
                near &= s[a:b, None] != s[None, c:d]
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            other = i != j
            if other.any():
                _hook(parent, i[other], j[other])
    least = np.full(n, n)  # parent has places in that order, not rows
    np.minimum.at(least, parent, order)  # name each tree by its least row
    out = np.empty(n, np.int64)
    out[order] = least[parent]
    return out


def small_links(fps: np.ndarray, group: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) inside runs of equal group of at most `most` rows, as a forest."""
    parent = np.arange(len(fps))
    for shift in range(1, most):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            break
        apart = np.bitwise_count(fps[same] ^ fps[same + shift]).sum(1, dtype=np.int64)
        near = same[apart <= radius]
        if len(near):
            _hook(parent, near, near + shift)
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return parent[child], child


def _whole_groups(part: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]):
    """mapInArrow body over rows sorted by group (g, t, u): calls part with whole groups and their columns g, t, u."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            g = np.stack([table.column(c).to_numpy() for c in ("g", "t", "u")], 1)
            change = np.flatnonzero((g[1:] != g[:-1]).any(1))
            if not len(change):  # one group so far; tiles bound its size
                continue
            cut = int(change[-1]) + 1
            if (out := part(table.slice(0, cut), g[:cut])) is not None:
                yield out
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if (out := part(table, np.stack([table.column(c).to_numpy() for c in ("g", "t", "u")], 1))) is not None:
                yield out

    return run


def _compare(radius: int, lanes: int):
    """mapInArrow body over rows (g: group, m: side, k, fp) sorted by group: the links of each group's forest."""
    small = 32

    def links(group: np.ndarray, side: np.ndarray, keys: pa.Array, fps: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(starts, len(group)))
        src, dst = [], []
        # pairs inside one tile, in small groups of which many are done at once
        little = np.repeat((sizes <= small) & (sizes > 1) & (side[starts] < 0), sizes)
        rows = np.flatnonzero(little)
        if len(rows):
            a, b = small_links(fps[rows], group[rows], radius, small)
            src.append(rows[a]), dst.append(rows[b])
        for a, n in zip(starts.tolist(), sizes.tolist()):
            if n > 1 and (n > small or side[a] >= 0):
                both = side[a : a + n]
                found = tile_links(fps[a : a + n], radius, both if both[0] >= 0 else None)
                child = np.flatnonzero(found != np.arange(n))
                src.append(found[child] + a), dst.append(child + a)
        if not src or not sum(map(len, src)):
            return None
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in (src, dst)], ["a", "b"])

    def part(table: pa.Table, g: np.ndarray) -> pa.RecordBatch | None:
        number = np.concatenate(([0], np.cumsum((g[1:] != g[:-1]).any(1))))
        raw = b"".join(table.column("fp").to_pylist())
        fps = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, lanes)
        side = table.column("m").to_numpy().copy()
        keys = table.column("k").combine_chunks()
        return links(number, side, keys if isinstance(keys, pa.Array) else pa.concat_arrays(keys.chunks), fps)

    return _whole_groups(part)


def candidate_links(reps: DataFrame, radius: int, lanes: int, sketch: bool, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between representatives (k, fp[, bands]), a forest for each group; blocks: their number, else by the number of rows."""
    if sketch:
        keyed = reps.select("k", "fp", F.explode("bands").alias("g"))
    else:
        number = F.conv(F.hex("fp"), 16, -10).cast("long")  # 8 bytes as a signed long
        blocks = blocks or blocks_for(reps.count(), radius)
        keyed = reps.select("k", "fp", F.explode(F.array(*block_keys(number, 64 * lanes, blocks, radius))).alias("g"))
    keyed = stored(keyed, "keyed")
    # groups over a tile are cut into tiles by hash; each pair of tiles is a group of its own
    large = keyed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("g", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(large, "g", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "g",
        F.least("own", "other").alias("t"),
        F.greatest("own", "other").alias("u"),
        F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("m"),
        "k",
        "fp",
    )
    # a tile with itself (m = -1 throughout) and with each other tile (m tells the two sides apart)
    spread = dealt.repartition("g", "t", "u").sortWithinPartitions("g", "t", "u", "k")  # so that a tree is named by its least key
    kind = reps.schema["k"].dataType.simpleString()
    return spread.mapInArrow(_compare(radius, lanes), f"a {kind}, b {kind}")


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to a spanning forest of each FOREST_LINKS of them, by local union; trees are named by their least id."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            both = pa.chunked_array(table.column("a").chunks + table.column("b").chunks).combine_chunks()
            names, place = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
            parent, n = np.arange(len(names)), table.num_rows
            _hook(parent, place[:n], place[n:])
            child = np.flatnonzero(parent != np.arange(len(names)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(names[parent[child]], both.type), pa.array(names[child], both.type)], ["a", "b"])
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= FOREST_LINKS:
            yield from out()
    yield from out()


def _with_least(edges: DataFrame, by: str, of: str, count: int) -> DataFrame:
    """edges, each with m: the least `of` of all edges with the same `by`.

    Nodes with many edges are few; their least goes to all executors, so their
    edges stay where they are and no task takes all edges of one.
    """
    least = edges.groupBy(by).agg(F.min(of).alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > max(HUB, -(-count // MOST_HUBS))).select(by, "m")  # at most MOST_HUBS
    told = edges.join(F.broadcast(hubs), by, "left")
    rest = told.where("m is null").drop("m").join(least.select(by, "m"), by)
    return told.where("m is not null").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """id, component (its least reachable id) for every id in links (a, b), by alternating large- and small-star steps.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest chain. Nothing but a count and a checksum comes to the driver.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    given = links.where(F.col("a") != F.col("b")).select(low, high)
    kind = given.schema["a"].dataType.simpleString()
    edges = stored(given.repartition("b").mapInArrow(_forests, f"a {kind}, b {kind}"), "links")
    sign = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == sign or not now[0]:
            break
        sign = now
        # large star: each node's larger neighbours go to the least of it and all its neighbours
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b", 2 * now[0]).where(F.col("b") > F.col("a")).select(F.least("a", "m").alias("a"), "b").distinct()
        # small star: each b's smaller neighbours, and b itself, go to the least of them
        large = stored(large, "large")
        least = large.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        small = _with_least(large, "b", "a", now[0]).where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stored(small.unionByName(least).distinct(), "links")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets (sorted, distinct) whose Jaccard similarity is at least `similarity`, as a forest; two empty sets are equal.

    Each step counts one set's common elements with all others by an inverted
    index. The end is reached when all sets not yet counted are in one tree.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    starts = segment_starts(flat[order])
    lengths = np.diff(np.append(starts, len(flat)))
    element = np.empty(len(flat), np.int64)
    element[order] = np.repeat(np.arange(len(starts)), lengths)
    owner = np.repeat(np.arange(n), size)[order]
    first = np.cumsum(size) - size
    parent, left = np.arange(n), np.ones(n, bool)
    while left.any():
        rest = np.flatnonzero(left)
        roots, count = np.unique(parent[rest], return_counts=True)
        if len(roots) == 1:
            break
        i = rest[parent[rest] != roots[count.argmax()]][0]
        left[i] = False
        own = element[first[i] : first[i] + size[i]]
        own = own[lengths[own] > 1]
        common = np.zeros(n, np.int64)
        part = np.cumsum(lengths[own]) // POSTINGS
        for a, b in zip(found := segment_starts(part).tolist(), [*found[1:], len(own)]):
            common += np.bincount(owner[ranges(starts[own[a:b]], lengths[own[a:b]])], minlength=n)
        common[i] = size[i]
        near = np.flatnonzero(common * den >= num * (size[i] + size - common))
        _hook(parent, np.full(len(near), i), near)
    child = np.flatnonzero(parent != np.arange(n))
    return parent[child], child


def sent(df: DataFrame) -> DataFrame:
    """df, marked to be sent to all executors if it has at most MOST_SENT rows (of a few numbers)."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def verified_links(df: DataFrame, clusters: DataFrame, names: DataFrame, key: str, text: str, words: int, similarity: float, rows: int = SET_ROWS) -> DataFrame:
    """Links (a, b) between nodes of one cluster (id, component) whose shingle sets have at least this Jaccard similarity.

    names (node, k, h1, h2) gives a document for each node. A cluster over a
    tile is cut into tiles by hash, and each pair of tiles is a task's group, so
    that every pair of a cluster meets; each group gives the links of a spanning
    forest.
    """
    members = clusters.select(F.col("id").alias("node"), F.col("component").alias("c"))
    members = members.unionByName(clusters.select(F.col("component").alias("node"), F.col("component").alias("c")).distinct())
    mark = F.xxhash64("k", "h1", "h2").alias("mark")
    members = stored(members.join(names.select("node", "k", "h1", "h2"), "node").select("node", "c", F.col("k").alias("mk"), "h1", "h2", mark), "members")
    docs = key_frame(df, key, text).toDF("k", "text").withColumns(text_hashes("text")).select("k", "h1", "h2", mark, "text")
    docs = may_be_among(docs, "mark", members)
    to = sent(members.drop("mark"))
    docs = docs.join(to, (docs["h1"] == to["h1"]) & (docs["h2"] == to["h2"]) & docs["k"].eqNullSafe(to["mk"])).select("node", "c", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.groupBy("node", "c").agg(F.first("text").alias("text"))  # repeated rows count once
    docs = stored(docs.select(F.col("node").alias("k"), F.xxhash64("c").alias("g"), "text"), "clustered")
    tiles = F.ceil(F.greatest(F.count("*") / rows, F.sum(F.octet_length("text")) / SET_BYTES)).cast("int")
    large = docs.groupBy("g").agg(tiles.alias("tiles")).where("tiles > 1")  # at most one row for each tile of the input
    dealt = docs.join(F.broadcast(large), "g", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tiles = 1 OR own <> other")
    dealt = dealt.select("g", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "k", "text")
    spread = dealt.repartition("g", "t", "u").sortWithinPartitions("g", "t", "u", "k")

    def part(table: pa.Table, g: np.ndarray) -> pa.RecordBatch | None:
        keys, texts = (table.column(c).combine_chunks() for c in ("k", "text"))
        starts = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1, [len(g)])).tolist()
        src, dst = [], []
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                i, j = set_links([np.unique(shingle_hashes(t, words)) for t in bytes_list(texts.slice(a, b - a))], similarity)
                src.append(i + a), dst.append(j + a)
        if not sum(map(len, src)):
            return None
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in (src, dst)], ["a", "b"])

    kind = docs.schema["k"].dataType.simpleString()
    return spread.mapInArrow(_whole_groups(part), f"a {kind}, b {kind}")


def _nodes(df: DataFrame, key: str, text: str, words: int, lanes: int, radius: int, sketch: bool, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows; and for each distinct fingerprint (or shingle set) its least key, its node and the least node it reaches (c)."""
    rows = stored(fingerprint_rows(df, key, text, words, lanes, sketch), "fingerprints")
    if sketch:
        first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h1", "h2")).alias("d")
        reps = rows.groupBy("s").agg(first, F.min("fp").alias("fp"), F.min("bands").alias("bands")).select("s", "d.k", "d.h1", "d.h2", "fp", "bands")
    else:
        reps = rows.groupBy("fp").agg(F.min("k").alias("k"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # once written, a node keeps its number
    found = components(candidate_links(reps.drop("k").withColumnRenamed("node", "k"), radius, lanes, sketch))
    if sketch:
        found = components(verified_links(df, found, reps, key, text, words, similarity))
    labels = reps.join(found.withColumnRenamed("id", "node"), "node", "left").select("s" if sketch else "fp", "k", "node", F.coalesce("component", "node").alias("c"))
    return rows, stored(labels, "labels")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """k, fp (binary), component for every row: the least key reachable over links of at most radius bits.

    Rows with equal fingerprints link. Null text and text without a word have
    the zero fingerprint and link like any other. Rows that repeat a key are
    documents of their own: each has the component of its own text. Rows with a
    null key link like others, and their component is null only if no row with
    a key is in it. An empty table gives an empty result; extra columns are not
    read. Copies are never expanded into pairs: one row for each distinct
    fingerprint is compared.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius must be from 0 to 63")
    rows, labels = _nodes(df, key, text, words, 1, radius, False, 0.0)
    lowest = labels.groupBy("c").agg(F.min("k").alias("component"))
    named = stored(labels.join(lowest, "c").select("fp", "component"), "named")
    # copies of one text may hold a third of all rows: Spark splits the large side of this join
    return rows.select("k", "fp").join(named, "fp").select("k", "fp", "component")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 8) -> DataFrame:
    """The rows of df without near copies: of each group the document with the least key stays, with all its columns.

    Links are pairs of documents whose sets of shingles have at least the
    Jaccard similarity given, confirmed exactly; groups are what links reach.
    Fingerprints have 64 * lanes bits. Two texts whose shingle sets have the
    similarity s differ in a share acos(2s / (1 + s)) / pi of the bits on
    average, and at s = 0.8 in at most 3/16 where sets are small (4 of 5
    shingles). The radius is the larger share plus four standard deviations: it
    only leaves out pairs that cannot be near.

    A document is a row, whatever its key: rows of one key with unlike texts
    all stay; of rows with equal key and text one stays, any of them. Null keys
    come last, so a document with a key stays before one without. Among equal
    keys the text with the least hash stays. Texts without a word are copies of
    each other. An empty table gives an empty result; columns of any name pass.
    """
    share = max(float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 3 / 16)
    bits = 64 * lanes
    radius = int(np.ceil(bits * share + 4 * (bits * share * (1 - share)) ** 0.5))
    rows, labels = _nodes(df, key, text, words, lanes, radius, True, similarity)
    # copies of one text may hold a third of all rows, but few are left after the first step of the count
    known = stored(rows.select("k", "h1", "h2", "s").join(labels.select("s", "c"), "s").groupBy("c", "k", "h1", "h2").agg(F.count("*").alias("n")), "known")
    order = F.struct(F.col("k").isNull().alias("none"), "k", "h1", "h2")
    best = known.groupBy("c").agg(F.min(order).alias("best"), F.count("*").alias("documents")).where("documents > 1").select("c", "best")
    lost = stored(known.join(best, "c").where(~order.eqNullSafe(F.col("best"))).select("k", "h1", "h2"), "lost")
    own = free_names(df, 4)
    numbered = df.withColumns(dict(zip(own, text_hashes(text).values())))

    def named(x: DataFrame) -> DataFrame:
        return x.select(F.col("h1").alias(own[2]), F.col("h2").alias(own[3]), F.col("k").alias("k"))

    def same(x: DataFrame) -> Column:
        return (numbered[own[0]] == x[own[2]]) & (numbered[own[1]] == x[own[3]]) & numbered[f"`{key}`"].eqNullSafe(x["k"])

    gone = sent(named(lost))
    numbered = numbered.join(gone, same(gone), "left_anti")
    # of rows that repeat a key and its text, one
    again = known.where("n > 1").select("k", "h1", "h2")
    if again.isEmpty():
        return numbered.select(*(F.col(f"`{c}`") for c in df.columns))
    more = sent(named(again))
    once = numbered.join(more, same(more), "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    every = numbered.join(more, same(more), "left_semi").groupBy(F.col(f"`{key}`"), *own[:2]).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(own[2]))
    return once.unionByName(every.select(*(F.col(own[2])[c].alias(c) for c in df.columns)))
