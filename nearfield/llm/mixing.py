"""Mixing sources to target weights by balanced sampling (cube method).

Each source's target is a share of the total by weight, capped at twice the
source's size. A document of a source is taken floor(rate) times for sure and
once more with the fractional probability; the cube method fixes those draws:
it moves the vector of probabilities through the null space of the balancing
constraints (tokens and documents of the source) until at most as many
fractions remain as there are constraints. Blocks of documents fly in
parallel; what they leave over flies again in ever fewer blocks. A few
documents of each source are held back from flight; they land together with the
last fractions, all subsets of a fitting count compared, where the tokens come
nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, key_frame, stored

WEIGHTS = (3, 1, 2)
#: SPARE + 2 fractions land at most: their subsets are compared at once.
BLOCK, SPARE = 4096, 14
#: Most sources, whose sizes come to the driver and whose targets go to all executors.
MOST_SOURCES = 1 << 20
_NEAR = 1e-9


def targets(sizes: dict, weights: list[float], share: float = 1.5, cap: float = 2.0) -> dict:
    """Target of each source: weighted share of the total, at most cap times its size, the excess reshared by weight."""
    total = share * sum(sizes.values())
    names = list(sizes)
    weight = dict(zip(names, weights))
    out: dict = {}
    open_ = [s for s in names]
    left = total
    while open_:
        all_weight = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / all_weight > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / all_weight for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for the constraints sum(size) and count: at most two fractions remain.

    Always three units at hand: the null vector of the two constraints is their
    cross product. A step goes as far as a unit reaches 0 or 1, up or down with
    the odds that keep every probability in expectation.
    """
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    hand: list[int] = []
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = round(p[i])
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)  # equal sizes: the count is the only constraint
        up = min((1 - p[j]) / v if v > 0 else p[j] / -v for j, v in zip(hand, u) if v)
        down = min(p[j] / v if v > 0 else (1 - p[j]) / -v for j, v in zip(hand, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        for j, v in zip(hand, u):
            x = p[j] + step * v
            if _NEAR < x < 1 - _NEAR:
                p[j] = x
                rest.append(j)
            else:
                p[j] = float(round(x))
        hand = rest
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray, most: int = SPARE + 2) -> np.ndarray:
    """Landing: the 0/1 design of the last fractions whose sizes come nearest to what they stand for.

    All subsets are compared. One with about as many documents as the fractions
    stand for (less than two off) is taken if it misses their sizes by no more
    than half the smallest, else the nearest of all. Of more than `most` fractions the smallest are compared so; the others, from the
    largest down, are taken while that brings the sum nearer.
    """
    p = prob.copy()
    rest = np.flatnonzero((p > _NEAR) & (p < 1 - _NEAR))
    rest = rest[np.argsort(-size[rest], kind="stable")]
    goal, count = float((size[rest] * p[rest]).sum()), float(p[rest].sum())
    for i in rest[: max(0, len(rest) - most)].tolist():
        p[i] = float(goal >= size[i] / 2)
        goal, count = goal - p[i] * size[i], count - p[i]
    rest = rest[max(0, len(rest) - most) :]
    sums, counts = np.zeros(1), np.zeros(1)
    for x in size[rest].tolist():  # the subset of number c has the i-th where bit i of c is set
        sums, counts = np.concatenate((sums, sums + x)), np.concatenate((counts, counts + 1))
    gap = np.abs(sums - goal)
    fit = np.where(np.abs(counts - count) < 2, gap, np.inf)
    if len(rest) and fit.min() <= size[rest].min() / 2:
        gap = fit
    pick = int(np.lexsort((np.abs(counts - count), gap))[0])
    p[rest] = pick >> np.arange(len(rest)) & 1
    return np.round(p)


def _flight(seed: int, level: int, last: bool):
    """One block's flight, and its landing where no other block is left."""

    def flight(block: pa.Table) -> pa.Table:
        block = block.take(pa.array(np.lexsort((block.column("size").to_numpy(), block.column("order").to_numpy()))))
        number = block.column("block")[0].as_py()
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{level}|{number}|{block.column('s')[0].as_py()}", seed))
        p, size = block.column("p").to_numpy().copy(), block.column("size").to_numpy().astype(float)
        # a few of the first block's documents do not fly: the landing closes the last gap with them
        spare = np.zeros(len(p), bool)
        if number == 0:
            spare[np.flatnonzero((p > _NEAR) & (p < 1 - _NEAR))[:SPARE]] = True
        p[~spare] = fly(p[~spare], size[~spare], rng)
        at = block.schema.get_field_index("p")
        return block.set_column(at, "p", pa.array(land(p, size) if last else p)).drop_columns(["block"])

    return flight


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (s, k, size, part, row) with `same`: a number of its own for each row among those of equal source, key and size.

    Such rows may be a third of all; they are numbered inside parts, after the
    rows of the parts before, and only they are.
    """
    own = ["s", "k", "size"]
    parts = stored(rows.groupBy(*own, "part").agg(F.count("*").alias("n")), "parts")
    repeated = stored(parts.groupBy(*own).agg(F.sum("n").alias("n")).where("n > 1").select(*own), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("same", F.lit(0).cast("long"))

    def equal(a: DataFrame, b: DataFrame):
        return a["s"].eqNullSafe(b["s"]) & a["k"].eqNullSafe(b["k"]) & (a["size"] == b["size"])

    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part at most
    first = parts.select(*own, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).where("first > 0")
    inside = Window.partitionBy(*own, "part").orderBy("row")
    several = rows.join(repeated, equal(rows, repeated), "left_semi").withColumn("inside", F.row_number().over(inside) - 1)
    numbered = several.join(first, equal(several, first) & (several["part"] == first["part"]), "left")
    numbered = numbered.select(*(several[c] for c in rows.columns), (F.coalesce(first["first"], F.lit(0)) + several["inside"]).cast("long").alias("same"))
    return rows.join(repeated, equal(rows, repeated), "left_anti").withColumn("same", F.lit(0).cast("long")).unionByName(numbered)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 17, row: str | None = None) -> DataFrame:
    """key, size, source, source_size, target, copies, taken for every row; size counts words, taken is copies times size.

    Sources are ordered by code point, null last, and take the weights in turn.
    Null text has no words, and a document without words is taken by the same
    draws though it adds nothing. Blocks and draws depend on keys, sizes and
    the seed alone, so reruns agree; rows with equal key, size and source are
    interchangeable, and each draws for itself. An empty table gives an empty
    result; extra columns are not read, but for `row`, which is passed on (it
    tells rows apart). More than MOST_SOURCES sources are refused; one source
    may hold most rows, as blocks of at most about `block` rows fly by
    themselves. A source of SPARE + 2 documents or fewer lands without flight.
    """
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    given = (F.col(f"`{row}`") if row else F.lit(0)).cast("long")
    frame = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), words.alias("size"), given.alias("given"))
    rows = stored(frame.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sizes")
    rows = _numbered(rows if row is None else rows.withColumn("row", F.col("given"))).drop("part", "given")
    spark = df.sparkSession
    per_source = rows.groupBy("s").agg(F.sum("size"), F.count("*"))
    sums = [(r[0], r[1], r[2]) for r in per_source.limit(MOST_SOURCES + 1).collect()]
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8") if isinstance(r[0] or "", str) else r[0]))  # bytes of UTF-8 sort by code point
    sizes = {r[0]: r[1] for r in sums}
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    plan = [(s, n, goal[s], max(1, -(-c // block)), min(cap, goal[s] / n) if n else 0.0) for s, n, c in sums]
    kind = frame.schema["s"].dataType.simpleString()
    table = spark.createDataFrame(plan, f"s {kind}, source_size long, target double, blocks long, rate double")
    rows = rows.join(F.broadcast(table), rows["s"].eqNullSafe(table["s"])).drop(table["s"])  # a row for each source
    rows = rows.withColumn("sure", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("sure"))
    salt = F.xxhash64(F.lit(seed), "k", "size", "same")
    rows = rows.withColumn("block", F.pmod(salt, F.col("blocks"))).withColumn("order", salt)
    schema = "k {0}, s {1}, size long, p double, source_size long, target double, sure long, `order` long, row long".format(frame.schema["k"].dataType.simpleString(), kind)
    state = rows.select("k", "s", "size", "p", "source_size", "target", "sure", "order", "row", "block")
    done, level, most = [], 0, 0
    while True:
        flown = stored(state.groupBy("s", "block").applyInArrow(_flight(seed, level, most == 1), schema), "flown")
        fraction = (F.col("p") > _NEAR) & (F.col("p") < 1 - _NEAR)
        done.append(flown.where(~fraction))
        left = flown.where(fraction)
        counts = left.groupBy("s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if not counts:
            break
        # at most two are left of each block; they fly on in blocks as large as before, and land when one block holds all
        most = -(-counts // block)
        level += 1
        state = left.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "order"), F.lit(most)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("sure") + F.round("p").cast("long")).alias("copies")
    passed = [F.col("row").alias(row)] if row else []
    return out.select(F.col("k").alias(key), "size", F.col("s").alias(source), "source_size", "target", copies, *passed).withColumn("taken", F.col("copies") * F.col("size"))


def take(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of df, with all their columns, as often as the mix takes each: not at all, once or twice.

    Rows are told apart by a number that is stored with them, so repeated and
    null keys do no harm; columns of any name pass. Otherwise as mix.
    """
    number, copies, again, to = free_names(df, 4)
    rows = stored(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    taken = mix(rows, key, text, source, row=number, **how).where("copies > 0").select(F.col(number).alias(to), F.col("copies").alias(copies))
    # numbers are all different, so the join is even; only the short side is held in memory, and texts are not sorted
    out = rows.join(taken.hint("shuffle_hash"), rows[number] == taken[to]).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))
