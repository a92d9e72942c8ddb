import hashlib
import itertools
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import mixing, queries, sharding, simhash, urls, winnow


def gram_hash(codes):
    """A polynomial in the inverse of the golden-ratio multiplier over code points plus one, mixed, upper half."""
    word = (1 << 64) - 1
    inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    h = sum((c + 1) * pow(inverse, j, 1 << 64) for j, c in enumerate(codes)) & word
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & word
    h = (h ^ h >> 29) * 0xA0761D6478BD642F & word
    return h >> 32


def edited(text, following):
    return text[: len(text) - len(text) // 4] + following[: len(text) // 4]


def kept_grams(text, k, w, hashes=None):
    """Winnowing by the book: positions of the rightmost least gram of each window."""
    if not text:
        return set()
    n = max(1, len(text) - k + 1)
    codes = [*map(ord, text), *[0x110000] * (k - len(text))]
    h = [gram_hash(codes[i : i + k]) for i in range(n)]
    if hashes is not None:
        hashes += h
    return {min(range(a, min(a + w, n)), key=lambda i: (h[i], -i)) for a in range(max(1, n - w + 1))}


def test_winnowing():
    rng = np.random.default_rng(0)
    texts = ["", "ab", "abcdefgh", "a" * 300, *("".join(rng.choice(list("abé "), int(rng.integers(17, 400)))) for _ in range(40))]
    h, p, s = winnow.fingerprints(texts)
    for i, t in enumerate(texts):
        hashes = []
        want = sorted(kept_grams(t, winnow.GRAM, winnow.WINDOW, hashes))
        assert p[s[i] : s[i + 1]].tolist() == want and h[s[i] : s[i + 1]].tolist() == [hashes[j] for j in want]
    passage = "".join(rng.choice(list("abcdefgh "), winnow.GRAM + winnow.WINDOW - 1))
    a, b = "q" * 77 + passage + "z" * 50, "y" * 13 + passage + "x" * 99
    h, p, s = winnow.fingerprints([a, b])
    assert set(h[: s[1]]) & set(h[s[1] :])


def test_op3_on_whole_table(spark, sf, documents):
    docs = [(r["doc_id"], r["text"] or "") for r in documents.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in queries.op3_winnow(spark, sf).collect()}
    assert len(got) == len(docs)
    prints = {}
    for (i, t), (_, following) in zip(docs, docs[1:] + docs[:1]):
        r, new = got[i], edited(t, following)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (winnow.fingerprints([x]) for x in (t, new, following))
        assert [r["fingerprint"], r["edited_fingerprint"]] == [winnow.to_hex(a)[0], winnow.to_hex(b)[0]]
        like = lambda x, y: len(set(x[0]) & set(y[0])) / len(set(x[0]) | set(y[0])) if len(x[0]) or len(y[0]) else 1.0
        assert np.allclose([r["near_edited"], r["near_next"]], [like(a, b), like(a, c)])
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_op3_odd_rows(odd):
    got = winnow.neighbours(odd).collect()
    assert len(got) == odd.count()
    one = winnow.neighbours(odd.where("doc_id = 4").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert winnow.neighbours(odd.limit(0)).count() == 0
    assert winnow.fingerprint_table(odd).count() == odd.count()


def test_urls_against_plain_rules(spark, sf):
    want = duckdb.connect().execute(queries.OP4_SQL.replace("FROM pages", f"FROM read_parquet('{sf}/pages.parquet')")).fetchall()
    assert sorted(map(str, map(tuple, queries.op4_urls(spark, sf).collect()))) == sorted(map(str, want))


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://NET/"), (5, "http://net"), (6, "x://a.EXAMPLE.net/en/1?q#f"), (7, "x://anet/"), (8, "x://m.org/fr/"), (9, "x://org?/fr/"), (10, "x://a..net/x"), (10, "x://a..net/x"), (None, "http://b.net/y")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    got = [tuple(r) for r in urls.filter_urls(spark, pages, queries.URL_RULES).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("net", "/", "net/", "block") and by[5] == ("net", "", None, "allow")
    assert by[6] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[7][2] is None
    assert by[8][2:] == ("org/fr/", "allow") and by[9] == ("org", "", None, "allow") and by[10][2] == "net/"
    assert urls.filter_urls(spark, pages, []).where("verdict != 'allow'").count() == 0
    with pytest.raises(ValueError):
        urls.pack([urls.Rule("block", "a"), urls.Rule("allow", "a")])


def test_long_hosts_cost_no_more(spark):
    """Probes are bounded by the rules; long hosts match as short ones do."""
    table = urls.DigestTable(urls.pack(queries.URL_RULES + [urls.Rule("block", "a.b.c.d.example", "/x")]))
    deep = "a." * 100_000
    hosts = [deep + "net", deep + "example.net", deep + "xnet", deep + "a.b.c.d.example", "x" * 200_000 + ".org", "." * 50_000 + "net", deep, "example.net"]
    paths = ["/1", "/en/" + "y" * 100_000, "/", "/x", "/fr/", "/", "/", "/de/"]
    began = time.process_time()
    got = [table.string(i).decode() if i >= 0 else None for i in table.match(hosts, paths)]
    assert got == ["net/", "example.net/en/", None, "a.b.c.d.example/x", "org/fr/", "net/", None, "net/"]
    assert time.process_time() - began < 0.5
    pages = spark.createDataFrame([(1, "http://" + deep + "EXAMPLE.net/en/?q")], "page_id long, url string")
    assert urls.filter_urls(spark, pages, queries.URL_RULES).first()["rule"] == "example.net/en/"


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda _: 7)
    table = urls.DigestTable(urls.pack([urls.Rule("block", "net", "/"), urls.Rule("allow", "org", "/fr/")]))
    assert [table.string(i) if i >= 0 else None for i in table.match(["a.net", "b.org", "c.com"], ["/x", "/fr/1", "/"])] == [b"net/", b"org/fr/", None]


def plain_fingerprint(text, words):
    parts = text.encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def plain_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_op5_on_whole_table(spark, sf, documents):
    docs = documents.orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"] or "", 4) for r in docs]
    want = sorted((r["doc_id"], f"{p:016x}", docs[g]["doc_id"]) for r, p, g in zip(docs, prints, plain_groups(prints, 4)))
    assert sorted(map(tuple, queries.op5_simhash(spark, sf).collect())) == want


@pytest.mark.parametrize("tile, blocks", [(4, None), (1024, 5), (1024, 6), (8, 7), (1024, 8)])
def test_links_against_brute_force(spark, tile, blocks):
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 2**63, 12)
    values = []
    for s in seeds.tolist():
        for _ in range(40):
            v = s
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    reps = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "k long, fp binary")
    links = simhash.candidate_links(reps, 4, 1, False, tile, blocks)
    found = {r["id"]: r["component"] for r in simhash.components(links).collect()}
    assert [found.get(i, i) for i in range(len(values))] == plain_groups(values, 4)


def test_blocks_follow_the_rows():
    assert [simhash.blocks_for(n, 4) for n in (0, 200_000, 10_000_000, 10**9, 10**11)] == [5, 5, 6, 7, 8]
    assert simhash.blocks_for(10**9, 0) <= 4 and simhash.blocks_for(10**9, 63) == 64


def test_hubs_are_dealt_out(spark, monkeypatch):
    """A star, chains through its arms, and cells of a grid: the same components however few links a task takes."""
    monkeypatch.setattr(simhash, "HUB", 3)
    monkeypatch.setattr(simhash, "FOREST_LINKS", 7)
    links = [(500, i) for i in range(501, 560)] + [(i, i + 100) for i in range(501, 530)] + [(700, 3), (3, 9), (10, 11)] + [(1000 + 10 * i + j, 1000 + 10 * (i + 1) + j) for i in range(8) for j in range(3)] + [(1000, 1001)]
    got = {r["id"]: r["component"] for r in simhash.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    nodes = sorted({x for link in links for x in link})
    place = {x: i for i, x in enumerate(nodes)}
    root = list(range(len(nodes)))
    for a, b in links:
        low, high = sorted((root[place[a]], root[place[b]]))
        root = [low if r == high else r for r in root]
    assert {x: got.get(x, x) for x in nodes} == {x: nodes[root[place[x]]] for x in nodes}


def test_op5_with_repeated_and_null_keys(spark):
    a, b = "one text of some words that is here", "and quite another text which says something else"
    rows = [(5, a), (9, a), (3, b), (5, b), (None, a), (None, "alone of its kind, this text has no key at all"), (5, a)]
    got = [(r["k"], r["component"]) for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (9, 5), (3, 3), (5, 3), (None, 5), (None, None), (5, 5)], key=str)


def test_one_row_of_each_text_stays(spark):
    """Repeated keys, null keys and repeated rows: no text is lost and none stays twice; columns of any name pass."""
    texts = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "ABCD"}
    rows = [(5, "A"), (9, "A"), (3, "B"), (5, "B"), (None, "A"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (7, "D"), (8, None), (8, None), (2, "")]
    rows = [(i, texts.get(c, c), n, "x", 1.0, 2) for n, (i, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, h1 string, `own_0` double, `a.b` int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "-")[0]) for r in got) == [("2", "-"), ("3", "B"), ("5", "A"), ("7", "D"), ("None", "C")]
    assert all(tuple(r) in rows for r in got)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_near_copies_at_the_limit_are_found(spark):
    """Pairs of a similarity from 0.80 to 0.82: recall of 0.9 or more (all of them, for these)."""
    rng = np.random.default_rng(21)
    pairs = [jaccard_pair(rng, size, int(np.ceil(size * 8 / 9)) + more) for size in (45, 90, 180, 450) for more in (0, 1) for _ in range(10)]
    texts = [t for pair in pairs for t in pair]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, len(texts), 2))


def test_tiles_skip_nothing():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2, (300, 64)).cumsum(0) % 2
    x = np.packbits(fps.astype(np.uint8), axis=1).view(">u8").astype(np.uint64)
    assert simhash.tile_links(x, 24, step=16).tolist() == plain_groups([int(v) for v in x[:, 0]], 24)


def test_a_tile_names_trees_by_their_own_rows():
    """The two lightest of 40 rows link to each other alone, though they come first in the order by bits."""
    x = np.random.default_rng(4).integers(0, 2**63, 40).astype(np.uint64)
    x[30], x[31] = 0, 1
    assert simhash.tile_links(x[:, None], 4).tolist() == plain_groups([int(v) for v in x], 4)


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(500, 499), (7, 7), (1000, 900)]
    got = {r["id"]: r["component"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[500] == 499 and got[1000] == 900


def test_op5_odd_rows(odd):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    by = {r["k"]: r["component"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[5] == 4 and by[None] is None
    assert simhash.near_groups(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_groups(odd, radius=64)


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 6))
    rows, n = [], 0
    for g in range(30):
        text = [word() for _ in range(150)]
        for c in range(4):  # two words changed: at most 10 of 146 shingles
            new = list(text)
            for at in rng.choice(150, 2 if c else 0, replace=False).tolist():
                new[at] = word()
            rows.append((n, " ".join(new), "src", g))
            n += 1
    df = spark.createDataFrame(rows + [(None, "no key", "src", -1)], "doc_id long, text string, source string, g int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [4 * g for g in range(30)]
    assert kept.where("doc_id is null").count() == 1


def test_op7_shards(spark, sf, documents, odd):
    for df in (documents, odd):
        got = sharding.byte_shards(df, 8).collect()
        assert len(got) == df.count() and {r["law"] for r in got} == {"bytes"}
        texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in df.collect()))
        rows = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in rows] == texts
        total, largest = sum(t[3] for t in texts), max(t[3] for t in texts)
        for s in {r["shard"] for r in rows}:
            own = [r for r in rows if r["shard"] == s]
            assert [r["slot"] for r in own] == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / 8) <= largest
    assert sharding.byte_shards(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_shards(odd, 0)


def test_op9_mix(spark, sf, documents, odd):
    for df in (documents, odd):
        a, b = mixing.mix(df).toPandas(), mixing.mix(df.repartition(3)).toPandas()
        order = ["doc_id", "size", "taken"]
        assert a.sort_values(order)[order].reset_index(drop=True).equals(b.sort_values(order)[order].reset_index(drop=True))
        assert len(a) == df.count() and (a.taken <= 2 * a["size"]).all()
        for _, own in a.groupby(a.source.fillna("~null")):
            assert own["size"].sum() == own.source_size.iloc[0]
            assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    assert mixing.mix(odd.limit(0)).count() == 0


def plain_words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_op9_comes_near_its_targets(spark, sf, size):
    """Within half a percent of the target or half the smallest document, but for sources of a dozen documents or fewer."""
    folder = sf.replace("0.001", size)
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sizes = {r["doc_id"]: plain_words(r["text"]) for r in rows}
    got = queries.op9_mix(spark, folder).toPandas()
    assert dict(zip(got.doc_id, got["size"])) == sizes
    want = mixing.targets({s: sum(sizes[r["doc_id"]] for r in rows if r["source"] == s) for s in sorted({r["source"] for r in rows})}, [(3, 1, 2)[i % 3] for i in range(len({r["source"] for r in rows}))])
    for s, own in got.groupby("source"):
        assert np.isclose(own.target.iloc[0], want[s]) and ((own.taken == 0) | (own["size"] <= own.taken)).all()
        if len(own) > 12:
            assert abs(own.taken.sum() - want[s]) <= max(0.005 * want[s], own["size"].min() / 2), s


def test_landing_against_all_subsets():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 9, 12):
        size, prob = rng.integers(0, 400, n).astype(float), rng.uniform(0.05, 0.95, n)
        goal, count = size @ prob, prob.sum()
        subsets = [np.array(x, float) for x in itertools.product((0, 1), repeat=n)]
        fit = min((abs(x @ size - goal) for x in subsets if abs(x.sum() - count) < 2), default=np.inf)
        best = fit if fit <= size.min() / 2 else min(abs(x @ size - goal) for x in subsets)
        assert np.isclose(abs(mixing.land(prob, size) @ size - goal), best)
    many = mixing.land(np.full(300, 0.5), rng.integers(1, 900, 300).astype(float))
    assert set(many) <= {0.0, 1.0}


def test_mix_of_repeated_and_null_keys(spark):
    """Each row draws for itself, whatever its key, and equal rows do not fall into one block."""
    rows = [(None, "some words that are repeated here", "a")] * 500 + [(7, "five words are in here", "a")] * 300 + [(i, "w " * (i % 9), "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (mixing.mix(x, block=64).toPandas() for x in (df, df.repartition(7)))
    assert len(a) == len(rows) and a["size"].sum() == sum(plain_words(t) for _, t, _ in rows)
    order = ["source", "size", "taken"]
    assert a.sort_values(order)[order].reset_index(drop=True).equals(b.sort_values(order)[order].reset_index(drop=True))
    for _, own in a.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    frame = df.withColumn("part", F.monotonically_increasing_id()).withColumn("row", F.lit(1))
    same = mixing._numbered(frame.select(F.col("source").alias("s"), F.col("doc_id").alias("k"), F.length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    numbers = same.groupBy("s", "k", "size").agg(F.sort_array(F.collect_list("same")).alias("n")).collect()
    assert all(r["n"] == list(range(len(r["n"]))) for r in numbers)


def test_taken_rows(spark, odd):
    """As many rows as copies, of the right texts; names that the stage uses inside, and repeated and null keys, do no harm."""
    rows = [(i % 3 if i % 4 else None, f"text number {i} " * (i + 1), f"s{i % 2}", i, "x", 3, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, copies string, `copy` int, `own_0` double")
    out = mixing.take(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    want = mixing.mix(df.withColumn("r", F.col("k")), row="r").where("copies > 0").collect()
    assert set(got) <= set(rows) and len(got) == sum(r["copies"] for r in want)
    assert max(got.count(x) for x in set(got)) <= 2
    sizes = {s: sum(plain_words(r[1]) for r in got if r[2] == s) for s in ("s0", "s1")}
    for r in want:
        assert abs(sizes[r["source"]] - r["target"]) <= 0.05 * r["target"]
    assert mixing.take(odd.limit(0)).count() == 0 and mixing.take(odd).columns == odd.columns


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, None: 100}, [3, 1, 2])
    assert got["b"] == 20 and np.isclose(sum(got.values()), 315) and got["a"] <= 200 and np.isclose(got["a"], 295 * 3 / 5)
    assert mixing.targets({"a": 0}, [3]) == {"a": 0}


def test_flight_keeps_totals_and_odds():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 400).astype(float)
    prob = np.full(400, 0.37)
    total = np.zeros(400)
    for i in range(60):
        p = mixing.fly(prob, size, np.random.default_rng(i))
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        assert np.isclose((p * size).sum(), (prob * size).sum()) and np.isclose(p.sum(), prob.sum())
        total += p
    assert abs(total.mean() / 60 - 0.37) < 0.01 and total.max() / 60 < 0.75


def test_op7_against_sql(spark, sf):
    want = duckdb.connect().execute(queries.OP7_SQL.replace("FROM documents", f"FROM read_parquet('{sf}/documents.parquet')")).fetchall()
    got = [tuple(r) for r in queries.op7_shards(spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(str((i, s, c, law, shard, slot, None)) for i, s, c, law, shard, slot, _ in want)


def jaccard_pair(rng, size, common):
    """Two texts of `size` distinct five-word shingles each, whose first `common` ones agree."""
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 8))
    head = [word() for _ in range(common + 4)]
    return [" ".join(head + [word() for _ in range(size - common)]) for _ in range(2)]


def test_near_copies_by_exact_similarity(spark):
    """Pairs just at 0.8 lose one, pairs just under it lose none, and repeated lines count once."""
    rng = np.random.default_rng(8)
    texts, want = [], set()
    for _ in range(40):
        for common, linked in ((160, True), (159, False), (157, False)):  # of 180 each: 160 / 200 = 0.8
            a, b = jaccard_pair(rng, 180, common)
            assert (len(set(shingles(a)) & set(shingles(b))) >= 0.8 * len(set(shingles(a)) | set(shingles(b)))) == linked
            want |= {len(texts)} if linked else {len(texts), len(texts) + 1}
            texts += [a, b]
    line = jaccard_pair(rng, 20, 20)[0]
    for _ in range(2):  # share only a line that they repeat
        want.add(len(texts))
        texts.append(" ".join([line] * 40 + jaccard_pair(rng, 60, 60)[:1]))
    once = jaccard_pair(rng, 100, 100)[0]
    want.add(len(texts))
    texts += [" ".join([once] * n) for n in (2, 30)]  # one set, other counts
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want


def shingles(text):
    words = text.lower().split()
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


@pytest.mark.parametrize("rows", [3, 256])
def test_verified_links_against_brute_force(spark, rows):
    """One cluster in tiles of any size gives the groups of all its pairs."""
    rng = np.random.default_rng(rows)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        new = base[int(rng.integers(0, 12)) :]
        new[int(rng.integers(0, len(new)))] = f"x{i % 7}"
        texts.append(" ".join(new))
    sets = [set(shingles(t)) for t in texts]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < 60
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100 + i, "other text") for i in range(50)], "doc_id long, text string")
    clusters = spark.createDataFrame([(i, 0) for i in range(1, 60)], "id long, component long")
    names = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("k"), *(c.alias(n) for n, c in simhash.text_hashes("text").items()))
    links = simhash.verified_links(docs, clusters, names, "doc_id", "text", 5, 0.8, rows)
    found = {r["id"]: r["component"] for r in simhash.components(links).collect()}
    assert [found.get(i, i) for i in range(60)] == root


@pytest.mark.parametrize("name", ["ppm_base", "winnow_edits", "mix_targets", "rules_statistics"])
def test_columns_against_sql(spark, sf, name):
    """What of four operators SQL can express, over the whole table."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
