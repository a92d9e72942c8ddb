import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearfield.llm import ppm, quality, queries, rules
from nearfield.llm.common import held_out


class Trie:
    """PPM by the book: dictionaries of contexts, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.nodes = order, defaultdict(Counter)
        for t in texts:
            for context, s in self.symbols(t):
                for j in range(order, -1, -1):
                    c = context[order - j :]
                    fresh = s not in self.nodes[c]
                    self.nodes[c][s] += 1
                    if not fresh:
                        break

    def symbols(self, text):
        seq = [ppm.START] * self.order + list(text) + [ppm.END]
        for i in range(self.order, len(seq)):
            yield tuple(seq[i - self.order : i]), seq[i]

    def prob(self, context, s):
        p, gone = 1.0, set()
        for j in range(self.order, -1, -1):
            node = self.nodes.get(context[self.order - j :], {})
            left = {x: n for x, n in node.items() if x not in gone}
            total = sum(left.values())
            if s in left:
                return p * (2 * left[s] - 1) / (2 * total)
            if left:
                p *= len(left) / (2 * total)
            gone |= set(node)
        return p / max(1, 257 - len(gone))

    def score(self, text):
        return sum(math.log10(self.prob(c, s)) for c, s in self.symbols(text))


def held(doc_id, folds, fold):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def check_scores(df, order, **more):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower()) for r in df.collect()]
    train = [t for i, t in rows if not held(i, 7, 2)]
    trie = Trie(train, order)
    count = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    want = sorted(
        (i is not None, i or 0, held(i, 7, 2), len(t.split()) + 1, sum(count[w] > 0 for w in [*t.split(), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*t.split(), None]), 6), round(trie.score(t), 6))
        for i, t in rows
    )
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score(df, order=order, **more).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:6] == b[:6] and np.allclose(a[6:], b[6:], atol=1e-5)


def test_op2_against_a_trie(documents, odd):
    check_scores(documents.where("doc_id < 40"), 5)
    check_scores(odd.where("doc_id is null or doc_id != 12"), 3)
    assert ppm.score(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ppm.score(odd, order=9)


@pytest.mark.parametrize("cut", [(2, 2), (4096, 4)])
def test_op2_however_the_cells_are_cut(documents, cut):
    check_scores(documents.where("doc_id < 25"), 5, cut=cut)


def test_cells_grow_with_the_input():
    assert ppm.cells_for(0) == ppm.cells_for(30 << 30) == (1024, 3)
    cells, shared = ppm.cells_for(100 << 40)
    assert shared == 4 and cells > 100_000 and cells & (cells - 1) == 0


@pytest.mark.parametrize("order", [3, 5])
def test_probabilities_sum_to_one(order):
    """Of every context, seen or not, the 257 symbols' probabilities in ppm.code."""
    rng = np.random.default_rng(order)
    texts = [b"abracadabra", b"banana", b"", bytes(rng.integers(97, 103, 400, dtype=np.uint8)), bytes(rng.integers(0, 256, 60, dtype=np.uint8))]
    keys, counts = ppm._uniq(ppm.runs(texts, order)[0])
    low = keys
    for _ in range(order - ppm.SHARED):
        low = np.unique(ppm._lower(low))
    short = ppm.short_levels(*ppm._uniq(ppm._lower(low)))
    contexts = np.unique(np.concatenate((keys >> ppm.BITS, ppm.runs([bytes(rng.choice(list(b"abcdefz"), 200).tolist())], order)[0] >> ppm.BITS)))
    every = (contexts[:, None] << ppm.BITS | np.arange(257)[None]).ravel()
    uses = np.zeros(len(every), np.int64)
    uses[np.searchsorted(every, keys)] = counts
    assert np.allclose((10 ** ppm.code(every, uses, short, order)).reshape(-1, 257).sum(1), 1)


def test_long_texts_come_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (3, 0, 64, 63, 65, 1, 128, 300, 5)]
    whole = [ppm.runs([t])[0].tolist() for t in texts]
    monkeypatch.setattr(ppm, "SLICE_CHARS", 64)
    found = [[] for _ in texts]
    for keys, sizes, a, b in ppm._pieces(texts, ppm.ORDER):
        assert len(keys) <= 64 + 64 + b - a
        for i, own in zip(range(a, b), np.split(keys, np.cumsum(sizes)[:-1])):
            found[i] += own.tolist()
    assert found == whole


def test_op2_beats_the_base_on_held_out_rows(spark, sf):
    got = queries.op2_ppm(spark, sf.replace("0.001", "0.1")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_op6_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = queries.op6_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.9
    assert got[got.quality == 1].predicted.mean() >= 0.97


def test_net_sees_the_whole_text_and_pieces_agree(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"abcd", bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"x" * 4999 + b"!"]
    net = quality.ByteNet.new()
    whole = net.score(texts)
    monkeypatch.setattr(quality, "SLICE_BYTES", 512)
    assert np.allclose(net.score(texts), whole, atol=1e-6)
    assert np.allclose([net.score([t])[0] for t in texts], whole, atol=1e-6)
    assert net.score([b"x" * 5000])[0] != whole[4]
    fixed = quality.ByteNet.new().train(texts, np.ones(5, np.float32))
    assert np.allclose(fixed.score(texts), fixed.score(texts)[0])


def test_net_against_plain_convolution():
    """Every filter at every chunk of the padded text, one product at a time."""
    rng = np.random.default_rng(6)
    net = quality.ByteNet.new(dims=3, filters=4)
    net.bias[:] = rng.normal(size=4)
    for n in (0, 1, 4, 5, 12, 37):
        text = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        blocks = max(1, -(-n // quality.BLOCK))
        codes = list(text) + [quality.PAD] * ((blocks + quality.PARTS - 1) * quality.BLOCK - n)
        top = []
        for f in range(4):
            responses = []
            for b in range(blocks):
                total = 0.0
                for k in range(quality.PARTS):
                    for j in range(quality.BLOCK):
                        for d in range(3):
                            total += float(net.embed[codes[(b + k) * quality.BLOCK + j], d]) * float(net.filters[k, j * 3 + d, f])
                responses.append(total)
            top.append(max(responses))
        z = sum(max(t + float(b), 0) * float(w) for t, b, w in zip(top, net.bias, net.weight)) + net.offset
        assert math.isclose(net.score([text])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_long_labelled_texts_teach(spark):
    """A long text is learnt from by an excerpt, so long junk is told from long prose."""
    rows = [(i, ("good prose of some kind " if i % 2 else "$$$ ### @@@ ") * 3000) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.classify(docs, labels, longest=500).toPandas()
    assert (got.predicted == got.doc_id % 2).all()


def test_op6_odd_rows(spark, odd, labels):
    got = quality.classify(odd, labels, most_labelled=50).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.keep_good(odd, labels, most_labelled=50).columns == odd.columns
    assert quality.classify(odd.limit(0), labels.limit(0)).count() == 0


def plain_stats(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_op10_statistics(spark, sf, documents, odd, labels):
    for r in [*documents.collect(), *odd.collect()]:
        assert rules.text_stats(r["text"] or "")[:5] == plain_stats(r["text"] or "")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in queries.op10_rules(spark, sf).collect():
        words, _, _, _, repeats = plain_stats(texts[r["doc_id"]])
        assert r["base_failed"] == (words < 10 or 100 * repeats > 20 * words)
        assert not (r["base_failed"] and r["kept"])
    assert rules.apply_rules(odd, labels).count() == odd.count()
    assert rules.apply_rules(odd.limit(0), labels.limit(0)).count() == 0
    assert {r["doc_id"] for r in rules.apply_rules(odd, labels.limit(0)).where("kept = base_failed").collect()} == set()


def test_op10_on_rows_the_forest_never_saw(spark, sf):
    """Fitted on four fifths of the labels; good and bad rows of the rest."""
    big = sf.replace("0.001", "0.1")  # a forest needs some hundred labelled rows
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.apply_rules(docs, labels, keep=quality.not_held_out).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.99
    assert got[got.quality == 0].kept.mean() <= 0.1


def test_paths_against_plain_trees():
    """Scores from path lengths walked node by node, with the mean path of an unsuccessful search by its sum."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3)).round(1)
    x[:, 2] = 1.0
    forest = rules.IsolationForest.fit(x, trees=7, sample=40)
    rest = lambda n: 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    for t in range(7):  # the rows a tree was grown on are not kept: count how many a leaf's depth stands for
        for leaf in np.flatnonzero((forest.feature[t] < 0) & (forest.depth[t] > 0)):
            assert any(math.isclose(forest.depth[t][leaf], level + rest(n)) for level in range(8) for n in range(1, 41))
    want = []
    for row in x:
        total = 0.0
        for f, v, left, depth in zip(forest.feature, forest.value, forest.left, forest.depth):
            node = 0
            while f[node] >= 0:
                node = left[node] + int(row[f[node]] > v[node])
            total += depth[node]
        want.append(2 ** (-total / 7 / rest(40)))
    assert np.allclose(forest.score(x), want)


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(500, 3)), [[9, 9, 9]]))
    s = rules.IsolationForest.fit(x).score(x)
    assert s.argmax() == 500 and s[500] > 0.7 and np.median(s) < 0.5
