"""The contract queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idfiles, mixing, pieces, ppm, quality, rules, sharding, simhash, urls, winnow
from .common import in_slices, key_frame, read_table, text_list

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
END_ID = 2
URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def tokenized(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and decoded text of every row, as the model encodes and decodes it; null text is empty."""
    frame = key_frame(df, key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces.tokenizer(model)
        for batch in batches:
            texts = text_list(batch.column(1))
            for a, b, ids, starts in in_slices(texts, tool.encode):
                decoded = [tool.decode(ids[i:j]) for i, j in zip(starts.tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    return frame.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, counted and digested, and the digest of the decoded text."""
    frame = key_frame(read_table(spark, sf_dir, "documents"), "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces.tokenizer(PIECE_MODEL)  # found on the worker's own machine
        for batch in batches:
            for a, b, ids, starts in in_slices(text_list(batch.column(1)), tool.encode):
                counts, digests, decoded = [], [], []
                for i, j in zip(starts.tolist(), starts[1:].tolist()):
                    own = ids[i:j]
                    counts.append(j - i)
                    digests.append(hashlib.sha256(",".join(map(tool.decimal.__getitem__, own.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tool.decode(own).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.neighbours(read_table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark, read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("k").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read_table(spark, sf_dir, "documents"), 8)


def op8_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = idfiles.write_ids(read_table(spark, sf_dir, "documents"), lambda texts: idfiles.tokenizer(BYTE_MODEL).encode(texts), end_id=END_ID)
    return idfiles.read_ids(blocks, per_document=idfiles.crc_of_ids).withColumnRenamed("value", "ids_crc32")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP4_SQL = """
WITH parted AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parted),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT s.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM split s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fit f ON f.page_id = s.page_id AND f.place = 1
"""

# the table of the reversed CRC-32 polynomial 0xEDB88320, a fold over each text's bytes, then prefix sums
OP7_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
body AS (SELECT doc_id, hex(coalesce(text, '')) AS digits FROM documents),
sized AS (
  SELECT b.doc_id, length(b.digits) // 2 + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(b.digits), 2), lambda i: ('0x' || substr(b.digits, i, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t.entries[xor(c, x) % 256 + 1])), 4294967295::BIGINT) AS text_crc32
  FROM body b, crc_table t),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
sharded AS (SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sharded
"""


# --- those columns of four queries that SQL can express, from the same operators over the whole table


def ppm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_ppm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def winnow_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_winnow(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def rules_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_CRC_TABLE = OP7_SQL[OP7_SQL.index("  SELECT list(c ORDER BY i)") : OP7_SQL.index("),\nbody AS")]

PPM_SQL = f"""
WITH crc_table AS ({_CRC_TABLE}),
body AS (
  SELECT doc_id, hex(doc_id::VARCHAR) AS digits, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
marked AS (
  SELECT doc_id, words, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits), 2), lambda i: ('0x' || substr(digits, i, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t.entries[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 7 = 2 AS held_out FROM body, crc_table t),
tokens AS (SELECT doc_id, held_out, unnest(list_append(words, '')) AS token FROM marked),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
sums AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score
FROM tokens LEFT JOIN counts USING (token), sums GROUP BY doc_id, held_out
"""

EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT d.doc_id, length(d.t) AS n_chars, sha256(substr(d.t, 1, length(d.t) - length(d.t) // 4) || substr(e.t, 1, length(d.t) // 4)) AS edited_sha256
FROM d JOIN d e ON e.i = d.i % d.n + 1
"""

# the level at which the weighted shares meet the total, if sources that would rise above their cap stop there
TARGETS_SQL = f"""
WITH sized AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM sized GROUP BY source),
weighed AS (SELECT *, CASE i WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT cap / w AS edge, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW p AS (ORDER BY cap / w, source)),
chosen AS (SELECT arg_min(level, edge) AS level FROM levels WHERE level <= edge)
SELECT s.doc_id, s.size, g.source_size, round(least(g.cap, c.level * g.w), 4) AS target
FROM sized s JOIN weighed g ON s.source IS NOT DISTINCT FROM g.source, chosen c
"""

RULES_SQL = f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM body)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE c > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM body)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
FROM counted LEFT JOIN covered USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_pieces": op1_pieces,
        "op2_ppm": op2_ppm,
        "op3_winnow": op3_winnow,
        "op4_urls": op4_urls,
        "op5_simhash": op5_simhash,
        "op6_quality": op6_quality,
        "op7_shards": op7_shards,
        "op8_idfiles": op8_idfiles,
        "op9_mix": op9_mix,
        "op10_rules": op10_rules,
        "ppm_base": ppm_base,
        "winnow_edits": winnow_edits,
        "mix_targets": mix_targets,
        "rules_statistics": rules_statistics,
    }
    return found


def oracle_sql() -> dict[str, str]:
    return {"op4_urls": OP4_SQL, "op7_shards": OP7_SQL, "ppm_base": PPM_SQL, "winnow_edits": EDITS_SQL, "mix_targets": TARGETS_SQL, "rules_statistics": RULES_SQL}
