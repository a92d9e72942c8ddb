import public_tokenizers as P
import pyarrow.dataset as ds
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import common, rules


def test_stages(spark, sf, documents, odd):
    docs, columns = documents.unionByName(odd.select("doc_id", "text", "lang", "source").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "0L AS n_chars")), documents.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        docs = corpus_pipeline.stored(out, "test")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == counts[4]
    tool = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in last[:50]:
        assert r["ids"] == tool.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_stages_on_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_rules_stage_sees_labels_of_rows_rejected_before(spark):
    """With no bad labelled row left in its input, the stage still rejects the anomalies that op10_rules rejects."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    verdicts = {r["doc_id"]: r for r in rules.apply_rules(docs, labels).collect()}
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.within_rules(spark, left, sf).collect()}
    assert kept == {i for i in ids if verdicts[i]["kept"]}
    assert any(not verdicts[i]["base_failed"] for i in ids - kept)


def test_stages_are_written_in_small_row_groups(spark):
    """40 MB of text in one file: a reader of one row group holds a bounded part of it, and no row is lost."""
    docs = spark.range(0, 20_000, 1, 1).select("id", F.concat(*(F.sha2((F.col("id") * 32 + i).cast("string"), 256) for i in range(32))).alias("text"))
    out = corpus_pipeline.stored(docs, "test")
    groups = [g.total_byte_size for f in ds.dataset([x.removeprefix("file://") for x in out.inputFiles()]).get_fragments() for g in f.row_groups]
    assert sum(groups) > 30_000_000 and max(groups) <= 1.5 * common.ROW_GROUP_BYTES
    assert out.count() == 20_000 and out.select("text").distinct().count() == 20_000
