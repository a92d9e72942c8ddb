from pyspark.sql import functions as F

from nearfield.llm import rules

BAD = "!!! ??? !!! ;;; !!! ??? ::: !!! one !!! two ??? !!! three"


def test_every_labelled_row_counts(spark):
    """The bad rows are those whose keys' hashes are greatest, behind 4,500 good ones: none of them is overlooked."""
    ids = [r[0] for r in spark.range(4600).orderBy(F.xxhash64("id")).collect()]
    bad = set(ids[4500:])
    rows = [(i, f"{BAD} {i} {i % 7}" if i in bad else f"a plain text of some words, as number {i} of many that are {i % 7} days old") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    known = rules.labelled_features(docs, labels, "quality")
    assert known.count() == 4600 and known.where("not good").count() == 100
    got = rules.apply_rules(docs, labels).where("not base_failed").collect()
    assert len(got) == 4600
    assert {r["doc_id"] for r in got if not r["kept"]} == bad
