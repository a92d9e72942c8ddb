import pytest

TEXTS = [
    "",
    None,
    " ",
    "one",
    "The quick brown fox jumps over the lazy dog again and again today",
    "The quick brown fox jumps over the lazy dog again and again today",
    "the QUICK brown fox jumps over the lazy dog again and again tonight",
    "a b c d e a b c d e f g h i",
    "line one here\nline one here\n\n  \nline two # $ %",
    "x" * 3000,
    "日本語のテキスト 👩‍👩‍👧 mixed\u00a0spaces  and\ttabs\r\n",
    "<s> </s> <unk> ▁▁ <|endoftext|> tail",
    " ".join(f"w{i % 50}" for i in range(30_000)),
    "!!! ### &&& ***",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Empty, null, odd and long texts, copies, a repeated row, a null key, and extra columns whose names the operators use inside."""
    rows = [(i, t, f"src{i % 3}" if i % 5 else None, "en", 1, "x", 2.0) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "a text without a key and some words more", "src1", "en", 1, "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, part int, k string, score double")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
