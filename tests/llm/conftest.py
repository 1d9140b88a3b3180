import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"wort{i % 977} und {i}" for i in range(12_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "the quick brown fox jumps over the lazy dog", "en", None, 43),
        (2, "the quick brown fox jumps over the lazy dog", "en", None, 43),
        (3, None, "fr", "b", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "fr", "a", 4),
        (6, long_text, "de", "c", len(long_text)),
        (None, "no id here but some words", None, None, None),
        (7, "12345 !!! 678", "en", "d", 13),
        (8, "one", "en", "a", 3),
        (9, "été naïve ß 漢字 \U0001f600 words", "fr", "\U0001f600", 20),
    ]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    from pyspark.sql import functions as F

    # names that the operators use themselves
    clash = ("_row", "size", "target", "block", "draws", "piece", "length", "sequence_id", "score", "term", "component_id", "line", "text_sha256", "_s", "words",
             "_cut", "_gone", "_shard", "_draw", "_text", "_lot", "_digest", "_stay", "_sha256_of_text", "_row_key", "_first", "key", "g", "at", "items", "hits")
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
