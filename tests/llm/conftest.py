import pytest

#: Columns named like those that operators add or use inside.
CLASHING = ("keep", "quality_score", "fingerprint", "keys", "signature", "language", "cosine", "token_ids", "n_tokens", "bpe", "pii_spans", "redacted", "group_id", "lost_id", "again_id", "number", "found")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
        full = [(i, t, "en", "s", len(t or ""), *("x" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    plain = "The board meets on the first day of each month and keeps its minutes."
    return docs([(1, None), (2, ""), (3, " \n\t "), (4, plain), (4, plain), (5, plain), (None, plain), (None, None), (6, LONG), (7, "é" * 3000), (8, "!!! ???"), (9, "日本語 テキスト"), (10, "a\x00b \U0001f600")])


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
