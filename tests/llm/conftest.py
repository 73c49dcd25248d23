import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, source]) rows, with columns whose names the operators use too."""

    def build(rows, extra=True):
        wide = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(wide, DOCS)
        if extra:
            for name in ("n_words", "size", "kept", "round", "token", "key", "cid", "hash", "_key", "n", "copies"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a\x00b c\n\nd"), (7, "ÄÖ ß\u2003x İ"),
    (8, "word " * 30_000), (9, "same text here for two"), (9, "same text here for two"), (None, "no id at all here"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs([(*r, None if i % 3 == 0 else "s") for i, r in enumerate(ODD)])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
