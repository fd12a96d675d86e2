import pytest

#: Columns whose names clash with those that the operators use within.
CLASH = ("id", "fp", "rep", "label", "h", "n", "uid", "x", "score", "host", "rule", "digest", "part", "__text", "base", "spans")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=True):
        """documents of (doc_id, text) or (doc_id, text, lang), with clashing columns."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *(f"cast(null as string) as `{c}`" for c in CLASH)) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null and empty text, blanks only, repeated rows, one very long word, one very long text."""
    return [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "same words here in this text"), (4, "same words here in this text"), (5, "x" * 50_000), (6, "word " * 40_000), (7, "\u00e9\U0001f600 mixed \u65e5\u672c")]
