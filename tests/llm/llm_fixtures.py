"""Tables whose other columns bear the names that operators use themselves."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """(doc_id, text) or (doc_id, text, source) rows -> a table with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("size", "length", "seq", "node", "fp", "terms", "doc", "item", "part", "license", "quality", "place"):
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return build
