import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score string, findings string, matches string, ids string, component string, _row string"


@pytest.fixture
def documents(spark):
    """Makes a table of documents with extra columns whose names clash with those of operators."""

    def make(texts, langs=None, ids=None):
        rows = []
        for k, t in enumerate(texts):
            i = k if ids is None else ids[k]
            rows.append((i, t, langs[k] if langs else "en", None if k % 2 else "s", None if t is None else len(t), "x", "x", "x", "x", "x", "x"))
        return spark.createDataFrame(rows, FIELDS)

    return make


@pytest.fixture
def data_dir(spark, tmp_path):
    """Writes tables into a folder as the queries read them."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


ODD = [None, "", " ", "\n\t", "a", "a", "one two three", "\u2581 \u2581", "x" * 70000, "word " * 30000, "\U0001f600 \u00e9\u00df \x00 end", "  two  blanks  "]


@pytest.fixture
def odd():
    """Null, empty, blank, repeated, very long and unusual texts."""
    return list(ODD)
