import pytest

ODD = [None, "", " \n\t ", "x", "é", "mit license", "a b", "ß 漢字 😀 ok", "word " * 3000, "no secrets here at all, none"]


@pytest.fixture
def docs(spark):
    """Rows of `doc_id, text` with columns whose names clash with those the operators use."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), 1, "q", 2) for i, t in enumerate(texts)]
        kind = "doc_id long, text string, lang string, source string, n_chars long, row int, labels string, f int"
        return spark.createDataFrame(rows, kind)

    return make


def same_rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
