import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_dir(spark, tmp_path):
    """Writes rows (doc_id, text, lang, source) as a documents table and gives the folder."""

    def make(rows, name="d"):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        return str(tmp_path / name)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty, blank, very long, repeated and odd texts."""
    long = " ".join(f"word{i % 977} runs\n" for i in range(30_000))
    texts = [None, "", " ", "\n\n", "a", "Hello  world \n it's  fine", long, "x" * 50_000, "a b\x1cc", "né 漢字 🙂 don't", "Hello  world \n it's  fine"]
    return [(i * 7, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", ) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
