import pytest

SF_DIR = "/root/testdata/sf0.001"
#: Rows every operator over documents has to take: nulls, empties, ties, repeats, odd characters, long texts.
ODD = [None, "", " ", "\n\t", "a", "word", "word", "ünïcödé ñ", "日本語 テキスト", "x\0y", "▁ mark ▁", "1234567890 " * 3,
       "😀😀", "long " * 9000, "aaaa" * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with nulls in every column, a repeated row and clashing extra columns."""
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", i, i, i, "x", float(i)) for i, t in enumerate(ODD)]
    rows += [rows[5], rows[6]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, key long, n long, seed long, ids string, score double")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
