import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null columns, empty and long texts, ties and repeated rows, and columns with names the operators use."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "src0"), (2, "", "src1"), (3, " \n\t", None), (None, "one two three four five six", "src2"), (4, "tie tie", "src3"), (4, "tie tie", "src3"),
            (5, long, "src4"), (6, long + " end", "src5"), (7, "a", "src6"), (8, "Ünï cödé 😀 \x0b x", "src7")]
    rows = [(i, t, "en" if i else None, s, len(t) if t else None, 9, 9, "x", 9) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, k1 int, kept string, component int")
