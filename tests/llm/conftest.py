import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and an extra column with a clashing name."""
    long = " ".join(f"w{i % 977}x{i // 31}" for i in range(20_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six", None), (4, "one two three four five six", "b"),
            (4, "one two three four five six", "b"), (None, "password: abcdefghijklmnop é AKIA" + "Z" * 16, "b"), (None, None, None),
            (7, "x\ty \n\n z  w", "c"), (8, "rep " * 90, "c"), (9, long, "a"), (10, long + " end", "a"), (11, "Ünï \x0b çode", "d")]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, score double")


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
