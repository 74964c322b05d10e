import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __s string, root long, block int, extra string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names the operators use themselves."""

    def made(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 7, 9, "e") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return made


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "two words"), (7, long), (8, long), (9, "é ü   日本 \x1c mark"), (10, "a" * 5000)]
