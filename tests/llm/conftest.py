import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tag string, rid long, body string, k long, target double, pii string, digit long, w string, size long"
LONG = "word " * 30_000 + "x" * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names operators might use themselves."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (2, "the QUICK brown fox\tjumps over the  lazy dog near the river bank today.", "en", None, None),
        (3, None, None, "a", None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "en", "b", 6),
        (6, LONG, "en", "c", len(LONG)),
        (7, LONG, None, "c", len(LONG)),
        (None, "a text without an id, twice", "de", "b", 27),
        (None, "a text without an id, twice", "de", "b", 27),
        (8, "Ünï çödé — 漢字 テスト 😀 mail me: a.b@c-d.example.org, +1 (212) 555-0100 or 4111 1111 1111 1111", "fr", "d", 10),
        (9, "one", "en", "d", 3),
    ]
    full = [r + (0.5, "t", 9, "b", 1, 2.0, "p", 3, "w", 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
