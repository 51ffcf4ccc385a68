import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part string, score string, rep int, bucket int, gone string, held_out int, piece string, component_id string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents of (id, text, lang) with extra columns whose names clash with those used inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), -1, "x", "y", 0, 0, "z", 0, "p", "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 997}x{i % 61}" for i in range(60_000)) + "."
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, LONG), (None, "null id text here now then"), (6, "émile ça 12345 !!!"), (7, "?!..."), (8, "a\nb\n\na\nb"), (9, "a\nb\n\na\nb")]


@pytest.fixture
def edges(table):
    return table(EDGES)


@pytest.fixture
def empty(table):
    return table([]) 
