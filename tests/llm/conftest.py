import pytest

#: Texts that operators meet at the edges: null, blank, short, repeated, accented, long.
EDGES = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", "b"),
    (4, "one", None),
    (5, "Éa b  c\x1cd\x0be", "b"),
    (6, "the same words again and again " * 40, "b"),
    (7, "the same words again and again " * 40, "a"),
    (7, "the same words again and again " * 40, "a"),
    (None, "the same words again and again " * 40, "a"),
    (None, None, None),
    (8, "x" * 5000, "a"),
    (9, " ".join(f"w{i}" for i in range(6000)), "c"),
    (9, "another text under the same id", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(i, t, s, 1, "kept") for i, t, s in EDGES]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, n_words int, `odd name` string"
    )


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def some(spark):
    """The smallest table's documents, and as (doc_id, text) in order of doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
