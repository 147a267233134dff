import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts or ``(doc_id, text)`` pairs, dealt over several partitions."""

    def make(rows, lang="en"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table of documents, as it is."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
