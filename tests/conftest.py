import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from logweave.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Open-layout events from ``fields`` dictionaries, in order of ``id``."""
    import json

    from logweave.model import from_documents

    def make(rows, raw=None):
        documents = [
            (json.dumps({
                "id": f"e{i}", "timestamp": "2023-01-01T12:00:00", "source_type": "test", "source_name": "t",
                "raw_data": raw[i] if raw else "", "fields": fields, "metadata": {}, "tags": [],
            }),)
            for i, fields in enumerate(rows)
        ]
        return from_documents(spark.createDataFrame(documents, "value string"))

    return make


@pytest.fixture(scope="session")
def read_events():
    """Events back as dictionaries keyed by id."""
    import json

    from logweave.model import event_document

    def read(df):
        return {e["id"]: e for e in (json.loads(r[0]) for r in df.select(event_document(df)).collect())}

    return read
