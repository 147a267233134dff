"""Search-index sinks: events as bulk actions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from logweave.model import event_document
from logweave.sinks.lines import batch_folder

INDEX = "logs-{yyyy.MM.dd}"
# Place of each date token in the text form of a timestamp.
_PLACES = {"yyyy": (1, 4), "MM": (6, 2), "dd": (9, 2), "HH": (12, 2)}


def index_name(pattern: str = INDEX, timestamp: Column | str = "timestamp") -> Column:
    """Index name with ``{...}`` date patterns filled in from the event time."""
    stamp = (F.col(timestamp) if isinstance(timestamp, str) else timestamp).cast("string")
    parts: list[Column] = []
    for piece in re.split(r"(\{[^{}]*\})", pattern):
        if piece.startswith("{"):
            for token in re.findall(r"yyyy|MM|dd|HH|[^A-Za-z]+|.", piece[1:-1]):
                if token in _PLACES:
                    parts.append(F.substring(stamp, *_PLACES[token]))
                elif token[0].isalpha():
                    raise ValueError(f"Unknown date pattern in index name: {pattern}")
                else:
                    parts.append(F.lit(token))
        elif piece:
            if "{" in piece or "}" in piece:
                raise ValueError(f"Unbalanced braces in index name: {pattern}")
            parts.append(F.lit(piece))
    return F.concat(*parts)


def bulk_actions(df: DataFrame, index: str = INDEX) -> DataFrame:
    """Rows ``(_index, _id, _source)``; the id is the event's, so a replay overwrites."""
    return df.select(index_name(index).alias("_index"), F.col("id").alias("_id"), event_document(df).alias("_source"))


def bulk_lines(actions: DataFrame) -> DataFrame:
    """The bulk request text of each action: action line and document line together."""
    action = F.to_json(F.struct(F.struct("_index", "_id").alias("index")))
    return actions.select(F.concat(action, F.lit("\n"), F.col("_source")).alias("value"))


def write_bulk_files(
    df: DataFrame, path: str, index: str = INDEX, batch_size: int = 1000, append: bool = True, batch_id: int | None = None, requests_per_file: int = 100
) -> None:
    """Files of at most ``requests_per_file`` bulk requests of ``batch_size`` actions each, one after the other.

    A request is the next ``2 * batch_size`` lines of a file: no text of an action holds a line end. A micro-batch has a folder of its own.
    """
    if batch_size < 1 or requests_per_file < 1:
        raise ValueError("batch_size and requests_per_file must be positive")
    path, append = batch_folder(df, path, append, batch_id)
    lines = bulk_lines(bulk_actions(df, index))
    lines.write.option("maxRecordsPerFile", int(batch_size) * int(requests_per_file)).mode("append" if append else "overwrite").text(path)


def connector_options(
    hosts: list[str],
    username: str | None = None,
    password: str | None = None,
    api_key: str | None = None,
    cloud_id: str | None = None,
    ssl_verify: bool = True,
    batch_size: int = 1000,
    timeout: int = 30,
    family: str = "es",
) -> dict[str, str]:
    """Options for the public Spark search connectors (``es`` / ``opensearch``)."""
    if not hosts:
        raise ValueError("Search hosts are required")
    options = {
        f"{family}.nodes": ",".join(hosts),
        f"{family}.mapping.id": "_id",
        f"{family}.batch.size.entries": str(batch_size),
        f"{family}.batch.write.retry.count": "3",
        f"{family}.batch.write.retry.wait": "2s",
        f"{family}.http.timeout": f"{timeout}s",
        f"{family}.net.ssl.cert.allow.self.signed": str(not ssl_verify).lower(),
    }
    if username and password:
        options[f"{family}.net.http.auth.user"] = username
        options[f"{family}.net.http.auth.pass"] = password
    elif api_key:
        options[f"{family}.net.http.header.Authorization"] = f"ApiKey {api_key}"
    if cloud_id:
        options[f"{family}.cloud.id"] = cloud_id
    return options


def write_search(df: DataFrame, hosts: list[str], index: str = INDEX, family: str = "es", **settings) -> None:
    """Hand the actions to the search connector, which must be on the class path."""
    source = "org.elasticsearch.spark.sql" if family == "es" else "opensearch"
    options = connector_options(hosts, family=family, **settings)
    documents = df.select(
        index_name(index).alias("_index"), F.col("id").alias("_id"), F.parse_json(event_document(df)).alias("document")
    )
    documents.write.format(source).options(**options).option(f"{family}.resource.write", "{_index}").mode("append").save()
