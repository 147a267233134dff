"""Registration of queries and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.model import to_events
from logweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of one data folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under ``name``."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def micros(ts: Column) -> Column:
    """Timestamp text with six fraction digits."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# SQL twins of the derived inputs below.
MICROS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
ISO = "CASE WHEN date_part('microsecond', ts)::BIGINT % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END"


def level() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").otherwise("INFO")


def log_lines(t: Tables) -> DataFrame:
    """Application log lines out of the event table: ``time level user=.. value=.. (type)``."""
    line = F.concat(
        micros(F.col("ts")), F.lit(" "), level(), F.lit(" user="), F.col("user_id"), F.lit(" value="), F.col("value"),
        F.lit(" ("), F.col("event_type"), F.lit(")"),
    )
    return t("events").select("event_id", "ts", line.alias("raw_data"))


def access_lines(t: Tables) -> DataFrame:
    """Web server access lines (combined format) out of the event table."""
    ip = F.concat_ws(".", F.lit("203"), F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7"))
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = F.concat(
        ip, F.lit(" - user"), F.col("user_id"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
        F.col("event_type"), F.lit("/"), F.col("event_id"), F.lit(' HTTP/1.1" '), status, F.lit(" "),
        F.col("user_id") * 10, F.lit(' "http://example.com/start" "agent/'), F.col("user_id"), F.lit('.0 (X11)"'),
    )
    return t("events").select("event_id", line.alias("raw_data"))


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels; most documents have none."""
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t("labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def open_events(t: Tables) -> DataFrame:
    """The event table as open-layout events; error rows carry no value."""
    rows = t("events")
    variant = {"event_type": F.col("event_type"), "user_id": F.col("user_id")}
    pairs = [p for k, v in variant.items() for p in (F.lit(k), v.cast("variant"))]
    value = F.create_map(F.lit("value"), F.col("value").cast("variant"))
    none = F.create_map().cast("map<string,variant>")
    fields = F.map_concat(F.create_map(*pairs), F.when(F.col("event_type") != "error", value).otherwise(none))
    return to_events(
        rows, id=F.col("event_id").cast("string"), timestamp=F.col("ts").cast("timestamp"), source_type=F.lit("table"),
        source_name=F.lit("events"), raw_data=F.col("props"), fields=fields,
    )


def field_text(name: str) -> Column:
    """Text of an open-layout field."""
    return F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", "string")
