"""Names of sources, processors and sinks, and what they build."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from logweave.operators.enrich import enrich
from logweave.operators.extract import extract_grok, extract_regex
from logweave.operators.filter import filter_events
from logweave.operators.json import parse_json
from logweave.operators.mutate import mutate
from logweave.sinks.lines import write_files, write_objects
from logweave.sinks.search import write_search
from logweave.sources.kafka import kafka
from logweave.sources.text import files, objects
from logweave.sources.winlog import winlog

KINDS = ("source", "processor", "sink")


class Registry:
    """``(kind, name)`` to builder.

    A source builder is ``(spark, **config) -> DataFrame``, a processor builder
    ``(**config) -> step`` and a sink builder ``(df, **config) -> None``. One name may stand
    for a source and for a sink. ``FileSource`` and ``file`` name the same thing.
    """

    def __init__(self):
        self._builders: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, name: str, builder: Callable) -> None:
        if kind not in KINDS:
            raise ValueError(f"Unknown component kind: {kind}")
        self._builders[kind, _short(kind, name)] = builder

    def resolve(self, kind: str, name: str) -> Callable:
        try:
            return self._builders[kind, _short(kind, name)]
        except KeyError:
            known = sorted(n for k, n in self._builders if k == kind)
            raise ValueError(f"Unknown {kind} type: {name} (known: {', '.join(known)})") from None

    def copy(self) -> Registry:
        other = Registry()
        other._builders.update(self._builders)
        return other


def _short(kind: str, name: str) -> str:
    return name.rsplit(".", 1)[-1].lower().removesuffix(kind)


def accepted(builder: Callable, config: dict[str, Any]) -> dict[str, Any]:
    """The settings a builder knows; others (such as poll sizes Spark plans itself) are left out."""
    parameters = inspect.signature(builder).parameters
    if any(p.kind is p.VAR_KEYWORD for p in parameters.values()):
        return config
    return {k: v for k, v in config.items() if k in parameters}


def _object_access(spark: SparkSession, config: dict[str, Any]) -> None:
    """Object-store credentials become file system settings of the session."""
    settings = {
        "aws_access_key_id": "fs.s3a.access.key",
        "aws_secret_access_key": "fs.s3a.secret.key",
        "aws_session_token": "fs.s3a.session.token",
        "endpoint_url": "fs.s3a.endpoint",
        "region": "fs.s3a.endpoint.region",
    }
    for ours, theirs in settings.items():
        if config.get(ours):
            spark.conf.set(theirs, config[ours])


def _objects_source(spark: SparkSession, **config: Any) -> DataFrame:
    _object_access(spark, config)
    return objects(spark, **accepted(objects, config))


def _objects_sink(df: DataFrame, batch_id: int | None = None, **config: Any) -> None:
    _object_access(df.sparkSession, config)
    write_objects(df, **accepted(write_objects, config), batch_id=batch_id)


def _search_sink(family: str) -> Callable:
    def write(df: DataFrame, **config: Any) -> None:
        write_search(df, family=family, **config)

    return write


def _enrich(geo_db_path: str | None = None, **config: Any) -> Callable[[DataFrame], DataFrame]:
    """``enrich`` whose location table may be named by path (Parquet)."""
    kind = config.get("enrich_type", "none")
    if kind == "geo" and "ranges" not in config:
        if not geo_db_path:
            raise ValueError("GeoIP database path is required for geo enrichment")
        return lambda df: enrich(**config, ranges=df.sparkSession.read.parquet(geo_db_path))(df)
    return enrich(**config)


def default_registry() -> Registry:
    registry = Registry()
    for name, builder in {"file": files, "kafka": kafka, "s3": _objects_source, "winlog": winlog}.items():
        registry.register("source", name, builder)
    for name, builder in {
        "json": parse_json, "filter": filter_events, "regex": extract_regex,
        "grok": extract_grok, "mutate": mutate, "enrich": _enrich,
    }.items():
        registry.register("processor", name, builder)
    for name, builder in {
        "file": write_files, "s3": _objects_sink,
        "elasticsearch": _search_sink("es"), "opensearch": _search_sink("opensearch"),
    }.items():
        registry.register("sink", name, builder)
    return registry
