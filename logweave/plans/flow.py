"""A declared flow: sources, a chain of processors, sinks; run as a batch or as a stream."""

from __future__ import annotations

import inspect
import json
import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from logweave import metrics
from logweave.files import Files, stage
from logweave.operators.base import Step, reason
from logweave.plans.registry import Registry, accepted, default_registry
from logweave.session import configure, shared_dir
from logweave.sources.union import fan_in
from logweave.streaming.ledger import Ledger


_log = logging.getLogger(__name__)


class ConfigError(ValueError):
    """A flow declaration that cannot be built."""


def check(spec: Any) -> None:
    """Raise ``ConfigError`` unless the declaration has its required parts."""
    for key in ("name", "sources", "sinks"):
        if key not in spec:
            raise ConfigError(f"Missing required configuration key: {key}")
    for kind in ("source", "processor", "sink"):
        items = spec.get(f"{kind}s", [] if kind == "processor" else None)
        if kind == "processor":
            if not isinstance(items, list):
                raise ConfigError("Processors must be a list")
        elif not isinstance(items, list) or not items:
            raise ConfigError(f"At least one {kind} must be configured")
        for i, item in enumerate(items):
            label = kind.capitalize()
            if not isinstance(item, dict):
                raise ConfigError(f"Invalid {kind} configuration at index {i}")
            for key in ("name", "type"):
                if key not in item:
                    raise ConfigError(f"{label} at index {i} is missing a {key}")
            if not isinstance(item.get("config"), dict):
                raise ConfigError(f"{label} at index {i} is missing a valid config")


def load_spec(path: str) -> dict[str, Any]:
    """Read a declaration from a YAML or JSON file on the driver."""
    with open(path, encoding="utf-8") as source:
        text = source.read()
    if path.endswith(".json"):
        spec = json.loads(text)
    else:
        import yaml

        spec = yaml.safe_load(text)
    if not isinstance(spec, dict):
        raise ConfigError(f"Invalid configuration format in {path}")
    return spec


class Flow:
    """A checked declaration whose processors are built."""

    def __init__(self, spec: dict[str, Any], registry: Registry | None = None):
        check(spec)
        self.spec, self.name = spec, spec["name"]
        self.sink_failures: list[str] = []  # of this run, in order
        self.started = time.time()
        self.ledger: Ledger | None = None  # of the running or last stream
        self.registry = registry or default_registry()
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        for item in spec.get("processors", []):
            builder = self.registry.resolve("processor", item["type"])
            self.steps.append(builder(**accepted(builder, item["config"])))
        for kind in ("source", "sink"):
            for item in spec[f"{kind}s"]:
                self.registry.resolve(kind, item["type"])

    def read(self, spark: SparkSession, stream: bool = False) -> DataFrame:
        """All sources in one DataFrame.

        In a stream ``batch_size`` bounds the rows of a micro-batch for sources that count rows (``max_poll_records``),
        unless they set it themselves; sources of files have bounds of their own.
        """
        bound = {"max_poll_records": int(self.spec["batch_size"])} if stream and self.spec.get("batch_size") else {}
        frames = []
        for item in self.spec["sources"]:
            builder = self.registry.resolve("source", item["type"])
            frames.append(builder(spark, **accepted(builder, {**bound, **item["config"], "tail": stream})))
        return fan_in(*frames)

    def transform(self, df: DataFrame) -> DataFrame:
        """The processor chain; dropped rows are gone."""
        for step in self.steps:
            df = step(df)
        return df

    def audit(self, df: DataFrame, status: str = metrics.STATUS) -> DataFrame:
        """The processor chain with every row kept and its fate in the ``status`` column."""
        df = df.withColumn(status, reason("ok", "", F.lit("")))
        for step in self.steps:
            df = step.audited(df, status) if isinstance(step, Step) else step(df)
        return df

    def sinks(self) -> dict[str, dict[str, Any]]:
        """The declared sinks by a name of their own, in order."""
        return {f"{number}-{item['name']}": item for number, item in enumerate(self.spec["sinks"])}

    def _send(self, df: DataFrame, sink: dict[str, Any], batch: int | None = None) -> str | None:
        """Rows to one sink; the failure, if it fails."""
        builder = self.registry.resolve("sink", sink["type"])
        given = {} if batch is None or "batch_id" not in inspect.signature(builder).parameters else {"batch_id": batch}
        try:
            builder(df, **accepted(builder, sink["config"]), **given)
        except Exception as error:  # noqa: BLE001 - isolation is the feature
            _log.error("flow %s, sink %s failed: %s", self.name, sink["name"], error)
            return f"{sink['name']}: {error}"
        return None

    def write(self, df: DataFrame, on_error: str = "record") -> list[str]:
        """Every row to every sink, in order; returns the failures.

        A failing sink does not keep the others from their rows. Several sinks read the rows from one written
        table, so all get the same, ids included. ``on_error="fail"`` raises after all were tried.
        """
        _check_policy(on_error)
        sinks = self.spec["sinks"]
        folder = shared_dir(df.sparkSession, f"fan-out-{self.name}") if len(sinks) > 1 else None
        try:
            rows = df if folder is None else stage(df, folder)
            failures = [f for f in (self._send(rows, item) for item in sinks) if f]
        finally:
            if folder is not None:
                Files(df.sparkSession, folder).remove("")
        self.sink_failures += failures
        if failures and on_error == "fail":
            raise RuntimeError("; ".join(failures))
        return failures

    def deliver(self, df: DataFrame, batch: int, ledger: Ledger, on_error: str = "record", seen: Observation | None = None) -> list[str]:
        """The rows of a micro-batch to every sink that has not got them; returns the failures.

        A batch that is run again skips the sinks that have it; the others write the same rows to the same place.
        The rows for a sink that fails are kept and handed to it again before the next batch and at the next
        start; with ``on_error="fail"`` the stream ends, and runs the batch again when it is restarted. ``seen``
        counts the rows; the counters go to the ledger once per batch.
        """
        _check_policy(on_error)
        self.redeliver(ledger, batch)
        sinks = self.sinks()
        open_ = {name: item for name, item in sinks.items() if name not in ledger.delivered(batch)}
        if not open_:
            return []
        alone = len(sinks) == 1
        rows = df if alone else ledger.stage(batch, df)
        failures = []
        for name, item in open_.items():
            failure = self._send(rows, item, batch)
            if failure is None:
                ledger.mark(batch, name)
            else:
                failures.append(failure)
        if failures and alone and on_error == "record":
            ledger.stage(batch, df)
        if seen is not None:
            ledger.count(batch, observed(seen) or dict.fromkeys(metrics.COUNTERS, 0))
        ledger.settle(batch, sinks)
        self.sink_failures += failures
        if failures and on_error == "fail":
            raise RuntimeError("; ".join(failures))
        return failures

    def redeliver(self, ledger: Ledger, before: int | None = None) -> None:
        """Staged rows of earlier batches to the sinks that have not got them."""
        sinks = self.sinks()
        for batch in ledger.waiting(sinks, before):
            for name in sorted(set(sinks) - ledger.delivered(batch)):
                failure = self._send(ledger.staged(batch), sinks[name], batch)
                if failure:
                    self.sink_failures.append(failure)
                else:
                    ledger.mark(batch, name)
            ledger.settle(batch, sinks)

    def run_batch(self, spark: SparkSession, count: bool = False, on_error: str = "record") -> dict[str, Any]:
        """Read, process and write once; returns the status row.

        ``count`` tallies processed, dropped and failed rows on the way. It keeps filters
        from reaching the scan, so it is off by default.
        """
        configure(spark)
        started = time.time()
        rows = self.read(spark)
        tally = dict.fromkeys(metrics.COUNTERS)
        if count:
            seen = Observation(f"{self.name}-counters")
            audited = self.audit(rows).observe(seen, *metrics.counters())
            kept = audited.where(F.col(metrics.STATUS)["state"] == "ok").drop(metrics.STATUS)
            failures = self.write(kept, on_error)
            tally = observed(seen) or dict.fromkeys(metrics.COUNTERS, 0)
            tally["processing_errors"] += len(failures)
        else:
            failures = self.write(self.transform(rows), on_error)
        return self.status(tally, False, time.time() - started) | {"failures": failures}

    def status(self, tally: dict[str, Any], running: bool, uptime: float) -> dict[str, Any]:
        """Status row with the given counters."""
        parts = {f"{k}s": len(self.spec.get(f"{k}s", [])) for k in ("source", "processor", "sink")}
        return {"name": self.name, "running": running, **parts, **tally, "uptime": uptime}


def _check_policy(on_error: str) -> None:
    if on_error not in ("record", "fail"):
        raise ValueError(f"Invalid on_error: {on_error}")


def observed(seen: Observation, patience: float = 5.0) -> dict[str, int]:
    """The observed counters; nothing if no query with them has run to its end, as where a sink ran none.

    They arrive shortly after such a query has ended, which ``patience`` (seconds) allows for.
    """
    until = time.time() + patience
    while seen._jo is not None and not seen._jo.future().isCompleted():
        if time.time() > until:
            return {}
        time.sleep(0.02)
    if seen._jo is None:
        return {}
    return {k: int(seen.get.get(k) or 0) for k in metrics.COUNTERS}
