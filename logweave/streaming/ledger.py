"""What a flow has delivered: markers per batch and sink, rows staged for several sinks, running counters.

A ledger is a folder beside the checkpoint of a stream, on the file system that folder names:

* ``batch=<id>/<sink>.done``: the sink has the rows of the batch. A batch that is run again skips it.
* ``batch=<id>/rows``: the rows of a batch, written once and read by all its sinks. They stay until every sink
  has them, so a sink that failed gets its rows later, and ids made anew by a repeated run cannot differ.
* ``totals/<id>.json``: the counters up to and with that batch. A repeated batch replaces its file.

Each file is made by one atomic step, so a crash leaves the entry out or whole. Folders of batches that are through
are removed, but for the last one, and so are totals but for the last two.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from logweave.files import Files, stage


class Ledger:
    """Entries of one flow."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def delivered(self, batch: int) -> set[str]:
        return {n.removesuffix(".done") for n in self.files.names(f"batch={batch}") if n.endswith(".done")}

    def mark(self, batch: int, sink: str) -> None:
        self.files.put(f"batch={batch}/{sink}.done")

    def batches(self) -> list[int]:
        return sorted(int(n.removeprefix("batch=")) for n in self.files.names("") if n.startswith("batch="))

    def staged(self, batch: int) -> DataFrame | None:
        """The rows of a batch, if they were staged to their end."""
        if not self.files.exists(f"batch={batch}/rows/_SUCCESS"):
            return None
        return self.spark.read.parquet(self.files.at(f"batch={batch}/rows"))

    def stage(self, batch: int, df: DataFrame) -> DataFrame:
        rows = self.staged(batch)
        return stage(df, self.files.at(f"batch={batch}/rows")) if rows is None else rows

    def settle(self, batch: int, sinks: Iterable[str]) -> None:
        """Drop what is no longer needed once all ``sinks`` have the batch."""
        if set(sinks) <= self.delivered(batch):
            self.files.remove(f"batch={batch}/rows")
            for old in self.batches():
                if old < batch and set(sinks) <= self.delivered(old):
                    self.files.remove(f"batch={old}")

    def waiting(self, sinks: Iterable[str], before: int | None = None) -> list[int]:
        """Batches with staged rows that a sink has not got."""
        return [b for b in self.batches() if (before is None or b < before) and not set(sinks) <= self.delivered(b) and self.staged(b) is not None]

    def count(self, batch: int, counters: dict[str, int]) -> None:
        """Add the counters of a batch to those of the batches before it; once, however often the batch is run."""
        known = self._totals()
        before = known.get(max((b for b in known if b < batch), default=-1), {})
        self.files.put(f"totals/{batch}.json", json.dumps({k: before.get(k, 0) + n for k, n in counters.items()}))
        for old in sorted(known)[:-1]:
            if old < batch:
                self.files.remove(f"totals/{old}.json")

    def totals(self) -> dict[str, int]:
        known = self._totals()
        return known[max(known)] if known else {}

    def _totals(self) -> dict[int, dict[str, int]]:
        names = [n for n in self.files.names("totals") if n.endswith(".json")]
        return {int(n.removesuffix(".json")): json.loads(self.files.get(f"totals/{n}")) for n in names}
