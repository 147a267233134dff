"""Custom per-event functions as steps, with a verdict for every row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logweave.model import event_document, from_documents
from logweave.operators.base import Step, reason

_Function = Callable[[dict[str, Any]], dict[str, Any] | None]
_VERDICT = "state string, message string"


@dataclass(frozen=True)
class EventStep(Step):
    """A step made of a Python function; see ``python_step``."""

    function: _Function | None = None
    on_error: str = "drop"

    def __call__(self, df: DataFrame) -> DataFrame:
        done = self._run(df, F.lit(True))
        if self.on_error == "fail":
            failed = F.raise_error(F.concat(F.lit(f"{self.name}: "), F.col("_verdict.message"))).cast("boolean")
            done = done.where(F.when(F.col("_verdict.state") == "error", failed).otherwise(True))
        return from_documents(done.where(F.col("_verdict.state") == "ok"), "value")

    def audited(self, df: DataFrame, status: str) -> DataFrame:
        """Run without dropping: a row that was rejected before never meets the function and stays as it is."""
        done = self._run(df, F.col(status)["state"] == "ok", status)
        state, message = F.col("_verdict.state"), F.col("_verdict.message")
        now = F.when(state == "error", reason("error", self.name, message))
        now = now.when(state == "filtered", reason("filtered", self.name, F.lit("")))
        done = done.withColumn(status, now.otherwise(F.col(status)))
        return from_documents(done, "value", status)

    def _run(self, df: DataFrame, going, *along: str) -> DataFrame:
        """``(value, _verdict, *along)``: the document of each event, changed where the verdict is ``ok``.

        A row that is not ``going`` has no verdict. Kept, dropped and failed rows leave by the same pass.
        """
        document = event_document(df.drop(*along)).alias("value")
        rows = df.select(document, F.coalesce(going, F.lit(False)).alias("_going"), *along)
        fields = [rows.schema["value"], T.StructField("_verdict", T.StructType.fromDDL(_VERDICT)), *(rows.schema[c] for c in along)]
        return rows.mapInArrow(_verdicts(self.function, list(along)), T.StructType(fields))


def _verdicts(function: _Function, along: list[str]):
    def one(document: str) -> tuple[str, str, str | None]:
        try:
            event = function(json.loads(document))
            if event is None:
                return document, "filtered", None
            if not isinstance(event, dict):
                raise TypeError(f"an event is a dictionary, not {type(event).__name__}")
            return json.dumps(event, allow_nan=False), "ok", None
        except Exception as error:  # noqa: BLE001 - whatever a custom function raises is the fate of its row alone
            return document, "error", f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("value").to_pylist(), batch.column("_going").to_pylist())
            done = [one(document) if going else (document, None, None) for document, going in rows]
            documents, states, messages = ([d[i] for d in done] for i in range(3))
            verdict = pa.StructArray.from_arrays([pa.array(states, pa.string()), pa.array(messages, pa.string())], ["state", "message"])
            columns = [pa.array(documents, pa.string()), verdict, *(batch.column(c) for c in along)]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "_verdict", *along])

    return run


def python_step(function: _Function, name: str = "python", on_error: str = "drop") -> Step:
    """A custom per-event function as a step over open-layout events.

    It gets the event as a dictionary and returns it, changed or not, or ``None`` to drop it. A row for which it
    raises, or gives what is no event, is dropped as an error and the others go on; audited, it keeps the event as it
    was, with the error as message. ``on_error="fail"`` ends the job instead. Rows travel in Arrow batches;
    built-in steps do not pay this price.
    """
    if on_error not in ("drop", "fail"):
        raise ValueError(f"Invalid on_error: {on_error}")
    return EventStep(name, function=function, on_error=on_error)
