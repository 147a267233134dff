"""The shape every operator has: ``op(**config)`` gives a step, ``df.transform(step)`` runs it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.once import once


@dataclass(frozen=True)
class Verdict:
    """Which rows a step keeps, and which of the others it drops because of an error."""

    keep: Column
    error: Column | None = None
    message: str = ""


@dataclass(frozen=True)
class Step:
    """A DataFrame -> DataFrame operator that may drop rows between two rewrites."""

    name: str
    prepare: Callable[[DataFrame], DataFrame] | None = None
    judge: Callable[[DataFrame], Verdict] | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        df = self.prepare(df) if self.prepare else df
        df = df.where(self.judge(df).keep) if self.judge else df
        return self.finish(df) if self.finish else df

    def audited(self, df: DataFrame, status: str) -> DataFrame:
        """Run without dropping: a rejected row records why in the ``status`` struct."""
        df = self.prepare(df) if self.prepare else df
        if self.judge:
            verdict = self.judge(df)
            error = F.lit(False) if verdict.error is None else F.coalesce(verdict.error, F.lit(False))
            message = F.lit(verdict.message)
            rejected = F.when(error, reason("error", self.name, message)).when(
                ~F.coalesce(verdict.keep, F.lit(False)),
                reason("filtered", self.name, message if verdict.error is None else F.lit("")),
            )
            so_far = F.col(status)
            df = once(df, status, F.when(so_far["state"] != "ok", so_far).otherwise(F.coalesce(rejected, so_far)))
        return self.finish(df) if self.finish else df


def reason(state: str, stage: str, message: Column) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(stage).alias("stage"), message.alias("message"))


def chain(name: str, *steps: Callable[[DataFrame], DataFrame]) -> Step:
    """Several rewrites as one step."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return Step(name, finish=run)
