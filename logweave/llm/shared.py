"""Helpers the operators share: written intermediate tables, free column names, code for the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from logweave.session import shared_dir

PACKAGE = Path(__file__).resolve().parents[1]
BATCH_ROWS = 1000  # sent to a Python worker at a time, unless the cluster says otherwise


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: what follows reads files that every executor reaches, so a lost
    executor costs the tasks that were running on it and nothing upstream.
    """
    path = shared_dir(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` would; once per context.

    Nothing is sent where the workers find it anyway: it is installed or on ``PYTHONPATH``. Batches
    for the workers are kept short, as texts are long and idle workers keep the memory they once had.
    """
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root, context = str(PACKAGE.parent), spark.sparkContext
    near = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in root
    if near or (context.master.startswith("local[") and os.path.realpath(os.getcwd()) == root) or getattr(context, "_logweave_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="logweave-code-"), "logweave.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._logweave_shipped = True
