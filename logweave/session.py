"""Session settings the operators rely on, and where jobs may put shared files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings; each keeps what the user set explicitly.
DEFAULTS = {
    # Event times are UTC wall clock, so text forms must not follow the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of making the document invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Setting a field that is there replaces it, without searching the map for it first.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Hot keys are split at run time even where that costs one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_configured: set[int] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``DEFAULTS`` once per session and return the session."""
    if id(spark) not in _configured:
        explicit = dict(spark.sparkContext.getConf().getAll())
        for key, value in DEFAULTS.items():
            if key not in explicit:
                spark.conf.set(key, value)
        _configured.add(id(spark))
    return spark


def last_key_wins(spark: SparkSession) -> bool:
    """Whether joining maps keeps the last value of a repeated key."""
    return spark.conf.get("spark.sql.mapKeyDedupPolicy").upper() == "LAST_WIN"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the duration of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def lasting_dir(spark: SparkSession, label: str) -> str | None:
    """The folder of that label under ``spark.checkpoint.dir``, the same in every session; none without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/logweave/{label}" if root else None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the root in ``spark.checkpoint.dir``. Only a local-mode
    session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="logweave-")
    return f"{root.rstrip('/')}/logweave/{label}-{uuid.uuid4().hex}"
