"""Line sources: files, directories of rolled files and object prefixes."""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logweave.files import Files
from logweave.functions import text as tx
from logweave.functions.prefix import with_running_sum
from logweave.model import to_events
from logweave.operators.joins import fits_broadcast, left_lookup
from logweave.sources.follow import SPLIT, growing_lines


def _lines(
    spark: SparkSession, path: str | list[str], stream: bool = False, max_files: int | None = None, **options
) -> DataFrame:
    """Lines with the path, block and modification time of the file they come from."""
    reader = spark.readStream if stream else spark.read
    for key, value in options.items():
        reader = reader.option(key, value)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def _mark(**entries: Column) -> Column:
    """Metadata map of variants; a NULL entry becomes a JSON null."""
    null = F.parse_json(F.lit("null"))
    parts = []
    for key, value in entries.items():
        parts += [F.lit(key), F.coalesce(value.cast("variant"), null)]
    return F.create_map(*parts)


def files(
    spark: SparkSession,
    path: str,
    tail: bool = False,
    read_from_start: bool | None = None,
    started_at: str | None = None,
    with_position: bool = False,
    in_file_order: bool = False,
    max_files_per_trigger: int | None = None,
    growing: bool | None = None,
    split_bytes: int = SPLIT,
) -> DataFrame:
    """Events from the non-blank lines of a file or a directory of rolled files.

    ``tail`` follows the directory as a stream: a rolled or replaced file is a new file. With ``growing`` a stream
    follows what is added to files as well (``follow.py``; files of a mounted file system only); it begins at their
    present ends unless ``read_from_start``. Left open, it is so where ``path`` is one file there.
    A stream starts with the files modified since ``started_at`` (UTC text, default: now)
    unless ``read_from_start``; a batch reads all unless that is False. ``with_position`` adds the character offset of each line (batch only), which
    also makes ids repeatable. ``in_file_order`` sorts by modification time, oldest first.
    """
    if tail and (growing or (growing is None and os.path.isfile(path))):
        return _growing(growing_lines(spark, path, bool(read_from_start), split_bytes))
    lines = _lines(spark, path, stream=tail, max_files=max_files_per_trigger)
    if not (not tail if read_from_start is None else read_from_start):
        # A constant: the start time must not move on with every micro-batch.
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        lines = lines.where(F.col("modified") >= F.lit(started_at or now).cast("timestamp"))
    if with_position and not tail:
        lines = with_file_position(lines)
        lines = lines.withColumn("id", line_id())
    if in_file_order and not tail:
        lines = lines.withColumn("_row", F.monotonically_increasing_id())
        lines = lines.orderBy("modified", "path", "block", "_row")
    positioned = "position" in lines.columns
    entries = {"file_path": F.col("path")}
    if positioned:
        entries["file_position"] = F.col("position")
    lines = lines.withColumn("value", tx.strip("value")).where(F.col("value") != "")
    given = {"id": F.col("id")} if positioned else {}
    return to_events(
        lines, **given, source_type=F.lit("file"), source_name=F.col("path"), raw_data=F.col("value"),
        metadata=_mark(**entries),
    )


def _growing(lines: DataFrame) -> DataFrame:
    """Events of lines with a byte position; the same line of the same file has the same id whenever it is read.

    Bytes that are no UTF-8 text become hex text and a ``decode_error`` entry.
    """
    valid = F.is_valid_utf8(F.col("value").cast("string"))
    text = F.when(valid, F.col("value").cast("string")).otherwise(F.lower(F.hex("value")))
    lines = lines.withColumns({"valid": valid, "text": tx.strip(text)}).where(F.col("text") != "")
    mark = _mark(file_path=F.col("path"), file_position=F.col("position"))
    failed = F.map_concat(mark, _mark(decode_error=F.lit("not UTF-8, shown as hex")))
    return to_events(
        lines, id=F.sha2(F.concat_ws("|", "file", F.col("position").cast("string"), "text"), 256), source_type=F.lit("file"),
        source_name=F.col("path"), raw_data=F.col("text"), metadata=F.when(F.col("valid"), mark).otherwise(failed),
    )


def with_file_position(lines: DataFrame) -> DataFrame:
    """Add ``position``: characters before the line in its file, one per line end.

    Two levels, so that no task sees a whole file and no line is shuffled: a running sum within an input split, as
    the split is read, plus the length of the splits before it, which is a table of a row per split. The splits
    are read twice; should the cluster cut them differently the second time, the query
    fails instead of giving wrong offsets.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lines.groupBy("path", "block").agg(F.sum(F.length("value") + 1).alias("_length"))
    splits = lengths.select(_split("path", "block"), F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_start"))
    sized = lines.withColumn("_size", F.coalesce(F.length("value"), F.lit(0)) + 1)
    offsets = with_running_sum(sized, ["path", "block"], "_size", "_offset").withColumn("_split", _split("path", "block"))
    joined = left_lookup(offsets, splits, "_split", fits_broadcast(splits))
    start = F.coalesce("_start", F.raise_error(F.lit("input splits changed between two reads")).cast("bigint"))
    return joined.withColumn("position", start + F.col("_offset")).drop("_split", "_size", "_offset", "_start")


def _split(path: str, block: str) -> Column:
    return F.concat_ws("|", path, F.col(block).cast("string")).alias("_split")


def line_id(path: str = "path", position: str = "position") -> Column:
    """An id that follows from where a line stands."""
    return F.sha2(F.concat_ws("|", path, F.col(position).cast("string")), 256)


def listing(spark: SparkSession, bucket: str, prefix: str = "", scheme: str | None = "s3a") -> DataFrame:
    """``(path, key, size, modified)`` of all objects under a prefix, names that Spark's readers pass over included.

    Those begin with ``_`` or ``.``, themselves or a folder above them. All others are listed by Spark, on the
    executors if they are many; the passed-over ones are asked of the file system folder level by folder level.
    """
    root, pattern = _places(bucket, prefix, scheme)
    found = "path string, size bigint, modified timestamp"
    try:
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
        seen = seen.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    except AnalysisException:  # nothing of that name, or only passed-over names
        seen = spark.createDataFrame([], found)
    hidden = [(path, size, datetime.fromtimestamp(ms / 1000, timezone.utc)) for path, size, ms in Files(spark, root).hidden(pattern)]
    every = seen.unionByName(spark.createDataFrame(hidden, found)).dropDuplicates(["path"]) if hidden else seen
    return every.withColumn("key", F.regexp_replace("path", _before_key(bucket), ""))


def _places(bucket: str, prefix: str, scheme: str | None) -> tuple[str, str]:
    """The root of the bucket, and a pattern for what is under the prefix."""
    root = f"{scheme}://{bucket.rstrip('/')}" if scheme else bucket.rstrip("/")
    return root, f"{root}/{literal_path(prefix)}*" if prefix and not prefix.endswith("/") else f"{root}/{literal_path(prefix)}"


def literal_path(path: str) -> str:
    """A path whose characters mean themselves where patterns are read."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def _before_key(bucket: str) -> str:
    """Everything up to the bucket's end; paths may name a host between scheme and folder."""
    folder = bucket.split("://")[-1].strip("/")
    return rf"^[a-z0-9]+:/.*?\Q{folder}\E/"


def objects(
    spark: SparkSession,
    bucket: str,
    prefix: str = "",
    region: str = "us-east-1",
    scheme: str | None = "s3a",
    tail: bool = False,
    processed: DataFrame | None = None,
    max_files_per_trigger: int | None = None,
    stable_ids: bool = False,
    skip_hidden: bool = False,
) -> DataFrame:
    """Events from the non-blank lines of all objects under a prefix; lines are not stripped.

    Without a ``scheme`` the bucket is a folder of the default file system. ``tail`` polls for new objects (whose
    names must not begin with ``_`` or ``.``); ``processed(key)`` leaves out the objects read before, which are taken from the
    ``listing`` before anything is read. Objects in folders of such names are read; one whose own name begins so
    raises an error, as Spark's readers pass over it, unless it is empty or ``skip_hidden`` leaves such objects out. With ``stable_ids`` the id of an event follows from object and place (batch only).
    Credentials are file system settings of the session.
    """
    if not bucket:
        raise ValueError("S3 bucket is required")
    _, pattern = _places(bucket, prefix, scheme)
    if tail:
        lines = _lines(spark, pattern, stream=True, max_files=max_files_per_trigger, recursiveFileLookup="true")
    else:
        wanted = listing(spark, bucket, prefix, scheme)
        if processed is not None:
            wanted = new_objects(wanted, processed)
        wanted = wanted.where("size > 0").select("path", F.col("path").rlike("/[_.][^/]*$").alias("no"))
        rows = [(r["path"], r["no"]) for r in wanted.toLocalIterator()]
        unread = sorted(path for path, no in rows if no)
        if unread and not skip_hidden:
            raise ValueError(f"Spark reads no object whose own name begins with _ or . ({len(unread)}, the first is {unread[0]})")
        paths = [literal_path(path) for path, no in rows if not no]
        lines = _lines(spark, paths) if paths else spark.createDataFrame([], "value string, path string, block bigint, modified timestamp")
    given = {}
    if stable_ids and not tail:
        lines = with_file_position(lines)
        given = {"id": line_id()}
    key = F.regexp_replace("path", _before_key(bucket), "")
    lines = lines.withColumn("key", F.url_decode(F.replace(key, F.lit("+"), F.lit("%2B"))))
    lines = lines.where(tx.strip(F.col("value")) != "")
    return to_events(
        lines,
        **given,
        source_type=F.lit("s3"),
        source_name=F.concat(F.lit(f"s3://{bucket}/"), F.col("key")),
        raw_data=F.col("value"),
        metadata=_mark(s3_bucket=F.lit(bucket), s3_key=F.col("key"), s3_region=F.lit(region)),
    )


def new_objects(rows: DataFrame, processed: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose object key is not among the processed ones.

    ``processed`` is broadcast while it is small; beyond that a hot object's rows are cut
    into slices for the shuffle.
    """
    seen = processed.select(F.col(key).cast("string").alias(key)).distinct().withColumn("_seen", F.lit(True))
    small = fits_broadcast(processed.select(key))
    return left_lookup(rows, seen, key, small).where(F.col("_seen").isNull()).drop("_seen")
