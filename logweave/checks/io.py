"""Sources, sinks, the event model and the counters."""

import math

from pyspark.sql import Window, functions as F

from logweave.checks.base import ISO, LEVEL, field_text, level, open_events, query
from logweave.files import stage
from logweave.functions.once import once
from logweave.functions.text import iso_text
from logweave.metrics import STATUS, errors, rollup
from logweave.model import event_document, from_documents
from logweave.operators.base import reason
from logweave.operators.custom import python_step
from logweave.operators.filter import filter_events
from logweave.operators.joins import fits_broadcast, left_lookup
from logweave.operators.json import parse_json
from logweave.session import setting, shared_dir
from logweave.sinks import lines as out, search
from logweave.sources import kafka as mq, text as src, winlog as win
from logweave.sources.union import fan_in

_LINES = "(SELECT lang, unnest(str_split(text, e'\\n')) AS line FROM documents)"


def _text_folder(t, label):
    """Document texts as text files, one folder per language; their line ends cut lines."""
    folder = shared_dir(t.spark, label)
    t("documents").select("text", "lang").write.partitionBy("lang").text(folder)
    return folder


@query("source_file_scan", f"SELECT trim(line, e' \\t\\n\\r') AS raw_data, 'file' AS source_type FROM {_LINES} WHERE trim(line, e' \\t\\n\\r') <> ''")
def source_file_scan(t):
    return src.files(t.spark, _text_folder(t, "scan")).select("raw_data", "source_type")


ORDERED_BYTES = 32 << 20  # about, of what one task of ``_ordered_folder`` writes


def _ordered_folder(t, label):
    """As ``_text_folder``, the documents of a language in the order of their ids, over files whose names sort in that order."""
    folder = shared_dir(t.spark, label)
    docs = t("documents").where("text IS NOT NULL").select("text", "lang", "doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("lang", "doc_id", F.xxhash64("text"))  # documents of the same id need not stay together
    ordered = docs.repartitionByRange(math.ceil(size / ORDERED_BYTES) or 1, *order).sortWithinPartitions(*order)
    ordered.select("text", "lang").write.partitionBy("lang").text(folder)
    return folder


@query(
    "source_file_position",
    """SELECT lang, line, CAST(sum(length(line) + 1) OVER (PARTITION BY lang ORDER BY doc_id, n) - length(line) - 1 AS BIGINT) AS position FROM
    (SELECT lang, doc_id, unnest(str_split(text, e'\n')) AS line, generate_subscripts(str_split(text, e'\n'), 1) AS n FROM documents WHERE text IS NOT NULL)""",
)
def source_file_position(t):
    """The position of every line among those of its language: that in its file, in splits of 64 KiB, after the files before."""
    with setting(t.spark, "spark.sql.files.maxPartitionBytes", "64k"):
        lines = src.with_file_position(src._lines(t.spark, _ordered_folder(t, "position")))
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")
    rows = stage(lines.select("path", lang, F.col("value").alias("line"), "position"), shared_dir(t.spark, "positions"))
    lengths = rows.groupBy("lang", "path").agg(F.max(F.col("position") + F.length("line") + 1).alias("_length"))
    before = Window.partitionBy("lang").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(lengths.select("path", F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_start")), shared_dir(t.spark, "starts"))
    placed = left_lookup(rows, starts, "path", fits_broadcast(starts))
    return placed.select("lang", "line", (F.col("position") + F.col("_start")).alias("position"))


@query("stable_ids", "SELECT count(*) AS n_lines, count(*) AS n_ids, CAST(0 AS BIGINT) AS changed FROM (SELECT unnest(str_split(text, e'\n')) AS line FROM documents WHERE text IS NOT NULL) WHERE trim(line, e' \t\n\r') <> ''")
def stable_ids(t):
    """Ids of two reads, of files and of objects, the second in splits of another size."""
    folder = _ordered_folder(t, "ids")
    read = {}
    for way, size in (("files", "1m"), ("objects", "100k")):
        with setting(t.spark, "spark.sql.files.maxPartitionBytes", size):
            rows = src.files(t.spark, folder, with_position=True) if way == "files" else src.objects(t.spark, folder, "lang=", scheme=None, stable_ids=True)
            read[way] = stage(rows.select("id", F.trim("raw_data").alias("raw_data")), shared_dir(t.spark, f"ids-{way}"))
    # Ids alone are joined: whether a line is there, not the line.
    there = {way: rows.select("id", F.when(F.col("raw_data").isNotNull(), True).alias(name)) for (way, rows), name in zip(read.items(), ("raw_data", "other"))}
    both = there["files"].join(there["objects"], "id", "full")
    odd = F.count_if(F.col("raw_data").isNull() | F.col("other").isNull()).alias("changed")
    return both.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("id").alias("n_ids"), odd)


def _object_key():
    return F.try_variant_get(F.try_element_at("metadata", F.lit("s3_key")), "$", "string")


def _object_lang():
    return F.regexp_extract(_object_key(), "lang=([^/]+)/", 1).alias("lang")


@query("source_objects", f"SELECT lang, line AS raw_data FROM {_LINES} WHERE trim(line, e' \\t\\n\\r') <> ''")
def source_objects(t):
    rows = src.objects(t.spark, _text_folder(t, "objects"), "lang=", scheme=None)
    return rows.select(_object_lang(), "raw_data")


@query("source_incremental", f"SELECT lang, line AS raw_data FROM {_LINES} WHERE trim(line, e' \\t\\n\\r') <> '' AND lang NOT IN ('de', 'es')")
def source_incremental(t):
    """Objects read before, here those of two languages, are left out."""
    folder = _text_folder(t, "incremental")
    before = fan_in(*(src.objects(t.spark, folder, f"lang={lang}/", scheme=None) for lang in ("de", "es")))
    seen = before.select(_object_key().alias("key")).distinct()
    rows = src.objects(t.spark, folder, "lang=", scheme=None, processed=seen)
    assert not any("lang=de" in f or "lang=es" in f for f in rows.inputFiles())  # they are not even read
    return rows.select(_object_lang(), "raw_data")


@query(
    "source_objects_hidden",
    f"""SELECT 'data' AS folder, lang, line AS raw_data FROM {_LINES} WHERE trim(line, e' \t\n\r') <> ''
    UNION ALL SELECT '_data', lang, line FROM {_LINES} WHERE trim(line, e' \t\n\r') <> '' UNION ALL SELECT 'data/.in', lang, line FROM {_LINES} WHERE trim(line, e' \t\n\r') <> ''""",
)
def source_objects_hidden(t):
    """Objects in folders that Spark's readers pass over count like any other."""
    root = shared_dir(t.spark, "hidden")
    for name in ("data", "_data", "data/.in"):
        t("documents").select("text", "lang").write.partitionBy("lang").text(f"{root}/{name}")
    rows = src.objects(t.spark, root, scheme=None)
    folder = F.regexp_extract(_object_key(), "^(.*)/lang=", 1).alias("folder")
    return rows.select(folder, _object_lang(), "raw_data")


@query(
    "source_start_position",
    f"SELECT trim(line, e' \\t\\n\\r') AS raw_data FROM {_LINES} WHERE trim(line, e' \\t\\n\\r') <> ''",
)
def source_start_position(t):
    """Files modified since the start time count, those before it do not."""
    folder = _text_folder(t, "start")
    new = src.files(t.spark, folder, read_from_start=False, started_at="2000-01-01 00:00:00")
    none = src.files(t.spark, folder, read_from_start=False, started_at="2100-01-01 00:00:00")
    return fan_in(new, none).select("raw_data")


@query(
    "source_union",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(NULL AS VARCHAR) AS text FROM events
    UNION ALL SELECT CAST(conv_id AS VARCHAR) || '/' || turn, role, text FROM conversations""",
)
def source_union(t):
    events = t("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"))
    talks = t("conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("id"), F.col("role").alias("kind"), "text")
    return fan_in(events, talks)


@query(
    "source_kafka_events",
    f"""SELECT CASE event_type WHEN 'error' THEN '41ff' ELSE props END AS raw_data, event_type AS source_name, event_id AS kafka_offset,
    CAST(epoch_us(ts) // 1000 AS BIGINT) AS kafka_timestamp, CASE event_type WHEN 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS kafka_key,
    'production' AS environment, event_type = 'error' AS failed FROM events""",
)
def source_kafka_events(t):
    kind = F.col("event_type")
    rows = t("events").select(
        F.when(kind != "view", F.encode(F.col("user_id").cast("string"), "UTF-8")).alias("key"),
        F.when(kind == "error", F.unhex(F.lit("41FF"))).otherwise(F.encode("props", "UTF-8")).alias("value"),
        kind.alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    events = mq.kafka_events(rows, {"environment": "production"})

    def entry(name, kind):
        return F.try_variant_get(F.try_element_at("metadata", F.lit(name)), "$", kind).alias(name)

    return events.select(
        "raw_data", "source_name", entry("kafka_offset", "bigint"), entry("kafka_timestamp", "bigint"), entry("kafka_key", "string"),
        entry("environment", "string"), F.map_contains_key("metadata", "decode_error").alias("failed"),
    )


_CHANNEL = "CASE event_type WHEN 'error' THEN 'Security' WHEN 'click' THEN 'System' WHEN 'view' THEN 'Setup' WHEN 'signup' THEN 'Application' END"
_PROVIDER = "CASE WHEN user_id % 2 = 0 THEN 'Kernel' ELSE 'Auth' END"


def _winlog_lines(t):
    """Event records as JSON lines; purchases have no channel, every fifth user an unreadable level."""
    kind, user = F.col("event_type"), F.col("user_id")
    channel = F.when(kind == "error", "Security").when(kind == "click", "System").when(kind == "view", "Setup").when(kind == "signup", "Application")
    provider = F.when(user % 2 == 0, "Kernel").otherwise("Auth")
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        F.concat(F.lit("User: "), user).alias("message"),
        F.struct(
            channel.alias("channel"), F.when(user % 5 == 0, "high").otherwise((user % 7).cast("string")).alias("level"),
            (F.col("event_id") % 10 + 4620).cast("string").alias("event_id"), F.lit("C1").alias("computer_name"),
            F.col("event_id").alias("record_id"), F.when(user % 2 == 0, F.struct(provider.alias("name"))).alias("provider"),
            F.when(user % 2 != 0, provider).alias("provider_name"),
            F.when(kind == "error", F.struct(user.alias("id"))).alias("event_data"),
        ).alias("winlog"),
    )
    return once(t("events"), "value", F.to_json(record)).select("value")


@query(
    "source_winlog_filter",
    f"""SELECT event_id AS record_id, {_CHANNEL} AS channel FROM events
    WHERE {_CHANNEL} IN ('Application', 'System', 'Security') AND user_id % 5 <> 0 AND user_id % 7 >= 2
    AND event_id % 10 IN (4, 5, 7) AND {_PROVIDER} = 'Auth'""",
)
def source_winlog_filter(t):
    rows = win.winlog_events(_winlog_lines(t), level=2, event_ids=[4624, 4625, 4627], providers=["Auth"])
    return rows.select(field_text("record_id").cast("bigint").alias("record_id"), F.col("source_name").alias("channel"))


@query(
    "source_winlog_project",
    f"""SELECT CAST(event_id AS VARCHAR) AS record_id, COALESCE({_CHANNEL}, 'unknown') AS source_name, {ISO} AS time,
    CAST(event_id % 10 + 4620 AS VARCHAR) AS event_id, {_PROVIDER} AS provider, 'User: ' || user_id AS message, 'C1' AS computer_name,
    CASE event_type WHEN 'error' THEN '{{"id":' || user_id || '}}' END AS event_data, CAST(CASE event_type WHEN 'error' THEN 10 ELSE 9 END AS INTEGER) AS n_fields
    FROM events""",
)
def source_winlog_project(t):
    rows = win.winlog_events(_winlog_lines(t), channels=[])
    names = ("record_id", "event_id", "provider", "message", "computer_name", "event_data")
    return rows.select(
        *(field_text(n).alias(n) for n in names), "source_name", iso_text(F.col("timestamp")).alias("time"), F.size("fields").alias("n_fields")
    )


@query(
    "source_winlog_directory",
    f"""SELECT event_id AS record_id, {_CHANNEL} AS channel, 'directory' AS mode FROM events
    WHERE {_CHANNEL} IN ('Application', 'System', 'Security')""",
)
def source_winlog_directory(t):
    """A folder of record files, oldest first, with other lines between the records."""
    folder = shared_dir(t.spark, "winlog")
    _winlog_lines(t).write.text(folder)
    t("documents").select("text").write.mode("append").text(folder)
    rows = win.winlog(t.spark, folder, mode="directory", in_file_order=True)
    mode = F.try_variant_get(F.try_element_at("metadata", F.lit("winlog_source")), "$", "string")
    return rows.select(field_text("record_id").cast("bigint").alias("record_id"), F.col("source_name").alias("channel"), mode.alias("mode"))


@query(
    "source_events_from_json",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, {ISO} AS time, props AS raw_data, event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value FROM events""",
)
def source_events_from_json(t):
    events = open_events(t)
    again = from_documents(events.select(event_document(events).alias("value")))
    value = F.try_variant_get(F.try_element_at("fields", F.lit("value")), "$", "double")
    return again.select(
        "id", iso_text(F.col("timestamp")).alias("time"), "raw_data", field_text("event_type").alias("event_type"), value.alias("value")
    )


def _typed_events(t):
    return t("events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.lit("table").alias("source_type"),
        F.col("props").alias("raw_data"), level().alias("level"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("message"),
    )


@query(
    "sink_template",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN {ISO} || ' ' || props
    ELSE {ISO} || ' [' || {LEVEL} || '] ' || CAST(value AS VARCHAR) || ': ' || CASE event_type WHEN 'view' THEN props ELSE event_type END END AS line FROM events""",
)
def sink_template(t):
    """A line with a missing value falls back to time and raw line."""
    events = _typed_events(t)
    return events.select("id", out.render_template(events, "{timestamp} [{level}] {value}: {message}").alias("line"))


@query(
    "sink_template_open",
    f"""SELECT CASE event_type WHEN 'error' THEN {ISO} || ' ' || props ELSE event_id || ' ' || event_type || ' ' || CAST(value AS VARCHAR) || ' ' || props END AS line
    FROM events""",
)
def sink_template_open(t):
    events = open_events(t)
    return events.select(out.render_template(events, "{id} {event_type} {value} {message}").alias("line"))


_DOCUMENT = f"""'{{"id":"' || event_id || '","timestamp":"' || {ISO} || '","source_type":"table","raw_data":' || to_json(props)
    || ',"fields":{{"level":"' || {LEVEL} || '"' || CASE event_type WHEN 'error' THEN '' ELSE ',"value":' || value END
    || CASE event_type WHEN 'view' THEN '' ELSE ',"message":"' || event_type || '"' END || '}},"metadata":{{}},"tags":[]}}'"""


@query("sink_json_document", f"SELECT {_DOCUMENT} AS document FROM events")
def sink_json_document(t):
    events = _typed_events(t)
    return events.select(event_document(events).alias("document"))


@query(
    "sink_bulk_actions",
    f"""SELECT 'app-' || strftime(ts, '%Y.%m.%d') || '-h' || strftime(ts, '%H') AS _index, CAST(event_id AS VARCHAR) AS _id, {_DOCUMENT} AS _source FROM events""",
)
def sink_bulk_actions(t):
    return search.bulk_actions(_typed_events(t), "app-{yyyy.MM.dd}-h{HH}")


@query("sink_index_name", "SELECT event_id, 'logs-' || strftime(ts, '%Y.%m.%d') AS name FROM events")
def sink_index_name(t):
    return t("events").select("event_id", search.index_name(timestamp="ts").alias("name"))


@query(
    "sink_bulk_files",
    f"""SELECT 'logs-' || strftime(ts, '%Y.%m.%d') AS _index, CAST(event_id AS VARCHAR) AS _id, {_DOCUMENT} AS _source FROM events""",
)
def sink_bulk_files(t):
    """Bulk request files written and read back: every action line with the document line below it."""
    folder, head = shared_dir(t.spark, "bulk"), '{"index":'
    search.write_bulk_files(_typed_events(t), folder, requests_per_file=2)
    pairs = t.spark.read.option("lineSep", head).text(folder).where("value <> ''").select(F.split("value", "\n").alias("line"))
    action = F.concat(F.lit(head), F.col("line")[0])
    return pairs.select(
        F.get_json_object(action, "$.index._index").alias("_index"), F.get_json_object(action, "$.index._id").alias("_id"), F.col("line")[1].alias("_source")
    )


@query(
    "sink_partition_columns",
    """SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour, count(*) AS n
    FROM events GROUP BY ALL""",
)
def sink_partition_columns(t):
    """Objects written by hour and read back."""
    folder = shared_dir(t.spark, "hours")
    out.write_objects(_typed_events(t), folder, "logs", format="text", scheme=None)
    keys = ("year", "month", "day", "hour")
    lines = t.spark.read.schema("value string, year string, month string, day string, hour string").text(f"{folder}/logs")
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_file_size",
    f"""SELECT strftime(date_trunc('week', ts), '%d') AS day,
    CAST(sum(strlen({LEVEL} || ' ' || event_id || ' ' || CASE event_type WHEN 'view' THEN props ELSE event_type END) + 1) AS BIGINT) AS bytes, TRUE AS well_sized
    FROM events GROUP BY ALL""",
)
def sink_file_size(t):
    """Objects written with a size, their files measured: all but the last one of each hour come within a tenth of it."""
    folder, size = shared_dir(t.spark, "sizes"), 16 << 10
    events = _typed_events(t).withColumn("timestamp", F.date_trunc("week", "timestamp"))
    out.write_objects(events, folder, "logs", format="text", template="{level} {id} {message}", buffer_size=size, scheme=None)
    written = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/logs")
    files = written.select(F.regexp_extract("path", "/day=([0-9]+)/", 1).alias("day"), "length")
    off = F.count_if((F.col("length") < 0.9 * size) | (F.col("length") > 1.1 * size))
    return files.groupBy("day").agg(F.sum("length").alias("bytes"), (off <= 1).alias("well_sized"))


@query(
    "sink_write_files",
    f"""SELECT {ISO} || ' ' || CASE event_type WHEN 'view' THEN props ELSE event_type END AS value FROM events
    UNION ALL SELECT {ISO} || ' ' || CASE event_type WHEN 'view' THEN props ELSE event_type END FROM events""",
)
def sink_write_files(t):
    """Two appends after an overwrite, default template."""
    folder = shared_dir(t.spark, "files")
    for append in (False, False, True):
        out.write_files(_typed_events(t), folder, format="text", append=append)
    return t.spark.read.text(folder)


@query(
    "counters_rollup",
    """SELECT event_type AS name, sum(user_id) AS events_processed, CAST(count_if(value < 5) AS BIGINT) AS events_dropped,
    CAST(count_if(user_id = 3) AS BIGINT) AS processing_errors, CASE WHEN event_type IS NULL THEN 5 ELSE 1 END AS flows
    FROM events GROUP BY ROLLUP (event_type)""",
)
def counters_rollup(t):
    rows = t("events").select(
        F.col("event_type").alias("name"), F.col("user_id").alias("events_processed"), (F.col("value") < 5).cast("bigint").alias("events_dropped"),
        (F.col("user_id") == 3).cast("bigint").alias("processing_errors"),
    )
    return rollup(rows)


@query(
    "audited_chain",
    f"""SELECT state, stage, count(*) AS n FROM (SELECT
    CASE WHEN event_type = 'click' THEN 'filtered' WHEN event_type = 'error' THEN 'filtered' WHEN event_type = 'view' THEN 'error'
      WHEN value > 10 THEN 'ok' ELSE 'filtered' END AS state,
    CASE WHEN event_type = 'click' THEN 'json' WHEN event_type = 'error' THEN 'filter' WHEN event_type = 'view' THEN 'filter'
      WHEN value > 10 THEN '' ELSE 'filter' END AS stage FROM events) GROUP BY ALL""",
)
def audited_chain(t):
    """Every row with the stage that dropped it: clicks are no JSON, views have a text value."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.lit("{oops")).when(kind == "view", F.to_json(F.struct(F.lit("ERR").alias("value"), kind.alias("kind"))))
        .otherwise(F.to_json(F.struct(F.col("value").cast("string").alias("value"), kind.alias("kind"))))
    )
    rows = t("events").select(raw.alias("raw_data"), reason("ok", "", F.lit("")).alias("_status"))
    for step in (parse_json(target_field="", schema="value string, kind string"), filter_events("kind != error"), filter_events("value > 10")):
        rows = step.audited(rows, "_status")
    return rows.groupBy(F.col("_status.state").alias("state"), F.col("_status.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("custom_step", "SELECT CAST(event_id AS VARCHAR) AS id, upper(event_type) AS event_type FROM events WHERE event_type <> 'view'")
def custom_step(t):
    """A per-event Python function in the chain."""

    def change(event):
        fields = event["fields"]
        if fields["event_type"] == "view":
            return None
        fields["event_type"] = fields["event_type"].upper()
        return event

    rows = open_events(t).transform(python_step(change))
    return rows.select("id", field_text("event_type").alias("event_type"))


def _strict(event):
    """A custom function that fails in two ways, drops some events and changes the rest."""
    fields = event["fields"]
    if fields["event_type"] == "error":
        fields["half"] = "done"
        raise ValueError(f"no value in {event['id']}")
    if fields["event_type"] == "view":
        return fields["user_id"]
    if fields["event_type"] == "signup":
        return None
    fields["event_type"] = fields["event_type"].upper()
    return event


@query(
    "custom_step_errors",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'strict' AS error_stage, event_type, FALSE AS half,
    CASE event_type WHEN 'error' THEN 'ValueError: no value in ' || event_id ELSE 'TypeError: an event is a dictionary, not int' END AS error_message
    FROM events WHERE event_type IN ('error', 'view')""",
)
def custom_step_errors(t):
    """The rows a custom function failed on, as they were, each with its error."""
    rows = open_events(t).withColumn(STATUS, reason("ok", "", F.lit("")))
    failed = errors(python_step(_strict, "strict").audited(rows, STATUS))
    half = F.map_contains_key("fields", "half").alias("half")
    return failed.select("id", "error_stage", "error_message", field_text("event_type").alias("event_type"), half)


@query(
    "custom_step_audited",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN user_id >= 20 AND event_type IN ('click', 'purchase') THEN upper(event_type) ELSE event_type END AS event_type,
    CASE WHEN user_id < 20 OR event_type = 'signup' THEN 'filtered' WHEN event_type IN ('error', 'view') THEN 'error' WHEN user_id >= 100 THEN 'filtered' ELSE 'ok' END AS state,
    CASE WHEN user_id < 20 THEN 'filter' WHEN event_type IN ('error', 'view', 'signup') THEN 'strict' WHEN user_id >= 100 THEN 'filter' ELSE '' END AS stage
    FROM events""",
)
def custom_step_audited(t):
    """Every row with its fate: a filter, a custom function that meets the rows left, a filter on what it made."""
    rows = open_events(t).withColumn(STATUS, reason("ok", "", F.lit("")))
    for step in (filter_events("user_id >= 20"), python_step(_strict, "strict"), filter_events("user_id < 100")):
        rows = step.audited(rows, STATUS)
    return rows.select("id", field_text("event_type").alias("event_type"), f"{STATUS}.state", f"{STATUS}.stage")


def flagship(t):
    """Raw JSON lines parsed, filtered and rendered: the smallest whole flow."""
    raw = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), level().alias("level"), F.col("event_type").alias("service"), F.col("value")))
    lines = t("events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), raw.alias("raw_data"))
    rows = lines.transform(parse_json(target_field="", schema="time string, level string, service string, value double"))
    rows = rows.transform(filter_events("level in [ERROR, WARN]", mode="all"))
    return rows.select("id", out.render_template(rows, "{time} [{level}] {service}: {value}").alias("line"))


query(
    "parse_filter_render",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' [' || {LEVEL} || '] ' || event_type || ': ' || CAST(value AS VARCHAR) AS line
    FROM events WHERE {LEVEL} IN ('ERROR', 'WARN')""",
)(flagship)

