"""Field changes."""

from pyspark.sql import functions as F

from logweave.checks.base import field_text, open_events, query
from logweave.functions.text import iso_text
from logweave.model import add_field, add_metadata, add_tag
from logweave.operators.mutate import mutate


def _customers(t):
    return t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("mutate_add", "SELECT c_custkey, 'prod' AS environment, 7 AS shard, 'fixed' AS c_name FROM customer")
def mutate_add(t):
    rows = t("customer").select("c_custkey", "c_name")
    return rows.transform(mutate(add_fields={"environment": "prod", "shard": 7, "c_name": "fixed"}))


@query("mutate_remove", "SELECT c_custkey, c_name FROM customer")
def mutate_remove(t):
    return _customers(t).transform(mutate(remove_fields=["c_mktsegment", "c_acctbal", "nothing"]))


@query(
    "mutate_rename",
    """SELECT d.doc_id, d.lang AS language, COALESCE(CAST(l.quality AS VARCHAR), d.source) AS source
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def mutate_rename(t):
    """An existing target is overwritten only where the source field exists."""
    docs = t("documents").select("doc_id", "lang", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumn("quality", F.col("quality").cast("string"))
    return docs.transform(mutate(rename_fields={"lang": "language", "quality": "source", "nothing": "source"}))


@query("mutate_uppercase", "SELECT p_partkey, upper(p_name) AS p_name, p_size FROM part")
def mutate_uppercase(t):
    return t("part").select("p_partkey", "p_name", "p_size").transform(mutate(uppercase_fields=["p_name", "p_size"]))


@query("mutate_lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def mutate_lowercase(t):
    return t("documents").select("doc_id", "text").transform(mutate(lowercase_fields=["text"]))


@query(
    "mutate_convert_int",
    r"""SELECT doc_id, CASE WHEN regexp_matches(s, '^\s*[+-]?[0-9]+\s*$') THEN CAST(s AS BIGINT) END AS n, CAST(trunc(f) AS BIGINT) AS f,
    NOT regexp_matches(s, '^\s*[+-]?[0-9]+\s*$') AS failed
    FROM (SELECT doc_id, regexp_replace(source, '^src', CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN ' +' ELSE 'x' END) AS s, n_chars / 8.0 AS f FROM documents)""",
)
def mutate_convert_int(t):
    lead = F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", " +").otherwise("x")
    n = F.concat(lead, F.regexp_replace("source", "^src", ""))
    docs = t("documents").select("doc_id", n.alias("n"), (F.col("n_chars") / F.lit(8.0)).alias("f"))
    rows = docs.transform(mutate(convert_fields={"n": "int", "f": "int"}))
    return rows.select("doc_id", "n", "f", F.map_contains_key("metadata", "convert_error_n").alias("failed"))


@query(
    "mutate_convert_float",
    """SELECT event_id, CASE event_type WHEN 'click' THEN NULL ELSE value END AS v, event_type = 'click' AS failed FROM events""",
)
def mutate_convert_float(t):
    text = F.concat(F.col("value"), F.when(F.col("event_type") == "click", "d").otherwise(""))
    rows = t("events").select("event_id", text.alias("v")).transform(mutate(convert_fields={"v": "float"}))
    return rows.select("event_id", "v", F.map_contains_key("metadata", "convert_error_v").alias("failed"))


@query(
    "mutate_convert_str",
    """SELECT o_orderkey, CAST(o_totalprice * 1000 AS VARCHAR) AS price, CAST(o_custkey AS VARCHAR) AS cust,
    CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS large FROM orders""",
)
def mutate_convert_str(t):
    rows = t("orders").select(
        "o_orderkey", (F.col("o_totalprice") * 1000).alias("price"), F.col("o_custkey").alias("cust"),
        (F.col("o_totalprice") > 100000).alias("large"),
    )
    return rows.transform(mutate(convert_fields={"price": "str", "cust": "str", "large": "str"}))


@query(
    "mutate_convert_bool",
    """SELECT event_id, event_type IN ('click', 'error') AS word, user_id % 3 <> 0 AS number FROM events""",
)
def mutate_convert_bool(t):
    kind = F.col("event_type")
    word = F.when(kind == "click", "YES").when(kind == "error", "1").when(kind == "view", "no").otherwise(kind)
    rows = t("events").select("event_id", word.alias("word"), (F.col("user_id") % 3).alias("number"))
    return rows.transform(mutate(convert_fields={"word": "bool", "number": "bool"}))


@query(
    "mutate_convert_list",
    """SELECT doc_id, len(items) AS n, array_to_string([trim(x, e' \t\n') for x in items], '|') AS items
    FROM (SELECT doc_id, str_split(text, ',') AS items FROM documents)""",
)
def mutate_convert_list(t):
    rows = t("documents").select("doc_id", F.col("text").alias("items")).transform(mutate(convert_fields={"items": "list"}))
    return rows.select("doc_id", F.size("items").cast("bigint").alias("n"), F.array_join("items", "|").alias("items"))


@query(
    "mutate_convert_timestamp",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END AS at,
    strftime(to_timestamp(user_id * 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS epoch FROM events""",
)
def mutate_convert_timestamp(t):
    kind = F.col("event_type")
    form = (
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "view", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(kind == "error", F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = t("events").select("event_id", form.alias("at"), (F.col("user_id") * 86400).alias("epoch"))
    rows = rows.transform(mutate(convert_fields={"at": "timestamp", "epoch": "timestamp"}))
    return rows.select("event_id", iso_text(F.col("at")).alias("at"), iso_text(F.col("epoch")).alias("epoch"))


@query(
    "mutate_convert_open",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS event_type, event_type <> 'error' AS has_value, CAST(trunc(value) AS BIGINT) AS whole
    FROM (SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)""",
)
def mutate_convert_open(t):
    """In the open layout a value that does not convert stays as it is."""
    rows = open_events(t).transform(mutate(convert_fields={"event_type": "int", "value": "int"}))
    failed = F.map_contains_key("metadata", "convert_error_event_type")
    whole = F.try_variant_get(F.try_element_at("fields", F.lit("value")), "$", "bigint")
    return rows.where(failed).select(
        "id", field_text("event_type").alias("event_type"), F.map_contains_key("fields", "value").alias("has_value"), whole.alias("whole")
    )


@query("mutate_gsub", r"SELECT doc_id, regexp_replace(text, '([A-Z])[a-z]+ (of|le)', '<\1> \2', 'g') AS text FROM documents")
def mutate_gsub(t):
    return t("documents").select("doc_id", "text").transform(mutate(gsub_fields={"text": [r"([A-Z])[a-z]+ (of|le)", r"<\1> \g<2>"]}))


@query("mutate_gsub_named", r"SELECT doc_id, regexp_replace(text, '([A-Z])[a-z]+ (of|le)', '<\1> \2!', 'g') AS text FROM documents")
def mutate_gsub_named(t):
    rule = [r"(?P<first>[A-Z])[a-z]+ (?P<word>of|le)", r"<\g<first>> \g<word>!"]
    return t("documents").select("doc_id", "text").transform(mutate(gsub_fields={"text": rule}))


@query(
    "mutate_merge",
    """SELECT d.doc_id, d.lang || COALESCE(' ' || l.quality, '') || ' ' || d.n_chars AS merged
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def mutate_merge(t):
    docs = t("documents").select("doc_id", "lang", "n_chars", F.lit("").alias("empty"))
    docs = docs.join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.transform(mutate(merge_fields={"merged": ["empty", "lang", "quality", "nothing", "n_chars"]}))
    return rows.select("doc_id", "merged")


@query(
    "mutate_split",
    """SELECT doc_id, len(str_split(text, '. ')) AS n_all, str_split(text, '. ')[1] AS head,
    CASE WHEN len(str_split(text, '. ')) > 1 THEN 2 ELSE 1 END AS n_once FROM documents""",
)
def mutate_split(t):
    rows = t("documents").select("doc_id", F.col("text").alias("a"), F.col("text").alias("b"))
    rows = rows.transform(mutate(split_fields={"a": [". ", -1], "b": [". ", 1]}))
    return rows.select(
        "doc_id", F.size("a").cast("bigint").alias("n_all"), F.get("a", F.lit(0)).alias("head"), F.size("b").alias("n_once")
    )


@query("mutate_strip", "SELECT doc_id, text FROM (SELECT doc_id, trim(text, e' \t\n') AS text FROM documents)")
def mutate_strip(t):
    padded = F.concat(F.lit(" \t \n"), F.col("text"), F.lit("  \r"))
    return t("documents").select("doc_id", padded.alias("text")).transform(mutate(strip_fields=["text"]))


@query(
    "mutate_all",
    r"""SELECT c_custkey AS id, lower(c_mktsegment) AS segment, 'crm' AS origin, CAST(trunc(c_acctbal) AS BIGINT) AS balance,
    upper(regexp_replace(c_name, '#0+', '-')) AS name, lower(c_mktsegment) || ' crm' AS label FROM customer""",
)
def mutate_all(t):
    """One call; the parts apply in their fixed order whatever the order here."""
    step = mutate(
        merge_fields={"label": ["segment", "origin"]}, gsub_fields={"name": ["#0+", "-"]}, convert_fields={"balance": "int"},
        lowercase_fields=["segment"], uppercase_fields=["name"], add_fields={"origin": "crm"},
        rename_fields={"c_custkey": "id", "c_mktsegment": "segment", "c_acctbal": "balance", "c_name": "name"},
        strip_fields=["name"], remove_fields=["c_nationkey"],
    )
    return t("customer").transform(step).drop("metadata")


@query(
    "event_changes",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'x' AS added, 0.5 AS seconds,
    CASE WHEN event_type = 'seen' THEN 'seen' ELSE 'seen,' || event_type END AS tags FROM events""",
)
def event_changes(t):
    rows = add_metadata(add_field(open_events(t), "added", "x"), "seconds", 0.5)
    rows = add_tag(add_tag(add_tag(rows, "seen"), field_text("event_type")), "seen")
    seconds = F.try_variant_get(F.try_element_at("metadata", F.lit("seconds")), "$", "double")
    return rows.select("id", field_text("added").alias("added"), seconds.alias("seconds"), F.array_join("tags", ",").alias("tags"))
