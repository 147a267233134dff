"""Enrichment: a value looked up for a source field is stored under a target field.

Shared rules: a missing source changes nothing (with ``ignore_missing=False`` it leaves
``enrich_error``); an existing target stays unless ``preserve_existing=False``; the number
of rows never changes.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logweave.functions import ip as ips, useragent_rules as ua
from logweave.functions.once import once
from logweave.model import Fields, is_open, literal, note, put
from logweave.operators import joins, networks
from logweave.operators.base import Step

_KEY = "_lookup_key"
_VALUE = "_lookup_value"
_HIT = "_lookup_hit"
_SMALL_TABLE = 32

# Members of a location.
GEO_MEMBERS = (
    "country_code", "country_name", "city_name", "region_name", "region_code",
    "continent_code", "latitude", "longitude", "timezone", "postal_code",
)
DOTTED = r"^\d+\.\d+\.\d+\.\d+$"


def _check(source_field: str | None, target_field: str | None) -> None:
    if not source_field:
        raise ValueError("Source field is required")
    if not target_field:
        raise ValueError("Target field is required")


def _begin(df: DataFrame, source: str, ignore_missing: bool) -> DataFrame:
    """Add the lookup key; note the rows without a source if asked to."""
    df = once(df, _KEY, Fields(df).source(source))
    if not ignore_missing:
        df = note(df, "enrich_error", F.lit(f"Source field not found: {source}"), F.col(_KEY).isNull())
    return df


def _end(df: DataFrame, target: str, value: Column, preserve: bool) -> DataFrame:
    """Store the value where there is one and the target may be written."""
    write = value.isNotNull() & F.col(_KEY).isNotNull()
    if preserve:
        write = write & ~Fields(df).present(target)
    return put(df, {target: value}, write).drop(_KEY, _VALUE, _HIT)


def lookup(
    source_field: str,
    target_field: str,
    lookup_table: dict[str, Any] | DataFrame | None = None,
    lookup_file: str | None = None,
    default_value: Any = None,
    preserve_existing: bool = True,
    ignore_missing: bool = True,
    broadcast_rows: int = joins.BROADCAST_ROWS,
) -> Step:
    """Value of a key table for the text of the source field, else the default.

    ``lookup_table`` is a mapping or a DataFrame ``(key, value)``; the JSON object in
    ``lookup_file`` is merged over it. Of several values of one key the smallest counts. A key whose value
    is null sets nothing, not even the default. Whole numbers are ``bigint`` whatever the size of the mapping. A
    file that is missing, is no JSON or holds no object raises ``ValueError``.
    """
    _check(source_field, target_field)

    def run(df: DataFrame) -> DataFrame:
        out = _begin(df, source_field, ignore_missing)
        if isinstance(lookup_table, dict) and not lookup_file and len(lookup_table) <= _SMALL_TABLE:
            found, hit = _small_table(lookup_table)
        else:
            dim = _table(df, lookup_table, lookup_file)
            dim = dim.select(F.col("key").cast("string").alias(_KEY), F.col("value").alias(_VALUE))
            small = joins.fits_broadcast(dim, broadcast_rows)
            pick = F.any_value if isinstance(dim.schema[_VALUE].dataType, (T.VariantType, T.MapType)) else F.min
            dim = dim.where(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(pick(_VALUE).alias(_VALUE), F.lit(True).alias(_HIT))
            out = joins.left_lookup(out, dim, _KEY, small)
            found, hit = F.col(_VALUE), F.col(_HIT)
        kind = out.select(found.alias("v")).schema[0].dataType
        if default_value is not None:
            default = literal(default_value)
            found = F.when(hit, found).otherwise(default.cast("variant") if isinstance(kind, T.VariantType) else default)
        if isinstance(kind, T.VariantType):  # a JSON null sets nothing
            found = F.when(~F.is_variant_null(found), found)
        return _end(out, target_field, found, preserve_existing)

    return Step("lookup", finish=run)


# Of the Python types of a mapping's values, the type they are stored as.
_KINDS = {str: "string", int: "bigint", float: "double", bool: "boolean"}


def _typed(table: dict[str, Any]) -> tuple[dict[str, Any], str]:
    """Keys as text, and the one type of the values; values of several types, or of none of these, are variants."""
    table = {str(k): v for k, v in table.items()}
    kinds = {type(v) for v in table.values() if v is not None}
    if not kinds:
        return table, "string"
    kind = _KINDS.get(next(iter(kinds))) if len(kinds) == 1 else None
    return (table, kind) if kind else ({k: json.dumps(v) for k, v in table.items()}, "variant")


def _value(column: Column, kind: str) -> Column:
    return F.parse_json(column) if kind == "variant" else column.cast(kind)


def _small_table(table: dict[str, Any]) -> tuple[Column, Column]:
    """The value of the key, and whether it is there."""
    table, kind = _typed(table)
    if not table:
        return F.lit(None).cast("string"), F.lit(False)
    pairs = F.create_map(*(c for k, v in table.items() for c in (F.lit(k), _value(F.lit(v), kind))))
    return F.try_element_at(pairs, F.col(_KEY)), F.coalesce(F.map_contains_key(pairs, F.col(_KEY)), F.lit(False))


def _table(df: DataFrame, table: dict[str, Any] | DataFrame | None, path: str | None) -> DataFrame:
    spark, dim = df.sparkSession, None
    if isinstance(table, DataFrame):
        dim = table
    elif table:
        table, kind = _typed(table)
        stored = "string" if kind == "variant" else kind
        dim = spark.createDataFrame(list(table.items()), f"key string, value {stored}").withColumn("value", _value(F.col("value"), kind))
    if path is None:
        return dim if dim is not None else spark.createDataFrame([], "key string, value string")
    members = _file_members(spark, path)
    if not is_open(df):  # typed columns hold one type: the text of the value
        members = members.withColumn("value", F.try_variant_get("value", "$", "string"))
    if dim is None:
        return members
    value = F.col("value").cast(members.schema["value"].dataType)
    inline = dim.withColumn("value", value).join(members.select("key"), "key", "left_anti")
    return inline.select("key", "value").unionByName(members)


def _file_members(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of the JSON objects in a file, or in the files of a folder."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        raise ValueError(f"Lookup file not found: {path}") from error
    read = texts.select(F.try_parse_json("value").alias("document"), F.col("_metadata.file_path").alias("file"))
    read = read.withColumn("members", F.col("document").try_cast("map<string,variant>"))
    if read.isEmpty():  # a file without a character has no row
        raise ValueError(f"Invalid JSON in lookup file: {path}")
    wrong = read.where("members IS NULL").select("file", F.col("document").isNull().alias("no_json")).first()
    if wrong is not None:
        raise ValueError(f"Invalid JSON in lookup file: {wrong['file']}" if wrong["no_json"] else f"Lookup file must contain a JSON object: {wrong['file']}")
    return read.select(F.explode("members"))


def geo(
    source_field: str,
    target_field: str,
    ranges: DataFrame,
    preserve_existing: bool = True,
    ignore_missing: bool = True,
    broadcast_rows: int = joins.BROADCAST_ROWS,
) -> Step:
    """Location of an IP address from a table of networks.

    ``ranges`` has ``lo`` and ``hi`` (address texts, both inclusive) and the location members. Where ranges
    overlap, the one with the fewest addresses counts, then the one that begins first. Private addresses
    get nothing; what is no address is noted with ``ignore_missing=False``.
    """
    _check(source_field, target_field)

    def run(df: DataFrame) -> DataFrame:
        out = _begin(df, source_field, ignore_missing)
        out = ips.with_ip_hex(out, F.col(_KEY), "_ip")
        if not ignore_missing:
            message = F.concat(F.lit("Invalid IP address: "), F.col(_KEY))
            out = note(out, "enrich_error", message, F.col(_KEY).isNotNull() & F.col("_ip").isNull())
        out = out.withColumn("_ip", F.when(~ips.is_private("_ip"), F.col("_ip")))
        members = [c for c in GEO_MEMBERS if c in ranges.columns]
        table = networks.prefixes(ranges, F.struct(*members))
        out = networks.longest_match(out, table, "_ip", _VALUE, broadcast_rows)
        return _end(out.drop("_ip"), target_field, F.col(_VALUE), preserve_existing)

    return Step("geo", finish=run)


def resolve_hosts(
    source_field: str,
    target_field: str,
    hosts: DataFrame,
    default_value: Any = None,
    preserve_existing: bool = True,
    ignore_missing: bool = True,
    broadcast_rows: int = joins.BROADCAST_ROWS,
) -> Step:
    """Host name of a dotted address, or address of a host name, from ``hosts(name, ip)``.

    Of several answers the smallest counts. Without one the default is stored, or
    with neither and ``ignore_missing=False`` the failure is noted.
    """
    _check(source_field, target_field)

    def run(df: DataFrame) -> DataFrame:
        out = _begin(df, source_field, ignore_missing)
        out = out.withColumn("_host", F.lower(_KEY))
        answers = hosts.select(
            F.explode(
                F.array(
                    F.struct(F.lower("ip").alias("_host"), F.col("name").alias(_VALUE), F.lit(True).alias("back")),
                    F.struct(F.lower("name").alias("_host"), F.col("ip").alias(_VALUE), F.lit(False).alias("back")),
                )
            ).alias("a")
        ).select("a.*")
        answers = answers.where(F.col("_host").rlike(DOTTED) == F.col("back"))
        small = joins.fits_broadcast(hosts, broadcast_rows // 2)  # two answers per host row
        single = answers.select("_host", _VALUE).groupBy("_host").agg(F.min(_VALUE).alias(_VALUE))
        out = joins.left_lookup(out, single, "_host", small).drop("_host")
        failed = F.col(_KEY).isNotNull() & F.col(_VALUE).isNull()
        if default_value is None and not ignore_missing:
            if preserve_existing:
                failed = failed & ~Fields(out).present(target_field)
            out = note(out, "enrich_error", F.concat(F.lit("DNS lookup failed for: "), F.col(_KEY)), failed)
        found = F.col(_VALUE) if default_value is None else F.coalesce(F.col(_VALUE), F.lit(str(default_value)))
        return _end(out, target_field, found, preserve_existing)

    return Step("dns", finish=run)


def user_agent(
    source_field: str,
    target_field: str,
    preserve_existing: bool = True,
    ignore_missing: bool = True,
    browsers: tuple[ua.Rule, ...] = ua.BROWSERS,
    systems: tuple[ua.Rule, ...] = ua.SYSTEMS,
    devices: tuple[ua.Rule, ...] = ua.DEVICES,
) -> Step:
    """Browser, system and device of a user-agent text; rules are tried in order."""
    _check(source_field, target_field)

    def run(df: DataFrame) -> DataFrame:
        out = _begin(df, source_field, ignore_missing)
        text, other, none = F.col(_KEY), F.lit("Other"), F.lit(None).cast("string")
        out = once(out, "_lowered", F.lower(text))
        for column, rules in {"_browser": browsers, "_system": systems, "_device": devices}.items():
            out = once(out, column, ua.first_rule(text, F.col("_lowered"), rules))
        out = once(out, "_browser_version", ua.found_version(text, F.col("_browser"), browsers))
        out = once(out, "_system_version", ua.found_version(text, F.col("_system"), systems))
        browser, system, device = F.col("_browser"), F.col("_system"), F.col("_device")
        kind = ua.pick(device, [r.kind for r in devices], F.lit(""))
        bot = (kind == "bot") | (ua.pick(browser, [r.kind for r in browsers], F.lit("")) == "bot")
        model = F.coalesce(
            *(
                F.when(device == i, F.nullif(F.regexp_extract(text, r.pattern, 1), F.lit("")))
                for i, r in enumerate(devices) if "(SM" in r.pattern or "(Pixel" in r.pattern
            ),
            ua.pick(device, [r.family if r.brand else None for r in devices], none),
        )
        info = F.struct(
            ua.pick(browser, [r.family for r in browsers], other).alias("browser_family"),
            ua.version_text(F.col("_browser_version")).alias("browser_version"),
            ua.pick(system, [r.family for r in systems], other).alias("os_family"),
            ua.version_text(F.col("_system_version")).alias("os_version"),
            ua.pick(device, [r.family for r in devices], other).alias("device_family"),
            ua.pick(device, [r.brand for r in devices], none).alias("device_brand"),
            model.alias("device_model"),
            (kind == "mobile").alias("is_mobile"),
            (kind == "tablet").alias("is_tablet"),
            (kind == "pc").alias("is_pc"),
            bot.alias("is_bot"),
        )
        out = _end(out, target_field, F.when(F.col(_KEY).isNotNull(), info), preserve_existing)
        return out.drop("_lowered", "_browser", "_system", "_device", "_browser_version", "_system_version")

    return Step("useragent", finish=run)


def enrich(enrich_type: str = "none", **config: Any) -> Step:
    """The enrichment of the given type; ``none`` changes nothing."""
    kinds = {"lookup": lookup, "geo": geo, "dns": resolve_hosts, "useragent": user_agent}
    if enrich_type not in (*kinds, "none"):
        raise ValueError(f"Invalid enrichment type: {enrich_type}")
    _check(config.get("source_field"), config.get("target_field"))
    if enrich_type == "none":
        keep = bool(config.get("ignore_missing", True))
        return Step("none", finish=lambda df: _begin(df, config["source_field"], keep).drop(_KEY))
    return kinds[enrich_type](**config)
