"""JSON, regex and grok extraction."""

from pyspark.sql import functions as F

from logweave.checks.base import ISO, LEVEL, MICROS, access_lines, field_text, log_lines, open_events, query
from logweave.functions.text import iso_text
from logweave.model import to_events
from logweave.operators.extract import extract_grok, extract_regex
from logweave.operators.json import parse_json


@query("json_extract", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extract(t):
    rows = t("events").select("event_id", "props").transform(parse_json("props", schema="k bigint"))
    return rows.select("event_id", F.col("parsed.k").alias("k"))


@query("json_flatten", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_flatten(t):
    rows = t("events").select("event_id", "props")
    return rows.transform(parse_json("props", "", preserve_original=False, schema="k bigint"))


@query(
    "json_flatten_open",
    """SELECT CAST(event_id AS VARCHAR) AS id, props->>'$.k' AS k, event_type, CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 4 END AS INTEGER) AS n_fields
    FROM events""",
)
def json_flatten_open(t):
    rows = open_events(t).transform(parse_json(target_field=""))
    return rows.select("id", field_text("k").alias("k"), field_text("event_type").alias("event_type"), F.size("fields").alias("n_fields"))


def _mixed(t):
    """Document texts of which the English ones are replaced by JSON records."""
    record = F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('", "n": '), F.col("n_chars"), F.lit("}"))
    raw = F.when(F.col("lang") == "en", record).when(F.col("lang") == "es", F.lit("")).otherwise(F.col("text"))
    return t("documents").select("doc_id", raw.alias("raw_data"))


@query(
    "json_errors_dropped",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN lang END AS lang, CASE WHEN lang = 'en' THEN n_chars END AS n FROM documents
    WHERE lang IN ('en', 'es') OR json_valid(text)""",
)
def json_errors_dropped(t):
    rows = _mixed(t).transform(parse_json(schema="lang string, n bigint"))
    return rows.select("doc_id", "parsed.lang", "parsed.n")


@query(
    "json_errors_kept",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars END AS n, lang NOT IN ('en', 'es') AND NOT json_valid(text) AS failed
    FROM documents""",
)
def json_errors_kept(t):
    rows = _mixed(t).transform(parse_json(target_field="", ignore_errors=True, schema="n bigint"))
    failed = F.map_contains_key("metadata", "json_error")
    return rows.select("doc_id", "n", failed.alias("failed"))


_URL = r"^(?P<scheme>https?)://(?P<host>[^/:?#]+)/(?P<lang_code>[a-z]{2})/(?P<num>[0-9]+)(?:\?page=(?P<page>[0-9]+))?"
_URL_RE2 = r"^(https?)://([^/:?#]+)/([a-z]{2})/([0-9]+)(?:\?page=([0-9]+))?"


def _url_part(i):
    return f"nullif(regexp_extract(url, '{_URL_RE2}', {i}), '')"


_URL_NAMES = ("scheme", "host", "lang_code", "num", "page")
_URL_COLUMNS = ", ".join(f"{_url_part(i)} AS {n}" for i, n in enumerate(_URL_NAMES, start=1))


@query("regex_named", f"SELECT page_id, url, {_URL_COLUMNS} FROM pages")
def regex_named(t):
    return t("pages").select("page_id", "url").transform(extract_regex(_URL, "url"))


@query("regex_escape", "SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host FROM pages")
def regex_escape(t):
    step = extract_regex(r"\x68ttps?:\057\x2f(?P<host>[^/]+)", "url")
    return t("pages").select("page_id", "url").transform(step).select("page_id", "host")


@query("regex_positional", f"SELECT page_id, {_url_part(1)} AS scheme, {_url_part(2)} AS group2, {_url_part(5)} AS group5 FROM pages")
def regex_positional(t):
    step = extract_regex(_URL_RE2, "url", named_groups=False, group_names=["scheme"], preserve_original=False)
    return t("pages").select("page_id", "url").transform(step).select("page_id", "scheme", "group2", "group5")


@query("regex_struct", f"SELECT page_id, {_url_part(2)} AS host, {_url_part(5)} AS page FROM pages")
def regex_struct(t):
    rows = t("pages").select("page_id", "url").transform(extract_regex(_URL, "url", target_field="parts"))
    return rows.select("page_id", "parts.host", "parts.page")


@query(
    "regex_drop_source",
    f"SELECT page_id, CASE WHEN regexp_matches(url, '{_URL_RE2}') THEN NULL ELSE url END AS url, {_url_part(2)} AS host FROM pages",
)
def regex_drop_source(t):
    rows = t("pages").select("page_id", "url").transform(extract_regex(_URL, "url", preserve_original=False))
    return rows.select("page_id", "url", "host")


_PATH = r"(?:/[A-Za-z0-9$.+!*''(){},~:;=@#%_\-]*)+"
_URI_RE2 = rf"([A-Za-z][A-Za-z0-9+\-.]+)://([0-9A-Za-z][0-9A-Za-z.-]*)({_PATH})(\?[A-Za-z0-9$.+!*''|(){{}},~@#%&/=:;_?\-\[\]<>]*)?"


def _uri_part(i):
    return f"nullif(regexp_extract(url, '{_URI_RE2}', {i}), '')"


@query("grok_url", f"SELECT page_id, {_uri_part(1)} AS proto, {_uri_part(2)} AS host, {_uri_part(3)} AS path, {_uri_part(4)} AS param FROM pages")
def grok_url(t):
    step = extract_grok(["%{URIPROTO:proto}://%{URIHOST:host}%{URIPATH:path}(?:%{URIPARAM:param})?"], "url")
    return t("pages").select("page_id", "url").transform(step).drop("url")


@query(
    "grok_logline",
    f"""SELECT event_id, {MICROS} AS time, {LEVEL} AS level, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value,
    event_type AS kind FROM events""",
)
def grok_logline(t):
    step = extract_grok(["%{TIMESTAMP_ISO8601:time} %{LOGLEVEL:level} user=%{INT:user_id} value=%{NUMBER:value} \\(%{WORD:kind}\\)"])
    return log_lines(t).transform(step).drop("raw_data", "ts")


@query(
    "grok_access_log",
    """SELECT event_id, '203.' || (user_id % 256) || '.' || (event_id % 256) || '.7' AS clientip, '-' AS ident, 'user' || user_id AS auth,
    strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS "timestamp", 'GET' AS verb, '/' || event_type || '/' || event_id AS request,
    '1.1' AS httpversion, CAST(NULL AS VARCHAR) AS rawrequest, CASE event_type WHEN 'error' THEN '500' ELSE '200' END AS response,
    CAST(user_id * 10 AS VARCHAR) AS bytes, '"http://example.com/start"' AS referrer, '"agent/' || user_id || '.0 (X11)"' AS agent
    FROM events""",
)
def grok_access_log(t):
    return access_lines(t).transform(extract_grok(["%{COMBINEDAPACHELOG}"])).drop("raw_data")


_ALTERNATIVES = ["ERROR user=%{INT:bad_user}", "user=%{INT:user_id} value=%{NUMBER:value}", "\\(%{WORD:kind}\\)"]


@query(
    "grok_first_match",
    f"""SELECT event_id, CASE WHEN {LEVEL} = 'ERROR' THEN CAST(user_id AS VARCHAR) END AS bad_user,
    CASE WHEN {LEVEL} <> 'ERROR' THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN {LEVEL} <> 'ERROR' THEN CAST(value AS VARCHAR) END AS value, CAST(NULL AS VARCHAR) AS kind FROM events""",
)
def grok_first_match(t):
    return log_lines(t).transform(extract_grok(_ALTERNATIVES)).drop("raw_data", "ts")


@query(
    "grok_all_matches",
    f"""SELECT event_id, CASE WHEN {LEVEL} = 'ERROR' THEN CAST(user_id AS VARCHAR) END AS bad_user, CAST(user_id AS VARCHAR) AS user_id,
    CAST(value AS VARCHAR) AS value, event_type AS kind FROM events""",
)
def grok_all_matches(t):
    return log_lines(t).transform(extract_grok(_ALTERNATIVES, break_on_match=False)).drop("raw_data", "ts")


@query(
    "grok_custom_pattern",
    """SELECT event_id, CAST(user_id AS VARCHAR) || '/' || CAST(value AS VARCHAR) AS pair FROM
    (SELECT event_id, user_id, value FROM events)""",
)
def grok_custom_pattern(t):
    custom = {"PAIR": r"user=%{INT:left_side} value=%{NUMBER:right_side}"}
    rows = log_lines(t).transform(extract_grok(["%{PAIR}"], custom_patterns=custom, target_field="found"))
    return rows.select("event_id", F.concat_ws("/", "found.left_side", "found.right_side").alias("pair"))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})"


@query(
    "grok_ipv4",
    f"""SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])((?:{_OCTET}[.]){{3}}{_OCTET})(?:[^0-9]|$)', 1), '') AS ip
    FROM documents""",
)
def grok_ipv4(t):
    return t("documents").select("doc_id", "text").transform(extract_grok(["%{IPV4:ip}"], "text")).drop("text")


@query(
    "grok_email",
    r"""SELECT doc_id, nullif(regexp_extract(text, '([a-zA-Z0-9!#$%&''*+/=?^_`{|}~-]+)@([0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?)', 1), '') AS local_part,
    nullif(regexp_extract(text, '([a-zA-Z0-9!#$%&''*+/=?^_`{|}~-]+)@([0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?)', 2), '') AS host
    FROM documents""",
)
def grok_email(t):
    step = extract_grok(["%{EMAILLOCALPART:local_part}@%{HOSTNAME:host}"], "text")
    return t("documents").select("doc_id", "text").transform(step).drop("text")


@query(
    "grok_open_layout",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, {LEVEL} AS level, CAST(user_id AS VARCHAR) AS user_id, {ISO} AS time FROM events""",
)
def grok_open_layout(t):
    events = to_events(log_lines(t), id=F.col("event_id").cast("string"), timestamp=F.col("ts").cast("timestamp"), raw_data=F.col("raw_data"))
    rows = events.transform(extract_grok(["%{LOGLEVEL:level} user=%{INT:user_id}"]))
    return rows.select("id", field_text("level").alias("level"), field_text("user_id").alias("user_id"), iso_text(F.col("timestamp")).alias("time"))


@query(
    "regex_on_error",
    f"SELECT page_id, {_url_part(2)} AS host, regexp_matches(url, '{_URL_RE2}') AS matched, 0 AS noted FROM pages",
)
def regex_on_error(t):
    """Without a match nothing is set, dropped or noted, whatever ``ignore_errors`` says."""
    rows = t("pages").select("page_id", "url")
    parts = [rows.transform(extract_regex(_URL, "url", ignore_errors=flag)).where((F.col("page_id") % 2 == 0) == flag) for flag in (True, False)]
    rows = parts[0].unionByName(parts[1])
    noted = F.lit(0) if "metadata" not in rows.columns else F.size("metadata")
    return rows.select("page_id", "host", F.col("host").isNotNull().alias("matched"), noted.alias("noted"))


@query(
    "grok_drop_source",
    r"SELECT page_id, nullif(regexp_extract(url, '/(\w+)/[+-]?[0-9]+', 1), '') AS code, CASE WHEN regexp_matches(url, '/\w+/[+-]?[0-9]+') THEN NULL ELSE url END AS url FROM pages",
)
def grok_drop_source(t):
    """The source field goes where the pattern matched, and only there."""
    step = extract_grok(["/%{WORD:code}/%{INT}"], "url", preserve_original=False)
    return t("pages").select("page_id", "url").transform(step).select("page_id", "code", "url")


@query(
    "grok_on_error",
    "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN 'rro' END AS word, 0 AS noted FROM events",
)
def grok_on_error(t):
    """Events without a match go on unchanged and unmarked."""
    step = extract_grok(["^e%{DATA:word}r$"], "event_type", ignore_errors=True)
    return open_events(t).transform(step).select("id", field_text("word").alias("word"), F.size("metadata").alias("noted"))
