"""Enrichment."""

from pyspark.sql import functions as F

from logweave.checks.base import query
from logweave.operators.enrich import geo, lookup, resolve_hosts, user_agent
from logweave.operators.extract import extract_grok, extract_regex
from logweave.session import shared_dir


@query(
    "enrich_lookup",
    """SELECT c.c_custkey, c.c_nationkey, n.n_name AS nation FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def enrich_lookup(t):
    nations = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return t("customer").select("c_custkey", "c_nationkey").transform(lookup("c_nationkey", "nation", nations))


@query(
    "enrich_lookup_default",
    """SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'visit' ELSE 'other' END AS meaning FROM events""",
)
def enrich_lookup_default(t):
    step = lookup("event_type", "meaning", {"error": "failure", "view": "visit", "never": "-"}, default_value="other")
    return t("events").select("event_id", "event_type").transform(step)


@query(
    "enrich_lookup_large",
    """SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment AS segment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def enrich_lookup_large(t):
    """The lookup table grows with the data: broadcast only while its measured size allows."""
    customers = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return t("orders").select("o_orderkey", "o_custkey").transform(lookup("o_custkey", "segment", customers))


@query(
    "enrich_lookup_shuffled",
    """SELECT e.event_id, e.user_id, c.c_name AS name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
)
def enrich_lookup_shuffled(t):
    """The way beyond the broadcast bound: hot users are cut into slices."""
    customers = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return t("events").select("event_id", "user_id").transform(lookup("user_id", "name", customers, broadcast_rows=0))


@query(
    "enrich_preserve",
    """SELECT d.doc_id, COALESCE(CAST(l.quality AS VARCHAR), CASE d.lang WHEN 'en' THEN 'english' ELSE 'foreign' END) AS mark
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def enrich_preserve(t):
    docs = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.select("doc_id", "lang", F.col("quality").cast("string").alias("mark"))
    return docs.transform(lookup("lang", "mark", {"en": "english"}, default_value="foreign")).select("doc_id", "mark")


@query(
    "enrich_missing_noted",
    """SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS verdict, l.quality IS NULL AS noted
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def enrich_missing_noted(t):
    docs = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.transform(lookup("quality", "verdict", {"1": "good", "0": "bad"}, ignore_missing=False))
    return rows.select("doc_id", "verdict", F.map_contains_key("metadata", "enrich_error").alias("noted"))


_SIZES = "SELECT {n} AS entries, event_id, CASE WHEN user_id % 50 < {n} THEN CAST(user_id % 50 * 2 AS BIGINT) END AS worth FROM events"


@query("enrich_lookup_types", f"{_SIZES.format(n=30)} UNION ALL {_SIZES.format(n=40)}")
def enrich_lookup_types(t):
    """Mappings of 30 and of 40 whole numbers give one type."""
    rows = t("events").select("event_id", F.col("user_id") % 50).toDF("event_id", "kind")
    made = [rows.transform(lookup("kind", "worth", {str(i): 2 * i for i in range(n)})).select(F.lit(n).alias("entries"), "event_id", "worth") for n in (30, 40)]
    assert made[0].schema == made[1].schema
    return made[0].union(made[1])


@query(
    "enrich_lookup_null",
    " UNION ALL ".join(f"SELECT '{way}' AS way, event_id, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN NULL ELSE 'default' END AS meaning FROM events" for way in ("mapping", "table", "shuffled")),
)
def enrich_lookup_null(t):
    """A key whose value is null sets nothing, not even the default."""
    pairs = {"click": "hit", "view": None}
    rows, table = t("events").select("event_id", "event_type"), t.spark.createDataFrame(list(pairs.items()), "key string, value string")
    ways = {"mapping": lookup("event_type", "meaning", pairs, default_value="default"), "table": lookup("event_type", "meaning", table, default_value="default"),
            "shuffled": lookup("event_type", "meaning", table, default_value="default", broadcast_rows=0)}
    made = [rows.transform(step).select(F.lit(way).alias("way"), "event_id", "meaning") for way, step in ways.items()]
    return made[0].union(made[1]).union(made[2])


@query(
    "enrich_lookup_missing_keys",
    """SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l_linenumber = 1 THEN o.o_orderpriority END AS priority FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
)
def enrich_lookup_missing_keys(t):
    """A shuffled lookup in which most rows have no key."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("order"))
    table = t("orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    return rows.transform(lookup("order", "priority", table, broadcast_rows=0)).select("l_orderkey", "l_linenumber", "priority")


@query(
    "enrich_lookup_file",
    """SELECT event_id, event_type, COALESCE(r.r_name, CASE event_type WHEN 'error' THEN 'failure' END) AS meaning FROM events
    LEFT JOIN region r ON event_type = CASE r.r_regionkey WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'refund' END""",
)
def enrich_lookup_file(t):
    """The JSON object in the file is merged over the inline table."""
    folder = shared_dir(t.spark, "lookup")
    kinds = ("view", "click", "purchase", "signup", "refund")
    names = t("region").groupBy().agg(*(F.max(F.when(F.col("r_regionkey") == i, F.col("r_name"))).alias(kind) for i, kind in enumerate(kinds)))
    names.select(F.to_json(F.struct(*kinds))).coalesce(1).write.text(folder)
    step = lookup("event_type", "meaning", {"error": "failure", "view": "overridden"}, lookup_file=folder)
    return t("events").select("event_id", "event_type").transform(step)


def _networks(t):
    """One address block per nation: ten leading octets each."""
    start = F.col("n_nationkey") * 10
    return t("nation").select(
        F.concat(start, F.lit(".16.0.0")).alias("lo"), F.concat(start + 9, F.lit(".255.255.255")).alias("hi"),
        F.substring("n_name", 1, 2).alias("country_code"), F.col("n_name").alias("country_name"),
    )


_PRIVATE_SQL = """(a IN (0, 10, 127) OR a >= 240 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10)))
    OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))"""
# 10n.16.0.0 up to 10n+9.255.255.255.
_IN_BLOCK = "(a // 10 = n.n_nationkey AND (a % 10 > 0 OR b >= 16))"


@query(
    "enrich_geo_range",
    f"""SELECT e.event_id, e.ip, substr(n.n_name, 1, 2) AS country_code, n.n_name AS country_name FROM
    (SELECT event_id, a, b, c, d, a || '.' || b || '.' || c || '.' || d AS ip FROM
      (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b, (event_id * 7) % 256 AS c, user_id % 11 AS d FROM events)) e
    LEFT JOIN nation n ON {_IN_BLOCK} AND NOT {_PRIVATE_SQL}""",
)
def enrich_geo_range(t):
    ip = F.concat_ws(".", F.col("event_id") % 256, F.col("user_id") % 256, (F.col("event_id") * 7) % 256, F.col("user_id") % 11)
    rows = t("events").select("event_id", ip.alias("ip")).transform(geo("ip", "place", _networks(t)))
    return rows.select("event_id", "ip", "place.country_code", "place.country_name")


def _overlapping(t):
    """Networks of customers: one or more per nation, nested and ragged, many inside another."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    a, b, c = nation * 10 + key % 10, key * 7 % 256, key * 13 % 256
    text = lambda *parts: F.concat_ws(".", *parts)
    wide = t("nation").select(text("n_nationkey", F.lit(0), F.lit(0), F.lit(0)).alias("lo"), text(F.col("n_nationkey") * 9 + 20, F.lit(255), F.lit(255), F.lit(255)).alias("hi"), F.col("n_name").alias("city_name"))
    inner = t("customer").select(
        text(a, b, c, F.lit(3)).alias("lo"), text(a, F.least(b + key % 5, F.lit(255)), F.lit(255), key % 256).alias("hi"),
        F.concat(F.lit("c"), key).alias("city_name"),
    ).where(nation < 25)
    return wide.unionByName(inner)


@query(
    "enrich_geo_overlap",
    """WITH r AS (
      SELECT n_nationkey * 16777216::BIGINT AS lo, (n_nationkey * 9 + 20) * 16777216::BIGINT + 16777215 AS hi, n_name AS city_name FROM nation
      UNION ALL SELECT (c_nationkey * 10 + c_custkey % 10) * 16777216::BIGINT + (c_custkey * 7 % 256) * 65536 + (c_custkey * 13 % 256) * 256 + 3,
        (c_nationkey * 10 + c_custkey % 10) * 16777216::BIGINT + least(c_custkey * 7 % 256 + c_custkey % 5, 255) * 65536 + 65280 + c_custkey % 256, 'c' || c_custkey FROM customer
    ), u AS (SELECT DISTINCT 256 + user_id * 34359 + 83886080 AS ip FROM events),
    m AS (SELECT ip, city_name, row_number() OVER (PARTITION BY ip ORDER BY hi - lo, lo, '{"city_name":"' || city_name || '"}') AS n FROM u JOIN r ON ip BETWEEN lo AND hi WHERE lo <= hi)
    SELECT event_id, city_name FROM events LEFT JOIN m ON m.ip = 256 + user_id * 34359 + 83886080 AND n = 1""",
)
def enrich_geo_overlap(t):
    """Overlapping ranges: the smallest one that holds the address; broadcast for one half of the rows, shuffled for the other."""
    number = F.lit(256) + F.col("user_id") * 34359 + 83886080
    parts = [F.shiftright(number, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]
    rows = t("events").select("event_id", F.concat_ws(".", *parts).alias("ip"))
    table = _overlapping(t)
    halves = [rows.where("event_id % 2 = 0").transform(geo("ip", "place", table)), rows.where("event_id % 2 = 1").transform(geo("ip", "place", table, broadcast_rows=0))]
    return halves[0].unionByName(halves[1]).select("event_id", "place.city_name")


@query(
    "enrich_geo_v6",
    """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN CASE WHEN event_id % 65536 BETWEEN 16 AND 4660 THEN 'inner' ELSE 'middle' END
      WHEN user_id % 7 < 3 THEN 'outer' END AS city_name FROM events""",
)
def enrich_geo_v6(t):
    """Nested networks of version 6, one of them ragged, besides one of version 4 with the same leading bits."""
    table = t.spark.createDataFrame(
        [("2400::", "2400:2:ffff:ffff:ffff:ffff:ffff:ffff", "outer"), ("2400::", "2400::ffff:ffff:ffff:ffff:ffff:ffff", "middle"),
         ("2400::10", "2400::1234", "inner"), ("36.0.0.0", "36.255.255.255", "four"), ("2400::9", "2400::1", "reversed"), ("2400::", "36.0.0.9", "mixed")],
        "lo string, hi string, city_name string",
    )
    ip = F.concat(F.lit("2400:"), F.lower(F.hex(F.col("user_id") % 7)), F.lit("::"), F.lower(F.hex(F.col("event_id") % 65536)))
    return t("events").select("event_id", ip.alias("ip")).transform(geo("ip", "place", table)).select("event_id", "place.city_name")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})"


@query(
    "enrich_geo_documents",
    f"""SELECT doc_id, ip, n.n_name AS country_name FROM
    (SELECT doc_id, ip, TRY_CAST(split_part(ip, '.', 1) AS INT) AS a, TRY_CAST(split_part(ip, '.', 2) AS INT) AS b,
       TRY_CAST(split_part(ip, '.', 3) AS INT) AS c, TRY_CAST(split_part(ip, '.', 4) AS INT) AS d FROM
       (SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])((?:{_OCTET}[.]){{3}}{_OCTET})(?:[^0-9]|$)', 1), '') AS ip FROM documents))
    LEFT JOIN nation n ON {_IN_BLOCK} AND NOT {_PRIVATE_SQL}""",
)
def enrich_geo_documents(t):
    docs = t("documents").select("doc_id", "text").transform(extract_grok(["%{IPV4:ip}"], "text")).select("doc_id", "ip")
    rows = docs.transform(geo("ip", "place", _networks(t), broadcast_rows=0))
    return rows.select("doc_id", "ip", "place.country_name")


_HOST = r"^https?://([^/:?#]+)"


@query(
    "enrich_hosts",
    f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '{_HOST}', 1)) AS host, '20.' || (page_id % 200) || '.0.1' AS ip, contains(url, '?') AS has_query FROM pages),
    h AS (SELECT host, ip FROM p WHERE has_query),
    f AS (SELECT host, min(ip) AS answer FROM h GROUP BY host), b AS (SELECT ip, min(host) AS answer FROM h GROUP BY ip)
    SELECT p.page_id, COALESCE(f.answer, 'unknown') AS address, b.answer AS name FROM p LEFT JOIN f ON p.host = f.host LEFT JOIN b ON p.ip = b.ip""",
)
def enrich_hosts(t):
    pages = t("pages").select("page_id", "url").transform(extract_regex(_HOST.replace("(", "(?P<host>", 1), "url"))
    pages = pages.select("page_id", F.lower("host").alias("host"), F.concat(F.lit("20."), F.col("page_id") % 200, F.lit(".0.1")).alias("ip"), "url")
    # The resolved names are those of pages with a query string.
    hosts = pages.where(F.contains("url", F.lit("?"))).select(F.col("host").alias("name"), "ip")
    rows = pages.transform(resolve_hosts("host", "address", hosts, default_value="unknown"))
    return rows.transform(resolve_hosts("ip", "name", hosts)).select("page_id", "address", "name")


@query(
    "enrich_user_agent",
    """SELECT event_id,
    CASE event_type WHEN 'click' THEN 'Chrome' WHEN 'view' THEN 'Mobile Safari' WHEN 'error' THEN 'Googlebot' WHEN 'purchase' THEN 'Firefox' ELSE 'Other' END AS browser,
    CASE event_type WHEN 'click' THEN '(' || user_id || ', 0, ' || event_id || ')' WHEN 'view' THEN '(14, ' || user_id || ')'
      WHEN 'error' THEN '(2, 1)' WHEN 'purchase' THEN '(' || user_id || ', 0)' ELSE '()' END AS version,
    CASE event_type WHEN 'click' THEN 'Windows' WHEN 'view' THEN 'iOS' WHEN 'purchase' THEN 'Linux' ELSE 'Other' END AS system,
    event_type = 'view' AS is_mobile, event_type IN ('click', 'purchase') AS is_pc, event_type = 'error' AS is_bot FROM events""",
)
def enrich_user_agent(t):
    kind, user = F.col("event_type"), F.col("user_id")
    agent = (
        F.when(kind == "click", F.concat(F.lit("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/"), user, F.lit(".0."), F.col("event_id"), F.lit(".1 Safari/537.36")))
        .when(kind == "view", F.concat(F.lit("Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 Version/14."), user, F.lit(" Mobile/15E148 Safari/604.1")))
        .when(kind == "error", "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)")
        .when(kind == "purchase", F.concat(F.lit("Mozilla/5.0 (X11; Linux x86_64; rv:9.0) Gecko/20100101 Firefox/"), user, F.lit(".0")))
        .otherwise(kind)
    )
    rows = t("events").select("event_id", agent.alias("agent")).transform(user_agent("agent", "ua"))
    return rows.select(
        "event_id", F.col("ua.browser_family").alias("browser"), F.col("ua.browser_version").alias("version"),
        F.col("ua.os_family").alias("system"), "ua.is_mobile", "ua.is_pc", "ua.is_bot",
    )


# Agents of ten products on five platforms: platform with system, its version, device and kind; product with family and version.
_PLATFORMS = (
    ("Windows NT 6.1; WOW64", "Windows", "(7,)", "Other", "pc"),
    ("Macintosh; Intel Mac OS X 10_15_7", "Mac OS X", "(10, 15, 7)", "Mac", "pc"),
    ("X11; CrOS x86_64 14541.0.0", "Chrome OS", "(14541, 0, 0)", "Other", "pc"),
    ("Linux; Android 13; SM-T870", "Android", "(13,)", "Samsung", "tablet"),
    ("Linux; Android 9.1; Pixel 7 Pro Build/TQ1", "Android", "(9, 1)", "Pixel", "mobile"),
)
_PRODUCTS = (
    ("Chrome/91.0.4472.124 Safari/537.36", "Chrome", "(91, 0, 4472)"),
    ("Chrome/120.0.0.0 Mobile Safari/537.36", "Chrome Mobile", "(120, 0, 0)"),
    ("Chrome/91.0.1 Safari/537.36 Edg/91.0.864.59", "Edge", "(91, 0, 864)"),
    ("Chrome/90.0.1 Safari/537.36 OPR/76.0", "Opera", "(76, 0)"),
    ("SamsungBrowser/23.0 Chrome/115.0.0.0 Safari/537.36", "Samsung Internet", "(23, 0)"),
    ("Gecko/20100101 Firefox/115", "Firefox", "(115,)"),
    ("Version/16.1 Safari/605.1.15", "Safari", "(16, 1)"),
    ("Version/16.1.2 Mobile/15E148 Safari/605.1.15", "Mobile Safari", "(16, 1, 2)"),
    ("Trident/7.0; rv:11.0 like Gecko", "IE", "(11, 0)"),
    ("Unknown Product 4", "Other", "()"),
)


def _cases(rows, column: int, position: str) -> str:
    return f"CASE {position} " + " ".join(f"WHEN {i} THEN '{row[column]}'" for i, row in enumerate(rows)) + " END"


@query(
    "enrich_user_agent_products",
    f"""SELECT event_id, {_cases(_PRODUCTS, 1, "event_id % 10")} AS browser, {_cases(_PRODUCTS, 2, "event_id % 10")} AS version,
    {_cases(_PLATFORMS, 1, "event_id // 10 % 5")} AS system, {_cases(_PLATFORMS, 2, "event_id // 10 % 5")} AS system_version,
    {_cases(_PLATFORMS, 3, "event_id // 10 % 5")} AS device, {_cases(_PLATFORMS, 4, "event_id // 10 % 5")} AS kind,
    CASE event_id // 10 % 5 WHEN 3 THEN 'SM-T870' WHEN 4 THEN 'Pixel 7 Pro' WHEN 1 THEN 'Mac' END AS model FROM events""",
)
def enrich_user_agent_products(t):
    """Fifty agents."""
    def nth(rows, position):
        return F.get(F.array(*(F.lit(row[0]) for row in rows)), position.cast("int"))

    agent = F.concat(
        F.lit("Mozilla/5.0 ("), nth(_PLATFORMS, F.floor(F.col("event_id") / 10) % 5), F.lit(") AppleWebKit/537.36 "), nth(_PRODUCTS, F.col("event_id") % 10)
    )
    rows = t("events").select("event_id", agent.alias("agent")).transform(user_agent("agent", "ua"))
    kind = F.when(F.col("ua.is_mobile"), "mobile").when(F.col("ua.is_tablet"), "tablet").when(F.col("ua.is_pc"), "pc")
    return rows.select(
        "event_id", F.col("ua.browser_family").alias("browser"), F.col("ua.browser_version").alias("version"), F.col("ua.os_family").alias("system"),
        F.col("ua.os_version").alias("system_version"), F.col("ua.device_family").alias("device"), kind.alias("kind"), F.col("ua.device_model").alias("model"),
    )


@query("enrich_none", "SELECT event_id, event_type FROM events")
def enrich_none(t):
    from logweave.operators.enrich import enrich

    return t("events").select("event_id", "event_type").transform(enrich("none", source_field="event_type", target_field="t"))
