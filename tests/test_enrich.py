"""Lookups, IP ranges, hosts and user agents."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave import enrich, geo, lookup, resolve_hosts, user_agent
from logweave.functions import ip as ips
from logweave.operators import joins


def test_lookup_small_table(make_events, read_events):
    df = make_events([{"k": 4624}, {"k": "4625"}, {"k": "9"}, {}, {"k": 4624, "t": "kept"}, {"k": None}])
    table = {"4624": "logon", "4625": "failed"}
    got = read_events(df.transform(lookup("k", "t", table, default_value="unknown", ignore_missing=False)))
    assert [got[f"e{i}"]["fields"].get("t") for i in range(6)] == ["logon", "failed", "unknown", None, "kept", None]
    assert ["enrich_error" in got[f"e{i}"]["metadata"] for i in range(6)] == [False, False, False, True, False, True]
    got = read_events(df.transform(lookup("k", "t", {"4624": {"a": 1}, "4625": 2}, preserve_existing=False)))
    assert [got[f"e{i}"]["fields"].get("t") for i in range(5)] == [{"a": 1}, 2, None, None, {"a": 1}]


@pytest.mark.parametrize("bound", [1000, 0])
def test_lookup_dataframe_broadcast_and_shuffled(spark, bound):
    # Key "hot" holds most rows; duplicates in the table must not multiply rows.
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 40}", i) for i in range(100)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(8)
    dim = spark.createDataFrame([("hot", "H"), ("hot", "I"), *((f"k{i}", f"v{i}") for i in range(20))], "key string, value string")
    out = df.transform(lookup("k", "t", dim, default_value="-", broadcast_rows=bound))
    counts = {r.t: r["count"] for r in out.groupBy("t").count().collect()}
    assert counts["H"] == 900 and counts["-"] == 40 and counts[None] == 1 and sum(counts.values()) == 1001
    assert set(out.columns) == {"k", "n", "t"}


def test_hot_keys_are_sliced(spark):
    df = spark.createDataFrame([("hot",)] * 600 + [(f"k{i}",) for i in range(1200)], "k string")
    hot = {r.k: r._slices for r in joins.hot_keys(df, "k").collect()}
    assert set(hot) == {"hot"} and hot["hot"] > joins.SLICES // 4
    spread = df.repartition(8).transform(lookup("k", "t", df.select(F.col("k").alias("key"), F.lit(1).alias("value")), broadcast_rows=0))
    assert spread.count() == 1800 and spread.where("t = 1").count() == 1800


def test_lookup_file_wins(spark, tmp_path, make_events, read_events):
    path = tmp_path / "table.json"
    path.write_text(json.dumps({"a": "file", "n": {"x": 1}}))
    df = make_events([{"k": "a"}, {"k": "b"}, {"k": "n"}, {"k": "z"}])
    got = read_events(df.transform(lookup("k", "t", {"a": "inline", "b": "inline"}, lookup_file=str(path))))
    assert [got[f"e{i}"]["fields"].get("t") for i in range(4)] == ["file", "inline", {"x": 1}, None]
    typed = spark.createDataFrame([("a",), ("b",), ("n",)], "k string")
    rows = typed.transform(lookup("k", "t", {"b": "inline"}, lookup_file=str(path))).orderBy("k").collect()
    assert [r.t for r in rows] == ["file", "inline", '{"x":1}']


def test_ip_hex_and_private_match_ipaddress(spark):
    rng = random.Random(5)
    texts = ["01.2.3.4", "256.1.1.1", "1.2.3", "::", "1::", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2", "::ffff:1.2.3.4",
             "64:ff9b::1.2.3.4", "fe80::1%eth0", "12345::", "g::1", "", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":1", "1:"]
    for _ in range(200):
        mask = rng.choice([2**128 - 1, 0xFFFF0000FFFF0000000000000000FFFF, 0xFFFFFFFF << 96, 0xFFFF])
        v6 = ipaddress.IPv6Address(rng.getrandbits(128) & mask)
        texts += [str(v6), v6.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    for network in ips.PRIVATE + ips.GLOBAL:
        net = ipaddress.ip_network(network)
        texts += [str(net[0]), str(net[-1])]
    df = ips.with_ip_hex(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), "h")
    for row in df.withColumn("p", ips.is_private("h")).collect():
        try:
            address = ipaddress.ip_address(row.t)
        except ValueError:
            assert row.h is None, row.t
            continue
        assert row.h == f"{int(address):0{8 if address.version == 4 else 32}x}", row.t
        assert row.p == address.is_private, row.t


RANGES = [
    ("1.0.0.0", "1.0.0.255", "AU"), ("2.0.0.0", "2.15.255.255", "FR"), ("5.0.255.0", "5.1.0.255", "DE"),
    ("2a00::", "2a00:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "EU"), ("2600:1f00::", "2600:1f00:ffff:ffff:ffff:ffff:ffff:ffff", "US"),
]


@pytest.mark.parametrize("bound", [1000, 0])
def test_geo_ranges(spark, make_events, read_events, bound):
    cases = [("1.0.0.7", "AU"), ("2.15.255.255", "FR"), ("5.1.0.1", "DE"), ("5.1.1.0", None), ("10.0.0.1", None), ("x", None),
             ("2a00:1::5", "EU"), ("2600:1f00::1", "US"), ("2600:1f01::1", None), (None, None)] + [("1.0.0.9", "AU")] * 40
    ranges = spark.createDataFrame(RANGES, "lo string, hi string, country_code string")
    df = make_events([{"ip": ip} if ip else {} for ip, _ in cases])
    got = read_events(df.transform(geo("ip", "g", ranges, ignore_missing=False, broadcast_rows=bound)))
    assert len(got) == len(cases)
    for i, (ip, want) in enumerate(cases):
        event = got[f"e{i}"]
        assert (event["fields"].get("g") or {}).get("country_code") == want, ip
        assert ("enrich_error" in event["metadata"]) == (ip in ("x", None)), ip


def test_geo_join_is_an_equi_join(spark):
    ranges = spark.createDataFrame(RANGES, "lo string, hi string, country_code string")
    df = spark.createDataFrame([("1.0.0.7",)], "ip string")
    for bound in (1000, 0):
        plan = df.transform(geo("ip", "g", ranges, broadcast_rows=bound))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hosts(spark, make_events, read_events):
    hosts = spark.createDataFrame(
        [("web", "1.2.3.4"), ("web", "1.2.3.3"), ("db", "9.9.9.9"), ("db2", "9.9.9.9")], "name string, ip string"
    )
    df = make_events([{"h": "WEB"}, {"h": "9.9.9.9"}, {"h": "nope"}, {}, {"h": "nope", "t": 1}])
    got = read_events(df.transform(resolve_hosts("h", "t", hosts, ignore_missing=False)))
    assert [got[f"e{i}"]["fields"].get("t") for i in range(5)] == ["1.2.3.3", "db", None, None, 1]
    assert ["enrich_error" in got[f"e{i}"]["metadata"] for i in range(5)] == [False, False, True, True, False]
    got = read_events(df.transform(resolve_hosts("h", "t", hosts, default_value="?")))
    assert got["e2"]["fields"]["t"] == "?"


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36":
        ("Chrome", "(91, 0, 4472)", "Windows", "(10,)", "Other", False, False, True, False),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.1.1 Mobile/15E148 Safari/604.1":
        ("Mobile Safari", "(14, 1, 1)", "iOS", "(14, 6)", "iPhone", True, False, False, False),
    "Mozilla/5.0 (iPad; CPU OS 13_3 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/13.0 Mobile/15E148 Safari/604.1":
        ("Mobile Safari", "(13, 0)", "iOS", "(13, 3)", "iPad", False, True, False, False),
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)":
        ("Googlebot", "(2, 1)", "Other", "()", "Spider", False, False, False, True),
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0":
        ("Firefox", "(89, 0)", "Ubuntu", "()", "Other", False, False, True, False),
    "something else": ("Other", "()", "Other", "()", "Other", False, False, False, False),
}


def test_user_agents(spark):
    df = spark.createDataFrame([(a,) for a in AGENTS] + [(None,)], "ua string")
    for row in df.transform(user_agent("ua", "info")).collect():
        info = row["info"]
        if row.ua is None:
            assert info is None
            continue
        got = (info.browser_family, info.browser_version, info.os_family, info.os_version, info.device_family,
               info.is_mobile, info.is_tablet, info.is_pc, info.is_bot)
        assert got == AGENTS[row.ua], row.ua


def test_settings(make_events, read_events):
    with pytest.raises(ValueError, match="Invalid enrichment type"):
        enrich("magic", source_field="a", target_field="b")
    with pytest.raises(ValueError, match="Source field"):
        enrich("lookup", target_field="b")
    with pytest.raises(ValueError, match="Target field"):
        enrich("lookup", source_field="b")
    df = make_events([{"a": 1}])
    assert read_events(df.transform(enrich("none", source_field="a", target_field="b")))["e0"]["fields"] == {"a": 1}


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_networks_against_all_ranges(spark, broadcast_rows):
    """Random nested, ragged and touching ranges of both versions: the smallest that holds the address."""
    import ipaddress
    import random

    rng = random.Random(4)
    rows, asked = [], []
    for base, bits, make in ((0x17000000, 32, ipaddress.IPv4Address), (0x2400 << 112, 128, ipaddress.IPv6Address)):
        space = 1 << 20 if bits == 32 else 1 << 100
        for i in range(60):
            lo = base + rng.randrange(space) // rng.choice([1, 1, 16, 4096]) * 1
            hi = min(lo + rng.randrange(1, space) // rng.choice([1, 7, 256, 65536]), base + space - 1)
            if i % 5 == 0:  # a whole network
                size = 1 << rng.randrange(0, 18)
                lo -= lo % size
                hi = lo + size - 1
            rows.append((str(make(lo)), str(make(hi)), f"r{bits}-{i}", lo, hi, bits))
            asked += [(make(x), x, bits) for x in (lo - 1, lo, lo + 1, (lo + hi) // 2, hi - 1, hi, hi + 1)]
    ranges = spark.createDataFrame([r[:3] for r in rows], "lo string, hi string, city_name string")
    df = spark.createDataFrame([(i, str(a[0])) for i, a in enumerate(asked)] + [(-1, None), (-2, "x"), (-3, "10.0.0.1")], "n int, ip string")
    got = {r["n"]: r["place"] and r["place"]["city_name"] for r in df.transform(geo("ip", "place", ranges, broadcast_rows=broadcast_rows)).collect()}
    for i, (address, x, bits) in enumerate(asked):
        held = [(hi - lo, lo, f'{{"city_name":"{name}"}}', name) for _, _, name, lo, hi, b in rows if b == bits and lo <= x <= hi]
        assert got[i] == (min(held)[3] if held and not address.is_private else None), address
    assert len(got) == len(asked) + 3 and got[-1] is got[-2] is got[-3] is None
    plan = df.transform(geo("ip", "place", ranges, broadcast_rows=broadcast_rows))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_without_a_key_are_dealt_out(spark):
    """With 90 % of the rows without a key no task of the shuffled join holds twice its share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN cast(id AS STRING) END AS key")
        table = spark.range(0, 40_000, 7).selectExpr("cast(id AS STRING) AS key", "id AS value")
        out = rows.transform(lookup("key", "value", table, broadcast_rows=0))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
        assert out.where("value IS NOT NULL").count() == len(range(0, 40_000, 70))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_files_are_strict(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "k string")
    for name, content, message in (("broken", '{"a": 1', "Invalid JSON"), ("list", "[1, 2]", "must contain a JSON object"), ("empty", "", "Invalid JSON")):
        (tmp_path / name).write_text(content)
        with pytest.raises(ValueError, match=message):
            df.transform(lookup("k", "v", lookup_file=str(tmp_path / name)))
    with pytest.raises(ValueError, match="not found"):
        df.transform(lookup("k", "v", lookup_file=str(tmp_path / "none")))
    (tmp_path / "good").write_text('{"a": "x", "b": null}')
    assert df.transform(lookup("k", "v", lookup_file=str(tmp_path / "good"))).first()["v"] == "x"


def test_lookup_of_odd_mappings(spark, make_events, read_events):
    df = spark.createDataFrame([("a",), ("1",), (None,)], "k string")
    assert [r["v"] for r in df.transform(lookup("k", "v", {})).collect()] == [None] * 3
    assert [r["v"] for r in df.transform(lookup("k", "v", {"a": None}, default_value="d")).collect()] == [None, "d", None]
    assert [r["v"] for r in df.transform(lookup("k", "v", {1: 5})).collect()] == [None, 5, None]
    big = {str(i): i for i in range(40)} | {"a": "text", "n": None, "l": [1, 2]}
    got = read_events(make_events([{"k": "a"}, {"k": "7"}, {"k": "n"}, {"k": "l"}, {"k": "zz"}]).transform(lookup("k", "v", big, default_value=0)))
    assert [got[f"e{i}"]["fields"].get("v") for i in range(5)] == ["text", 7, None, [1, 2], 0]
    small = {k: v for k, v in big.items() if not k.isdigit()}
    assert [e["fields"].get("v") for e in read_events(make_events([{"k": "a"}, {"k": "n"}, {"k": "l"}, {"k": "z"}]).transform(lookup("k", "v", small))).values()] == ["text", None, [1, 2], None]
