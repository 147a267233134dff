"""JSON, regex and grok extraction."""

import re

import pytest
from pyspark.sql import functions as F

from logweave import extract_grok, extract_regex, parse_json
from logweave.functions import grok_patterns, regex


def test_json_to_field_and_flatten(make_events, read_events):
    raw = ['{"level": "INFO", "n": 1, "x": null}', "[1, 2]", '"s"', "", '{"invalid": "json"', '{"a": 1} rest', "12 foo"]
    df = make_events([{"level": "old", "keep": 1}] * len(raw), raw)
    got = read_events(df.transform(parse_json()))
    assert sorted(got) == ["e0", "e1", "e2", "e3"]
    assert got["e0"]["fields"]["parsed"] == {"level": "INFO", "n": 1, "x": None}
    assert got["e1"]["fields"]["parsed"] == [1, 2]
    assert "parsed" not in got["e3"]["fields"]
    flat = read_events(df.transform(parse_json(target_field="", ignore_errors=True)))
    assert len(flat) == len(raw)
    assert flat["e0"]["fields"] == {"level": "INFO", "keep": 1, "n": 1, "x": None}
    assert flat["e1"]["fields"] == {"level": "old", "keep": 1}
    assert "json_error" in flat["e4"]["metadata"] and "json_error" in flat["e5"]["metadata"]
    assert "json_error" not in flat["e3"]["metadata"]


def test_json_from_field_and_drop_source(make_events, read_events):
    df = make_events([{"json_data": '{"a": 1, "a": 2}', "k": 1}, {"k": 2}, {"json_data": {"b": 1}}])
    got = read_events(df.transform(parse_json("json_data", "p", preserve_original=False)))
    assert got["e0"]["fields"] == {"k": 1, "p": {"a": 2}}
    assert got["e1"]["fields"] == {"k": 2}
    assert got["e2"]["fields"] == {"p": {"b": 1}}


def test_json_typed(spark):
    rows = [('{"k": 3, "s": "x"}',), ('{"k": "bad"}',), ("nope",), (None,), ("[1]",)]
    df = spark.createDataFrame(rows, "raw_data string")
    flat = df.transform(parse_json(target_field="", schema="k bigint, s string"))
    assert [(r.raw_data, r.k, r.s) for r in flat.collect()] == [
        (rows[0][0], 3, "x"), (rows[1][0], None, None), (None, None, None), ("[1]", None, None),
    ]
    nested = df.transform(parse_json(schema="k bigint", ignore_errors=True)).collect()
    assert [r.parsed.k if r.parsed else None for r in nested] == [3, None, None, None, None]
    assert [("json_error" in (r.metadata or {})) for r in nested] == [False, False, True, False, False]
    with pytest.raises(ValueError):
        df.transform(parse_json(target_field=""))


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([('{"k": 3}',)], "raw_data string")
    plan = df.transform(parse_json(target_field="", schema="k bigint, j bigint", ignore_errors=True))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("parseJson") == 1


PATTERN_CASES = [
    (r"(?P<user_name>\w+)@(?P<host>\w+)?", ["foo@bar x", "é@ x", "none", "", None]),
    (r"(?<a>a)|(?<b>b)", ["zb", "a", "c"]),
    (r"^(?P<d>\d+)$", ["12\n", "12", "x12"]),
    (r"(?P<q>[\[&\]]+)", ["x[[&", "]"]),
    (r"(?i)(?P<v>é.)", ["É1", "e1"]),
    (r"(?P<all>.*)", ["a\x01b", "line\nnext", "a\rb"]),
    (r"(?P<x>x(?P<y>y)?)+z", ["xyxz", "xz", "xyz"]),
    (r"(?P<w>a{,2})b", ["aaab", "b"]),
    (r"(?P<c>\d{1,3})\.(?P<rest>\S*)", ["v1.22.3 x", "1."]),
    (r"(?x) (?P<n>\d+) # number", ["ab 12"]),
]


def test_regex_matches_like_re(spark, make_events):
    texts = sorted({t for _, ts in PATTERN_CASES for t in ts if t is not None})
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "raw_data string")
    for pattern, _ in PATTERN_CASES:
        python = re.compile(re.sub(r"\(\?<(?=[a-z])", "(?P<", pattern))
        got = {r.raw_data: r.m for r in df.transform(extract_regex(pattern, target_field="m")).collect()}
        for text in texts:
            match = python.search(text) if text else None
            want = match.groupdict() if match else None
            assert (got[text].asDict() if got[text] else None) == want, (pattern, text)
        assert got[None] is None


def test_regex_fields(make_events, read_events):
    df = make_events([{"m": "id=7 ok", "id_no": "old"}, {"m": "nothing"}, {"n": 1}, {"m": "id=8"}])
    got = read_events(df.transform(extract_regex(r"id=(?P<id_no>\d+)(?: (?P<word>\w+))?", "m", preserve_original=False)))
    assert [got[f"e{i}"]["fields"] for i in range(4)] == [
        {"id_no": "7", "word": "ok"}, {"m": "nothing"}, {"n": 1}, {"id_no": "8"},
    ]
    struct = read_events(df.transform(extract_regex(r"id=(?P<id_no>\d+)(?: (?P<word>\w+))?", "m", target_field="t")))
    assert struct["e3"]["fields"]["t"] == {"id_no": "8", "word": None}
    assert "t" not in struct["e1"]["fields"]


def test_regex_positional(spark):
    df = spark.createDataFrame([("2024-05", "keep"), ("x", "keep")], "raw_data string, year string")
    step = extract_regex(r"(\d+)-(\d+)", named_groups=False, group_names=["year"])
    rows = [(r.year, r.group2) for r in df.transform(step).collect()]
    assert rows == [("2024", "05"), ("keep", None)]
    with pytest.raises(ValueError, match="2 capturing groups"):
        extract_regex(r"(\d+)-(\d+)", named_groups=False)
    for bad in ("", "(", "[a", "a)", "(?(1)a|b)", "*a"):
        with pytest.raises(ValueError):
            extract_regex(bad)


def test_each_pattern_runs_once(spark):
    df = spark.createDataFrame([("a1",)], "raw_data string")
    out = df.transform(extract_regex(r"(?P<a>[a-z])(?P<b>[0-9])"))
    assert out._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1


# A text each grok pattern finds, what it finds there, and a text without a match.
GROK = {
    "WORD": ("-- word_1 --", "word_1", "--"), "NOTSPACE": (" a,b c", "a,b", "  "), "SPACE": ("a  b", "  ", "ab"),
    "DATA": ("abc", "", None), "GREEDYDATA": ("abc", "abc", None),
    "QUOTEDSTRING": (r'x "a \"b\" c" y', r'"a \"b\" c"', '"open'), "QS": ("say 'hi'", "'hi'", "none"),
    "INT": ("n=-12", "-12", "x"), "BASE10NUM": ("v 3.25s", "3.25", "x"), "NUMBER": ("v .5", ".5", "x"),
    "BASE16NUM": ("0xFF", "0xFF", "xyz"), "BASE16FLOAT": ("1A.F", "1A.F", "xyz"), "POSINT": ("010 12", "12", "0"),
    "NONNEGINT": ("a 0", "0", "a0b"), "IPV4": ("at 10.0.0.255:80", "10.0.0.255", "256.1.1"),
    "IPV6": ("[fe80::1]", "fe80::1", "1:2"), "IP": ("ip 1.2.3.4", "1.2.3.4", "x"),
    "HOSTNAME": ("to web-1.example.com now", "to", "--"), "HOST": ("a.b", "a.b", "--"),
    "IPORHOST": ("1.2.3.4", "1.2.3.4", "--"), "HOSTPORT": ("db:5432", "db:5432", "db:x"),
    "PATH": ("see /var/log", "/var/log", "none"), "UNIXPATH": ("see /var/log x", "/var/log", "none"),
    "WINPATH": (r"in C:\Temp\a", r"C:\Temp\a", "none"), "TTY": ("on /dev/pts/3", "/dev/pts/3", "/dev/x"),
    "URIPROTO": ("https://x", "https", "1"), "URIHOST": ("a.b:80/x", "a.b:80", "--"),
    "URIPATH": ("x /a/b?c", "/a/b", "none"), "URIPARAM": ("/a?b=1&c", "?b=1&c", "none"),
    "URIPATHPARAM": ("/a/b?c=1 x", "/a/b?c=1", "none"),
    "URI": ("go http://u:p@h.org:8/p?q=1 x", "http://u:p@h.org:8/p?q=1", "h.org"),
    "MONTH": ("in March 3", "March", "Mars"), "MONTHNUM": ("00 12", "1", "x"), "MONTHNUM2": ("12", "12", "1"),
    "MONTHDAY": ("31", "31", "x"), "DAY": ("on Tuesday", "Tuesday", "x"), "YEAR": ("in 2024", "2024", "x"),
    "HOUR": ("23", "23", "x"), "MINUTE": ("59", "59", "x"), "SECOND": ("59.123", "59.123", "x"),
    "TIME": ("at 12:30:45.5", "12:30:45.5", "12:30"), "DATE_US": ("12/31/2024", "12/31/2024", "x"),
    "DATE_EU": ("31.12.2024", "31.12.2024", "x"), "ISO8601_TIMEZONE": ("+02:00", "+02:00", "x"),
    "ISO8601_SECOND": ("59,5", "59,5", "x"), "TIMESTAMP_ISO8601": ("t=2024-01-02T03:04:05.6Z", "2024-01-02T03:04:05.6Z", "x"),
    "DATE": ("1/2/2024", "1/2/2024", "x"), "DATESTAMP": ("1/2/2024 03:04:05", "1/2/2024 03:04:05", "1/2/2024"),
    "TZ": ("in PST", "PST", "XST"), "DATESTAMP_RFC822": ("Mon Jan 02 2024 03:04:05 UTC", "Mon Jan 02 2024 03:04:05 UTC", "x"),
    "DATESTAMP_RFC2822": ("Mon, 02 Jan 2024 03:04:05 +0000", "Mon, 02 Jan 2024 03:04:05 +0000", "x"),
    "DATESTAMP_OTHER": ("Mon Jan 02 03:04:05 UTC 2024", "Mon Jan 02 03:04:05 UTC 2024", "x"),
    "DATESTAMP_EVENTLOG": ("20240102030405", "20240102030405", "x"),
    "SYSLOGTIMESTAMP": ("Jan  2 03:04:05 h", "Jan  2 03:04:05", "x"), "PROG": ("sshd[1]", "sshd", "[]"),
    "SYSLOGPROG": ("sshd[12]:", "sshd[12]", "[]"), "SYSLOGHOST": ("web1", "web1", "--"),
    "SYSLOGFACILITY": ("<1.2>", "<1.2>", "<>"),
    "SYSLOGBASE": ("Jan  2 03:04:05 web1 sshd[12]: hi", "Jan  2 03:04:05 web1 sshd[12]:", "x"),
    "HTTPDATE": ("[10/Oct/2000:13:55:36 -0700]", "10/Oct/2000:13:55:36 -0700", "x"),
    "HTTPDUSER": ("frank", "frank", " "), "HTTPDERROR_DATE": ("Mon Jan 02 03:04:05 2024", "Mon Jan 02 03:04:05 2024", "x"),
    "COMMONAPACHELOG": ('h - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23',
                        'h - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23', "x"),
    "COMBINEDAPACHELOG": ('h - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 - "r" "a b"',
                          'h - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 - "r" "a b"', "x"),
    "USER": ("@bob_1", "bob_1", "@"), "USERNAME": ("@bob", "bob", "@"), "EMAILLOCALPART": ("<joe+x>", "joe+x", "<>"),
    "EMAILADDRESS": ("<joe@example.com>", "joe@example.com", "joe"), "LOGLEVEL": ("[WARN] x", "WARN", "x"),
}


def test_every_grok_pattern(spark):
    assert set(GROK) == set(grok_patterns.PATTERNS) and len(GROK) == 69
    compiled = {n: regex.compile_pattern(grok_patterns.expand("%%{%s:found_it}" % n)) for n in GROK}
    columns = []
    for name, (text, _, other) in GROK.items():
        for k, value in enumerate((text, other)):
            groups = regex.match_groups(F.lit(value).cast("string"), compiled[name])
            hit = F.when(regex.matched(groups), F.coalesce(regex.group_value(groups, compiled[name], 1), F.lit("")))
            columns.append(hit.alias(f"{name}_{k}"))
    row = spark.range(1).select(*columns).first()
    for name, (text, want, other) in GROK.items():
        assert row[f"{name}_0"] == want, (name, text)
        assert row[f"{name}_1"] is None, (name, other)


def test_grok_apache_and_syslog(make_events, read_events):
    lines = [
        '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326 "http://r/" "Mozilla/4.08 [en]"',
        "Oct 11 22:14:15 mymachine su[99]: failed", "noise",
    ]
    df = make_events([{}] * 3, lines)
    got = read_events(df.transform(extract_grok(["%{COMBINEDAPACHELOG}", "%{SYSLOGBASE} %{GREEDYDATA:message}"])))
    assert got["e0"]["fields"] == {
        "clientip": "127.0.0.1", "ident": "-", "auth": "frank", "timestamp": "10/Oct/2000:13:55:36 -0700",
        "verb": "GET", "request": "/a.gif", "httpversion": "1.0", "response": "200", "bytes": "2326",
        "referrer": '"http://r/"', "agent": '"Mozilla/4.08 [en]"',
    }
    assert got["e1"]["fields"] == {
        "timestamp": "Oct 11 22:14:15", "logsource": "mymachine", "program": "su", "pid": "99", "message": "failed",
    }
    assert got["e2"]["fields"] == {}


def test_grok_break_on_match(spark, make_events, read_events):
    patterns = ["%{INT:n}", "%{WORD:w} %{INT:n}", "%{TAG:tag}"]
    custom = {"TAG": r"#\w+"}
    df = make_events([{"m": "7 b 8"}, {"m": "#x"}, {"m": "-"}])

    def fields(**kw):
        got = read_events(df.transform(extract_grok(patterns, "m", custom_patterns=custom, **kw)))
        return [{k: v for k, v in got[f"e{i}"]["fields"].items() if k != "m"} for i in range(3)]

    assert fields() == [{"n": "7"}, {"tag": "#x"}, {}]
    assert fields(break_on_match=False) == [{"n": "8", "w": "b"}, {"tag": "#x"}, {}]
    assert fields(target_field="t")[0] == {"t": {"n": "7"}}
    assert fields(target_field="t", break_on_match=False)[0] == {"t": {"w": "b", "n": "8"}}
    typed = spark.createDataFrame([("7 b 8",), ("#x",), ("-",)], "raw_data string")
    rows = typed.transform(extract_grok(patterns, custom_patterns=custom, break_on_match=False)).collect()
    assert [(r.n, r.w, r.tag) for r in rows] == [("8", "b", None), (None, None, "#x"), (None, None, None)]
    with pytest.raises(ValueError, match="Unknown pattern: NOPE"):
        extract_grok(["%{NOPE:x}"])
    with pytest.raises(ValueError, match="At least one"):
        extract_grok([])
