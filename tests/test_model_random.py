"""Random events through a chain, against a plain restatement of the documented rules."""

import json
import random
import re

import pytest

from logweave import Flow

LOOKUP = {"1": "one", "True": "yes", "a b": "text", "None": "null"}


def text(v):
    return json.dumps(v, separators=(",", ":")) if isinstance(v, (list, dict)) else str(v)


def m_json(e, ignore):
    raw = e["raw_data"]
    if raw:
        try:
            value = json.loads(raw)
        except ValueError:
            if not ignore:
                return None
            e["metadata"]["json_error"] = "invalid JSON"
            return e
        if isinstance(value, dict):
            e["fields"].update(value)
    return e


def m_filter(e, field, op, value, negate):
    f = e["fields"]
    if op == "exists":
        hit = field in f
    elif op == "==":
        hit = field in f and text(f[field]) == value
    elif op == "!=":
        hit = field in f and text(f[field]) != value
    elif op == "in":
        hit = field in f and text(f[field]) in [v.strip() for v in value[1:-1].split(",")]
    elif op == "=~":
        hit = field in f and bool(re.search(value, text(f[field])))
    else:
        if field not in f:
            hit = False
        else:
            try:
                number = float(f[field])
            except (TypeError, ValueError):
                return None
            hit = number > float(value) if op == ">" else number <= float(value)
    return e if hit != negate else None


def m_regex(e, field, pattern):
    value = e["fields"].get(field)
    if value:
        match = re.search(pattern, text(value))
        if match:
            e["fields"].update({k: v for k, v in match.groupdict().items() if v is not None})
    return e


def m_mutate(e, c):
    f = e["fields"]
    f.update(c.get("add_fields", {}))
    for k in c.get("remove_fields", []):
        f.pop(k, None)
    for old, new in c.get("rename_fields", {}).items():
        if old in f:
            f[new] = f[old]
            del f[old]
    for k in c.get("uppercase_fields", []):
        if isinstance(f.get(k), str):
            f[k] = f[k].upper()
    for k, kind in c.get("convert_fields", {}).items():
        if f.get(k) is not None:
            try:
                f[k] = {"int": int, "float": float, "str": text}[kind](f[k])
            except (TypeError, ValueError):
                e["metadata"][f"convert_error_{k}"] = True
    for k, (pattern, repl) in c.get("gsub_fields", {}).items():
        if isinstance(f.get(k), str):
            f[k] = re.sub(pattern, repl, f[k])
    for target, sources in c.get("merge_fields", {}).items():
        merged = ""
        for s in sources:
            if s in f:
                merged += (" " if merged else "") + text(f[s])
        if merged:
            f[target] = merged
    for k, (sep, limit) in c.get("split_fields", {}).items():
        if isinstance(f.get(k), str):
            f[k] = f[k].split(sep, limit)
    for k in c.get("strip_fields", []):
        if isinstance(f.get(k), str):
            f[k] = f[k].strip()
    return e


def m_lookup(e, source, target, default, preserve):
    f = e["fields"]
    if f.get(source) is None or (preserve and target in f):
        return e
    value = LOOKUP.get(text(f[source]), default)
    if value is not None:
        f[target] = value
    return e


NAMES = ["a", "b", "c", "d"]
VALUES = ["", " x ", "a b", "1", "-2.5", "ERR-7", "é Ü", 1, 0, -3, 2.5, True, False, None, [1, "x"], {"k": 1}]


def random_event(rng, i):
    fields = {n: rng.choice(VALUES) for n in NAMES if rng.random() < 0.7}
    raw = rng.choice(["", "{broken", "[1]", json.dumps({rng.choice(NAMES): rng.choice(VALUES), "z": i}), '{"a": 1} x'])
    return {"id": f"e{i}", "timestamp": "2023-01-01T00:00:00", "source_type": "t", "source_name": "s", "raw_data": raw,
            "fields": fields, "metadata": {}, "tags": []}


def random_step(rng):
    """A processor declaration and its model."""
    kind = rng.choice(["json", "filter", "regex", "mutate", "mutate", "lookup"])
    name = rng.choice(NAMES)
    if kind == "json":
        ignore = rng.random() < 0.7
        return ("json", {"target_field": "", "ignore_errors": ignore}), lambda e: m_json(e, ignore)
    if kind == "filter":
        negate = rng.random() < 0.4
        op, value = rng.choice([("exists", ""), ("==", "1"), ("!=", "True"), ("in", "[1, a b, None]"), ("=~", "[0-9b]"), (">", "0"), ("<=", "1.5")])
        condition = f"exists:{name}" if op == "exists" else f"{name} {op} {value}"
        return ("filter", {"condition": condition, "negate": negate}), lambda e: m_filter(e, name, op, value, negate)
    if kind == "regex":
        pattern = rng.choice([r"(?P<c>[A-Z]+)-(?P<n>\d)?", r"(?P<b>\w+) (?P<d>\w+)", r"^(?P<x>-?)(?P<y>\d)"])
        # "^(-?)" may match nothing; such a group is not optional and keeps the empty text.
        return ("regex", {"field": name, "pattern": pattern}), lambda e: m_regex(e, name, pattern)
    if kind == "lookup":
        default, preserve = rng.choice([None, "dflt"]), rng.random() < 0.5
        config = {"enrich_type": "lookup", "source_field": name, "target_field": "d", "lookup_table": LOOKUP,
                  "default_value": default, "preserve_existing": preserve}
        return ("enrich", config), lambda e: m_lookup(e, name, "d", default, preserve)
    other = rng.choice(NAMES)
    parts = [
        ("add_fields", {name: rng.choice(["new", 5])}), ("remove_fields", [other]), ("rename_fields", {name: other, "b": "q"}),
        ("uppercase_fields", NAMES), ("convert_fields", {name: rng.choice(["int", "float", "str"])}),
        ("gsub_fields", {other: [r"(\w)\s?", r"<\1>"]}), ("merge_fields", {"m": [name, other, "zz"]}),
        ("split_fields", {name: [" ", rng.choice([-1, 1])]}), ("strip_fields", NAMES),
    ]
    config = dict(rng.sample(parts, 3))
    return ("mutate", config), lambda e: m_mutate(e, config)


def normal(v):
    """Values as the engine stores them: integral floats from JSON read as whole numbers."""
    if isinstance(v, bool) or not isinstance(v, (int, float, list, dict)):
        return v
    if isinstance(v, list):
        return [normal(x) for x in v]
    if isinstance(v, dict):
        return {k: normal(x) for k, x in v.items()}
    return float(v)


@pytest.mark.parametrize("seed", range(6))
def test_random_chains(spark, read_events, seed):
    rng = random.Random(seed)
    from logweave.model import from_documents

    events = [random_event(rng, i) for i in range(120)]
    df = from_documents(spark.createDataFrame([(json.dumps(e),) for e in events], "value string"))
    steps = [random_step(rng) for _ in range(4)]
    flow = Flow({
        "name": "r", "sources": [{"name": "s", "type": "file", "config": {"path": "x"}}],
        "sinks": [{"name": "o", "type": "file", "config": {"path": "x"}}],
        "processors": [{"name": f"p{i}", "type": kind, "config": config} for i, ((kind, config), _) in enumerate(steps)],
    })
    got = read_events(flow.transform(df))
    want = {}
    for event in json.loads(json.dumps(events)):
        for _, model in steps:
            event = event and model(event)
        if event:
            want[event["id"]] = event
    story = [step for step, _ in steps]
    assert sorted(got) == sorted(want), story
    for key, event in want.items():
        assert normal(got[key]["fields"]) == normal(event["fields"]), (key, story)
        assert set(got[key]["metadata"]) == set(event["metadata"]), (key, story)
