"""Row filters."""

from pyspark.sql import functions as F

from logweave.checks.base import LABELLED, labelled, open_events, query
from logweave.operators.filter import filter_events
from logweave.operators.mutate import mutate


def _events(name, condition, where):
    @query(name, f"SELECT event_id, event_type, value FROM events WHERE {where}")
    def run(t):
        return t("events").transform(filter_events(condition)).select("event_id", "event_type", "value")


_events("filter_eq", "event_type == 'error'", "event_type = 'error'")
_events("filter_ne", "event_type != \"click\"", "event_type <> 'click'")
_events("filter_in", "event_type in [error, 'purchase']", "event_type IN ('error', 'purchase')")
_events("filter_not_in", "event_type not in [error, purchase]", "event_type NOT IN ('error', 'purchase')")
_events("filter_gt", "value > 12.5", "value > 12.5")
_events("filter_lt", "value < 3", "value < 3")


@query("filter_ge", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_ge(t):
    return t("lineitem").transform(filter_events("l_quantity >= 45")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_le", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10.5")
def filter_le(t):
    return t("part").transform(filter_events("p_size <= 10.5")).select("p_partkey", "p_size")


@query("filter_int_eq", "SELECT p_partkey, p_size FROM part WHERE p_size IN (7, 11)")
def filter_int_eq(t):
    # Whole-number columns compare natively; "07" is not the text of any number.
    return t("part").transform(filter_events("p_size in [7, 11, 07, x]")).select("p_partkey", "p_size")


@query("filter_regex", "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '[0-9]{3}[-.][0-9]')")
def filter_regex(t):
    return t("documents").transform(filter_events("text =~ [0-9]{3}[-.][0-9]")).select("doc_id", "n_chars")


@query("filter_not_regex", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^(red|blue) .*t$')")
def filter_not_regex(t):
    return t("part").transform(filter_events("p_name !~ '^(red|blue) .*t$'")).select("p_partkey", "p_name")


@query("filter_regex_escape", "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'An[a-z]+[.]') AND NOT regexp_matches(text, 'É[a-z]')")
def filter_regex_escape(t):
    rows = t("documents").transform(filter_events(r"text =~ '\x41n[a-z]+\x2e'")).transform(filter_events(r"text !~ '\u00c9[a-z]'"))
    return rows.select("doc_id", "n_chars")


@query("filter_exists", f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL")
def filter_exists(t):
    return labelled(t).transform(filter_events("exists:quality")).select("doc_id", "quality")


@query("filter_missing", f"SELECT doc_id, lang FROM {LABELLED} WHERE quality IS NULL")
def filter_missing(t):
    return labelled(t).transform(filter_events("missing:quality")).select("doc_id", "lang")


_RULES = ["quality != 1", "toxic >= 1", "lang in [de, es]"]
_HOLDS = "(coalesce(quality <> 1, FALSE) {0} coalesce(toxic >= 1, FALSE) {0} coalesce(lang IN ('de', 'es'), FALSE))"


def _combined(name, mode, negate, where):
    @query(name, f"SELECT doc_id, lang, quality, toxic FROM {LABELLED} WHERE {where}")
    def run(t):
        step = filter_events(conditions=_RULES, mode=mode, negate=negate)
        return labelled(t).transform(step).select("doc_id", "lang", "quality", "toxic")


_combined("filter_any", "any", False, _HOLDS.format("OR"))
_combined("filter_all", "all", False, _HOLDS.format("AND"))
_combined("filter_any_negate", "any", True, "NOT " + _HOLDS.format("OR"))
_combined("filter_all_negate", "all", True, "NOT " + _HOLDS.format("AND"))


@query(
    "filter_error_rows",
    """SELECT doc_id, s AS source, lang FROM (SELECT doc_id, lang, regexp_replace(source, '^src1', '') AS s FROM documents)
    WHERE TRY_CAST(s AS DOUBLE) IS NOT NULL AND (TRY_CAST(s AS DOUBLE) > 3 OR lang = 'en')""",
)
def filter_error_rows(t):
    """Rows whose operand is no number are dropped whatever the other condition says."""
    docs = t("documents").select("doc_id", "source", "lang")
    docs = docs.transform(mutate(gsub_fields={"source": ["^src1", ""]}))
    return docs.transform(filter_events(conditions=["source > 3", "lang == en"]))


@query(
    "filter_open_layout",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type FROM events
    WHERE event_type <> 'error' AND value >= 10 AND user_id NOT IN (3, 4)""",
)
def filter_open_layout(t):
    step = filter_events(conditions=["value >= 10", "user_id not in [3, 4]"], mode="all")
    kind = F.try_variant_get(F.try_element_at("fields", F.lit("event_type")), "$", "string")
    return open_events(t).transform(step).select("id", kind.alias("event_type"))
