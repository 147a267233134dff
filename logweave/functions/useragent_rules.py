"""Ordered rules that read browser, system and device from a user-agent text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from logweave.functions import regex


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds the product; its group is the version.

    ``version`` gives the version where the text does not spell it. ``marks`` are texts in lower case, one of
    which every match holds in some case; a plain search for them spares other texts a pattern without a literal of its own.
    """

    pattern: str
    family: str
    brand: str | None = None
    version: str | None = None
    kind: str = ""  # mobile, tablet, pc or bot
    marks: tuple[str, ...] = ()


_CRAWLERS = ("bot", "spider", "crawler", "slurp")
_V3 = r"(\d+(?:[._]\d+){0,2})"

# Product tokens browsers, systems and devices announce themselves with.
BROWSERS = (
    Rule(rf"Googlebot(?:/{_V3})?", "Googlebot", kind="bot"),
    Rule(rf"(?i)bingbot(?:/{_V3})?", "bingbot", kind="bot", marks=("bingbot",)),
    Rule(rf"(?i)(?:bot|spider|crawler|slurp)\b(?:/{_V3})?", "Other", kind="bot", marks=_CRAWLERS),
    Rule(rf"Edg(?:e|A|iOS)?/{_V3}", "Edge"),
    Rule(rf"(?:OPR|Opera)[/ ]{_V3}", "Opera", marks=("opr", "opera")),
    Rule(rf"SamsungBrowser/{_V3}", "Samsung Internet"),
    Rule(rf"FxiOS/{_V3}", "Firefox iOS"),
    Rule(rf"CriOS/{_V3}", "Chrome Mobile iOS"),
    Rule(rf"(?:Mobile|Tablet); rv:.*Firefox/{_V3}", "Firefox Mobile"),
    Rule(rf"Firefox/{_V3}", "Firefox"),
    Rule(rf"Chrome/{_V3}(?:\.\d+)? Mobile", "Chrome Mobile"),
    Rule(rf"Chrome/{_V3}", "Chrome"),
    Rule(rf"Version/{_V3}.*Mobile.*Safari/", "Mobile Safari"),
    Rule(rf"Version/{_V3}.*Safari/", "Safari"),
    Rule(rf"MSIE {_V3}", "IE"),
    Rule(rf"Trident/.*rv:{_V3}", "IE"),
    Rule(rf"curl/{_V3}", "curl"),
    Rule(rf"[Pp]ython-requests/{_V3}", "Python Requests"),
)
SYSTEMS = (
    Rule(r"Windows NT 10\.0", "Windows", version="10"),
    Rule(r"Windows NT 6\.3", "Windows", version="8.1"),
    Rule(r"Windows NT 6\.2", "Windows", version="8"),
    Rule(r"Windows NT 6\.1", "Windows", version="7"),
    Rule(r"Windows", "Windows", version=""),
    Rule(rf"(?:iPhone|CPU) OS {_V3}", "iOS"),
    Rule(rf"Android {_V3}", "Android"),
    Rule(r"Android", "Android", version=""),
    Rule(rf"Mac OS X {_V3}", "Mac OS X"),
    Rule(rf"CrOS \S+ {_V3}", "Chrome OS"),
    Rule(r"Ubuntu", "Ubuntu", version=""),
    Rule(r"Linux", "Linux", version=""),
)
DEVICES = (
    Rule(r"(?i)bot\b|spider|crawler|slurp", "Spider", brand="Spider", kind="bot", marks=_CRAWLERS),
    Rule(r"iPad", "iPad", brand="Apple", kind="tablet"),
    Rule(r"iPhone", "iPhone", brand="Apple", kind="mobile"),
    Rule(r"(SM-T\w+)", "Samsung", brand="Samsung", kind="tablet"),
    Rule(r"(SM-\w+)", "Samsung", brand="Samsung", kind="mobile"),
    Rule(r"(Pixel [\w ]+?)(?: Build|\))", "Pixel", brand="Google", kind="mobile"),
    Rule(r"Android.*Mobile|Mobile.*Firefox", "Generic Smartphone", brand="Generic", kind="mobile", marks=("mobile",)),
    Rule(r"Android", "Generic Tablet", brand="Generic", kind="tablet"),
    Rule(r"Macintosh", "Mac", brand="Apple", kind="pc"),
    Rule(r"Windows NT|X11|CrOS", "Other", kind="pc", marks=("windows nt", "x11", "cros")),
)


def first_rule(text: Column, lowered: Column, rules: tuple[Rule, ...]) -> Column:
    """Position of the first rule that applies, NULL if none does; ``lowered`` is the text in lower case."""
    chain = None
    for i, rule in enumerate(rules):
        hit = regex.found(text, regex.compile_pattern(rule.pattern))
        if rule.marks:
            hit = reduce(or_, (F.contains(lowered, F.lit(mark)) for mark in rule.marks)) & hit
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return chain


def pick(position: Column, values: list, default: Column) -> Column:
    """The entry of a constant list at ``position``."""
    constants = F.array(*(F.lit(v).cast("string") for v in values))
    return F.coalesce(F.get(constants, position), default)


def found_version(text: Column, position: Column, rules: tuple[Rule, ...]) -> Column:
    """Version of the chosen rule as spelled, empty without one."""
    chain = None
    for i, rule in enumerate(rules):
        value = F.regexp_extract(text, rule.pattern, 1) if rule.version is None else F.lit(rule.version)
        chain = F.when(position == i, value) if chain is None else chain.when(position == i, value)
    return F.coalesce(chain, F.lit(""))


def version_text(version: Column) -> Column:
    """``91.0.4472`` as ``(91, 0, 4472)``, ``7`` as ``(7,)``."""
    parts = F.replace(F.translate(version, "_", "."), F.lit("."), F.lit(", "))
    single = (version != "") & ~F.contains(parts, F.lit(","))
    return F.concat(F.lit("("), parts, F.when(single, F.lit(",")).otherwise(F.lit("")), F.lit(")"))
