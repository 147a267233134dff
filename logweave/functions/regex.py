"""Regular expressions written in the ``re`` dialect, run by the JVM.

``compile_pattern`` rewrites a pattern once on the driver. ``match_groups`` returns all
groups of the first match with a single regex evaluation per row.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Separates groups in the rewritten text; rows that contain it take the per-group path.
MARK = "\x01"

_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_FLAGS = re.compile(r"\(\?([aiLmsux]+)([:)])")
_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}")
# One escape as a whole: a code point, an octal number, a group reference, or a single character.
_ESCAPE = re.compile(r"\\(?:x(?P<x>[0-9a-fA-F]{2})|u(?P<u>[0-9a-fA-F]{4})|U(?P<U>[0-9a-fA-F]{8})|(?P<octal>0[0-7]{0,2}|[0-3][0-7]{2})|(?P<group>[1-9]\d?)|(?P<plain>.))", re.S)
# Escapes whose Java spelling differs outside a character class.
_ESCAPES = {"Z": r"\z", "v": r"\x0B", "a": r"\x07"}
# Escapes of one character in a replacement.
_PLAIN = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}


@dataclass(frozen=True)
class Group:
    name: str | None
    optional: bool  # may stay out of a successful match


@dataclass(frozen=True)
class Pattern:
    flags: str
    body: str
    groups: tuple[Group, ...]
    required: str = ""  # a text every match contains

    @property
    def java(self) -> str:
        return self.flags + self.body

    def names(self) -> list[str]:
        """Distinct group names in order of appearance."""
        return list(dict.fromkeys(g.name for g in self.groups if g.name))


@dataclass(eq=False)
class _Open:
    index: int | None
    branches: bool = False
    negative: bool = False
    around: bool = False
    literals: list[str] = field(default_factory=lambda: [""])  # the last one may still grow

    def literal(self, ch: str, rest: str) -> None:
        """Note a plain character, given what follows it in the pattern."""
        count = _COUNT.match(rest)
        if rest[:1] in ("?", "*") or (count and int(count.group(1) or 0) == 0):
            self.literals.append("")
        elif rest[:1] == "+" or count:
            self.literals[-1] += ch
            self.literals.append("")
        else:
            self.literals[-1] += ch

    def cut(self) -> None:
        self.literals.append("")


def compile_pattern(pattern: str) -> Pattern:
    """Translate ``pattern`` to the JVM dialect with numbered groups."""
    out: list[str] = []
    names: list[str | None] = []
    parents: list[list[_Open]] = []
    skippable: set[int] = set()
    stack: list[_Open] = [_Open(None)]
    unicode_classes = ignore_case = ascii_only = False
    i, in_class, class_start = 0, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            token = _ESCAPE.match(pattern, i)
            if not token:
                raise ValueError("Invalid regular expression pattern: trailing backslash")
            i = token.end()
            code = token["x"] or token["u"] or token["U"] or (token["octal"] and f"{int(token['octal'], 8):x}")
            nxt = token["plain"] or ""
            unicode_classes |= nxt != "" and nxt in "wWdDsSbB"
            if not in_class:
                if nxt and not nxt.isalnum():
                    stack[-1].literal(nxt, pattern[i:])
                else:  # stands for something else than its own text
                    stack[-1].cut()
            if code:
                out.append("\\x{%s}" % code)
            elif token["group"]:
                out.append(f"(?:\\{token['group']})")
            elif in_class and nxt == "b":
                out.append(r"\x08")
            else:
                out.append(_ESCAPES.get(nxt, ch + nxt))
            continue
        if in_class:
            if ch == "]" and i > class_start:
                in_class = False
                out.append(ch)
            else:
                out.append("\\" + ch if ch in "[]&" else ch)
            i += 1
            continue
        if ch == "[":
            stack[-1].cut()
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            class_start = i
            continue
        if ch == "(":
            stack[-1].cut()
            named = _NAMED.match(pattern, i)
            flags = _FLAGS.match(pattern, i)
            if named or pattern[i + 1 : i + 2] != "?":
                names.append(named.group(1) if named else None)
                parents.append(list(stack))
                stack.append(_Open(len(names)))
                out.append("(")
                i = named.end() if named else i + 1
            elif flags:
                ascii_only |= "a" in flags.group(1)
                ignore_case |= "i" in flags.group(1)
                kept = "".join(c for c in flags.group(1) if c in "imsx")
                if flags.group(2) == ":":
                    stack.append(_Open(None))
                    out.append(f"(?{kept}:")
                elif kept:
                    out.append(f"(?{kept})")
                i = flags.end()
            elif pattern.startswith("(?P=", i):
                end = pattern.index(")", i)
                out.append(f"(?:\\{names.index(pattern[i + 4:end]) + 1})")
                i = end + 1
            elif pattern.startswith("(?#", i):
                i = pattern.index(")", i) + 1
            elif pattern.startswith("(?(", i):
                raise ValueError("Invalid regular expression pattern: conditional groups are not supported")
            else:
                head = re.compile(r"\(\?(?:<?[=!]|>|[imsx]*-?[imsx]*:)").match(pattern, i)
                if not head:
                    raise ValueError(f"Invalid regular expression pattern: unknown group at {i}")
                stack.append(_Open(None, negative="!" in head.group(), around=head.group()[-1] in "=!"))
                out.append(head.group())
                i = head.end()
            continue
        if ch == ")":
            if len(stack) == 1:
                raise ValueError("Invalid regular expression pattern: unbalanced parenthesis")
            closed = stack.pop()
            count = _COUNT.match(pattern, i + 1)
            after = pattern[i + 1 : i + 2]
            may_skip = after in ("?", "*") or bool(count and int(count.group(1) or 0) == 0)
            for index, chain in enumerate(parents, start=1):
                within = index == closed.index or closed in chain
                if within and (may_skip or closed.branches or closed.negative):
                    if index != closed.index or may_skip:
                        skippable.add(index)
            if not (may_skip or closed.branches or closed.around):
                stack[-1].literals += closed.literals
            stack[-1].cut()
            out.append(")")
            i += 1
            continue
        if ch == "|":
            stack[-1].branches = True
        if ch in "|.^$?*+{}":
            stack[-1].cut()
        else:
            stack[-1].literal(ch, pattern[i + 1 :])
        if ch == "{":
            count = _COUNT.match(pattern, i)
            if count and (count.group(1) or count.group(3)):
                out.append("{%s%s%s}" % (count.group(1) or "0", count.group(2), count.group(3)))
                i = count.end()
            else:
                out.append(r"\{")
                i += 1
            continue
        out.append(ch)
        i += 1
    if len(stack) != 1 or in_class:
        raise ValueError("Invalid regular expression pattern: missing ), unterminated group or class")
    if stack[0].branches:
        skippable.update(range(1, len(names) + 1))
    _check(pattern)
    flexible = stack[0].branches or re.search(r"\(\?[a-zA-Z]*[ix]", pattern)
    required = "" if flexible else max(stack[0].literals, key=len).strip(" ")
    flags = "(?d" + ("U" if (unicode_classes or ignore_case) and not ascii_only else "") + ")"
    groups = tuple(Group(n, k in skippable) for k, n in enumerate(names, start=1))
    return Pattern(flags, "".join(out), groups, required)


def _check(pattern: str) -> None:
    """Let ``re`` reject a malformed pattern (repeated names are legal here)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(_NAMED.sub("(", re.sub(r"\(\?P=\w+\)", "", pattern)))
    except re.error as error:
        raise ValueError(f"Invalid regular expression pattern: {error}") from error


def found(text: Column, pattern: Pattern) -> Column:
    """Whether the pattern occurs anywhere in the text.

    A plain search for the required part spares the regex most texts without a match.
    """
    hit = text.rlike(pattern.java)
    return F.contains(text, F.lit(pattern.required)) & hit if pattern.required else hit


def match_groups(text: Column, pattern: Pattern) -> Column:
    """Array whose element ``i`` is group ``i`` of the first match.

    The array has a single element or is NULL when nothing matches. All groups come
    out of one regex run: the text is replaced by its marked groups and cut apart.
    """
    numbers = range(1, len(pattern.groups) + 1)
    end = "\n" if re.search(r"\(\?[ims]*x", pattern.body) else ""  # ends a trailing comment
    whole = f"{pattern.flags}\\A(?s:.*?)(?:{pattern.body}{end})(?s:.*)\\z"
    marked = MARK + MARK.join(f"${i}" for i in numbers)
    one_run = F.split(F.regexp_replace(text, whole, marked), MARK)
    per_group = F.when(
        found(text, pattern),
        F.array(F.lit(""), *([F.regexp_extract(text, pattern.java, i) for i in numbers] or [F.lit("")])),
    )
    groups = F.when(F.instr(text, MARK) > 0, per_group).otherwise(one_run)
    return F.when(F.contains(text, F.lit(pattern.required)), groups) if pattern.required else groups


def matched(groups: Column) -> Column:
    """Whether ``match_groups`` found a match."""
    return F.coalesce(F.size(groups) > 1, F.lit(False))


def group_value(groups: Column, pattern: Pattern, index: int) -> Column:
    """Text of group ``index``; NULL without a match or when the group took no part."""
    value = F.get(groups, index)
    return F.nullif(value, F.lit("")) if pattern.groups[index - 1].optional else value


def replacement(template: str, pattern: Pattern) -> str:
    """Replacement text of the ``re`` dialect (``\\1``, ``\\g<1>``, ``\\g<name>``) in the JVM's ``$1`` spelling."""
    out, i = [], 0
    names = [g.name for g in pattern.groups]
    while i < len(template):
        ch = template[i]
        ref = re.compile(r"\\(?:g<([^>]*)>|([1-9]\d?)(?![0-7]))").match(template, i)
        octal = re.compile(r"\\(0[0-7]{0,2}|[0-3][0-7]{2})").match(template, i)
        if ref:
            name = ref.group(1) if ref.group(1) is not None else ref.group(2)
            if name.isdecimal() and int(name) <= len(names):
                number = int(name)
            elif name in names:
                number = names.index(name) + 1
            else:
                raise ValueError(f"invalid group reference {name}")
            out.append(f"${number}")
            i = ref.end()
            if template[i : i + 1].isdigit():  # keep a following digit out of the group number
                out.append("\\" + template[i])
                i += 1
        elif octal:
            out.append(_quoted(chr(int(octal.group(1), 8))))
            i = octal.end()
        elif ch == "\\" and i + 1 < len(template):
            nxt = template[i + 1]
            if nxt not in _PLAIN and nxt.isascii() and nxt.isalnum():
                raise ValueError(f"bad escape \\{nxt}")
            out.append(_quoted(_PLAIN.get(nxt, ch + nxt)))
            i += 2
        else:
            out.append(_quoted(ch))
            i += 1
    return "".join(out)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")
