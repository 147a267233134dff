"""Licence scans by canonical digest.

A known licence text and a text to be scanned are brought to one canonical form, whose SHA-256 digests are
joined: lower case, equivalent spellings as one, copyright lines out, every run of what is neither letter
nor digit (line breaks too) as one space. Whole texts are compared, and beside them every line of a document as a text of its
own, so a notice above or below other content is found. Digests equal or not: nothing is guessed.

Known are the notices of one line below, the licences and notices of ``license_texts.json`` and the notices of
the GNU licences, each in the variants of ``known_texts``: with and without title, as lines and as paragraphs. A
notice of several lines is found where it is the whole text or stands on one line.

Everything is a DataFrame expression. The known table is counted, and broadcast only within
``BROADCAST_ROWS`` rows of fixed width; beyond that the digests are joined by a shuffle.

Null and empty texts, and lines without a letter or digit, match nothing. Rows are answered one by one,
repeated ones too. Extra columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.functions.once import once

BROADCAST_ROWS = 100_000

# Spellings that count as one. What every place to change holds (as plain text, or None for a
# digit), the pattern, and what it becomes; in this order. None reaches over the end of a line.
EQUIVALENT = (
    ("licence", r"licence", "license"), ("http", r"https?://(www\.)?", ""), ("organisation", "organisation", "organization"),
    ("authorise", "authorise", "authorize"), ("commercial", r"\bnon-commercial\b", "noncommercial"), ("(c)", r"\(c\)", "copyright"), ("©", "©", "copyright"),
    ("&", "&", " and "), ("version", r"\bversion\b", "v"), (None, r"\bv(\d)", "v $1"), (None, r"(\d)\.0\b", "$1"),
)
# Notices as their owners publish them, and short licences whole.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("reserved", "All rights reserved."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)


# Titles that stand above the two licences given whole among the notices.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)")}
GNU = """{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
{work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.
You should have received a copy of the GNU {kind} Public License along with {this}{end}"""
GNU_KINDS = (
    ("GPL-2.0-or-later", "General", "2"), ("GPL-3.0-or-later", "General", "3"), ("AGPL-3.0-or-later", "Affero General", "3"),
    ("LGPL-2.0-or-later", "Library General", "2"), ("LGPL-2.1-or-later", "Lesser General", "2.1"), ("LGPL-3.0-or-later", "Lesser General", "3"),
)
GNU_ENDS = (
    ". If not, see <https://www.gnu.org/licenses/>.", "; if not, see <https://www.gnu.org/licenses/>.", ".",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)


def _gnu_notices() -> Iterator[tuple[str, str]]:
    for (name, kind, version), work, end in product(GNU_KINDS, ("program", "library", "file", "software"), GNU_ENDS):
        yield name, GNU.format(work=f"This {work}", this=f"this {work}", kind=kind, version=version, end=end)


def known_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of all that is known, in every variant."""
    out = [*NOTICES, *_gnu_notices()]
    whole = [{"license": name, "titles": TITLES[name], "text": text.removeprefix("MIT License\n")} for name, text in NOTICES if name in TITLES and "\n" in text]
    whole += json.loads(files(__package__).joinpath("license_texts.json").read_text("utf-8"))
    for entry in whole:
        bodies = [entry["text"]]
        if entry["license"] == "ISC":
            bodies.append(bodies[0].replace("and/or distribute", "and distribute"))
        if entry.get("bsd"):  # both words for the holder, numbered and with other marks, the rights on a line of their own
            bodies += [b.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for b in bodies]
            bodies += [re.sub(r"(?m)^[0-9][.] ", "* ", b) for b in bodies]
            bodies += [f"All rights reserved.\n\n{b}" for b in bodies]
        bodies += [re.sub(r"([^\n])\n(?!\n)", r"\1 ", b) for b in bodies]  # where a line happens to begin with "copyright"
        out += [(entry["license"], f"{title}\n\n{body}" if title else body) for title, body in product(("", *entry["titles"]), bodies)]
    return list(dict.fromkeys(out))


def _with(value: Column, change: Callable[[Column], Column]) -> Column:
    """``change(value)`` with ``value`` evaluated once, however often the change reads it."""
    return F.get(F.transform(F.array(value), change), F.lit(0))


def _replacement(holds: str | None, pattern: str, wanted: str) -> Callable[[Column], Column]:
    def change(x: Column) -> Column:
        there = x.contains(holds) if holds else x.rlike("[0-9]")
        return F.when(there, F.regexp_replace(x, pattern, wanted)).otherwise(x)

    return change


def evened_lines(text: Column) -> Column:
    """The lines of a text in lower case with equivalent spellings as one, and copyright lines empty."""

    def without_copyright(x: Column) -> Column:
        # A line that opens with a copyright mark goes whole, unless it speaks of a notice.
        line = r"^[^\p{L}\p{N}(©]*(copyright\b|\(c\)|©)(?!.*\bnotice\b).*$"
        marked = x.contains("copyright") | x.contains("(c)") | x.contains("©")
        return F.when(marked, F.regexp_replace(x, line, "")).otherwise(x)

    def even(line: Column) -> Column:
        out = _with(line, without_copyright)
        for holds, pattern, wanted in EQUIVALENT:
            out = _with(out, _replacement(holds, pattern, wanted))
        return out

    return F.transform(F.split(F.lower(text), "\n", -1), even)


def form(evened: Column) -> Column:
    """The canonical form of evened text: words parted by one space."""
    return F.trim(F.regexp_replace(evened, r"[^\p{L}\p{N}]+", " "))


def head(evened: Column) -> Column:
    """The first three letters or digits, as far as the first word has them; equal where forms are equal."""
    return F.regexp_extract(evened, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{1,3})", 1)


def known_licenses(spark: SparkSession, texts: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, head, license)`` of known texts; add a corpus of licences by passing its rows or a union."""
    rows = spark.createDataFrame([(name, text) for name, text in (known_texts() if texts is None else texts)], "license string, body string")
    evened = F.array_join(evened_lines(F.col("body")), " ")
    rows = rows.select(F.sha2(form(evened), 256).alias("digest"), head(evened).alias("head"), "license")
    return rows.groupBy("digest", "head").agg(F.min("license").alias("license"))


def license_matches(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, line, license)`` of all matches: ``line`` is -1 for the whole text, else the number of the line."""
    body = F.col(f"`{text}`").cast("string")
    rows = once(docs.where(body.isNotNull()).select(F.col(f"`{key}`").alias(key), body.alias("_body")), "_lines", evened_lines(F.col("_body")))
    # A form is worked out only where the text begins as some known text does: at most 3 characters each.
    heads = [r["head"] for r in known.select("head").distinct().collect()]

    def digest(evened: Column, begin: Column) -> Column:
        return F.when(begin.isin(heads), F.sha2(form(evened), 256))

    first = F.get(F.filter(F.transform("_lines", head), lambda h: h != ""), F.lit(0))
    whole = F.array(F.struct(F.lit(-1).alias("line"), digest(F.array_join("_lines", " "), first).alias("digest")))
    lines = F.transform("_lines", lambda x, i: F.struct(i.cast("int").alias("line"), digest(x, head(x)).alias("digest")))
    # A text of one line is answered once, as the whole text.
    units = F.when(F.size("_lines") > 1, F.concat(whole, F.filter(lines, lambda u: u["digest"].isNotNull()))).otherwise(whole)
    rows = once(rows, "_units", units).select(key, F.inline("_units")).where("digest IS NOT NULL")
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = known.select("digest", "license")
    return rows.join(F.broadcast(known) if small else known, "digest").select(key, "line", "license")
