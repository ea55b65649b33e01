"""License scans: whole texts, and their lines, against the digests of known licences.

A text is made canonical (case, copyright lines, equivalent spellings, punctuation, spaces) and hashed;
equal digests are equal licences. Whole documents are hash-joined to the known digests. Licence notices
that stand as lines of their own inside a document are looked up line by line in the same digests, inside
the row. All expressions are built in; the known table is as small as the list of licences.

Edge cases: null, empty and punctuation-only texts have the digest of nothing and match no licence; so
does a list entry that is empty. Several names with one digest give the first by name. Repeated rows match
alike. Texts are taken whole, however long. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The wording of well-known licence notices and short licences.
KNOWN = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

#: Spellings taken as equal: each left word is written as the right one. Fixed values.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "organisation": "organization",
    "authorisation": "authorization", "acknowledgement": "acknowledgment", "favour": "favor", "behaviour": "behavior",
    "merchantibility": "merchantability", "noncommercial": "non commercial", "sub license": "sublicense",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders",
}

#: Patterns to replace in lower-cased text, in this order.
STEPS = [
    # A line that states a copyright: an optional comment mark, then the word or sign and a year or sign.
    (r"(?m)^[^a-z0-9©\n]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]|©)[^\n]*$", ""),
    ("https?://", "http://"),
    ("&", " and "),
    (r"[^\p{L}\p{N}]+", " "),
]


def canonical(text: Column) -> Column:
    """The text without what may differ between copies of one licence."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, instead in STEPS:
        out = F.regexp_replace(out, pattern, instead)
    for other, usual in SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b{other}\b", usual)
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left."""
    inner = canonical(text)
    return F.when(inner != "", F.sha2(inner, 256))


def known_digests(spark, known: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, license) of the known texts."""
    rows = [{"name": n, "text": t} for n, t in sorted(known.items())]
    table = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps(rows)), "array<struct<name: string, text: string>>")).alias("k")).select("k.*")
    return table.select(digest(F.col("text")).alias("digest"), "name").filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("name").alias("license"))


def _hint(known: dict[str, str]) -> str:
    """A pattern that every line equal to a known text matches: the longest word of each that no step changes.

    Lines without any of these words cannot match and are not made canonical, which costs many passes. A known text that
    has no such word can be any line, so that then all are made canonical.
    """
    changed = {w for pair in SPELLINGS.items() for side in pair for w in side.split()} | {"http", "https", "and"}
    found = []
    for text in known.values():
        kept = re.sub(STEPS[0][0], "", text.lower())  # a copy may do without the copyright lines
        if not re.search(r"[^\W_]", kept):
            continue  # nothing is left of it, so no line equals it
        words = sorted(set(re.findall(r"[a-z0-9]+", kept)) - changed, key=lambda w: (-len(w), w))
        if not words:
            return ""
        found.append(words[0])
    return "|".join(sorted(set(found))) or "(?!)"


def scan(docs: DataFrame, known: dict[str, str] = KNOWN) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null) and notices (names found on lines, sorted)."""
    table = known_digests(docs.sparkSession, known)
    names = table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("m")).first()["m"] or {}
    by_digest = F.from_json(F.lit(json.dumps(names)), "map<string, string>")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.lower(line).rlike(_hint(known)))
    notices = F.array_sort(F.array_distinct(F.filter(
        F.transform(lines, lambda line: F.element_at(by_digest, digest(line))), lambda n: n.isNotNull())))
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"), notices.alias("notices"))
    return found.join(table, "digest", "left").select("doc_id", "digest", "license", "notices")
