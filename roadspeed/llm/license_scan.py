"""License scans: word-bigram Dice of text units against licence templates.

A unit is one line of a document, or the whole document. Words are maximal runs
of letters and digits of the lower-cased unit. With A and T the bags of word
bigrams of unit and template, ``dice = 2 |A n T| / (|A| + |T|)``. As
``|A n T| <= min(|A|, |T|)``, a template can reach ``t`` only if
``t/(2-t) |T| <= |A| <= (2-t)/t |T|``; units outside these bounds of every
template are dropped by their word count, before a bigram is built.

One projection over built-in functions: no Python, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import text_of

#: The usual one-line notices, licence identifier and text.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    """The words of a template: runs of ASCII letters and digits, as templates are ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The smallest and largest bag a unit may have against a template of ``size`` bigrams."""
    slack = 1e-9  # for quotients that are whole numbers but for rounding
    return math.ceil(size * threshold / (2 - threshold) - slack), math.floor(size * (2 - threshold) / threshold + slack)


def _units(text: Column) -> Column:
    """Word arrays: one per line, and one for the whole text if it has several lines."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split(clean, "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.translate(clean, "\n", " "))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(lines, whole), lambda u: F.filter(F.split(u, " "), lambda w: w != ""))


def _score(words: Column, name: str, bigrams: list[str], threshold: float) -> Column:
    """(dice, license) of a unit and one template; null where the size bounds rule it out."""
    size = F.size(words) - 1
    low, high = bounds(len(bigrams), threshold)
    own = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat_ws(" ", words[i - 1], words[i]))
    counts = {b: bigrams.count(b) for b in dict.fromkeys(bigrams)}
    shared = F.aggregate(
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in counts.items()]), F.lit(0),
        lambda acc, t: acc + F.least(t["n"], F.size(F.filter(own, lambda x: x == t["b"]))))
    return F.when((size >= low) & (size <= high), F.struct(
        (F.lit(2.0) * shared / (size + F.lit(len(bigrams)))).alias("dice"), F.lit(name).alias("license")))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_lines, n_units (units with a match), licenses, best_license, best_dice.

    ``licenses`` lists the matched identifiers, sorted and comma-joined ("" if
    none). Of templates with equal Dice the identifier that sorts last is a
    unit's match. Null and empty texts have one line and no match; repeated rows
    are answered each on its own; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0 and at most 1")
    bags = [(name, [f"{a} {b}" for a, b in zip(w, w[1:])]) for name, text in (templates or TEMPLATES)
            for w in [words_of(text)] if len(w) > 1]
    if not bags:
        raise ValueError("a template needs two words")
    low = min(bounds(len(b), threshold)[0] for _, b in bags)
    high = max(bounds(len(b), threshold)[1] for _, b in bags)
    text = text_of(text_col)
    near = F.filter(_units(text), lambda w: (F.size(w) - 1 >= low) & (F.size(w) - 1 <= high))
    best = F.transform(near, lambda w: F.array_max(F.array(*[_score(w, n, b, threshold) for n, b in bags])))
    found = F.filter(best, lambda s: s["dice"] >= threshold)
    # The one-row explode keeps the scan from being repeated in each column below.
    rows = df.select(F.col(id_col).alias("id"), (F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
                     F.explode(F.array(F.struct(found.alias("x")))).alias("f")).select("id", "n_lines", F.col("f.x").alias("x"))
    top = F.array_max("x")
    return rows.select(
        F.col("id").alias(id_col), "n_lines", F.size("x").cast("long").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.col("x.license"))), ",").alias("licenses"),
        top["license"].alias("best_license"), top["dice"].alias("best_dice"))
