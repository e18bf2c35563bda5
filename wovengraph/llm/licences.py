"""Licence scans: TF-IDF cosine to templates, and inheritance by directories. DataFrame functions only.

A file's units are its headers: every run of one to three lines, and every
paragraph (lines between blank ones). A file named LICENSE, LICENCE or COPYING
has its whole text as a unit too. Units and templates are sparse vectors of
term counts times inverse document frequency, which is counted over all files;
a term of no template weighs as one that no file holds. A unit whose best
cosine reaches ``LEAST`` declares that licence; a file's licence is its best
unit's. A licence file declares it for its directory, and a file without a
licence of its own takes the one of the nearest directory above it.

A unit is passed over only where it cannot reach ``LEAST``: if it holds none of
the rarest terms of a template, its cosine to that one is at most the length of
the template's other terms over that of all (Cauchy-Schwarz), and as many
frequent terms are left out as keep this bound below ``LEAST``. That holds
however many files carry a term.

Templates are a table of fixed size given by the caller, so what is gathered
from them is bounded by their words. Ancestors are joined once for each
directory, not for each file.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import fold, settle

LEAST = 0.6
RESULT = ("own", "score", "licence", "inherited_from")
NAMED = r"^(?i:licen[cs]e|copying)"

# Fixed texts of the licences that are looked for: their one-line notices, and the wordings their publishers give.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def _cosines(given: list[tuple[str, Counter]], inverse: dict[str, float], unheld: float) -> Column:
    """An array of (score, licence), one for each template, for the column ``terms``: one pass over its sorted terms."""
    weights = {t: [n * inverse[t] ** 2 for n in (counts[t] for _, counts in given)] for t in inverse}
    known = F.create_map(*(x for t, w in weights.items() for x in (F.lit(t), F.array(*map(F.lit, (inverse[t], *w))))))
    other = F.array(F.lit(unheld), *(F.lit(0.0) for _ in given))

    def ended(run: Column) -> Column:
        """The sums with the last term's: the square of the unit's length, then its product with each template."""
        own = F.coalesce(F.try_element_at(known, run["term"]), other)
        n = run["n"]
        # The first weight counts squared, for the unit's length; the others once.
        return F.zip_with(run["sums"], F.transform(own, lambda w, k: F.when(k == 0, n * w * n * w).otherwise(n * w)), lambda x, y: x + y)

    def add(run: Column, term: Column) -> Column:
        same = run["term"] == term
        return F.struct(
            term.alias("term"),
            F.when(same, run["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(same, run["sums"]).otherwise(ended(run)).alias("sums"),
        )

    none = F.array(*(F.lit(0.0) for _ in range(len(given) + 1)))
    begin = F.struct(F.lit("").alias("term"), F.lit(0).alias("n"), none.alias("sums"))
    named = [(licence, math.sqrt(sum((n * inverse[t]) ** 2 for t, n in counts.items()))) for licence, counts in given]

    def scores(run: Column) -> Column:
        bare = F.struct(ended(run).alias("sums"))
        score = lambda s, k, size: F.round(s["sums"][k] / (F.sqrt(s["sums"][0]) * F.lit(size)), 6)
        each = lambda s: F.array(*(F.struct(score(s, k + 1, size).alias("score"), F.lit(licence).alias("licence")) for k, (licence, size) in enumerate(named)))
        return F.flatten(F.transform(F.array(bare), each))

    return F.aggregate(F.sort_array("terms"), begin, add, scores)


def telling(given: list[tuple[str, Counter]], inverse: dict[str, float]) -> list[str]:
    """Terms of which a unit holds at least one if any of its cosines reaches ``LEAST``, the rarest that will do."""
    out = set()
    for _, counts in given:
        squares = {t: (n * inverse[t]) ** 2 for t, n in counts.items()}
        spare = (LEAST - 1e-6) ** 2 * sum(squares.values())
        for t in sorted(squares, key=lambda t: (inverse[t], t)):
            spare -= squares[t]
            if spare <= 0:
                out.add(t)
    return sorted(out)


def units(text: Column, whole: Column, found: str) -> Column:
    """The units of a text with a term that ``found`` matches; no term reaches beyond a line."""
    runs = [(back, size) for size in (1, 2, 3) for back in range(size)]

    def own(t: Column) -> Column:
        lines = t["lines"]
        hits = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(found), i + 1)), lambda i: i.isNotNull())
        around = lambda i: F.array(*(F.array_join(F.slice(lines, F.greatest(i - back, F.lit(1)), F.lit(size)), "\n") for back, size in runs))
        paragraphs = F.filter(F.split(t["text"], r"\n[ \t\r]*\n"), lambda p: p.rlike(found))
        itself = F.when(whole, F.array(t["text"])).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.flatten(F.transform(hits, around)), paragraphs, itself))

    # The text and its lines are bound once; an expression within a lambda would split them again for every line.
    bound = F.array(F.struct(text.alias("text"), F.split(text, "\n").alias("lines")))
    return F.flatten(F.transform(bound, own))


def own_licences(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """path, mark (hash of the text), own, score of each file with a licence; files: path, text."""
    spark = files.sparkSession
    given = spark.createDataFrame(list(templates), "licence string, notice string")
    given = [(r["licence"], Counter(r["terms"])) for r in given.select("licence", terms(F.col("notice")).alias("terms")).collect()]
    given = [(licence, counts) for licence, counts in given if counts]
    if not given:
        return spark.createDataFrame([], "path string, mark long, own string, score double")
    words = sorted({t for _, counts in given for t in counts})
    listed = F.array(*map(F.lit, words))
    held = files.select(F.explode(F.array_intersect(terms(F.col("text")), listed)).alias("term"))
    held = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = files.count()
    inverse = {w: math.log((total + 1) / (held.get(w, 0) + 1)) + 1 for w in words}
    found = rf"(?<![a-z0-9])(?:{'|'.join(telling(given, inverse))})(?![a-z0-9])"
    texts = files.select("path", F.xxhash64("text").alias("mark"), fold(F.col("text")).alias("text")).where(F.col("text").rlike(found))
    own = units(F.col("text"), _name(F.col("path")).rlike(NAMED), found)
    parts = texts.select("path", "mark", F.explode(own).alias("unit")).select("path", "mark", terms(F.col("unit")).alias("terms"))
    scores = parts.select("path", "mark", F.explode(_cosines(given, inverse, math.log(total + 1) + 1)).alias("best"))
    scores = scores.where(F.col("best.score") >= LEAST)
    best = scores.groupBy("path", "mark").agg(F.max("best").alias("best"))
    return best.select("path", "mark", F.col("best.licence").alias("own"), F.col("best.score").alias("score"))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _ancestors(folder: Column) -> Column:
    """The folder itself and all above it, up to the empty one."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """The rows of ``files`` (each column but the text) with own, score, licence, inherited_from.

    ``own``: the licence that the file declares; ``licence``: that, or else the
    nearest directory's; ``inherited_from``: that directory ('' is the root), null
    if nothing is inherited. Equal cosines: the licence later in the alphabet.
    A null path is the empty path, a null text has no licence of its own. Rows
    with equal paths are judged by their own texts. A column named like one of
    the result comes back as ``given_`` and its name.
    """
    others = [c for c in files.columns if c not in (path_col, text_col)]
    rows = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("row"))
    own = settle(own_licences(rows.where("text IS NOT NULL").select("path", "text"), templates))
    folder = directory(F.col("path"))
    named = own.where(_name(F.col("path")).rlike(NAMED))
    declared = named.select(folder.alias("above"), F.struct("score", "own").alias("best")).groupBy("above").agg(F.max("best")["own"].alias("given"))
    folders = rows.select(folder.alias("folder")).distinct().withColumn("above", F.explode(_ancestors(F.col("folder"))))
    nearest = folders.join(declared, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("near"))
    nearest = settle(nearest.select("folder", "near.above", "near.given"))
    rows = rows.select("path", F.xxhash64("text").alias("mark"), "row", folder.alias("folder"))
    joined = rows.join(own, ["path", "mark"], "left").join(nearest, "folder", "left")
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    return joined.select(
        F.col("path").alias(path_col),
        *(F.col(f"row.`{c}`").alias(f"given_{c}" if c in RESULT else c) for c in others),
        "own",
        "score",
        F.coalesce("own", "given").alias("licence"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )
