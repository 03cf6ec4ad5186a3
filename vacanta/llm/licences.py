"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A statement is a line with a marker word, or a group of the lines around one; a file whose name is that of a licence file
is one statement more as a whole. A licence has several templates: usual lines, header blocks, file texts and
SPDX lines. Statements become arrays of (word, count), weighted with the inverse document frequency over all
files, and meet the words of the templates inside their row; the best template of a file whose cosine reaches the least of its kind
(``LEAST``) names its own licence. A file without one takes that of the licence file in the nearest directory
above it: the distinct directories are spread into their ancestors and joined by path.

DataFrame functions only; neither texts nor their words are shuffled. The words of the templates with their
weights are a constant of fixed size in the plan. A word outside the templates weighs as one that no file holds.

Defined cases: a null or empty text states nothing; a null path inherits nothing; a file without a directory lies in
the root, named by the empty string; of several licence files in a directory the closest match
wins, then the licence that sorts first; rows that repeat path and text are one file. Columns named in
``keep`` are kept; others do not take part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import counted
from ..functions.text import let
from ..session import cut

#: Least cosine by kind of template: a name among few words has to be met almost word for word.
LEAST = {"line": 0.6, "header": 0.7, "file": 0.7, "spdx": 0.9}
#: Lines before and after a line with a marker that are compared together with it.
GROUPS = ((0, 1), (2, 3), (4, 12))
# fixed values: usual statements, by SPDX identifier
LINES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
HEADERS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("GPL-2.0", _GNU.format(kind="", version=2)),
    ("GPL-3.0", _GNU.format(kind="", version=3)),
    ("LGPL-3.0", _GNU.format(kind="Lesser ", version=3)),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
FILES = (
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """ + _AS_IS),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)


def _templates() -> tuple[tuple[int, str, float, str], ...]:
    """``(number, licence, least cosine, statement)`` of all templates; SPDX lines follow from the identifiers."""
    known = sorted({licence for licence, _ in (*LINES, *HEADERS, *FILES)})
    named = [(k, f"SPDX-License-Identifier: {k}{end}") for k in known for end in ("", "-only", "-or-later") if not end or "GPL" in k]
    kinds = (("line", LINES), ("header", HEADERS), ("file", FILES), ("spdx", named))
    rows = [(licence, LEAST[kind], " ".join(text.split())) for kind, texts in kinds for licence, text in texts]
    return tuple((k, *row) for k, row in enumerate(rows))


TEMPLATES = _templates()
MARKERS = ("copyleft", "copyright", "licence", "licenced", "license", "licensed", "licensing", "spdx")
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying)([-_.].*)?$"
_BREAK = "[^a-z0-9]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def _template_rows(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame(
        list(TEMPLATES), "template int, licence string, least double, statement string"
    )


def _template_words(files: DataFrame) -> DataFrame:
    return (
        _template_rows(files).select("template", F.explode(words(F.col("statement"))).alias("word"))
        .groupBy("template", "word").agg(F.count("*").alias("tf"))
    )


def _weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """Weight of every template word, and that of all others."""
    vocabulary = sorted({w[0] for w in _template_words(files).select("word").distinct().collect()})
    held = F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    counts = {r["word"]: r["n"] for r in (
        files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    )}  # one row per template word
    total = files.count()
    weights = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
    return weights, math.log(total + 1) + 1


def _shares(files: DataFrame, weights: dict[str, float]) -> Column:
    """Every template word with its weight and its share in each template, as one constant map."""
    values: dict[str, list[float]] = {w: [0.0] * len(TEMPLATES) for w in weights}
    for r in _template_words(files).collect():
        values[r["word"]][r["template"]] = r["tf"] * weights[r["word"]]
    norms = [math.sqrt(sum(own[k] ** 2 for own in values.values())) for k in range(len(TEMPLATES))]
    known = {w: {"weight": weights[w], "shares": [v / n for v, n in zip(own, norms)]} for w, own in values.items()}
    return F.from_json(F.lit(json.dumps(known)), "map<string, struct<weight: double, shares: array<double>>>")


def _units(files: DataFrame) -> DataFrame:
    """``(_row, unit_no, unit)``: lines with a marker, the groups of lines around them, and whole licence files."""
    markers = F.array(*[F.lit(m) for m in MARKERS])
    lines = files.where(F.lower("text").rlike("|".join(MARKERS))).select(
        "_row", F.inline(F.array(F.struct(F.split("text", "\n", -1).alias("lines"))))
    )
    marked = lines.select(
        "_row", "lines",
        F.explode(
            F.filter(
                F.transform("lines", lambda x, i: F.when(F.arrays_overlap(words(x), markers), i)),
                lambda i: i.isNotNull(),
            )
        ).alias("at"),
    )
    size = len(GROUPS) + 1
    around = [(0, 0), *GROUPS]
    units = F.array(
        *[
            F.struct(
                (F.col("at") * size + k).cast("bigint").alias("unit_no"),
                F.array_join(
                    F.slice("lines", F.greatest(F.col("at") - before, F.lit(0)) + 1,
                            F.col("at") + after - F.greatest(F.col("at") - before, F.lit(0)) + 1),
                    "\n",
                ).alias("unit"),
            )
            for k, (before, after) in enumerate(around)
        ]
    )
    whole = files.where(F.col("is_licence_file") & (F.length("text") > 0)).select(
        "_row", F.lit(-1).cast("bigint").alias("unit_no"), F.col("text").alias("unit")
    )
    return marked.select("_row", F.inline(units)).unionByName(whole)


def own_licences(files: DataFrame) -> DataFrame:
    """``(_row, licence, score)`` of the files that state one.

    A statement is compared inside its row, so only licences that were found are shuffled.
    """
    weights, other = _weights(files)
    known = _shares(files, weights)
    kinds = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(least).alias("least")) for _, name, least, _ in TEMPLATES])

    def valued(terms: Column) -> Column:
        """Weighted counts, and the shares of words that templates hold."""
        return F.transform(terms, lambda t: let(F.try_element_at(known, t["term"]), lambda k: F.struct(
            (t["tf"] * F.coalesce(k["weight"], F.lit(other))).alias("value"), k["shares"].alias("shares"),
        )))

    def hits(values: Column) -> Column:
        square = F.aggregate(values, F.lit(0.0), lambda total, v: total + v["value"] * v["value"])
        products = F.aggregate(
            F.filter(values, lambda v: v["shares"].isNotNull()),
            F.array_repeat(F.lit(0.0), len(TEMPLATES)),
            lambda sums, v: F.zip_with(sums, v["shares"], lambda total, share: total + v["value"] * share),
        )
        scores = let(F.sqrt(square), lambda norm: F.transform(products, lambda p: F.round(p / norm, 6)))
        named = F.zip_with(scores, kinds, lambda score, k: F.struct(
            (-score).alias("minus"), k["licence"].alias("licence"), (score >= k["least"]).alias("reached"),
        ))
        return F.filter(named, lambda n: n["reached"])

    terms = counted(F.sort_array(words(F.col("unit"))))
    none = F.array().cast("array<struct<minus: double, licence: string, reached: boolean>>")
    found = let(let(terms, valued), lambda values: F.when(F.size(values) > 0, hits(values)).otherwise(none))
    return (
        _units(files).select("_row", F.inline(found))
        .groupBy("_row").agg(F.min(F.struct("minus", "licence")).alias("best"))
        .select("_row", "best.licence", (-F.col("best.minus")).alias("score"))
    )


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., path, licence, origin, score, licence_dir`` of every row.

    ``origin`` is ``file`` for a licence file, ``header`` for another file with a statement of
    its own, ``inherited``, or null; ``score`` is the cosine behind the licence.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select(*keep, F.col(path).alias("path"), F.col(text).alias("text")).select(
        *keep, "path", "text",
        F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        .when(F.col("path").isNotNull(), "").alias("dir"),
        F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)).alias("is_licence_file"),
        F.unhex(F.md5(F.concat_ws(":", F.coalesce("path", F.lit("~")), "text"))).alias("_row"),
    )
    own = cut(own_licences(files))
    narrow = files.drop("text").join(own, "_row", "left")
    by_dir = (
        narrow.where("is_licence_file AND licence IS NOT NULL AND dir IS NOT NULL")
        .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
        .select(F.col("dir").alias("licence_dir"), F.col("best.licence").alias("dir_licence"),
                (-F.col("best.minus")).alias("dir_score"))
    )
    parts = F.split("dir", "/", -1)
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    ancestors = narrow.where("dir IS NOT NULL").select("dir").distinct().select(
        "dir", F.explode(depths).alias("depth")
    ).withColumn("licence_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = cut(
        ancestors.join(by_dir, "licence_dir")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "licence_dir", "dir_licence", "dir_score")).alias("up"))
        .select("dir", "up.licence_dir", "up.dir_licence", "up.dir_score")
    )
    has_own = F.col("licence").isNotNull()
    return narrow.join(nearest, "dir", "left").select(
        *keep, "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(has_own & F.col("is_licence_file"), "file").when(has_own, "header")
        .when(F.col("dir_licence").isNotNull(), "inherited").alias("origin"),
        F.when(has_own, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(has_own & F.col("is_licence_file"), F.col("dir"))
        .when(~has_own, F.col("licence_dir")).alias("licence_dir"),
    )


def oracle(files_sql: str, id_column: str) -> str:
    """The scan in SQL over a query with ``id_column``, ``path`` and ``text``, paths unique."""
    quoted = [(k, name, least, text.replace("'", "''")) for k, name, least, text in TEMPLATES]
    templates = ", ".join(f"({k}, '{name}', {least}, '{text}')" for k, name, least, text in quoted)
    around = [(0, 0), *GROUPS]
    groups = " UNION ALL ".join(
        f"SELECT path, (i - 1) * {len(around)} + {k} AS unit_no, "
        f"array_to_string(ls[greatest(i - {before}, 1):i + {after}], chr(10)) AS unit FROM marked"
        for k, (before, after) in enumerate(around)
    )
    markers = ", ".join(f"'{m}'" for m in MARKERS)
    return f"""
WITH files AS ({files_sql}), templates(template, licence, least, statement) AS (VALUES {templates}),
placed AS (
  SELECT *, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir,
         regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}') AS is_licence_file FROM files
), template_words AS (
  SELECT template, word, count(*) AS tf FROM (
    SELECT template, unnest(string_split_regex(lower(statement), '{_BREAK}')) AS word FROM templates
  ) WHERE word <> '' GROUP BY ALL
), counts AS (
  SELECT word, count(DISTINCT path) AS n FROM (
    SELECT path, unnest(string_split_regex(lower(text), '{_BREAK}')) AS word FROM files
  ) WHERE word IN (SELECT word FROM template_words) GROUP BY word
), total AS (SELECT count(*) AS n FROM files), weights AS (
  SELECT DISTINCT t.word, ln((total.n + 1.0) / (coalesce(c.n, 0) + 1)) + 1 AS weight
  FROM template_words t LEFT JOIN counts c USING (word), total
), template_values AS (
  SELECT template, word, tf * weight / sqrt(sum((tf * weight) ** 2) OVER (PARTITION BY template)) AS share
  FROM template_words JOIN weights USING (word)
), marked AS (
  SELECT path, ls, i FROM (
    SELECT path, string_split(text, chr(10)) AS ls, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files
  ) WHERE list_has_any(string_split_regex(lower(ls[i]), '{_BREAK}'), [{markers}])
), units AS (
  {groups}
  UNION ALL SELECT path, -1, text FROM placed WHERE is_licence_file AND length(text) > 0
), terms AS (
  SELECT path, unit_no, word, count(*) AS tf FROM (
    SELECT path, unit_no, unnest(string_split_regex(lower(unit), '{_BREAK}')) AS word FROM units
  ) WHERE word <> '' GROUP BY ALL
), valued AS (
  SELECT path, unit_no, word, tf * coalesce(weight, ln(total.n + 1.0) + 1) AS value
  FROM terms LEFT JOIN weights USING (word), total
), norms AS (SELECT path, unit_no, sqrt(sum(value ** 2)) AS norm FROM valued GROUP BY ALL
), scored AS (
  SELECT path, template, round(sum(value * share) / any_value(norm), 6) AS score
  FROM valued JOIN template_values USING (word) JOIN norms USING (path, unit_no) GROUP BY path, unit_no, template
), own AS (
  SELECT path, licence, score FROM scored JOIN templates USING (template) WHERE score >= least
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1
), by_dir AS (
  SELECT dir AS licence_dir, licence AS dir_licence, score AS dir_score
  FROM placed JOIN own USING (path) WHERE is_licence_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1
), nearest AS (
  SELECT d.dir, b.* FROM (SELECT DISTINCT dir FROM placed) d
  JOIN by_dir b ON b.licence_dir = '' OR d.dir = b.licence_dir OR starts_with(d.dir, b.licence_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(b.licence_dir) DESC) = 1
)
SELECT p.{id_column}, p.path, coalesce(o.licence, n.dir_licence) AS licence,
       CASE WHEN o.licence IS NOT NULL AND p.is_licence_file THEN 'file' WHEN o.licence IS NOT NULL THEN 'header'
            WHEN n.dir_licence IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.licence IS NOT NULL THEN o.score ELSE n.dir_score END AS score,
       CASE WHEN o.licence IS NULL THEN n.licence_dir WHEN p.is_licence_file THEN p.dir END AS licence_dir
FROM placed p LEFT JOIN own o USING (path) LEFT JOIN nearest n USING (dir)
"""
