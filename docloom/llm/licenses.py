"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units compared are each whole text and each of its lines. Sizes are numbers of bigrams, repeats counted, so that a
word count bounds the coefficient before any bigram is made: 2 * min(sizes) / (sum of sizes) must reach the
threshold, which prunes most templates for most units and all templates for long texts. Bigrams of the units
that remain meet the template bigrams in one equi-join; a small table made from LICENSES below is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of

PERCENT = 80

#: Licence notices and short licences as they stand in public use.
LICENSES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT/line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-3.0/line": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSL-1.0/notice": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_bigrams(licenses: dict[str, str] | None = None) -> list[tuple[str, int, str, int]]:
    """(licence, its number of bigrams, bigram, how often) for each template."""
    out = []
    for name, text in (licenses or LICENSES).items():
        words = _words(text)
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        out += [(name, len(words) - 1, p, n) for p, n in sorted(pairs.items())]
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, licenses: dict[str, str] | None = None) -> DataFrame:
    """The units that reach the threshold: id_col, text_hash, line (null: the whole text), license, dice, best (highest dice of the unit, first name on ties).

    A unit is a whole text or one of its lines where there are several. Normalised means lower-cased in A-Z, with anything but a-z and 0-9 between words. Texts
    that are null, empty or of one word have no bigrams and match nothing. Rows that repeat id and text give one set of units. Other columns are ignored; an empty table gives no rows."""
    templates = template_bigrams(licenses)
    sizes = sorted({n for _, n, _, _ in templates})
    low, high = min(sizes) * percent / (200 - percent), max(sizes) * (200 - percent) / percent
    known = F.broadcast(docs.sparkSession.createDataFrame(templates, "_license string, _tsize int, _tpair string, _tn int"))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    lines = F.split("_text", "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.col("_text").alias("unit"))),
                                               F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("unit"))))
                   ).otherwise(F.array(F.struct(F.lit(-1).alias("line"), F.col("_text").alias("unit"))))
    units = texts.select("_id", "_hash", F.explode(units).alias("u")).select("_id", "_hash", "u.line", "u.unit")
    units = units.withColumn("_size", F.regexp_count("unit", F.lit("[A-Za-z0-9]+")) - 1).where(F.col("_size").between(low, high))
    # past the bounds a unit is all ASCII words or loses what isn't, so lower() is safe
    words = F.filter(F.split(F.lower(F.regexp_replace("unit", "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    pairs = units.select("_id", "_hash", "line", "_size", words.alias("_w")).select("_id", "_hash", "line", "_size", F.posexplode(
        F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("_at", "_pair"))
    fits = 200 * F.least("_size", "_tsize") >= percent * (F.col("_size") + F.col("_tsize"))
    met = pairs.join(known, (F.col("_pair") == F.col("_tpair")) & fits)
    common = met.groupBy("_id", "_hash", "line", "_size", "_license", "_tsize", "_pair", "_tn").agg(F.countDistinct("_at").alias("_n"))
    scored = common.groupBy("_id", "_hash", "line", "_size", "_license", "_tsize").agg(F.sum(F.least("_n", "_tn")).alias("_common"))
    scored = scored.where(200 * F.col("_common") >= percent * (F.col("_size") + F.col("_tsize"))).withColumn("dice", 2.0 * F.col("_common") / (F.col("_size") + F.col("_tsize")))
    best = scored.groupBy("_id", "_hash", "line").agg(F.min(F.struct((-F.col("dice")).alias("d"), F.col("_license").alias("l"))).alias("_best"), F.collect_list(F.struct("_license", "dice")).alias("_all"))
    return best.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.when(F.col("line") >= 0, F.col("line")).alias("line"), F.explode("_all").alias("a"), "_best").select(
        id_col, "text_hash", "line", F.col("a._license").alias("license"), F.col("a.dice").alias("dice"), (F.col("a._license") == F.col("_best.l")).alias("best"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its units that match, the licence that the whole text is, and the licences found in it."""
    docs = table(spark, sf_dir, "documents")
    found = license_scan(docs).where("best")
    by = stage(found.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(
        F.count(F.lit(1)).alias("n_units"), F.max("dice").alias("max_dice"), F.max(F.when(F.col("line").isNull(), F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses")), "license-hits")
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("_hash"))
    return rows.join(by, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").select(
        "doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "max_dice", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",".join(f"({quote(a)},{n},{quote(p)},{c})" for a, n, p, c in template_bigrams())
    return rf"""
WITH t(license, tsize, pair, tn) AS (VALUES {rows}),
u AS (
  SELECT doc_id, -1 AS line, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS unit
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE len(l) > 1),
w AS (SELECT doc_id, line, regexp_extract_all(lower(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM u),
p AS (SELECT doc_id, line, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w WHERE len(w) BETWEEN 2 AND 1000),
c AS (
  SELECT doc_id, line, size, license, tsize, pair, least(count(*), any_value(tn)) AS n FROM p JOIN t USING (pair)
  WHERE 200 * least(size, tsize) >= {PERCENT} * (size + tsize) GROUP BY ALL),
s AS (SELECT doc_id, line, license, 2.0 * sum(n) / (size + tsize) AS dice FROM c GROUP BY doc_id, line, license, size, tsize HAVING 200 * sum(n) >= {PERCENT} * (size + tsize)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS rk FROM s),
g AS (
  SELECT doc_id, count(*) AS n_units, max(dice) AS max_dice, max(CASE WHEN line < 0 THEN license END) AS whole_license,
         array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM b WHERE rk = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, CAST(max_dice AS DOUBLE) AS max_dice, whole_license, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _oracle()}
