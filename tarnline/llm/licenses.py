"""License scans with DataFrame functions alone: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits, in lower case; shingles are 5 words. A window is LONG neighbouring shingles, one beginning at each
shingle, of templates that have so many, and SHORT of others; a template of fewer than SHORT is a window of its own. Each of BANDS bands is the least of a
window's shingles under its own hash. A document is held against a template if a window of each agree in a band.

What the bands guarantee for a template of which CONTAINMENT or more of the shingles are in a document, wherever they stand there. A band meets the
template by a shingle that is the least of some window around it on both sides. For SHORT = 2 that has a probability of at least 5/12 for a
shingle found, and 2/3 for the only one of a template; for LONG = 8 at least 0.09 (0.15 but for a template's ends). With 16 bands a template of one shingle is
missed with probability 3**-16 = 2e-8, one of two to seven, of which at least two are found, (7/12)**32 = 3e-8, and a
longer one, of which at least seven are found, 0.91**(16 * 7) = 3e-5 if all are scattered, each alone. Where they stand in a row, as in a notice, whole windows agree: two
of 8 shingles with one word changed agree in a band with probability 3/13 at least, and unchanged ones always.

Then the share of a template's shingles, as texts, that the document contains decides: CONTAINMENT or more.

Before that, a filter passes documents that contain one of a few words of the templates, chosen so that more than 1 - CONTAINMENT of each template's shingles
have one: documents without any contain too little of every template, so none is lost. It looks for them as parts of the text first,
inside the scan's code generation, and then as words.

Templates are rows (license, text), from a table or TEMPLATES. They are the side that is broadcast: their size is checked, and above MOST_BYTES the scan
fails. Their bands are compared as one array that a subquery makes, not as literals of the plan.

A null or short text has no licenses and no rows, nor have empty tables; texts of any length are scanned whole. A null doc_id is kept. Repeated rows give
repeated rows. Templates without a shingle or a name fail; of templates with the same name each is scanned for. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.llm.common import written

SHINGLE = 5
SHORT = 2
LONG = 8
BANDS = 16
CONTAINMENT = 0.8
MOST_BYTES = 4 << 20
#: License names and their notices or, where they are short, whole texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MIT-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution."""),
    ("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission."""),
    ("BSD-disclaimer", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
        SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
        or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so"""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details."""),
    ("LGPL-notice", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation"""),
    ("AGPL-3.0-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
)


#: Words too common to tell a notice by.
COMMON = frozenset("a an and any are as at be but by can for from if in is it of on or that the this to under use with without you".split())


def shingles_of(text: str, k: int = SHINGLE) -> list[str]:
    """Distinct shingles of a template, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


def pivots(shingles: list[list[str]], containment: float = CONTAINMENT) -> list[str]:
    """Words such that, of each template, more than 1 - containment of its shingles have one: no document can contain enough of it without one.

    Long words first, those in many shingles and templates, until each template has enough.
    """
    need = [len(s) - math.ceil(containment * len(s)) + 1 for s in shingles]
    left = [[set(x.split()) for x in s] for s in shingles]
    chosen: list[str] = []
    while any(n > 0 for n in need):
        worth: dict[str, int] = {}
        for n, s in zip(need, left, strict=True):
            if n > 0:
                for words in s:
                    for w in words - COMMON or words:
                        worth[w] = worth.get(w, 0) + len(w) ** 3
        best = min(worth, key=lambda w: (-worth[w], w))
        chosen.append(best)
        for k, s in enumerate(left):
            rest = [words for words in s if best not in words]
            need[k] -= len(s) - len(rest)
            left[k] = rest
    return chosen


def _hashed(hashes: Column, bands: int) -> Column:
    """Of each band the hashes of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda band: F.transform(hashes, lambda x: F.xxhash64(x, band)))


def _paired(rows: Column, step: int) -> Column:
    """Of each band's hashes the less of each and the one `step` after it."""
    rest = lambda x: F.greatest(F.size(x) - step, F.lit(0))
    return F.transform(rows, lambda x: F.zip_with(F.slice(x, F.lit(1), rest(x)), F.slice(x, F.lit(1 + step), rest(x)), lambda a, b: F.least(a, b)))


def _let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x evaluated once however often it stands there."""
    return F.element_at(F.transform(F.array(x), of), 1)


def _windows(h: Column, bands: int) -> Column:
    """short and long for an array of shingle hashes: all bands of its windows of SHORT and LONG, or of all together where there are fewer."""

    def of(one: Column, two: Column) -> Column:
        least = F.transform(one, lambda x: F.array_min(x))
        many = lambda rows: F.exists(rows, lambda x: F.size(x) > 0)
        pick = lambda rows: F.array_distinct(F.when(many(rows), F.flatten(rows)).otherwise(least))
        return F.struct(pick(two).alias("short"), _let(_paired(_paired(two, 2), 4), pick).alias("long"))

    return _let(_hashed(h, bands), lambda one: _let(_paired(one, 1), lambda two: of(one, two)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))


def _known(spark: SparkSession, templates: DataFrame | None, k: int) -> tuple[DataFrame, list[list[str]]]:
    """no, license, shingles of the templates, and the shingles in Python; their size is checked first."""
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, text string")
    templates = templates.select(F.col("license").cast("string"), F.col("text").cast("string"))
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"templates of {size} bytes are too many to broadcast; {MOST_BYTES} are allowed")
    rows = [(no, r.license, shingles_of(r.text or "", k)) for no, r in enumerate(templates.collect())]
    if not all(name and held for _, name, held in rows):
        raise ValueError("a template has no name or no shingle")
    return spark.createDataFrame(rows, "no int, license string, shingles array<string>"), [held for _, _, held in rows]


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """doc_id, license, n_shingles, n_found, containment: a row for each template(license, text) that a row of docs(doc_id, text) contains."""
    known, shingles = _known(docs.sparkSession, templates, k)
    if not shingles:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, n_shingles long, n_found long, containment double")
    windows = _windows(F.transform("shingles", lambda s: F.xxhash64(s)), bands)
    keyed = known.select("no", F.size("shingles").alias("n"), windows.alias("w")).select("no", F.explode(F.when(F.col("n") >= LONG, F.col("w.long")).otherwise(F.col("w.short"))).alias("key"))
    keyed = written(keyed.groupBy("key").agg(F.collect_set("no").alias("no")))
    wanted = keyed.agg(F.sort_array(F.collect_list("key"))).scalar()  # bands times the templates' windows, whose size was checked
    holders = keyed.agg(F.map_from_entries(F.collect_list(F.struct("key", "no")))).scalar()

    pivot = pivots(shingles, containment)
    lower = F.lower(F.col("text"))
    some = F.lit(False)
    for w in pivot:
        some = some | F.contains(lower, F.lit(w))
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(some)
    split = read.select("doc_id", _words(F.col("text")).alias("words")).where((F.size("words") >= k) & F.arrays_overlap("words", F.array(*map(F.lit, pivot))))
    held = split.select("doc_id", _shingles(F.col("words"), k).alias("held"))
    own = _let(_windows(F.transform("held", lambda s: F.xxhash64(s)), bands), lambda w: F.concat(w["short"], w["long"]))
    met = held.select("doc_id", "held", F.array_intersect(own, wanted).alias("met"), holders.alias("holders"))
    # Each key met has the templates that hold it, in a map of the templates' keys.
    numbers = F.array_distinct(F.flatten(F.transform("met", lambda x: F.element_at("holders", x))))
    once = met.select("doc_id", "held", F.explode_outer(numbers).alias("no"))
    checked = once.join(F.broadcast(known.select("no", "license", "shingles")), "no").select(
        "doc_id", "license", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", "held")).alias("n_found")
    )
    share = F.col("n_found") / F.col("n_shingles")
    return checked.where(share >= containment).select("doc_id", "license", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"), share.alias("containment"))


def containment_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the rows of scan(): every template's shingles looked for among those of every text."""
    rows = ", ".join(f"('{name}', '{s}')" for name, t in templates for s in shingles_of(t))
    return rf"""WITH t(license, shingle) AS (VALUES {rows}),
      n AS (SELECT license, count(*) AS n_shingles FROM t GROUP BY 1),
      d AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
      s AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS shingle FROM d),
      f AS (SELECT r, doc_id, license, count(*) AS n_found FROM s JOIN t USING (shingle) GROUP BY 1, 2, 3)
      SELECT doc_id, license, n_shingles, n_found, n_found / n_shingles AS containment
      FROM f JOIN n USING (license) WHERE n_found >= {containment} * n_shingles"""
