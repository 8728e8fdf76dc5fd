"""Licences of files: TF-IDF cosine of their passages to templates, then the nearest directory's, in DataFrame operations alone."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

THRESHOLD = 0.75
#: Lines of a passage; each begins at a line with one of LICENCE_WORDS.
WINDOWS = (1, 2, 4, 8, 16, 32)
# Words of which a line with a licence, or the start of one, holds one.
LICENCE_WORDS = r"licen[cs]|copyright|copyleft|permission|permitted|redistribut|merchantab|warrant|liabilit|public domain|creative commons|cc[ -]?by|cc0"
# Short notices, by SPDX identifier.
NOTICES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Titles that licence files begin with.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "Unlicense": "The Unlicense",
}
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as
published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""
# The texts of short licences, and the headers that longer ones ask for.
TEXTS = {
    "AGPL-3.0": GNU.format(kind="Affero General Public License", n=3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{CONDITIONS} {DISCLAIMER}",
    "BSD-3-Clause": f"{CONDITIONS} {NO_ENDORSEMENT} {DISCLAIMER}",
    "GPL-2.0": GNU.format(kind="General Public License", n=2).replace("software:", "software;"),
    "GPL-3.0": GNU.format(kind="General Public License", n=3),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-3.0": GNU.format(kind="Lesser General Public License", n=3),
    "MIT": GRANT + """ The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
}
#: (license_id, text): a licence has several templates. The last are its identifier as a tag, and its grant alone.
TEMPLATES = (
    *NOTICES.items(), *TITLES.items(), *TEXTS.items(), *((k, f"SPDX-License-Identifier: {k}") for k in sorted({**NOTICES, **TITLES})),
    *((k, f"SPDX-License-Identifier: {k}-{x}") for k in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0") for x in ("only", "or-later")), ("MIT", GRANT),
)
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Names of files that speak for their whole directory.
FILE_NAME = r"(?i)^(?:licen[cs]e|copying|notice)(?:[.\-_].*)?$"


def weigh(templates: Sequence[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """Each term's idf, the idf of any other word, and (license_id, template, term, weight) of unit vectors.

    Frequencies are those of the templates, so what a file is called does not depend on which others are scanned.
    """
    terms = [(k, Counter(re.findall(TERM, t.lower()))) for k, t in templates]
    df, n = Counter(t for _, c in terms for t in c), len(terms)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(df.items())}
    out = []
    for i, (k, c) in enumerate(terms):
        length = math.sqrt(sum((v * idf[t]) ** 2 for t, v in sorted(c.items())))
        out += [(k, i, t, v * idf[t] / length) for t, v in sorted(c.items())]
    return idf, math.log(1 + n) + 1, out


def passages(files: DataFrame) -> DataFrame:
    """(path, tk, at, k, passage): from each line with a licence word on, so many lines; and such sentences within a line.

    Blank lines are left out before. tk tells texts of one path apart.
    """
    lines = files.select("path", F.hash("text").alias("tk"), F.explode(F.array(F.filter(F.split(F.lower("text"), "\n", -1), lambda x: x.rlike(r"\S")))).alias("lines"))
    marked = lines.select("path", "tk", "lines", F.posexplode("lines").alias("i", "line")).filter(F.col("line").rlike(LICENCE_WORDS)).withColumn("at", F.col("i") + 1)
    new = F.filter(F.array(*map(F.lit, WINDOWS)), lambda w: (w == 1) | (F.col("at") + F.floor(w / 2) <= F.size("lines")))
    some = F.transform(new, lambda w: F.array_join(F.slice("lines", F.col("at"), w), " "))
    sentences = F.split(F.regexp_replace("line", r"([.;!?])\s+", "$1\n"), "\n", -1)
    within = F.when(F.size(sentences) > 1, F.filter(sentences, lambda x: x.rlike(LICENCE_WORDS))).otherwise(F.array().cast("array<string>"))
    return marked.select("path", "tk", "at", F.posexplode(F.concat(some, within)).alias("k", "passage"))


def matches(files: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(path, license_id, score) of the passages and templates with a cosine of at least the threshold."""
    spark = files.sparkSession
    idf, other, weights = weigh(templates)
    table = F.broadcast(spark.createDataFrame(weights, "license_id string, template int, term string, weight double"))  # the templates' size
    common = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    unit = ["path", "tk", "at", "k"]
    terms = passages(files).select(*unit, F.explode(F.regexp_extract_all("passage", F.lit(TERM), F.lit(0))).alias("term"))
    terms = terms.groupBy(*unit, "term").agg(F.count("*").alias("tf")).join(common, "term", "left")
    terms = terms.withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other)))
    length = terms.groupBy(*unit).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    dot = terms.join(table, "term").groupBy(*unit, "license_id", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    found = dot.join(length, unit).select("path", "license_id", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    return found.filter(F.col("score") >= threshold)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of each path in files (path, text): (path, license_id, score, origin, from_path).

    A file's own licence is that of the template most like any passage of its whole text (see passages(); ties: the
    first by name), origin `own`.
    A file without one inherits that of the nearest directory above it with a licence file (FILE_NAME) that has one
    (of several, the best by score, then by licence and path), origin `inherited`; else origin is `none` and the rest
    null. A null or empty text has no passage that matches, a very long one is
    read whole; a null path has no directory; rows of equal path count as one file and give one row; an empty table gives none; further columns, whatever their names, are not looked at.
    """
    files = files.select("path", "text")
    found = matches(files, templates, threshold).groupBy("path", "license_id").agg(F.max("score").alias("score"))
    # The first name of the highest score: the smallest of (-score, name).
    best = F.min(F.struct((-F.col("score")).alias("score"), "license_id")).alias("m")
    own = saved(found.groupBy("path").agg(best).select("path", F.col("m.license_id").alias("license_id"), (-F.col("m.score")).alias("score")))
    spoken = own.filter(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME))
    best = F.min(F.struct((-F.col("score")).alias("score"), "license_id", "path")).alias("m")
    spoken = spoken.groupBy(folder(F.col("path")).alias("dir")).agg(best)
    rest = files.select("path").distinct().join(own, "path", "left")
    parts = F.split(folder(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))
    bare = rest.filter("license_id IS NULL AND path IS NOT NULL").select("path", F.inline(above))
    near = bare.join(spoken, "dir").groupBy("path").agg(F.max_by("m", "depth").alias("m"))
    rest = rest.join(near, "path", "left")
    origin = F.when(F.col("license_id").isNotNull(), "own").when(F.col("m").isNotNull(), "inherited").otherwise("none")
    return rest.select(
        "path", F.coalesce("license_id", "m.license_id").alias("license_id"), F.coalesce("score", -F.col("m.score")).alias("score"),
        origin.alias("origin"), F.when(F.col("license_id").isNotNull(), F.col("path")).otherwise(F.col("m.path")).alias("from_path"),
    )
