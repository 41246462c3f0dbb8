r"""License scans: TF-IDF cosine to templates, then inheritance down the directories.

Templates are full short licences, the titles and standard notices of long ones,
SPDX lines, and short mentions made by a rule from names. Units of a file are
windows of consecutive words around every cue word (``license``, ``copyright``,
``permission``, ...), across line breaks: for each template that has this cue word
first, a window with as many words before and after as the template has. A unit and a template of its shape are sparse TF-IDF vectors over their
words, with document frequencies taken from the templates; words that no
template holds weigh nothing. A unit's licence is the template of the largest
cosine, if that reaches ``THRESHOLD``; ties go to the larger name. A file's own
licence is that of its best unit. A file without one inherits from the nearest
directory above it, its own first, that holds a licence file: ancestors are
resolved once per directory, by joins on paths, and not per file.

Files are told apart by path and content, so two files of one path keep their own
licences. Work grows with the number of cue words. NULL and empty texts have no licence of their own; texts
of any length are read whole; a NULL path has neither an own licence nor a directory. Repeated rows
all get the result of their file. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref
from ledgerloom.llm.common import WORD, query, staged, table

#: SPDX names of licences, and the names that texts call them by.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
)
#: Titles and notices as the licences prescribe them, and short licences whole.
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _FREE.format("Affero General Public License", 3)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", _BSD.format("", "")),
    ("BSD-2-Clause", _BSD.format("1. ", "2. ")),
    ("BSD-3-Clause", _BSD.format("", "") + _NEITHER),
    ("BSD-3-Clause", _BSD.format("1. ", "2. ") + " 3." + _NEITHER),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "CC0 1.0 Universal Creative Commons Legal Code"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _FREE.format("General Public License", 2)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _FREE.format("General Public License", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _FREE.format("Lesser General Public License", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
SPDX = tuple(dict.fromkeys(name for name, _ in (*NAMES, *TEXTS)))
#: Short mentions and SPDX lines, by rule.
TEMPLATES = (
    *TEXTS,
    *((i, f"{how} under the {name}") for i, name in NAMES for how in ("Licensed", "Released", "This work is licensed") if how != "Released" or "License" in name),
    *((i, f"Licensed under {name}") for i, name in NAMES if i.startswith("CC")),
    *((i, f"SPDX-License-Identifier: {i}") for i in SPDX),
    *((i, f"SPDX-License-Identifier: {i}-or-later") for i in SPDX if "GPL" in i),
    *((i, f"SPDX-License-Identifier: {i}-only") for i in SPDX if "GPL" in i),
)
THRESHOLD = 0.75
#: Cue words.
CUE = "^((un|sub)?licen[sc]e[sd]?|copyright|spdx|unencumbered|redistributions?|permission|waived|cc0)$"
#: A text without one of these has no cue word.
MAY_HOLD = r"(?i)licen[sc]e|copyright|spdx|unencumbered|redistribution|permission|waived|cc0"
LICENSE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice"
TERM = "[a-z0-9]+"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def shapes(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, str, int, int, int, str]]:
    """template, license, first cue word, words before and after it, number of that shape, text."""
    numbers: dict[tuple[str, int, int], int] = {}
    out = []
    for i, (name, text) in enumerate(templates):
        words = re.findall(TERM, text.lower())
        at = next(k for k, w in enumerate(words) if re.search(CUE, w))
        shape = (words[at], at, len(words) - at - 1)
        out.append((i, name, *shape, numbers.setdefault(shape, len(numbers)), text))
    return out


def template_weights(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cue, before, after, shape; term, idf; and license, template, shape, term, weight, each template a vector of length one.

    As many rows as templates have words.
    """
    rows = spark.createDataFrame(shapes(templates), "template int, license string, cue string, before int, after int, shape int, text string")
    tf = rows.select("template", "license", "shape", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "shape", "term").count()
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(len(templates))) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("count") * F.col("idf"))
    norms = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = raw.join(F.broadcast(norms), "template").select("template", "license", "shape", "term", (F.col("w") / F.col("norm")).alias("weight"))
    return rows.select("cue", "before", "after", "shape").distinct(), idf, weights


def own_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """path, print, license, similarity of the files with a unit above the threshold; ``files`` has path, print and text."""
    around, idf, weights = template_weights(files.sparkSession, templates)
    held = files.where(F.col("path").isNotNull() & F.regexp_like("text", F.lit(MAY_HOLD))).select("path", "print", _terms(F.col("text")).alias("words"))
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.get("words", i - 1).rlike(CUE))
    cues = held.where(F.size("words") > 0).select("*", F.explode(places).alias("at")).withColumn("cue", F.get("words", F.col("at") - 1))
    first = F.greatest(F.col("at") - F.col("before"), F.lit(1))
    windows = cues.join(F.broadcast(around), "cue").select("path", "print", "at", "shape", F.slice("words", first, F.col("at") + F.col("after") - first + 1).alias("window"))
    unit = ["path", "print", "at", "shape"]
    tf = windows.select(*unit, F.explode("window").alias("term")).join(F.broadcast(idf), "term").groupBy(*unit, "term").agg((F.count(F.lit(1)) * F.max("idf")).alias("w"))
    tf = staged(tf)
    norms = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        tf.join(F.broadcast(weights), ["shape", "term"])
        .groupBy(*unit, "template", "license")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    cosine = dots.join(norms, unit).select("path", "print", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = cosine.where(F.col("similarity") >= THRESHOLD).groupBy("path", "print").agg(F.max(F.struct("similarity", "license")).alias("_best"))
    return best.select("path", "print", "_best.license", "_best.similarity")


def directory(path: Column) -> Column:
    """The directory of a path, without a closing slash; the root is empty."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def inherited(dirs: DataFrame, holders: DataFrame) -> DataFrame:
    """dir, license of the nearest directory at or above each distinct ``dir`` that ``holders`` (dir, license) names."""
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")),
    )
    found = dirs.select("dir", F.inline(above)).join(holders.withColumnRenamed("dir", "above"), "above")
    return found.groupBy("dir").agg(F.max(F.struct("depth", "license")).alias("_near")).select("dir", "_near.license")


def scan_licenses(
    df: DataFrame, path: str = "path", text: str = "text", licence_file: Column | None = None, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str | None = None
) -> DataFrame:
    """path (and ``key``), license, similarity, via (own, inherited, none) of every row.

    ``licence_file`` is a condition on the columns ``path`` and ``text``; by
    default the file's name says so. Runs jobs: term weights and licences are staged.
    """
    carried = [ref(key).alias("key")] if key else []
    files = df.select(ref(path).alias("path"), ref(text).alias("text"), F.md5(ref(text).cast("binary")).alias("print"), *carried)
    if licence_file is None:
        licence_file = F.regexp_like(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENSE_FILE))
    own = staged(own_licenses(files, templates))
    named = files.select("path", "print", *(["key"] if key else []), directory(F.col("path")).alias("dir"))
    says = files.where(F.coalesce(licence_file, F.lit(False))).select("path", "print").distinct()
    holders = own.join(says, ["path", "print"]).groupBy(directory(F.col("path")).alias("dir")).agg(F.max(F.struct("similarity", "license")).alias("_best"))
    below = staged(inherited(named.where(F.col("dir").isNotNull()).select("dir").distinct(), holders.select("dir", "_best.license")))
    return (
        named.join(own, ["path", "print"], "left")
        .join(below.withColumnRenamed("license", "_above"), "dir", "left")
        .select(
            "path",
            *([F.col("key").alias(key)] if key else []),
            F.coalesce("license", "_above").alias("license"),
            "similarity",
            F.when(F.col("license").isNotNull(), "own").when(F.col("_above").isNotNull(), "inherited").otherwise("none").alias("via"),
        )
    )


#: In the query a document of so few words that names a licence is the licence file of its source.
HOLDER_WORDS = 60
_VALUES = ", ".join(f"({i}, '{name}', '{cue}', {before}, {after}, {shape}, '{text}')" for i, name, cue, before, after, shape, text in shapes())


@query(
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS dir, text FROM documents),
t AS (SELECT * FROM (VALUES {_VALUES}) v(template, license, cue, before, after, shape, text)),
tw AS (SELECT template, license, shape, term, count(*) AS n FROM (SELECT template, license, shape, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM t) GROUP BY ALL),
i AS (SELECT term, ln({len(TEMPLATES) + 1}::DOUBLE / (1 + count(*))) + 1 AS idf FROM tw GROUP BY term),
tn AS (SELECT tw.*, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM tw JOIN i USING (term)),
x AS (SELECT r, regexp_extract_all(lower(text), '{TERM}') AS words FROM d WHERE doc_id IS NOT NULL AND regexp_matches(text, '{MAY_HOLD}')),
p AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS pos FROM x),
s AS (SELECT DISTINCT cue, before, after, shape FROM t),
u AS (SELECT r, pos, shape, unnest(list_slice(words, greatest(pos - before, 1), pos + after)) AS term FROM p JOIN s ON words[pos] = cue),
w AS (SELECT r, pos, shape, term, count(*) * any_value(idf) AS w FROM u JOIN i USING (term) GROUP BY ALL),
n AS (SELECT r, pos, shape, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
o AS (SELECT r, pos, shape, template, license, sum(w * weight) AS dot FROM w JOIN tn USING (shape, term) GROUP BY ALL),
c AS (SELECT r, license, round(dot / norm, 6) AS similarity FROM o JOIN n USING (r, pos, shape)),
b AS (SELECT r, max((similarity, license)) AS best FROM c WHERE similarity >= {THRESHOLD} GROUP BY r),
h AS (SELECT dir, max(best) AS best FROM d JOIN b USING (r) WHERE len(regexp_extract_all(text, '{WORD}')) <= {HOLDER_WORDS} GROUP BY dir)
SELECT doc_id, CASE WHEN doc_id IS NOT NULL THEN coalesce(b.best[2], h.best[2], z.best[2]) END AS license, b.best[1] AS similarity,
  CASE WHEN b.best IS NOT NULL THEN 'own' WHEN doc_id IS NOT NULL AND (h.best IS NOT NULL OR z.best IS NOT NULL) THEN 'inherited' ELSE 'none' END AS via
FROM d LEFT JOIN b USING (r) LEFT JOIN h ON h.dir = d.dir LEFT JOIN h z ON z.dir = ''"""
)
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, each a file named by its id in the directory of its source; short ones that name a licence are the directory's."""
    docs = table(spark, folder, "documents")
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    short = F.regexp_count("text", F.lit(WORD)) <= HOLDER_WORDS
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), licence_file=short, key="doc_id").drop("path")
