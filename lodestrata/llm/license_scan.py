"""Licence scans with DataFrame functions only.

Header lines, header blocks and licence files are compared to licence statements, standard
headers and whole licence texts by the cosine of sparse TF-IDF vectors; a file without a licence of its own inherits that of the nearest directory
above it which holds a licence file. Only lines and blocks with a licence cue leave the scan, equal
ones are compared once, and the texts themselves are never shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import marked, settle

#: A line with one of these is a header line.
CUE = r"(?i)(licen[sc]e|copyright|all rights reserved|spdx-|public domain|warranty)"
#: Words that a licence text or standard header begins its grant or conditions with, over line breaks and comment marks.
_GAP = r"[\s#/*;%!-]+"
GRANT = "(?i)(" + "|".join(x.replace(" ", _GAP) for x in (
    "permission is hereby granted", "permission to use, copy", "redistribution and use in source", "redistributions of source code must", "redistributions in binary form must",
    "this (?:program|library|software) is free software", "you can redistribute it and/or", "you should have received a copy of the gnu", "licensed to the apache software foundation",
    "you may not use this file except in compliance", "subject to the terms of the", "this program and the accompanying materials", "this is free and unencumbered software", "anyone is free to copy",
    "to the extent possible under law", "the software is provided", "this software is provided", "the above copyright notice and this permission notice",
)) + ")"
#: What a line of reserved rights stands for; any other licence of the file counts before it, as licence texts have such lines.
RESERVED = "proprietary"
#: Different words from which on a template is a long text.
LONG = 80
#: What a comment line begins with.
_MARK = r"[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)"
#: The last part of a path that names a licence file.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
_TOKEN = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: Short statements of licences, by SPDX id. A licence may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]

_PROGRAM = "This {kind} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_PURPOSE = "This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {kind}. If not, see <https://www.gnu.org/licenses/>."
_GNU = [("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.0", "library", "Library General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")]

#: Standard header blocks, by SPDX id.
HEADERS: list[tuple[str, str]] = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "This code is licensed under the MIT license."),
    ("BSD-3-Clause", "This code is licensed under the BSD license."),
    *((spdx, _PROGRAM.format(kind=kind, name=name, version=version, colon=":" if version == "3" else ";", comma="," if version == "3" else ";")) for spdx, kind, name, version in _GNU),
    *((spdx, (_PROGRAM + " " + _PURPOSE).format(kind=kind, name=name, version=version, colon=":" if version == "3" else ";", comma="," if version == "3" else ";")) for spdx, kind, name, version in _GNU),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("0BSD", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-1.0", "EPL-2.0", "ISC", "MPL-2.0", "PSF-2.0", "Unlicense", "WTFPL", "X11", "Zlib")),
    # the old forms, which say neither "only" nor "or later" or end with a plus
    *((x, f"SPDX-License-Identifier: {x}") for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
    *((x, f"SPDX-License-Identifier: {x}-only") for x in ("AGPL-3.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
    *((x, f"SPDX-License-Identifier: {x}-or-later") for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")),
]
#: Licences whose text is so short that files carry all of it as their header; each of its paragraphs is a template as well.
_SHORT = ("0BSD", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Unlicense")


def texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX id, and the grants of the short ones."""
    whole = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
    grants = [(name, part) for name, text in whole if name in _SHORT for part in text.split("\n\n") if re.search(GRANT, part) and "AS IS" not in part.upper()]
    return whole + grants


def templates(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """A table of (license, template_text)."""
    return spark.createDataFrame(rows if rows is not None else TEMPLATES + HEADERS + texts(), "license string, template_text string")


def tokens(text: str | Column) -> Column:
    """Lower-case words and numbers; points, pluses and hyphens within them belong to them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1))


def directory(path: str | Column) -> Column:
    """What stands before the last slash, else the empty string."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def _ancestors(folder: str) -> Column:
    """The folder and all above it, the nearest first; the root is the empty string."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def units(files: DataFrame, file_share: float) -> DataFrame:
    """(path, unit, is_file) of header lines, header blocks and whole licence files.

    A header block is a run of comment lines with a cue or a grant, or a paragraph with a
    grant; one that is a header line by itself counts once. A licence file is one whose name
    says so, or of whose words at least ``file_share`` stand in header lines and paragraphs
    with a grant.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(CUE))
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    # a piece is a line and the comment lines below it
    pieces = F.transform(F.split(F.col("body"), rf"\n(?!{_MARK})"), lambda x: F.regexp_replace(x, rf"^(?!{_MARK})[^\n]*\n?", ""))
    comments = F.filter(pieces, lambda x: x.contains("\n") & (x.rlike(CUE) | x.rlike(GRANT)))
    paragraphs = F.filter(F.split(F.col("body"), r"\n[ \t]*\n"), lambda x: x.rlike(GRANT) & ~F.array_contains(F.col("lines"), x))
    cued = files.select("path", "text", text.alias("body"), lines.alias("lines")).where((F.size("lines") > 0) | named | F.col("body").rlike(GRANT))
    cued = cued.withColumns({"comments": comments, "paragraphs": F.filter(paragraphs, lambda x: ~x.rlike(rf"(?m)^{_MARK}")), "granted": paragraphs})
    words = F.size(tokens(F.coalesce("text", F.lit(""))))
    single = F.filter("lines", lambda x: ~F.exists("paragraphs", lambda y: y.contains(F.regexp_replace(x, "\r", ""))))
    is_file = named | (F.size(tokens(F.array_join(F.concat(single, "paragraphs"), " "))) >= file_share * words)
    whole = F.when(is_file, F.array(F.struct(F.coalesce("text", F.lit("")).alias("unit"), F.lit(True).alias("is_file")))).otherwise(F.array().cast("array<struct<unit:string,is_file:boolean>>"))
    blocks = F.array_union("comments", "granted")
    every = F.concat(F.transform(F.concat("lines", blocks), lambda x: F.struct(x.alias("unit"), F.lit(False).alias("is_file"))), whole)
    return cued.select("path", F.explode(every).alias("u")).select("path", "u.unit", "u.is_file")


def scan(files: DataFrame, known: DataFrame | None = None, min_score: float = 0.6, file_share: float = 0.5, text_score: float = 0.85) -> DataFrame:
    """(path, license, score, n_units, inherited_from, directory) for each different path.

    ``files`` has path and text, ``known`` license and template_text. ``license`` is that of
    the template closest to a header line, header block or licence file of the path, if the cosine is at
    least ``min_score`` (``text_score`` for templates of ``LONG`` different words and more);
    otherwise that of the nearest directory with a licence file, named
    in ``inherited_from``, with a null score; otherwise null. Of equal scores the smaller
    licence name counts, and reserved rights count where nothing else is found. Inverse document frequencies come from all units of all files.

    Null and empty texts have no units. Rows with the same path are one file, whose units
    are pooled; null paths are one file, in the root directory. A table of no rows gives
    none; extra columns aren't looked at.
    """
    spark = files.sparkSession
    known = templates(spark) if known is None else known
    files = files.select("path", "text")
    found = settle(units(files, file_share), "license-units")
    counted = found.groupBy("unit").agg(F.count("*").alias("copies"))
    # each different unit is split into terms once
    terms = counted.select("unit", "copies", F.explode(tokens("unit")).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"), F.any_value("copies").alias("copies"))
    total = found.count()
    # the weight of a term that no unit has is that of df 0
    idf = lambda df: F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1.0
    weight = terms.groupBy("term").agg(F.sum("copies").alias("df")).select("term", idf(F.col("df")).alias("idf"))
    weight = marked(settle(weight, "license-weights"))
    vectors = terms.join(weight, "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = vectors.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    named = known.select("license", F.xxhash64("license", "template_text").alias("template"), F.explode(tokens("template_text")).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))
    told = named.join(weight, "term", "left").select("license", "template", "term", (F.col("tf") * F.coalesce("idf", idf(F.lit(0.0)))).alias("tw"))
    lengths = told.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"), F.count("*").alias("words"))
    told = marked(settle(told.join(lengths, ["license", "template"]), "license-templates"))  # so that frequent words meet in no one task
    dots = vectors.join(told, "term").groupBy("unit", "license", "template").agg((F.sum(F.col("w") * F.col("tw")) / F.any_value("tnorm")).alias("dot"), F.any_value("words").alias("words"))
    scored = dots.join(norms, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "words")
    # common words alone bring long prose near to a long text
    scored = scored.where((F.col("words") < LONG) | (F.col("score") >= text_score))
    scored = scored.groupBy("unit", "license").agg(F.max("score").alias("score"))
    nearest = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("unit", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    close = found.join(nearest.where(F.col("score") >= min_score), "unit").select(F.coalesce("path", F.lit("")).alias("path"), "is_file", "license", "score")
    order = F.min(F.struct((F.col("license") == RESERVED).alias("r"), (-F.col("score")).alias("s"), "license")).alias("b")
    own = close.groupBy(F.col("path").alias("own_path")).agg(order).select("own_path", F.col("b.license").alias("own"), (-F.col("b.s")).alias("score"))
    holds = close.where("is_file").withColumn("holder", directory("path")).groupBy("holder").agg(order).select("holder", F.col("b.license").alias("above"))
    paths = files.select(F.coalesce("path", F.lit("")).alias("path")).distinct().withColumn("directory", directory("path"))
    folders = paths.select("directory").distinct().select("directory", F.posexplode(_ancestors("directory")).alias("up", "holder"))
    inherit = folders.join(holds, "holder").groupBy("directory").agg(F.min(F.struct("up", "holder", "above")).alias("b"))
    inherit = inherit.select(F.col("directory").alias("dir_"), F.col("b.above").alias("above"), F.col("b.holder").alias("holder"))
    many = found.groupBy(F.coalesce("path", F.lit("")).alias("unit_path")).agg(F.count("*").alias("n_units"))
    out = paths.join(own, F.col("path") == F.col("own_path"), "left").join(many, F.col("path") == F.col("unit_path"), "left").join(inherit, F.col("directory") == F.col("dir_"), "left")
    return out.select(
        "path", F.coalesce("own", "above").alias("license"), "score", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
        F.when(F.col("own").isNull(), F.col("holder")).alias("inherited_from"), "directory",
    )


def scanned_documents(docs: DataFrame) -> DataFrame:
    """One row for each document; its path is source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    out = scan(docs.select(path.alias("path"), "text"))
    return out.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "path", "license", "score", "n_units", "inherited_from")


def sql() -> str:
    """The same rows by DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    tok = lambda x: f"regexp_extract_all(lower({x}), '{_TOKEN}')"
    return f"""
WITH known(license, template_text) AS (VALUES {quoted}),
files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS directory, coalesce(source, 'none') AS top, coalesce(text, '') AS text
  FROM documents
), cued AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) AS lines FROM files
), found AS (
  SELECT path, directory, unnest(lines) AS unit, false AS is_file FROM cued WHERE len(lines) > 0
  UNION ALL
  SELECT path, directory, text, true FROM cued
  WHERE len(lines) > 0 AND len({tok("array_to_string(lines, ' ')")}) >= 0.5 * len({tok("text")})
), counted AS (SELECT unit, count(*) AS copies FROM found GROUP BY unit),
terms AS (SELECT unit, term, count(*) AS tf, any_value(copies) AS copies FROM (SELECT unit, copies, unnest({tok("unit")}) AS term FROM counted) GROUP BY unit, term),
total AS (SELECT count(*) AS n FROM found),
weight AS (SELECT term, ln((1.0::DOUBLE + (SELECT n FROM total)) / (1.0::DOUBLE + sum(copies))) + 1.0 AS idf FROM terms GROUP BY term),
vectors AS (SELECT unit, term, tf * idf AS w FROM terms JOIN weight USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY unit),
named AS (SELECT license, template_text, term, count(*) AS tf FROM (SELECT license, template_text, unnest({tok("template_text")}) AS term FROM known) GROUP BY ALL),
told AS (SELECT license, template_text, term, tf * coalesce(idf, ln(1.0::DOUBLE + (SELECT n FROM total)) + 1.0) AS tw FROM named LEFT JOIN weight USING (term)),
lengths AS (SELECT license, template_text, sqrt(sum(tw * tw)) AS tnorm FROM told GROUP BY ALL),
dots AS (SELECT unit, license, template_text, sum(w * tw) AS dot FROM vectors JOIN told USING (term) GROUP BY ALL),
scored AS (SELECT unit, license, round(max(dot / tnorm / norm), 6) AS score FROM dots JOIN lengths USING (license, template_text) JOIN norms USING (unit) GROUP BY unit, license),
nearest AS (SELECT unit, license, score FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1),
near AS (SELECT path, directory, is_file, license, score FROM found JOIN nearest USING (unit)),
own AS (SELECT path, license AS own, score FROM near QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
holds AS (SELECT directory, license AS above FROM near WHERE is_file QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, license) = 1),
many AS (SELECT path, count(*) AS n_units FROM found GROUP BY path)
SELECT doc_id, path, coalesce(own, h.above, t.above) AS license, score, coalesce(n_units, 0) AS n_units,
       CASE WHEN own IS NULL THEN CASE WHEN h.above IS NOT NULL THEN h.directory WHEN t.above IS NOT NULL THEN t.directory END END AS inherited_from
FROM files LEFT JOIN own USING (path) LEFT JOIN many USING (path)
LEFT JOIN holds h ON h.directory = files.directory LEFT JOIN holds t ON t.directory = files.top
"""
