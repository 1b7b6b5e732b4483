"""Licences of files: TF-IDF cosine of header lines and licence files to templates, then inheritance by directory.

A line that has one of CUES is a candidate, without comment signs. Where a file's lines match nothing, or where it has
words of a licence's body (BODY), a second round takes wider ones: as notices are wrapped, the lines beside it joined
to it in several widths (REACHES), and paragraphs and, of a file whose name says licence, the text. Equal candidates are scored once, and
carried by a number: terms are weighted by 1 + ln of their count and their frequency
over all candidates of the round, and the sparse cosine to each template comes from a join on terms. A template counts only for candidates
that hold its decisive terms (DECIDES): the names and the version that tell licences apart. A candidate that names no
version may match where TEMPLATES has one version of the licence only. A file's licence is its best candidate's, if that
reaches CLOSE. A file whose candidates match nothing is UNKNOWN and inherits nothing, unless its lines only name an
owner or point to a licence file. A file with a licence is a licence file if its name says so, or (a known licence) if
the candidate is most of what it has. A file without one inherits from the licence file in its nearest ancestor
directory; the directories above each path are joined with those of licence files.

Null and empty texts have no licence of their own; a null path has no directory and inherits nothing; ties go to the
licence, then the path, that comes first; repeated rows are judged each alike; an empty table gives an empty result;
all lines of a text of any length are looked at; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: The licences of Creative Commons by their short and long names.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _cc(code: str, name: str, version: str) -> list[str]:
    port = "International" if version == "4.0" else "Unported"
    return [f"Licensed under CC {code} {version}", f"This work is licensed under a Creative Commons {name} {version} {port} License", f"Creative Commons {name} {version}"]


def _gnu(name: str, kind: str, version: str) -> list[str]:
    return [
        f"This {'work' if kind == 'program' else kind} is licensed under the {name}, version {version}",
        f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version",
        _gnu_notice(name, kind, version),
    ]


#: Whole texts of short licences, without titles and owners.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _gnu_notice(name: str, kind: str, version: str) -> str:
    return (
        f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this {kind}."
    )


#: Whole texts and notices, and characteristic sentences of them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", _APACHE],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The MIT License (MIT)", _GRANT],
    "GPL-2.0": [*_gnu("GNU General Public License", "program", "2"), "Licensed under the GPL, version 2", "Licensed under GPLv2"],
    "GPL-3.0": [*_gnu("GNU General Public License", "program", "3"), "Licensed under the GPL, version 3", "Licensed under GPLv3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL-2.1": [*_gnu("GNU Lesser General Public License", "library", "2.1"), "Licensed under the LGPL, version 2.1", "Licensed under LGPLv2.1"],
    "LGPL-3.0": [*_gnu("GNU Lesser General Public License", "library", "3"), "Licensed under the LGPL, version 3", "Licensed under LGPLv3"],
    "AGPL-3.0": [*_gnu("GNU Affero General Public License", "program", "3"), "Licensed under the AGPL, version 3", "Licensed under AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License", "Licensed under the Simplified BSD License", f"{_CLAUSES} {_WARRANTY}"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "BSD 3-Clause License", "Licensed under the BSD 3-Clause License", f"{_CLAUSES} {_THIRD} {_WARRANTY}"],
    "ISC": ["ISC License", "Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", _ISC],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", _MPL],
    "Unlicense": ["This is free and unencumbered software released into the public domain", _UNLICENSE],
    **{f"CC-{code}-{version}": _cc(code, name, version) for code, name in CREATIVE.items() for version in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}
CUES = r"(?i)licen[sc]e|copyright|permission is hereby|redistribution and use|free software|public domain|creative commons|\bcc[ -]by\b"
#: Candidate lines that state no terms of their own: they name an owner, or point to the licence file.
OWNER = r"(?i)licen[sc]e|permission|redistribution|free software|public domain|creative commons|\bcc[ -]by\b"
POINTS = r"(?i)\b(see|found in|refer to)\b.{0,40}\b(licen[sc]e|copying)\b"
UNKNOWN = "unknown"
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
CLOSE, MOST = 0.6, 0.5
BODY = r"(?i)permission is hereby|permission to use, copy|redistribution and use|free software|unencumbered|in compliance with the license|this source code form"
#: Lines before and after a candidate that are joined to it, and signs that begin a comment or end one.
REACHES = [(0, 1), (1, 1), (0, 3), (1, 3), (0, 7)]
SIGNS = r"^\s*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|\"\"\"|')*\s*|\s*(?:\*+/|-->)?\s*$"
TERM = r"[\p{L}\p{N}.+-]*[\p{L}\p{N}]"
DECIDES = r"^(apache|mit|isc|mozilla|gnu|lesser|affero|[al]?gpl(v[0-9.]+)?|bsd(-style)?|simplified|[0-9]-clause|creative|cc|by-.*|attribution.*|unencumbered)$"
VERSION = r"^[0-9]{1,2}(\.[0-9]+)?$"


def _terms(line):
    """Words in small letters; v3 and 3.0 are 3, and CC-BY-NC-4.0 is CC BY-NC 4.0."""
    plain = F.regexp_replace(F.lower(line), r"\bcc[ -]by((?:-[a-z]{2})*)(?:[ -]v?(?=[0-9]))?", "cc by$1 ")
    return F.transform(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), lambda t: F.regexp_replace(t, r"^v?([0-9]{1,2}(?:\.[1-9][0-9]*)?)(?:\.0)?$", "$1"))


def _family(license: str) -> str:
    """The licence without its version."""
    return re.sub(r"-[0-9.]+$", "", license)


def candidates(files: DataFrame, wide: bool) -> DataFrame:
    """(key, path, size, kind, line) for each candidate of files(key, path, text): a line; or (wide) lines joined to it, a paragraph, or the text of a file that is named as a licence. size is that of the text."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, SIGNS, ""))
    own = files.where(F.col("text").rlike(CUES)).select("key", "path", F.length("text").alias("size"), F.col("path").rlike(NAMES).alias("named"), lines.alias("l"))
    unit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("line"))
    at = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("l", i).rlike(CUES))
    near = lambda i, a, b: F.array_join(F.slice(F.col("l"), F.greatest(i - a, F.lit(0)) + 1, b + 1 + F.least(i, F.lit(a))), " ")
    single = F.transform(at, lambda i: unit("line", F.get("l", i)))
    joined = F.flatten(F.transform(at, lambda i: F.array(*(unit("wide", near(i, a, b)) for a, b in REACHES))))
    paragraphs = F.transform(F.filter(F.split(F.array_join("l", "\n"), r"\n\n+"), lambda p: p.rlike(CUES) & p.rlike(BODY.replace(" ", r"\s+"))), lambda p: unit("paragraph", p))
    text = F.when(F.col("named"), F.array(unit("text", F.array_join("l", " ")))).otherwise(F.expr("cast(array() as array<struct<kind:string, line:string>>)"))
    units = F.concat(joined, paragraphs, text) if wide else single
    return own.select("key", "path", "size", F.explode(F.array_distinct(units)).alias("u")).select("key", "path", "size", "u.*")


def scored_lines(lines: DataFrame) -> DataFrame:
    """(digest, license, score): the best template of each distinct line, told by the SHA-256 of it. Terms carry a number for their line, so the work grows with the terms of a line and not with their square."""
    spark = lines.sparkSession
    distinct = lines.groupBy(F.sha2(F.col("line").cast("binary"), 256).alias("digest"), "line").agg(F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("no", F.monotonically_increasing_id()), "lines")
    counts = cut(distinct.select("no", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("no", "n", "term").agg(F.count("*").alias("tf")), "terms")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (F.ln(F.lit(1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    families = Counter(map(_family, TEMPLATES))
    rows = [(f"{k}#{i}", k, families[_family(k)] == 1, t) for k, own in TEMPLATES.items() for i, t in enumerate(own)]
    fixed = spark.createDataFrame(rows, "template string, license string, lone boolean, line string")
    own = fixed.select("template", "license", "lone", F.explode(_terms(F.col("line"))).alias("term")).groupBy("template", "license", "lone", "term").agg(F.count("*").alias("tf"))
    weigh = lambda x: x.join(idf, "term", "left").withColumn("w", (1 + F.ln("tf")) * F.coalesce("idf", F.lit(1.0)))
    ours, theirs = weigh(counts), weigh(own)
    versions = lambda: F.count_if(F.col("term").rlike(VERSION))
    names = lambda: F.count_if(F.col("term").rlike(DECIDES))
    norm = ours.groupBy("no").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("a"), versions().alias("named"))
    size = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("b"), names().alias("names"), versions().alias("versions"))
    theirs = theirs.join(size, "template").select("template", "license", "lone", "names", "versions", "term", (F.col("w") / F.col("b")).alias("wt"))
    # The templates are fixed, some thousand terms, so they are broadcast.
    dot = ours.join(F.broadcast(theirs), "term").groupBy("no", "template", "license", "lone", "names", "versions").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"), names().alias("met"), versions().alias("same")).join(norm, "no")
    dot = dot.where((F.col("met") == F.col("names")) & ((F.col("same") == F.col("versions")) | F.col("lone") & (F.col("named") == 0)))
    best = dot.select("no", "license", F.round(F.col("dot") / F.col("a"), 6).alias("score")).groupBy("no").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
    return best.join(distinct.select("no", "digest"), "no").select("digest", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def scan(files: DataFrame, key_col: str, path_col: str, text_col: str) -> DataFrame:
    """key, path, license (UNKNOWN: a notice that no template matches), score, found (header, file, inherited or none, which an unknown header is too), origin (the path that it comes from)."""
    files = files.select(files[key_col].alias("key"), files[path_col].cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    close = F.coalesce(F.col("score") >= CLOSE, F.lit(False))

    def scored(rows, name):
        rows = cut(rows, name)
        own = rows.withColumn("digest", F.sha2(F.col("line").cast("binary"), 256))
        return cut(own.join(scored_lines(rows), "digest", "left").select("key", "path", "size", "kind", "line", "license", "score"), name)

    lines = scored(candidates(files, False), "lines")
    # Few files are left for the second round: those without a close line, and those with a licence's body.
    found = lines.where(close).select(F.col("key").alias("k"), F.col("path").alias("p")).distinct()
    open_ = files.where(F.col("text").rlike(CUES)).join(found, files["key"].eqNullSafe(found["k"]) & files["path"].eqNullSafe(found["p"]) & ~files["text"].rlike(BODY.replace(" ", r"\s+")), "left_anti")
    more = scored(candidates(open_, True), "wide")
    hits = lines.union(more).where(close | (F.col("kind") == "line") & F.col("line").rlike(OWNER) & ~F.col("line").rlike(POINTS))
    hits = hits.select("key", "path", "line", "size", (~close).alias("odd"), F.when(close, F.col("license")).otherwise(UNKNOWN).alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"))
    own = hits.groupBy("key", "path").agg(F.min(F.struct("odd", (-F.col("score")).alias("s"), "license", "line", "size")).alias("m"))
    whole = F.col("path").rlike(NAMES) | (~F.col("m.odd") & (F.length("m.line") >= MOST * F.col("m.size")))
    own = cut(own.select("key", "path", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"), F.coalesce(whole, F.lit(False)).alias("whole")), "own")
    folder = F.regexp_replace("path", "[^/]*$", "")
    given = own.where("whole and path is not null").groupBy(folder.alias("dir")).agg(F.min(F.struct((~F.col("path").rlike(NAMES)).alias("odd"), (F.col("license") == UNKNOWN).alias("vague"), "path", "license", "score")).alias("g"))
    ids = files.select("key", "path")
    mine = own.select(F.col("key").alias("k"), F.col("path").alias("p"), "license", "score", "whole")
    out = ids.join(mine, ids["key"].eqNullSafe(mine["k"]) & ids["path"].eqNullSafe(mine["p"]), "left").drop("k", "p")
    # All directories above a path, the root included; each directory is looked up once.
    folders = out.where("license is null and path is not null").select(folder.alias("at")).distinct()
    above = folders.select("at", F.explode(F.expr("transform(sequence(0, size(split(at, '/')) - 1), i -> concat_ws('/', slice(split(at, '/'), 1, i), ''))")).alias("dir"))
    above = above.withColumn("dir", F.when(F.col("dir") == "/", F.lit("/")).otherwise(F.col("dir")))
    near = above.join(given, "dir").groupBy("at").agg(F.max_by("g", F.length("dir")).alias("g"))
    out = out.withColumn("at", folder).join(near, "at", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "key", "path", F.coalesce("license", "g.license").alias("license"), F.coalesce("score", "g.score", F.lit(0.0)).alias("score"),
        F.when(has & F.col("whole"), "file").when(F.col("license") == UNKNOWN, "none").when(has, "header").when(F.col("g.path").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(has, F.col("path")).otherwise(F.col("g.path")).alias("origin"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a repository, a hundred ids in a row share a directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.withColumn("__path", path), "doc_id", "__path", "text").withColumnRenamed("key", "doc_id")
