"""License scans: TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

Only DataFrame functions are used. A file is compared in parts: its lines, the sentences of lines that
have several, its blocks of lines between blank ones (a header in comment marks is such a block), and,
if it is a licence file by its name, the whole of it. Parts and templates are sparse vectors of term
counts times inverse document frequency, ln((N + 1) / (n + 1)) + 1 over the N documents that have any
term, n of which hold it; frequencies are counted over all documents for every term of a compared part,
whether templates have it or not. A part at or above the threshold is a notice: a header in an ordinary
file; in a licence file it also is the directory's declaration. A file without a notice of its own
inherits from the nearest directory above it, its own included, that declares one.

By Cauchy-Schwarz a part that lacks a template's heaviest terms, so that those left weigh less than the
threshold, cannot reach it. A small set of terms that all templates need in this sense is picked from
the weights, and only documents, then parts, that hold one of them are compared: a saving that loses no
notice.

Terms are runs of A-Z, a-z and 0-9 in lower case. Of several notices the highest score counts, then the
license's name; so also for directories. Null texts and parts without
terms match nothing; a null path has no directory, so it inherits nothing. Every row is a file of its
own, also when ids are null or repeat: notices belong to rows. Extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm._shared import Scratch, located, text_of

# Texts of licenses and the notices by which files state them.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
)
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Texts by license. Each is a template of its own; so is, for every license, its SPDX tag.
TEXTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", APACHE_HEADER],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{BSD_GRANT} {BSD_TWO} {BSD_REST}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_REST}", BSD_THIRD],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", GPL_HEADER.format(v=2), f"{GPL_HEADER.format(v=2)} {GPL_REST}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GPL_HEADER.format(v=3), f"{GPL_HEADER.format(v=3)} {GPL_REST}"],
    "ISC": ["Licensed under the ISC License.", ISC_GRANT, f"{ISC_GRANT} {ISC_REST}"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", MIT_GRANT, f"{MIT_GRANT} {MIT_REST}"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", MPL_HEADER],
}
TEMPLATES = [(name, text) for name, texts in TEXTS.items() for text in (*texts, f"SPDX-License-Identifier: {name}")]
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)"
#: Fixed value: what stands before the holder's name in a notice of copyright; it says nothing about the license.
COPYRIGHT = "(?i)copyright *(\\(c\\)|©)? *[0-9]{4}([ ,-]+[0-9]{4})*,?"
SENTENCE, BLOCK = "[.!?;] +", "\n([^A-Za-z0-9\n]*\n)+"
KEY = ["file", "row"]


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def parts_of(text: Column, whole: Column) -> Column:
    """The different parts of a text that are compared: lines, sentences, blocks, and all of it where ``whole`` says so."""
    lines = F.split(F.regexp_replace(text, COPYRIGHT, ""), "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE)))
    blocks = F.split(text, BLOCK)
    return F.array_distinct(F.concat(lines, sentences, blocks, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def needed(vectors: dict[int, dict[str, float]], threshold: float, seen: dict[str, int]) -> list[str]:
    """Terms of which a part must hold one at least to come to the threshold with any of the templates.

    Picked one after another, each time the one with the largest shares in templates not done with for the documents that hold it (``seen``).
    """
    share = {k: {t: w * w / sum(x * x for x in v.values()) for t, w in v.items()} for k, v in vectors.items()}
    left, out = {k: 1.0 for k in share}, []
    while left:
        gain: dict[str, float] = {}
        for k in left:
            for t, w in share[k].items():
                if t not in out:
                    gain[t] = gain.get(t, 0.0) + w
        out.append(min(gain, key=lambda t: (-gain[t] / (1 + seen.get(t, 0)), t)))
        for k in list(left):
            left[k] -= share[k].get(out[-1], 0.0)
            if left[k] < threshold * threshold - 1e-9:
                del left[k]
    return out


def notices(files: DataFrame, scratch: Scratch, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(file, row, license, score): the best notice of each row of ``files`` (file, row, declares, text) that has one."""
    spark = files.sparkSession
    own = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    own = own.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf")).collect()  # the templates' terms
    known = sorted({r["term"] for r in own})

    # how many documents hold each of the templates' terms: a row per term, and one for all documents (the empty term)
    distinct = F.array_distinct(terms(F.col("text")))
    hits = F.when(F.size(distinct) > 0, F.array_append(F.array_intersect(distinct, F.array(*map(F.lit, known))), F.lit("")))
    seen = {r["term"]: r["n"] for r in files.select(F.explode(hits).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = seen.pop("", 0)
    idf = lambda n: F.log((F.lit(total) + 1.0) / (n + 1.0)) + 1.0
    counted = spark.createDataFrame([(t, seen.get(t, 0)) for t in known], "term string, n long").withColumn("idf", idf(F.col("n")))
    weights = {r["term"]: r["idf"] for r in counted.collect()}
    vectors: dict[int, dict[str, float]] = {}
    for r in own:
        vectors.setdefault(r["template"], {})[r["term"]] = r["tf"] * weights[r["term"]]
    gate = needed(vectors, threshold, seen)
    one_of = F.array(*map(F.lit, gate))
    parts = files.filter(F.arrays_overlap(terms(F.col("text")), one_of)).select(*KEY, F.posexplode(parts_of(F.col("text"), F.col("declares"))).alias("part", "said")).select(*KEY, "part", terms(F.col("said")).alias("terms"))
    parts = parts.filter(F.arrays_overlap("terms", one_of)).select(*KEY, "part", F.explode("terms").alias("term"))
    parts = scratch.save(parts.groupBy(*KEY, "part", "term").agg(F.count(F.lit(1)).alias("tf")), "parts")

    # the other terms of these parts, in all documents
    others = scratch.save(parts.select("term").distinct().filter(~F.col("term").isin(known)), "others")
    elsewhere = files.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(others, "term", "left_semi")  # counted before it is moved
    rarity = scratch.save(elsewhere.select("term", idf(F.col("n")).alias("idf")).unionByName(counted.select("term", "idf")), "rarity")
    weighed = scratch.save(parts.join(rarity, "term").select(*KEY, "part", "term", (F.col("tf") * F.col("idf")).alias("w")), "weighed")
    length = weighed.groupBy(*KEY, "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = spark.createDataFrame(
        [(r["template"], r["license"], r["term"], vectors[r["template"]][r["term"]] / sum(w * w for w in vectors[r["template"]].values()) ** 0.5) for r in own], "template int, license string, term string, unit double"
    )
    product = weighed.join(F.broadcast(unit), "term").groupBy(*KEY, "part", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("product"))
    scored = product.join(length, [*KEY, "part"]).select(*KEY, "license", F.round(F.col("product") / F.col("length"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy(*KEY).agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("b"))
    return best.select(*KEY, F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"))


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.7, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, license, source, score, declared_in), one row per row of ``df``.

    source: header, licence file, inherited or none. declared_in: the directory inherited from.
    """
    scratch = Scratch(df.sparkSession, "licenses")
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").alias("path"), text_of(f"`{text_col}`").alias("text"))
    rows = located(plain, scratch, id=F.col("id"), path=F.col("path"), text=F.col("text"))
    declares = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False)).alias("declares")
    own = scratch.save(notices(rows.select(*KEY, declares, "text"), scratch, templates, threshold), "notices")
    files = rows.select(*KEY, "id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), declares)
    files = scratch.save(files.join(own, KEY, "left").drop(*KEY), "files")
    declared = files.filter("declares and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("d"))
    declared = scratch.save(declared.select(F.col("dir").alias("above"), "d.license"), "declared")

    # every directory with those above it, then the deepest of them that declares a license
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    dirs = files.select("dir").dropna().distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = dirs.join(declared, "above").groupBy("dir").agg(F.max(F.struct("depth", "license", "above")).alias("n"))
    nearest = scratch.save(nearest.select("dir", F.col("n.license").alias("inherited"), F.col("n.above").alias("declared_in")), "nearest")
    out = files.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    source = F.when(mine & F.col("declares"), "licence file").when(mine, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "inherited").alias("license"), source.alias("source"), "score",
        F.when(~mine, F.col("declared_in")).alias("declared_in"),
    )


def tree_path(lang: str = "lang", source: str = "source", id_col: str = "doc_id") -> Column:
    """A place in a file tree for documents that come without one, from their source, language and id."""
    i = F.col(id_col)
    folder = F.when(i % 3 == 0, F.col(source)).when(i % 3 == 1, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", F.col(source), F.col(lang), F.concat(F.lit("b"), F.floor(i / 100).cast("string"))))
    name = F.when(i % 5 == 0, F.concat(F.lit("LICENSE-"), i.cast("string"))).otherwise(F.concat(F.lit("d"), i.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", folder, name)


def template_sql() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
