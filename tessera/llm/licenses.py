"""License scans: TF-IDF cosine to templates, then inheritance along directories.

DataFrame functions only. What is compared are the places where a license can be
stated: lines with a cue word anywhere in the text, the leading comment block, and
the whole text of a license file. Equal statements are scored once. Lines are compared
with the sentences of headers, several lines also with whole license texts.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize

# The usual statements of well-known licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# What licenses are called in headers.
NAMES = (
    ("MIT", "MIT License"), ("MIT", "MIT"), ("Unlicense", "The Unlicense"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache 2.0"),
    *((f"GPL-{v}.0", f"{name} {n}") for v in (1, 2, 3) for name, n in (("GNU General Public License, version", v), ("GNU General Public License", f"v{v}"), ("GNU General Public License, version", f"{v}.0"), ("GPL", f"v{v}"))),
    ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"),
    *((f"LGPL-{v}", f"GNU Lesser General Public License, {n}") for v, n in (("2.1", "version 2.1"), ("2.1", "v2.1"), ("3.0", "version 3"), ("3.0", "v3"), ("3.0", "version 3.0"))),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-1.1", "Mozilla Public License, version 1.1"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    *((f"CC-{short}-4.0", f"{name} 4.0{rest}") for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))
      for name, rest in ((f"CC {short}", ""), (f"CC {short}", " International License"), (f"Creative Commons {long}", " International License"))),
)
SENTENCES = ("{}", "Released under the {}.", "Licensed under the {}.", "Distributed under the terms of the {}.", "This work is licensed under a {}.")
#: Terms that tell licenses apart: a template's name counts only where the statement has these terms of it.
NAMING = frozenset("mit apache general lesser gpl gplv2 gplv3 mozilla bsd cc cc0 creative attribution sharealike noncommercial by nc sa unlicense 1 2 3 v1 v2 v3 v2.1 1.0 1.1 2.0 2.1 3.0 4.0".split())
# Headers of several lines.
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *((f"{short}-{v}", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/.")
      for short, name, v, n in (("GPL", "General Public License", "2.0", "2"), ("GPL", "General Public License", "3.0", "3"), ("LGPL", "Lesser General Public License", "2.1", "2.1"), ("LGPL", "Lesser General Public License", "3.0", "3"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
# Whole texts that differ by few words: (license, text, terms it must have, terms it must not have).
WHOLE = (
    *((name, text, *{
        "CC-BY-NC-4.0": (("noncommercial",), ("sharealike", "noderivatives")), "CC-BY-SA-4.0": (("sharealike",), ("noncommercial",)), "GPL-3.0": ((), ("remotely",)),
        "BSD-3-Clause": (("neither", "endorse"), ()), "BSD-2-Clause": ((), ("endorse", "advertising")),
    }.get(name, ((), ()))) for name, text in TEXTS.items()),
    ("CC-BY-4.0", re.sub("-?NonCommercial", "", TEXTS["CC-BY-NC-4.0"]), ("attribution", "4.0"), ("noncommercial", "sharealike", "noderivatives")),
    ("CC-BY-NC-SA-4.0", TEXTS["CC-BY-SA-4.0"], ("noncommercial", "sharealike"), ()),
)
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)"
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|\bCC[ -]?(BY|0)|redistribution|\bL?GPL"
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"
COMMENT_LINE = r"^[ \t]*(?:#|//|/?\*|--|;|<!--)"
MIN_SIMILARITY = 0.7


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.+"), lambda t: t != "")


def _comment_block(lines: Column) -> Column:
    """The leading comment lines as one text. Java's matcher recurses on a repeated group, so no pattern spans lines."""
    other = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT_LINE)), F.lit(False)).cast("int")
    return F.array_join(F.slice(lines, F.lit(1), F.when(other == 0, F.size(lines)).otherwise(other - 1)), "\n")


def _weights(statements: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of unit length: tf * idf."""
    counts = statements.select(key, F.explode(_terms(F.col("statement"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighted = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def score_statements(statements: DataFrame, templates: DataFrame) -> DataFrame:
    """Best template of each distinct statement: statement, license, similarity.

    ``statements`` has statement and n, how often it occurs; n counts in the document
    frequencies. Ties go to the first license by name. Templates may name terms that a
    statement must have (needs) and must not have (bars).
    """
    numbered = materialize(statements.select("statement", "n", F.monotonically_increasing_id().alias("s")), "statements")
    every = numbered.select(F.col("statement"), "n").unionByName(templates.select("statement", F.lit(1).cast("long").alias("n")))
    total = every.agg(F.sum("n").alias("n")).first()["n"]
    seen = every.select("n", F.explode(F.array_distinct(_terms(F.col("statement")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    # Only terms of templates carry to a product, but all count in a statement's length.
    idf = seen.select("term", (F.log(F.lit(1.0 + total) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    own = _weights(numbered.select("s", "statement"), idf, "s")
    need, bar = F.lit(0).alias("need"), F.lit(0).alias("bar")
    known = _weights(templates, idf, "t").select("t", "term", F.col("w").alias("tw"), need, bar)
    asked = F.lit(0)
    if "needs" in templates.columns:
        marks = lambda c, *flags: templates.select("t", F.explode(c).alias("term"), F.lit(0.0).alias("tw"), *flags)
        known = known.unionByName(marks("needs", F.lit(1).alias("need"), bar)).unionByName(marks("bars", need, F.lit(1).alias("bar")))
        asked = F.size("needs")
    known = known.join(templates.select("t", "license", asked.alias("asked")), "t")
    products = own.join(known, "term").groupBy("s", "t", "license", "asked").agg(F.sum(F.col("w") * F.col("tw")).alias("cosine"), F.sum("need").alias("met"), F.sum("bar").alias("barred"))
    products = products.where("met = asked AND barred = 0")
    best = products.groupBy("s").agg(F.min(F.struct((-F.round("cosine", 6)).alias("far"), "license")).alias("best"))
    return numbered.join(best, "s").select("statement", F.col("best.license").alias("license"), (-F.col("best.far")).alias("similarity"))


def _named(words: str) -> list[str]:
    """The terms by which a short statement names a license."""
    terms = [t.strip(".") for t in re.split(r"[^\w.]+", words.lower())]
    return sorted(NAMING.intersection(terms)) if len(terms) < 16 else []


def _templates(spark: SparkSession) -> DataFrame:
    """t, license, statement, needs, bars, whole."""
    said = dict.fromkeys([*TEMPLATES, *((license, sentence.format(name)) for license, name in NAMES for sentence in SENTENCES)])
    rows = [(*x, _named(x[1]), [], False) for x in said if x[1] != "MIT"] + [(*x, [], [], True) for x in NOTICES] + [(*x[:2], list(x[2]), list(x[3]), True) for x in WHOLE]
    words = lambda terms: F.array(*map(F.lit, terms)).cast("array<string>")
    made = [F.struct(F.lit(k).alias("t"), F.lit(r[0]).alias("license"), F.lit(r[1]).alias("statement"), words(r[2]).alias("needs"), words(r[3]).alias("bars"), F.lit(r[4]).alias("whole")) for k, r in enumerate(rows)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*made)))


def _identifiers(statements: DataFrame) -> DataFrame:
    """statement, license, similarity (1) of the identifiers that SPDX lines name.

    GPL identifiers lose -only and -or-later; of an expression all identifiers count but
    for exceptions. Known licenses get their usual spelling.
    """
    tokens = F.filter(F.split(F.regexp_extract("statement", SPDX, 1), r"[()\s]+"), lambda x: x != "")
    joined = F.filter(tokens, lambda x, i: (i == 0) | F.upper(F.get(tokens, i - 1)).isin("AND", "OR"))
    said = statements.where(F.col("statement").rlike(SPDX)).select("statement", F.explode(joined).alias("said"))
    said = said.where(r"said RLIKE '^[A-Za-z0-9][A-Za-z0-9.+-]*$' AND upper(said) NOT IN ('NONE', 'NOASSERTION')").withColumn("said", F.regexp_replace("said", r"(?i)(-only|-or-later|\+)$", ""))
    usual = sorted({name for name, *_ in (*TEMPLATES, *NAMES, *WHOLE)})
    known = F.create_map(*[F.lit(x) for name in usual for x in (name.upper(), name)])
    return said.select("statement", F.coalesce(F.try_element_at(known, F.upper("said")), "said").alias("license"), F.lit(1.0).alias("similarity"))


def scan_licenses(files: DataFrame, id_column: str, path: Column, text_column: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """License of every file: doc_id, path, license, similarity, found_in, declared_in.

    ``found_in`` is 'statement' for a license stated in the file itself, 'file' for a
    license file, 'inherited' where the nearest directory upwards with a declaration
    gave it (``declared_in``), else NULL. A directory is declared by its license
    files, and where it has none by files whose first line is a statement. Of several
    statements or declarations the most similar counts, then the first license by
    name. NULL texts and paths count as empty; repeated rows repeat; no rows give no
    rows; other columns are ignored.
    """
    spark = files.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    where = F.coalesce(path.cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    is_file = F.substring_index(where, "/", -1).rlike(FILE_NAME)
    block = _comment_block(lines)
    stated = F.array_distinct(F.when(is_file, F.array(text)).otherwise(F.concat(F.filter(lines, lambda x: x.rlike(CUE)), F.filter(F.array(block), lambda x: x != ""))))
    found = materialize(
        files.select(F.col(id_column).alias("doc_id"), where.alias("path"), F.monotonically_increasing_id().alias("row"), is_file.alias("is_file"), F.element_at(lines, 1).alias("opening"), stated.alias("stated"))
        .withColumn("opening", F.when(F.col("opening").rlike(CUE), F.col("opening"))),
        "license-statements",
    )
    templates = materialize(_templates(spark), "license-templates")
    statements = found.select("row", "path", "is_file", "opening", F.explode("stated").alias("statement"))
    counted = materialize(statements.groupBy("statement").agg(F.count("*").alias("n")), "distinct-statements")
    # Lines are scored against what headers say, texts of several lines also against whole licenses.
    several = F.instr("statement", "\n") > 0
    scores = score_statements(counted.where(~several), templates.where("NOT whole")).unionByName(score_statements(counted.where(several), templates))
    scores = scores.where(F.col("similarity") >= min_similarity).unionByName(_identifiers(counted))
    scores = materialize(scores, "license-scores")
    hits = statements.join(scores, "statement")
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "license")).alias("best")
    own = hits.groupBy("row").agg(best).select("row", F.col("best.license").alias("own"), (-F.col("best.far")).alias("own_similarity"))

    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    declared = (
        hits.where(F.col("is_file") | (F.col("statement") == F.col("opening")))
        .groupBy(directory.alias("declared_in")).agg(F.min(F.struct((~F.col("is_file")).alias("loose"), (-F.col("similarity")).alias("far"), "license")).alias("d"))
        .select("declared_in", F.col("d.license").alias("given"), (-F.col("d.far")).alias("given_similarity"))
    )
    places = found.select(directory.alias("directory")).distinct()
    steps = F.split("directory", "/")
    upwards = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    nearest = (
        places.select("directory", F.posexplode(upwards).alias("depth", "declared_in")).join(declared, "declared_in")
        .groupBy("directory").agg(F.max(F.struct("depth", "declared_in", "given", "given_similarity")).alias("up"))
        .select("directory", "up.declared_in", "up.given", "up.given_similarity")
    )
    nearest = materialize(nearest, "nearest-declarations")
    has_own = F.col("own").isNotNull()
    return (
        found.select("doc_id", "path", "row", "is_file", directory.alias("directory"))
        .join(own, "row", "left").join(nearest, "directory", "left")
        .select(
            "doc_id", "path",
            F.coalesce("own", "given").alias("license"),
            F.when(has_own, F.col("own_similarity")).otherwise(F.col("given_similarity")).alias("similarity"),
            F.when(has_own, F.when(F.col("is_file"), "file").otherwise("statement")).when(F.col("given").isNotNull(), "inherited").alias("found_in"),
            F.when(~has_own, F.col("declared_in")).alias("declared_in"),
        )
    )
