"""License scans: statements, files, inheritance, against a plain computation."""

import itertools
import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import licenses

FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("a/b/one.py", "# Licensed under the Apache License, Version 2.0.\ncode = 1"),
    ("a/b/two.py", "code = 2"),
    ("a/b/c/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("a/b/c/d/e.py", ""),
    ("x/y.py", None),
    ("top.py", "no such thing"),
    ("z/first.txt", "Licensed under CC BY-NC 4.0.\nwords"),
    ("z/second.txt", "words\nmore words"),
    (None, "words, then\nReleased under the MIT License."),
    ("z/third.txt", "My driving license was lost in the year of the great flood, and nobody found it."),
]


def test_scan(spark):
    rows = [(k, p, t) for k, (p, t) in enumerate(FILES)] + [(3, *FILES[3])]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, path string, text string, license string, row long")
    got = licenses.scan_licenses(df, "doc_id", F.col("path")).collect()
    by_id = {r["doc_id"]: (r["license"], r["found_in"], r["declared_in"]) for r in got}
    assert len(got) == len(rows)
    assert by_id == {
        0: ("MIT", "file", None), 1: ("Apache-2.0", "statement", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("GPL-3.0", "file", None),
        4: ("GPL-3.0", "inherited", "a/b/c"), 5: (None, None, None), 6: (None, None, None), 7: ("CC-BY-NC-4.0", "statement", None),
        8: ("CC-BY-NC-4.0", "inherited", "z"), 9: ("MIT", "statement", None), 10: ("CC-BY-NC-4.0", "inherited", "z"),
    }
    assert licenses.scan_licenses(df.limit(0), "doc_id", F.col("path")).collect() == []


def terms(text):
    return [t for t in re.split(r"[^\w.]+|\.+(?!\w)|(?<!\w)\.+", text.lower()) if t]


def test_scores(spark, sf):
    """Cosines of the statements of a table, computed plainly."""
    lines = [x for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for x in r["text"].split("\n") if re.search(licenses.CUE.replace("(?i)", ""), x, re.I)]
    counted = Counter(lines) + Counter(["Licenced under CC BY-NC-SA, version 4.0", "a b license"])
    df = Counter()
    for text, n in [*counted.items(), *((t, 1) for _, t in licenses.TEMPLATES)]:
        df.update({t: n for t in set(terms(text))})
    total = sum(counted.values()) + len(licenses.TEMPLATES)

    def vector(text):
        w = {t: c * (math.log((1 + total) / (df[t] + 1)) + 1) for t, c in Counter(terms(text)).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    want = {}
    for text in counted:
        own = vector(text)
        scores = [(-round(sum(v * other.get(t, 0) for t, v in own.items()), 6), name) for name, words in licenses.TEMPLATES for other in [vector(words)]]
        if min(scores)[0] < 0:
            want[text] = (min(scores)[1], -min(scores)[0])
    templates = spark.createDataFrame([(k, *t) for k, t in enumerate(licenses.TEMPLATES)], "t int, license string, statement string")
    rows = spark.createDataFrame(list(counted.items()), "statement string, n long")
    got = {r["statement"]: (r["license"], r["similarity"]) for r in licenses.score_statements(rows, templates).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_long_comments(spark):
    """A comment block has no limit of lines, whatever they start with."""
    header = "# Licensed under the Apache License, Version 2.0."
    texts = ["* item\n" * 100_000, "# x\n// y\n-- z\n; w\n/* v\n" * 20_000 + header, header + "\n" + "* item\n" * 100_000, header + "\n//\ncode\n# not in the block", "", "code\n# x", "\t<!-- a\n  * b\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    blocks = {r["doc_id"]: r["block"] for r in df.select("doc_id", licenses._comment_block(F.split("text", "\n")).alias("block")).collect()}
    comment = re.compile(r"[ \t]*(?:#|//|/?\*|--|;|<!--)")
    want = lambda t: "\n".join(itertools.takewhile(comment.match, t.split("\n")))
    assert blocks == {k: want(t) for k, t in enumerate(texts)}
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df, "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/x"))).collect()}
    assert got == {0: None, 1: "Apache-2.0", 2: "Apache-2.0", 3: "Apache-2.0", 4: None, 5: None, 6: None}


def test_whole_texts_headers_and_identifiers(spark):
    """Complete license files with a copyright line of their own, headers of one and several lines, SPDX lines."""
    texts = {n: t.replace("<year>", "2019").replace("<copyright holders>", "Some Body").replace("<copyright holder>", "Some Body, Inc.") for n, t in licenses.TEXTS.items()}
    files = [(n, t) for n, t in texts.items()] + [("MIT", texts["MIT"].split("\n", 1)[1]), ("CC-BY-4.0", licenses.WHOLE[-2][1])]
    block = lambda words, mark, width=70: "".join(f"{mark} {x}\n" for x in textwrap.wrap(words, width)) + "code = 1"
    heads = [
        ("MIT", "MIT License"), ("MIT", "Distributed under the terms of the MIT license."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"), ("GPL-3.0", "Released under the GPLv3."),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-NC-SA-4.0", "Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
        ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "# spdx-license-identifier: apache-2.0"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */"), ("ISC", "# SPDX-License-Identifier: ISC"),
        ("Apache-2.0", "# SPDX-License-Identifier: (MIT OR Apache-2.0)"), (None, "Distributed under the terms of the ISC license."), (None, "ISC License"), (None, "# SPDX-License-Identifier: NONE"),
        ("Apache-2.0", block(licenses.NOTICES[0][1], "#")), ("GPL-2.0", block(licenses.NOTICES[1][1], " *")), ("LGPL-3.0", block(licenses.NOTICES[4][1], "//")), ("MPL-2.0", block(licenses.NOTICES[5][1], "--")),
        ("MIT", block(texts["MIT"], "//")),
    ]
    rows = [(k, f"f{k}/LICENSE", t, n) for k, (n, t) in enumerate(files)] + [(100 + k, f"h{k}/x.c", t, n) for k, (n, t) in enumerate(heads)]
    rows += [(1000 + k, f"f{k}/src/x.c", "code", n) for k, (n, _) in enumerate(files)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["found_in"]) for r in licenses.scan_licenses(df, "doc_id", F.col("path")).collect()}
    want = {k: (n, None if n is None else "file" if k < 100 else "statement" if k < 1000 else "inherited") for k, _, _, n in rows}
    assert {k: (v, got[k], rows[[r[0] for r in rows].index(k)][2][:60]) for k, v in want.items() if got[k] != v} == {}
