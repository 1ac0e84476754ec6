"""Exact and line deduplication against SQL and brute force."""

import hashlib
import re

import pytest

from tessera.llm import exact_dedup, line_dedup

TEXTS = [None, "", " \n", "a b", "ab", "a\tb", "AB", "ä b", "äb ", "long text here", "long  text here", "x y", "xy", "ab"]
SCHEMA = "doc_id long, text string, fingerprint string, row long"


def brute_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0))
    out = []
    for i, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[body])
        out.append((i, None if best[1] else best[2], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


# Fingerprints of 5 bits collide: bytes have to decide.
@pytest.mark.parametrize("bits", [(20, 32), (4, 1)])
def test_exact(spark, bits):
    rows = [*enumerate(TEXTS), (3, "a b"), (None, "long text  here"), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    got = exact_dedup.exact_duplicates(docs, quotient_bits=bits[0], remainder_bits=bits[1]).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute_exact(rows)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def brute_lines(rows, least=20):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), {})[n if i is None else f"id {i}"] = i
    gone = {k: max((i for i in v.values() if i is not None), default=None) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and gone[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [26, 16])
def test_lines(spark, bits):
    a, b, c = "a line that is long enough", "Ä-line of twenty code", "x" * 19
    rows = [
        (1, f"{a}\n{b}\n{c}"), (2, f" {a.upper()}\t\nother\n{a}"), (3, f"{a}\r\n{c}\n"), (4, b), (5, f"{b}\n\n{b}"), (6, c), (None, a), (7, None), (8, ""), (3, f"{a}\r\n{c}\n"),
        (None, "held by nulls only, thrice"), (None, "held by nulls only, thrice"), (None, "held by nulls only, thrice"),
        (11, "said by two ids in three rows"), (11, "said by two ids in three rows"), (12, "said by two ids in three rows"), (13, "long\n" * 40000 + f"{a}\nend"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, suspects string, row long")
    got = line_dedup.drop_repeated_lines(docs, bits=bits).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got], key=str) == brute_lines(rows)
    assert all((r["kept_text"] is None) == (r["n_dropped"] == 0) for r in got)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []


def test_full_filters_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small, large = (line_dedup.drop_repeated_lines(docs, bits=b).drop("kept_text") for b in (16, 26))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_repeated_ids_against_the_sql(spark):
    """Rows (1, L), (1, L), (2, L): two documents hold L, too few to lose it."""
    import duckdb

    from tessera.llm import queries

    line = "a line that is long enough"
    rows = [(1, line), (1, line), (2, line), (3, line + "!"), (4, line + "!"), (4, line + "!"), (5, f"x\n{line}!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    by_id = dict(con.execute(f"select doc_id, n_dropped from ({queries.ORACLES['op10_line_dedup']})").fetchall())
    assert found[1] == by_id[1] == 0 and found[2] == 0
    assert (found[3], found[4], found[5]) == (1, 1, 0)
