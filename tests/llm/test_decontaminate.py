import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesoro.llm import decontaminate as D
from tesoro.llm.common import prepare

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def brute(docs, items, width=10):
    """Contract, word for word: {row number: (n_words, n_hit, items)}."""
    windows = {}
    for item, text in items:
        found = WORD.findall(lowered(text))
        size = min(width, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            windows.setdefault(tuple(found[i:i + size]), set()).update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = []
    for _, text in docs:
        found, hit, names = WORD.findall(lowered(text)), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                if (names_here := windows.get(tuple(found[i:i + size]))) is not None:
                    hit.update(range(i, i + size))
                    names |= names_here
        out.append((len(found), len(hit), sorted(names)))
    return out


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"before {PASSAGE} after"), (2, None), (3, ""), (4, "  \n "), (5, PASSAGE.upper().replace(" ", "--")),
    (6, "tiny item here"), (6, "tiny item here"), (7, f"{PASSAGE} x {PASSAGE} one two three"),
    (8, "one two three four five six seven eight nine"), (9, "ten Ötzi straße 42 tiny item"), (None, PASSAGE),
    (10, "filler words " * 4000 + PASSAGE + " tail" * 3000), (11, "a a a a a a a a a a a a a a a"),
]
ITEMS = [(0, PASSAGE), (1, "tiny item"), (10, "six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "!!"),
         (0, PASSAGE), (None, "before"), (5, "a a a a a a a a a a a a"), (6, "never met")]


def frames(spark, docs=DOCS, items=ITEMS):
    prepare(spark)
    d = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(docs)],
                              "doc_id long, text string, hit string, n int")
    return d, spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, n_words long")


def check(found, docs, items):
    got = {r["n"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in
           found.withColumn("n_hit", D.n_hit()).collect()}
    assert [got[n] for n in range(len(docs))] == brute(docs, items)


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_edge_cases_match_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)  # the second runs the passes by blocks
    docs, items = frames(spark)
    check(D.find_contamination(docs, items, keep=("doc_id", "n")), DOCS, ITEMS)


def test_a_block_is_searched_before_the_next_is_read(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    docs, items = frames(spark)
    steps, read, find = [], D._blocks, D._find

    def blocks(benchmark):
        n, found = read(benchmark)
        return n, (steps.append("read") or block for block in found)
    monkeypatch.setattr(D, "_blocks", blocks)
    monkeypatch.setattr(D, "_find", lambda docs, block, width: steps.append("find") or find(docs, block, width))
    check(D.find_contamination(docs.union(docs), items, keep=("doc_id", "n")), DOCS, ITEMS)
    n = read(items)[0]
    assert n > 1 and steps == ["read", "find"] * n + ["find"]
    assert D.find_contamination(docs.union(docs), items, keep=("doc_id", "n")).count() == 2 * len(DOCS)


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, [])
    assert D.find_contamination(docs, items).where("size(items) > 0").count() == 0
    docs, items = frames(spark, [], ITEMS)
    assert D.find_contamination(docs, items).count() == 0


def test_query_matches_brute_force_on_the_whole_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    want = {d[0]: (w, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0)
            for d, (w, h, names) in zip(docs, brute(docs, items))}
    got = {r[0]: tuple(r)[1:] for r in D.op5_decontamination(spark, sf).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == want and any(v[4] for v in want.values())


def test_spans_are_cut_and_the_rest_is_untouched(spark):
    docs, items = frames(spark)
    out = {r["n"]: r for r in D.decontaminate(docs, items).collect()}
    assert out[0]["text"] == " after" and out[0]["hit"] == "x"
    assert out[1]["text"] is None and out[8]["text"] == DOCS[8][1]
    assert out[7]["text"] == " x  one two three"
    left = spark.createDataFrame([(r["n"], r["text"]) for r in out.values()], "doc_id long, text string")
    assert D.find_contamination(left.where("doc_id <> 9"), items).where(F.size("hit") > 0).count() == 0


def test_columns_of_any_type_pass_through_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    docs, items = frames(spark)
    typed = docs.withColumn("extra", F.create_map(F.lit("k"), F.col("n"))).withColumn("_digest", F.lit("own"))
    out = {r["n"]: r for r in D.decontaminate(typed, items).collect()}
    assert len(out) == len(DOCS) and all(r["extra"] == {"k": n} and r["_digest"] == "own" for n, r in out.items())
    assert out[0]["text"] == " after" and out[8]["text"] == DOCS[8][1]


def test_phrases_of_random_items_are_the_distinct_windows():
    rng = random.Random(4)
    for width in (1, 2, 5, 8, 10):
        items = [(rng.choice([None, "a", "b", "c"]), " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))).encode())
                 for _ in range(40)]
        want = {}
        for name, text in items:
            found = text.split()
            size = min(width, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                want.setdefault(tuple(found[i:i + size]), set()).update([] if name is None else [name])
        made = D.Phrases(items, width)
        word = {number: w for w, number in made.vocabulary.items()}
        rows = [tuple(word[x] for x in row if x) for row in made.table(0, len(made.lengths)).tolist()]
        assert [len(r) for r in rows] == made.lengths.tolist() and len(set(rows)) == len(rows)
        assert {r: set(made.items(np.array([i]))) for i, r in enumerate(rows)} == want
    assert len(D.Phrases([], 10).table(0, 5)) == 0
