import hashlib
import random
import re

import numpy as np
import pytest

import oracle_harness
from tesoro.llm import substring_dedup as S
from tesoro.llm.common import prepare


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i:i + width])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            first = least.get(tuple(w[i:i + width]))
            if first is not None and (doc is None or first < doc):
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), kept))
    return sorted(map(repr, out))


def corpus(seed, width, vocabulary, docs=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "漢字", "A", "\x1c", "\x85", "\x00"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(width + d) for d in (-2, -1, 0, 1, 2, width, 5 * width)]
    rows = [(900, None), (901, ""), (902, "one"), (None, None), (903, " \n\t "), (904, "z " * (3 * width)), (905, "z " * width)]
    for i in range(docs):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (*some(rng.randint(0, 2 * width)), *rng.choice(passages))]
        if parts and rng.random() < .4:
            parts[rng.randrange(len(parts))] = "edited"
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows + rows[10:30] + [(5000 + i, t) for i, (_, t) in enumerate(rows[20:60])]


def run(spark, rows, width):
    prepare(spark)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(5)
    got = S.drop_repeated_words(docs, width, keep_text=True).collect()
    for r in got:
        assert r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
        assert r["n_removed"] == sum(x["last"] - x["first"] for x in r["removed"])
    return sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got)


@pytest.mark.parametrize("seed,width,vocabulary", [(1, 13, 1000), (2, 13, 2), (3, 4, 20), (4, 1, 40)])
def test_matches_brute_force(spark, seed, width, vocabulary):
    rows = corpus(seed, width, vocabulary)
    assert run(spark, rows, width) == brute(rows, width)


def test_sections_and_chunks_agree_with_the_whole(monkeypatch):
    rng = random.Random(7)
    texts = [b" ".join(b"%d" % rng.randint(0, 30) for _ in range(n)) for n in (500, 3, 40, 900)]
    row = S.encoded([1, 2, 3, 4], texts)
    whole = S.Chunk(row, 13).segments()
    monkeypatch.setattr(S, "SECTION", 97)
    cut = S.Chunk(row, 13).segments()
    spread = lambda s: {(f + i, d, k) for f, n, d, k in zip(s.first.tolist(), s.windows.tolist(), s.doc.tolist(), s.key.tolist()) for i in range(n)}
    assert spread(whole) == spread(cut)
    assert len(spread(whole)) == sum(max(0, len(t.split()) - 12) for t in texts)


def test_shards_tell_the_smallest_id():
    word = lambda *n: np.array(n, dtype="<u4").tobytes()
    found = S.match_shard([word(2, 3, 4, 5), word(3, 4, 5, 6), word(9, 3, 4, 5)], [7, 5, 3], 3)
    assert [x.tolist() for x in found] == [[7, 3], [3, 5], [3, 3]]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a " * 20)]])
def test_tables_without_repeats(spark, rows):
    assert run(spark, rows, 13) == brute(rows, 13)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    problems, n, _ = oracle_harness.compare(S.op11_substring_dedup(spark, sf), oracle_harness.duck(sf), S.OP11_SQL)
    assert not problems and n == 1000
