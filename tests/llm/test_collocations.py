import random
import re
from collections import Counter, defaultdict

import pytest

import oracle_harness
from tesoro.llm import collocations as C
from tesoro.llm.common import prepare


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows):
    """f by lang and phrase, n by lang."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, threshold, top):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        drop = {p[i:i + s] for p, a in cand.items() for s in range(2, len(p)) for i in range(len(p) - s + 1)
                if a >= cand[p[i:i + s]]}
        scored = []
        for p, a in cand.items():
            if p not in drop:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=300):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "漢", "x\x1c", "zz", "\x85", "q" * 40, "Ä"] + [f"w{i}" for i in range(15)]
    fixed = ["the quick brown fox jumps", "new york city", "zz zz zz zz zz zz"]
    rows = [(None, None), (None, ""), ("en", None), ("xx", "..."), ("en", "only"), ("und", "a b the"), (None, "a b the")]
    for _ in range(docs):
        parts = [rng.choice(fixed) if rng.random() < .2 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for p in parts)))
    return rows + rows[20:40]


def run(spark, rows, **options):
    prepare(spark)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, slice int").repartition(3)
    return sorted(tuple(r) for r in C.collocations(docs, **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,threshold,intervals", [(1, 5, 3), (2, 12, 1), (3, 40, 4)])
def test_matches_brute_force(spark, seed, threshold, intervals):
    rows = corpus(seed)
    want = brute(rows, threshold, 50)
    assert want and run(spark, rows, threshold=threshold, intervals=intervals, top=50) == want


def test_phrases_that_share_a_key_keep_their_counts(spark):
    """All phrases of a length in 64 keys: the counters show too much, the result doesn't."""
    rows = corpus(4, 60)
    f, _ = counted(rows)
    prepare(spark)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r["lang"], r["phrase"], r["f"]) for r in C.frequent_phrases(docs, 8, 2, 0xFC << 56).where("size > 0").collect()}
    assert got == {(lang, " ".join(p), c) for lang, x in f.items() for p, c in x.items() if c >= 8}


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = [("en", "", 0, 9 * 10 ** 15), ("en", "a", 1, 10 ** 15 + 7), ("en", "b", 1, 10 ** 15 + 9), ("en", "a b", 2, 10 ** 15 - 1)]
    found = spark.createDataFrame(big, "lang string, phrase string, size int, f long")
    monkeypatch.setattr(C, "frequent_phrases", lambda *_: found)
    row = C.collocations(found).first()
    assert row["score"] == 1000 * (10 ** 15 - 1) * 9 * 10 ** 15 // ((10 ** 15 + 7) * (10 ** 15 + 9))


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "few words")]])
def test_nothing_frequent(spark, rows):
    assert run(spark, rows) == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    problems, n, _ = oracle_harness.compare(C.op12_phrase_collocations(spark, sf), oracle_harness.duck(sf), C.OP12_SQL)
    assert not problems and n > 50
