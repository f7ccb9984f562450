import hashlib
import random
from collections import Counter

import pytest

from tesoro.llm import suffix_dedup as S
from tesoro.llm.common import prepare


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha of the rest) of each text."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                hit[i:i + length] = [True] * length
        kept = bytes(b for b, h in zip(t, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet, length):
    """Texts that share passages of all lengths around a window's, at several offsets."""
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    passages = [word(length + d) for d in (-2, -1, 0, 1, 2, 7, length // 2, length, 3 * length)]
    texts = [b"", b"a", word(length - 1), b"z" * (3 * length), b"zy" * length]
    for _ in range(25):
        parts = [p for _ in range(rng.randint(0, 4)) for p in (word(rng.randint(0, length)), rng.choice(passages))]
        if parts and rng.random() < 0.5:  # an edited passage
            i, x = rng.randrange(len(parts)), rng.randrange(1000)
            if parts[i]:
                parts[i] = parts[i][:x % len(parts[i])] + b"#" + parts[i][x % len(parts[i]):]
        texts.append(b"".join(parts) + word(rng.randint(0, 2 * length)))
    return texts + [texts[7], texts[7], texts[9], texts[9][3:], passages[-1] * 3]


def run(spark, texts, length, ids=None):
    prepare(spark)
    ids = ids or list(range(len(texts)))
    rows = [(i, t.decode("latin-1") if t is not None else None, "x") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(5)
    return S.repeated_spans(docs, length=length, keep_text=True, base=20).collect()


@pytest.mark.parametrize("seed,alphabet,length", [(1, b"abcdefgh", 40), (2, b"ab", 60), (3, b"abcd", 200)])
def test_matches_brute_force(spark, seed, alphabet, length):
    texts = corpus(seed, alphabet, length)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, texts, length)}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_nulls_and_repeated_rows(spark):
    text = b"".join(b"%d," % i for i in range(300))
    out = run(spark, [None, b"", text, text, text[:250] + b"!", text[400:]], 200, [None, 1, 2, 2, None, 5])
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out)
    assert got == sorted([(0, 0, 0), (0, 0, 0), (len(text), len(text), 1), (len(text), len(text), 1), (251, 250, 1),
                          (len(text) - 400, len(text) - 400, 1)])
    assert all(r["kept"] == b"!" for r in out if r["n_bytes"] == 251)


def test_empty_table(spark):
    assert run(spark, [], 200) == []


def test_chunks_of_a_long_text_agree_with_the_whole(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc") for _ in range(5000)) * 2
    whole = S.anchors(text)
    monkeypatch.setattr(S, "CHUNK", 700)
    parts = S.anchors(text)
    assert all((a == b).all() for a, b in ((whole.at, parts.at), (whole.first, parts.first), (whole.last, parts.last),
                                           (whole.hash, parts.hash)))
