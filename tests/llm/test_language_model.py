import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesoro.llm import hash_arrays as A
from tesoro.llm import language_model as M
from tesoro.llm.common import prepare, shared_uri, write_file


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


class Slow:
    """The model by its formulas, with dictionaries."""

    def __init__(self, texts):
        self.count, self.pair = Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            self.count.update(ts)
            self.pair.update(zip(["\n\n", *ts], ts))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.left = Counter(w for _, w in self.pair)
        self.d, self.dc = self.discounts(self.pair), self.discounts(self.left)

    @staticmethod
    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not min(n):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0), k + 1) for k in range(3))

    def lower(self, w):
        if not self.left:
            return 1 / (self.v + 1)
        total, c = sum(self.left.values()), self.left[w]
        spare = sum(self.dc[min(x, 3) - 1] for x in self.left.values())
        return (max(c - self.dc[min(c, 3) - 1], 0) if c else 0) / total + spare / total / (self.v + 1)

    def probability(self, u, w):
        following = {x: c for (a, x), c in self.pair.items() if a == u}
        if not following:
            return self.lower(w)
        total, c = sum(following.values()), following.get(w, 0)
        spare = sum(self.d[min(x, 3) - 1] for x in following.values())
        return (max(c - self.d[min(c, 3) - 1], 0) if c else 0) / total + spare / total * self.lower(w)

    def score(self, text):
        ts = tokens(text)
        return (len(ts), sum(self.count[t] > 0 for t in ts),
                sum(math.log10((self.count[t] + 1) / (self.n + self.v + 1)) for t in ts),
                sum(math.log10(self.probability(u, w)) for u, w in zip(["\n\n", *ts], ts)))


def corpus():
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(30)] + ["É", "é", "x\x1cy"]
    train = [" ".join(rng.choice(words, size=rng.integers(1, 40), p=None)) for _ in range(60)]
    return train + ["", None, "The the THE", "a\tb\nc", "same text", "same text", "one " * 20000]


TESTS = ["w1 w2 w3", "never seen words", "", None, "W1\x0bw2", "w1 unseen w2", "same text", "one " * 500, "</s>"]


@pytest.mark.parametrize("small_parts", [False, True])
def test_matches_the_formulas(spark, monkeypatch, small_parts):
    prepare(spark)
    if small_parts:  # many files, and tasks that pass their counts on early
        monkeypatch.setattr(M, "VOCABULARY_PART_BYTES", 4000)
        monkeypatch.setattr(M, "PAIR_PART_TOKENS", 2000)
    texts = corpus()
    train = spark.createDataFrame([(t, 1) for t in texts], "text string, score int").repartition(4)
    model = M.train(train, shared_uri(spark, "lm"))
    slow = Slow(texts)
    assert (model.tokens, model.size, model.continuations) == (slow.n, slow.v, len(slow.pair))
    assert (model.pair_parts > 1) == small_parts
    docs = spark.createDataFrame(list(enumerate(TESTS)) + [(None, "w1"), (0, "w1 w2 w3")], "doc_id long, text string")
    for r in M.score(docs, model, keep=("doc_id", "text")).collect():
        want = slow.score(r["text"])
        assert (r["n_tokens"], r["n_known"]) == want[:2]
        assert r["base_score"] == pytest.approx(want[2]) and r["score"] == pytest.approx(want[3])
        assert r["perplexity"] == pytest.approx(10 ** (-want[3] / want[0]))
    for context in ("w1", "\n\n", "never seen"):
        assert sum(slow.probability(context, w) for w in slow.count) + slow.probability(context, "?") == pytest.approx(1)


def test_no_training_text(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "text string")
    model = M.train(empty, shared_uri(spark, "lm"))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in M.score(docs, model).collect()) == [
        (1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert M.score(docs.limit(0), model).count() == 0


def test_counts_pass_on_early_and_merge_again(monkeypatch):
    monkeypatch.setattr(A, "HELD_KEYS", 50)
    rng = np.random.default_rng(0)
    held, keys, found = A.Held(A.top_part(3)), [], Counter()
    batches = []
    for _ in range(20):
        part = rng.integers(0, 200, 40).astype(np.uint64) << np.uint64(56)
        keys.append(part)
        batches += held.add(part)
    batches += held.flush()
    for b in batches:
        table = b.to_pydict()
        got = A.unblock(b)
        assert set(A.top_part(3)(got[0]).tolist()) <= set(table["part"])
        found.update(dict(zip(got[0].tolist(), got[1].tolist())))
    assert found == Counter(np.concatenate(keys).tolist())


def test_query_on_the_whole_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    slow = Slow([])
    slow.count = Counter(t for i, text in docs if not held[i] for t in tokens(text))
    slow.n, slow.v = sum(slow.count.values()), len(slow.count)
    found = {r["doc_id"]: r for r in M.op7_language_model(spark, sf).collect()}
    assert len(found) == len(docs)
    for i, text in docs:
        ts, r = tokens(text), found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(ts), sum(slow.count[t] > 0 for t in ts), slow.n)
        assert r["base_score"] == pytest.approx(sum(math.log10((slow.count[t] + 1) / (slow.n + slow.v + 1)) for t in ts))
    unseen = [r for i, r in found.items() if held[i]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)  # better than the base on unseen text


def test_counts_of_64_bits_are_kept():
    many = np.array([3, 1 << 32, 5 << 40], dtype=np.int64)
    assert [len(A.packed(x)) for x in (many, many[:1], many[:0])] == [24, 4, 0]
    for counts in (many, many[:1], many[:0], many[1:2], np.array([2, (1 << 32) - 1])):
        assert A.unpacked(A.packed(counts), len(counts)).tolist() == counts.tolist()
    held = A.Held(A.top_part(0))
    keys = np.array([1, 2, 3, 4], dtype=np.uint64)
    blocks = [*held.put(keys[:3], many), *held.put(keys, np.array([1, 1, 1, 1])), *held.flush()]
    blocks += [*held.put(keys, np.array([1, 2, 1, 1])), *held.flush()]
    found = A.unblock(pa.Table.from_batches(blocks))
    assert [x.tolist() for x in found] == [[1, 2, 3, 4], [5, (1 << 32) + 3, (5 << 40) + 2, 2]]


def test_pair_counts_of_both_widths_and_of_more_files_than_a_process_may_map(tmp_path):
    parts = 70_000
    model = M.BigramModel(str(tmp_path), 0, np.array([0, 9]), 10, pair_parts=parts)
    keys = np.arange(1, 2001, dtype=np.uint64)
    part = M._pair_part(parts)(keys)
    want = np.where(keys % 2 == 0, keys << np.uint64(33), keys).astype(np.int64)
    for p in np.unique(part):
        at = part == p
        write_file(str(tmp_path / f"pair-{p}"), keys[at].astype("<u8").tobytes())
        write_file(str(tmp_path / f"pairs-{p}"), A.packed(want[at]))
    assert model.pair_counts(keys).tolist() == want.tolist()
    one = tmp_path / "one"
    one.write_bytes(np.arange(4, dtype="<u8").tobytes())
    for i in range(parts):
        (tmp_path / f"link-{i}").symlink_to(one)
        assert model._map(f"link-{i}", "<u8")[3] == 3
    assert model.pair_counts(keys).tolist() == want.tolist()
