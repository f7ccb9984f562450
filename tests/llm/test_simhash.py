import random
import re

import pytest
import xxhash

from tesoro.llm import simhash as S
from tesoro.llm.common import prepare
from tesoro.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    """The contract, bit by bit, as 16 hex digits."""
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return f"{bits:016x}"


def slow_components(rows):
    """{row number: smallest id reachable} by comparing all pairs."""
    prints = [int(slow_fingerprint(t), 16) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = {}
    for (i, _), g in zip(rows, group):
        ids[g] = min((x for x in (ids.get(g), i) if x is not None), default=None)
    return [ids[g] for g in group]


TEXTS = ["", None, "   \n", "One", "one", "ONE\ttwo", "one two", "one two three", "é É ß", "a " * 20000,
         "b c d e f g h i", "b c d e f g h i", "B C D\x0bE F G H I", "x\x1cy z w", "nbsp joined words here"]


def test_fingerprints_follow_the_contract():
    for text in TEXTS:
        got = S.fingerprint(None if text is None else text.encode())
        assert f"{got & (1 << 64) - 1:016x}" == slow_fingerprint(text)


def test_components_match_all_pairs(spark):
    prepare(spark)
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(500) for _ in range(4000)]
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "one two three"), (None, "alone without id"), (7, "x y"), (7, "x y")]
    for i in range(60):  # a chain of edits: links, and links of links
        base[rng.randrange(4000)] = "e%d" % i
        rows.append((1000 + i, " ".join(base)))
    docs = spark.createDataFrame([(i, t, n, 0) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, fp int, component_id int").repartition(4)
    found = S.near_duplicates(docs)
    want = sorted(((i, int(slow_fingerprint(t), 16), c) for (i, t), c in zip(rows, slow_components(rows))), key=repr)
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found.collect()), key=repr)
    assert got == want
    assert len({c for *_, c in want}) < len({p for _, p, _ in want})  # near ones were linked
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["component_id"]) for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        (c, 0) for c in {c for *_, c in want} if c is not None)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    prepare(spark)
    rows = [(None, "alone without id", 2), (None, "Alone without ID", 1), (None, "alone without id", 1), (None, "b c d e", 0),
            (5, "B c d e", 0), (9, "b c d e", 0), (7, "one two three four", 0), (7, "ONE two three four", 0),
            (7, "another text of the same id", 3), (7, "another text of the same id", 1), (5, "one two three four", 0),
            (None, "", 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for parts in (1, 5):
        kept = [tuple(r) for r in S.drop_near_duplicates(docs.repartition(parts)).collect()]
        groups = sorted((slow_fingerprint(t), i) for i, t, _ in kept if i is not None)
        assert groups == sorted([(slow_fingerprint("b c d e"), 5), (slow_fingerprint("one two three four"), 5),
                                 (slow_fingerprint("another text of the same id"), 7)])
        assert sorted(slow_fingerprint(t) for i, t, _ in kept if i is None) == sorted(
            [slow_fingerprint(""), slow_fingerprint("alone without id")])
        assert (7, "another text of the same id", 1) in kept and all(n < 2 for *_, n in kept)


def test_other_column_names(spark):
    prepare(spark)
    rows = [(2, "b c d e", 0), (1, "B c d e", 1), (3, "one two three four", 2)]
    docs = spark.createDataFrame(rows, "`my id` long, body string, n int")
    kept = S.drop_near_duplicates(docs, id_col="my id", text_col="body")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[1:]


def test_query_matches_the_contract_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    prepare(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, slow_fingerprint(t), c) for (i, t), c in zip(rows, slow_components(rows)))
    assert sorted(tuple(r)[:3] for r in S.op2_simhash_near_dedup(spark, sf).collect()) == want


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_links_connect_what_all_pairs_connect(spark, distance):
    prepare(spark)
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(5)}
    for p in list(prints):
        for _ in range(12):
            p ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 3 << rng.randrange(62)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()
    assert all((r["u"] ^ r["v"] & (1 << 64) - 1).bit_count() <= 64 and r["u"] < r["v"] for r in links)
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        parent[root(r["u"])] = root(r["v"])
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                assert root(a) == root(b)
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components_of_paths_stars_and_cycles(spark):
    prepare(spark)
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    cycle = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges = [(min(e), max(e)) for e in path + star + cycle]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 209)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
