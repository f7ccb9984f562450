import hashlib
import random
import re

import pytest

import oracle_harness
from tesoro.llm import fill_in_middle as M
from tesoro.llm.common import prepare

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n, h = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, count):
    rng = random.Random(seed)
    pieces = [" ", "\n", "\t", "\x0b\x0c\r", "a", "word", "é", "漢字", "😀", "<", "<S", "P>", ">", "\x1c", "\x85", " ", "x" * 70]
    out = [None, "", " ", "   \n", "a", " a", "a ", "<P> kept plain", "a <S>", "no <M>arker", "é" * 300]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 200))) for _ in range(count)]


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, M.FRAME_BYTES])
def test_matches_brute_force(spark, frame_bytes):
    prepare(spark)
    rows = [(i, t, "x") for i, t in enumerate(texts(frame_bytes, 250))] + [(None, "null id words", "x"), (None, None, "x")]
    rows += rows[40:60]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(4)
    got = M.fill_in_middle(docs, keep_output=True, frame_bytes=frame_bytes).collect()
    want = []
    for i, t, _ in rows:
        n, form, p, m, output = brute(i, t)
        want.append((i, n, form, p, m, sha(output), sha(t or ""), output))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_cut_reads_one_frame():
    text = b" ".join(b"w%d" % i for i in range(5000))
    import io

    import zstandard
    frames = [zstandard.compress(d) for d, _, _ in M.split(text, 100)]
    units = [u for _, u, _ in M.split(text, 100)]
    row = {"at": 0, "n_bytes": len(text), "sizes": [len(f) for f in frames], "frame_bytes": 100,
           "units": [sum(units[:i + 1]) for i in range(len(units))], "chars": [100 * (i + 1) for i in range(len(units))]}
    stored = M.Frames(io.BytesIO(b"".join(frames)), row)
    for unit in (0, 1, 77, 4999, 5000):
        before = stored.frame.cache_info().misses
        assert stored.cut(unit)[0] == len(b" ".join(text.split()[:unit]))
        assert stored.frame.cache_info().misses <= before + 1


def test_markers_across_stream_pieces():
    output = b"<S>suf<P>pre<M>mid"
    pieces = lambda first=0, last=None: (output[i:i + 1] for i in range(first, len(output) if last is None else last))
    assert b"".join(M.restored(pieces, "spm")) == b"premidsuf"


def test_empty_table(spark):
    prepare(spark)
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    problems, n, _ = oracle_harness.compare(M.op13_fill_in_middle(spark, sf), oracle_harness.duck(sf), M.OP13_SQL)
    assert not problems and n == 1000
