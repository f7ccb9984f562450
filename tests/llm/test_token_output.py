import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesoro.llm import token_output as T
from tesoro.llm.common import prepare, shared_uri
from tesoro.llm.repair import Shard, compress, paying_places

ODD = ["it's DON'T 'stop' a.b,c 1234x x1234 <|endoftext|>foo <|ENDOFTEXT|> İstanbul ÀÉ éà ≠ ...… “quoted” café! KK ẞ ΣΣ "
       "nbsp x　y 漢字!! हिन्दी 가각 ## a\x1cb \U0001F600hi! H̱ x̱ ﬁne ''s 's ?!what -- é",
       "", " \n\t ", "a" * 3000, "!" * 50, "Ünïcode", "word " * 2000]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(T.tokenizer_path())
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


def encode(words, texts):
    ids, counts = words.encode([None if t is None else t.encode() for t in texts])
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def test_words_apart_give_the_ids_of_the_whole_text(plain):
    words = T.WordTokenizer(T.tokenizer_path())
    for _ in range(2):  # unknown, then remembered
        assert encode(words, [*ODD, None]) == [plain(t) for t in [*ODD, None]]
    assert encode(words, []) == []


@pytest.mark.parametrize("chunk", ["CUMHURİYETİ.", "ŞİRKETİ,", "İ)", "(İ)", "\u0915\u095c.", "\u0921\u093f\u095c,", "\u095c!", "\u0a36.",
                                   "\ufb4b,", "\u01f0)", "É.", "(ΣΑΣ),"])
def test_letters_that_end_in_a_mark_when_normalised(plain, chunk):
    words = T.WordTokenizer(T.tokenizer_path())
    texts = [chunk, f"word {chunk} été {chunk[:-1]}"]
    for _ in range(2):
        assert encode(words, texts) == [plain(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aA' .!é́ßİ<|>1"), max_size=40))
def test_any_text(text):
    global _CACHED
    words, plain_ = _CACHED
    assert encode(words, [text])[0] == plain_.encode(text, add_special_tokens=False).ids + [T.END_ID]


_words = T.WordTokenizer(T.tokenizer_path())
_CACHED = (_words, _words.tokenizer)


def test_a_full_memory_starts_anew(monkeypatch, plain):
    monkeypatch.setattr(T, "CACHE_CHUNKS", 3)
    words = T.WordTokenizer(T.tokenizer_path())
    for text in ("one two three four five", "six Seven one.", "Two, nine ten eleven", "\u00a0 \u3000 x", "Nine. (ten) \u00a0",
                 "nine ten seven", "one", "Eleven!"):
        assert encode(words, [text, None]) == [plain(text), plain(None)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [16, 64, 65, 1024, 2048])
def test_a_chunk_and_its_complement(plain, n):
    one = thue_morse(n)
    texts = [one, one.translate({97: 98, 98: 97}), f"{one}. {one[::-1]}"]
    assert encode(T.WordTokenizer(T.tokenizer_path()), texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("different", [1, 7])
def test_chunks_that_share_a_hash_keep_their_ids(monkeypatch, plain, different):
    whole = T._Chunks.hashes
    monkeypatch.setattr(T._Chunks, "hashes", lambda self: whole(self) % np.uint64(different))
    words = T.WordTokenizer(T.tokenizer_path())
    texts = [*ODD, "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 70 + "\0", "x" * 70, "a\0", "a", "\0", "\0\0 \0", "abcdefgh abcdefg"]
    for _ in range(2):
        assert encode(words, texts) == [plain(t) for t in texts]


def test_chunks_of_a_text():
    text = b"a bb " + b"c" * 5000 + b"  d\x0be" + b"f" * 900 + b" a bb "
    chunks = T._Chunks(text)
    hashes = chunks.hashes()
    assert [chunks[i] for i in range(len(hashes))] == text.split()
    assert hashes[0] == hashes[-2] and len(set(hashes.tolist())) == 5


def test_letters_and_marks_are_apart():
    text = "The-END, (É)été!  A1.B <|endoftext|>Ab H\u0331.A Š.É ×A÷ it's ... x ".encode()
    chunks = T._Chunks.apart(text)
    want = "the - end , ( É ) été ! A1.B <|endoftext|>Ab H\u0331.A Š.É ×A÷ it's ... x"
    assert [chunks[i].decode() for i in range(len(chunks.first))] == want.split()
    assert not len(T._Chunks.apart(b" \n ").first)


def test_a_word_is_encoded_once_whatever_stands_around_it(plain):
    words = T.WordTokenizer(T.tokenizer_path())
    texts = ["word Word word. WORD, (word) word!", "Été été. (été), -- word-été word--été", "word. <|endoftext|>Word wORD"]
    for _ in range(2):
        assert encode(words, texts) == [plain(t) for t in texts]
    # none, word . , ( ) ! Été été ), -- - <|endoftext|>Word
    assert len(words.memory.id_sizes) == 13


@pytest.mark.parametrize("text", ["foo-bar,BAZ.(É)É! Ñandú-Über.x", "×A÷ A×B. a÷b, ß.ẞ", "NAÏVE.Naïve", "<|EndOfText|>A.B A<|B.C <|endoftext|>",
                                  "H\u0331.A A\u0301.B, E\u0301", "\u212a.K K\u0327. \u00aa.A \u00b5.B", "don't.DON'T ''S.x 'S", "A\x1cB.C a\x85B.C \u00a0X.Y",
                                  "(((A)))...B;;;C 1A.2B A1,B2"])
def test_cut_chunks_have_the_ids_of_the_whole_text(plain, text):
    assert encode(T.WordTokenizer(T.tokenizer_path()), [text, None, text.swapcase()]) == [plain(text), plain(None), plain(text.swapcase())]


def test_the_first_of_chunks_that_share_a_slot_keeps_it(monkeypatch):
    monkeypatch.setattr(T, "_SLOT_SHIFT", np.uint64(63))
    words = T.WordTokenizer(T.tokenizer_path())
    encode(words, ["the"])
    first = words.memory.slots[words.memory.slots > 0].tolist()
    encode(words, [" ".join(chr(97 + i) * 3 for i in range(26))])
    assert first == [1] and 1 in words.memory.slots[:2]


@pytest.mark.parametrize("seed,vocabulary", [(1, 3), (2, 40), (3, 1), (4, 70_000)])
def test_grammar_round_trip_and_random_access(seed, vocabulary):
    rng = random.Random(seed)
    phrase = [rng.randrange(vocabulary) for _ in range(30)]
    docs = [[], [0]] + [sum((phrase if rng.random() < 0.6 else [rng.randrange(vocabulary) for _ in range(9)]
                             for _ in range(rng.randint(0, 30))), []) for _ in range(40)]
    starts = np.cumsum([0, *map(len, docs)])
    names = [None, *range(len(docs) - 1)]
    made = compress(names, np.array(sum(docs, []), dtype=np.uint32), starts, vocabulary, min_pairs=4, per_round=5)
    shard = Shard.from_bytes(made.to_bytes())
    assert shard.ids == names and shard.decode().tolist() == sum(docs, [])
    assert [shard.decode(i, i + 1).tolist() for i in range(len(docs))] == docs
    assert len(shard.left) > 0 and len(shard.symbols) < starts[-1]
    lengths = [len(Shard([], np.array([0, 1]), None, np.array([vocabulary + i]), vocabulary, shard.left, shard.right,
                         shard.lengths).decode(0, 1)) for i in range(len(shard.left))]
    assert lengths == shard.lengths.tolist()


def most_places(shard):
    """The most places, not overlapping, of a pair in a shard."""
    found = Counter()
    for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist()):
        symbols, last = shard.symbols[a:b].tolist(), None
        for pair in zip(symbols, symbols[1:]):
            last = None if pair == last else pair
            found[pair] += last is not None
    return max(found.values())


@pytest.mark.parametrize("seed,first_rule", [(1, 49_408), (2, 65_500), (3, 70_000)])
def test_production_values_leave_no_pair_that_pays(seed, first_rule):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, first_rule, rng.integers(2, 9)) for _ in range(600)]
    docs = [np.concatenate([phrases[i] for i in (rng.random(50) ** 2 * 600).astype(int)]) for _ in range(400)]
    docs += [np.zeros(13 + seed, dtype=np.int64)] * 40
    starts = np.cumsum([0, *map(len, docs)])
    shard = Shard.from_bytes(compress(list(range(len(docs))), np.concatenate(docs), starts, first_rule).to_bytes())
    symbols = first_rule + len(shard.left)
    assert (shard.symbols.dtype == np.uint16) == (symbols <= 1 << 16) and shard.symbols.max() >= first_rule
    assert shard.decode().tolist() == np.concatenate(docs).tolist()
    assert most_places(shard) < paying_places(symbols) <= 7


def test_pairs_are_counted_again_between_rounds():
    # the best pair takes places from both others: the rest of those don't pay
    text = [1, 2, 3] * 20 + [2, 3] * 20 + [1, 2] * 3
    docs = [text[i:i + n] for i, n in [(k * 3, 3) for k in range(20)] + [(60 + k * 2, 2) for k in range(23)]]
    made = compress(list(range(43)), np.array(text), np.cumsum([0, *map(len, docs)]), 4)
    assert list(zip(made.left.tolist(), made.right.tolist())) == [(2, 3), (1, 4)]
    assert made.decode().tolist() == text and most_places(made) == 3


def test_files_hold_all_rows_in_id_order(spark, plain):
    prepare(spark)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (50, None), (7, "again"), (7, "again"), (-3, "first")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    manifest = T.write_shards(docs, shared_uri(spark, "shards"), shard_tokens=60)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in T.read_shards(manifest).collect()))
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        tokens = np.array(plain(t), dtype="<u4")
        want.append((at, i, len(tokens), zlib.crc32(tokens.tobytes())))
        at += len(tokens)
    assert got == want
    assert manifest.count() > 1
    assert T.token_output(docs.limit(0)).count() == 0


def test_query_matches_the_tokenizer_on_the_whole_table(spark, plain):
    import duckdb
    sf = "/root/testdata/sf0.01"
    want, at = {}, 0
    for i, text in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall():
        tokens = np.array(plain(text), dtype="<u4")
        want[i] = (at, len(tokens), zlib.crc32(tokens.tobytes()))
        at += len(tokens)
    assert {r[0]: tuple(r)[1:] for r in T.op9_token_output(spark, sf).collect()} == want
