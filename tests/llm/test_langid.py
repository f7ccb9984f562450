import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesoro.llm import langid as L
from tesoro.llm.common import prepare


def slow_viterbi(scores, penalty):
    n, k = scores.shape
    best = [scores[0].tolist()]
    for t in range(1, n):
        top = max(best[-1])
        best.append([scores[t][j] + max(best[-1][j], top - penalty) for j in range(k)])
    return max(best[-1])


def value(path, scores, penalty):
    return sum(scores[t][j] for t, j in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-8, 8)] * 3), min_size=1, max_size=14), min_size=1, max_size=5),
       st.integers(0, 12))
def test_labels_are_a_best_path_of_every_text(texts, penalty):
    scores = np.array([w for t in texts for w in t], dtype=float)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    labels = L.viterbi(scores, starts, penalty)
    for a, b in zip(starts, [*starts[1:], len(scores)]):
        assert value(labels[a:b].tolist(), scores[a:b], penalty) == pytest.approx(slow_viterbi(scores[a:b], penalty))


def docs(spark):
    english, spanish = "the quick brown fox and the lazy dog " * 3, "el perro rápido y la zorra perezosa de aquí " * 3
    greek, russian = "η γρήγορη αλεπού και ο σκύλος " * 3, "быстрая лиса и ленивая собака " * 3
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [(english, "en"), (spanish, "es"), (greek, "el"), (russian, "ru")] * 6)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 ... !!", "en"), (103, "“—…” 42", None), (104, "THE QUICK DOG", None),
             (105, english + spanish * 2, None), (106, "и лиса αλεπού σκύλος και", None), (None, "la zorra", None),
             (107, "the " * 60000, None), (108, "漢字", None), (109, "the fox", None), (109, "the fox", None), (110, "no language", None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")


def test_mixed_text_scripts_and_odd_rows(spark):
    prepare(spark)
    table = docs(spark)
    model = L.train(table.where("doc_id < 100"))
    assert model.languages == ["el", "en", "es", "ru"]
    found = {r["doc_id"]: r for r in L.identify(table, model).collect()}
    for i in range(24):
        assert found[i]["lang_pred"] == ["en", "es", "el", "ru"][i % 4] and found[i]["score"] == 1.0
    for i in (100, 101, 102, 103):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["spans"]) == ("und", 0.0, [])
    assert found[104]["lang_pred"] == "en" and found[107]["lang_pred"] == "en" and found[None]["lang_pred"] == "es"
    mixed = found[105]
    assert mixed["lang_pred"] == "es" and [s["lang"] for s in mixed["spans"]] == ["en", "es"] and 0.5 < mixed["score"] < 1
    assert mixed["spans"][0]["last"] == mixed["spans"][1]["first"] == 24
    # a script rules the other languages out, word by word
    assert {s["lang"] for s in found[106]["spans"]} == {"ru", "el"}
    assert found[108]["lang_pred"] in model.languages
    assert L.identify(table, L.train(table.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert L.identify(table.limit(0), model).count() == 0


def test_words_and_scripts():
    words = L.split_words([None, b"", "Ab c1d ÉÉ".encode(), b"  ", "αβγ жз".encode()])
    assert words.owner.tolist() == [2, 2, 2, 2, 4, 4]
    assert words.lengths.tolist() == [2, 1, 1, 4, 6, 4]
    bits = L.word_scripts(words)
    assert bits[:4].tolist() == [0, 0, 0, 0] and bits[4] != bits[5] and 0 not in bits[4:]


def test_held_out_accuracy_of_the_given_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    found = L.op3_language_id(spark, sf).collect()
    assert len(found) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.99 * len(held) > 0
