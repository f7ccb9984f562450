import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesoro.llm import decontaminate, mixture, simhash, toxicity
from tesoro.llm.common import prepare, read, store
from tesoro.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_in_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "decontamination", "mixture", "token_output"]
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def results(spark):
    prepare(spark)
    out = [read(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_each_stage_works_on_what_the_one_before_kept(spark, results):
    docs, clean, unique, cut, mixed, tokens = results
    for stage in (clean, unique, cut, mixed):
        assert stage.columns == docs.columns
    labels = read(spark, SF, "labels")
    assert 0 < clean.join(labels.where("toxic = 0"), "doc_id").count() == docs.join(labels.where("toxic = 0"), "doc_id").count()
    assert clean.count() < docs.count()
    found = simhash.near_duplicates(clean)
    assert sorted(r[0] for r in unique.select("doc_id").collect()) == sorted(
        r[0] for r in found.select("component_id").distinct().collect())
    assert sorted(r[0] for r in cut.select("doc_id").collect()) == sorted(r[0] for r in unique.select("doc_id").collect())
    benchmark = read(spark, SF, "benchmark")
    before = decontaminate.find_contamination(unique, benchmark)
    hit = {r["doc_id"] for r in before.where(F.size("hit") > 0).collect()}
    changed = {r[0] for r in cut.join(unique.withColumnRenamed("text", "old"), "doc_id").where("text <> old").select("doc_id").collect()}
    assert hit and hit == changed
    assert cut.where(F.char_length("text") != F.col("n_chars")).join(
        unique.where(F.char_length("text") != F.col("n_chars")), "doc_id", "left_anti").count() == 0
    assert 0 < mixed.count() < cut.count() and mixed.select("doc_id").distinct().count() == mixed.count()
    assert sorted(r[0] for r in tokens.select("doc_id").collect()) == sorted(r[0] for r in mixed.select("doc_id").collect())
    last = tokens.orderBy(F.desc("start")).first()
    assert last["start"] + last["n_tokens"] == tokens.agg(F.sum("n_tokens")).first()[0]


def test_run_gives_the_last_stage(spark, results):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, results[-1].collect()))


def test_clean_documents_stay_through_the_filters(spark, results):
    """Documents without toxic words, near copies or benchmark passages reach the mixing."""
    docs, clean, unique, cut = results[:4]
    con = duckdb.connect()
    words = "idiot|loser|pathetic|scum|worthless|disgusting|clown|moron|stupid|trash"
    plain = {r[0] for r in con.sql(f"""SELECT doc_id FROM '{SF}/documents.parquet' WHERE lang = 'en'
        AND NOT regexp_matches(lower(text), '(^|[^a-z])({words})([^a-z]|$)')""").fetchall()}
    kept = {r[0] for r in clean.select("doc_id").collect()}
    assert len(plain - kept) <= 0.01 * len(plain)
    alone = {r[0] for r in simhash.near_duplicates(clean).groupBy("component_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("doc_id").collect()}
    assert alone <= {r[0] for r in cut.select("doc_id").collect()}
    assert toxicity.REJECT_AT == 0.5 and mixture.SEED == 11
