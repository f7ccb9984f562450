import datetime as dt
import glob
import json
import random
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tesoro.plans import catalog
from tesoro.session import ensure_checkpoint_dir
from tesoro.sources import driver_tables, feed, json_array
from tesoro.sources.json_array import read_array
from test_feed_quality import write_feed

PART = T.StructType().add("a", T.StringType()).add("b", T.IntegerType())
RECORD = (T.StructType().add("id", T.IntegerType()).add("name", T.StringType())
          .add("parts", T.ArrayType(PART)).add("more", T.StringType()))
ODD = ['}', '{', '"', '\\', '\\"', ',', '[', ']', 'é', '日本', '\n', '\\\\', ' ', 'x']


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def records(n, seed=0):
    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choice(ODD) for _ in range(rnd.randrange(12)))
    return [{"id": i, "name": word(), "parts": [{"a": word(), "b": k} for k in range(rnd.randrange(4))],
             "more": word() if i % 97 else word() * 2000} for i in range(n)]


def found(df):
    return [(r["_pos"], r["id"], r["name"], [tuple(p) for p in r["parts"] or []], r["more"])
            for r in df.orderBy("_pos").collect()]


def wanted(held):
    return [(i, r["id"], r["name"], [(p["a"], p["b"]) for p in r["parts"]], r["more"]) for i, r in enumerate(held)]


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    held = records(1200)
    for name, text in (("plain", json.dumps(held)), ("wide", json.dumps(held, indent=3, ensure_ascii=False) + "\n")):
        file = tmp_path / f"{name}.json"
        file.write_text(text, encoding="utf-8")
        assert spark.read.text(str(file)).rdd.getNumPartitions() > 20
        got = read_array(spark, str(file), RECORD)
        assert found(got) == wanted(held)
        if name == "wide":
            continue
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90000")
        other = read_array(spark, str(file), RECORD)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert {r[0] for r in got.select("batch_id").distinct().collect()} == {
            r[0] for r in other.select("batch_id").distinct().collect()}   # content, not ranges
        file.write_text(text.replace('"id": 1199', '"id": 3199'), encoding="utf-8")
        changed = read_array(spark, str(file), RECORD)
        assert changed.select("batch_id").distinct().join(got.select("batch_id").distinct(), "batch_id").count() == 0


def test_bad_records_keep_their_position(spark, tmp_path, small_ranges):
    held = records(900, seed=1)
    texts = [json.dumps(r) for r in held]
    for i, bad in ((0, "{bad}"), (400, '{"id": "x", "name": 3, "parts": {}}'), (899, "17")):
        texts[i] = bad
    file = tmp_path / "bad.json"
    file.write_text("[" + ",\n".join(texts) + "]")
    got = {r["_pos"]: r for r in read_array(spark, str(file), RECORD).collect()}
    assert sorted(got) == list(range(900))
    assert [p for p in sorted(got) if got[p]["id"] is None] == [0, 400, 899]
    assert got[1]["name"] == held[1]["name"]


def test_files_that_are_not_one_array(spark, tmp_path, small_ranges):
    text = json.dumps(records(900, seed=2))
    files = {"cut.json": text[:-1], "cut_text.json": text[: len(text) // 2], "object.json": '{"id": 1}', "number.json": "5",
             "empty.json": "[]", "blank.json": " [ \n ] \n", "none.json": "", "one.json": '[{"id": 7}]'}
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    got = sorted((r["_source_file"].rsplit("/", 1)[1], r["_pos"], r["id"]) for r in read_array(
        spark, str(tmp_path / "*.json"), RECORD, "b").select("_source_file", "_pos", F.coalesce("id", F.lit(-1)).alias("id")).collect())
    assert got == [("cut.json", 0, -1), ("cut_text.json", 0, -1), ("number.json", 0, -1), ("object.json", 0, -1), ("one.json", 0, 7)]


def test_load_by_ranges_is_the_load_of_whole_files(spark, tmp_path):
    path = write_feed(tmp_path / "feed")
    loads = {}
    for split in (False, True):
        after, added = feed.load_feed(spark, path, feed.empty_bronze(spark), dt.datetime(2026, 1, 1), batch_id="b", split=split)
        loads[split] = {name: rows(df) for name, df in after.items()}, dict(rows(feed.load_counts(added)))
        if split:
            again = feed.load_feed(spark, path, after, dt.datetime(2026, 1, 2), batch_id="b", split=True)[1]
            assert {n for t, n in rows(feed.load_counts(again)) if not t.startswith("rejected")} == {0}
    assert loads[True] == loads[False]


def test_records_are_cut_by_whole_batches():
    """No Python step for each record: one array holds all that end in a batch of pieces."""
    n = 500
    text = json.dumps([{"id": i, "name": "a,\\]}[" * (i % 3)} for i in range(n)])
    pieces = pa.array([p.encode() + b"}" for p in text.split("}")], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array([0] * len(pieces), pa.int64()),
                                        pa.array([9] * len(pieces), pa.int64()), pieces], ["file", "start", "length", "value"])
    (key, some), = json_array._by_range(iter([batch]))
    assert key == ("f", 0, 9)
    got = list(json_array._Records((False, 0, 0)).add(some))
    assert len(got) == 1
    positions, whole, texts = got[0]
    assert positions.tolist() == list(range(n)) and whole
    assert [json.loads(t)["id"] for t in texts.to_pylist()] == list(range(n))


def test_files_may_be_gone_after_their_turn(spark, tmp_path, small_ranges):
    """Each path is written when it is asked for and removed after; rows and content are those of one reading of both."""
    held = [records(600, seed) for seed in (3, 4)]
    files = [tmp_path / "a.json", tmp_path / "b.json"]

    def written():
        for file, some in zip(files, held):
            assert not any(f.exists() for f in files)
            file.write_text(json.dumps(some))
            yield str(file)
            file.unlink()

    got = json_array.read_arrays(spark, written(), RECORD)
    assert not any(f.exists() for f in files)
    of = {r["_source_file"].rsplit("/", 1)[1]: r["batch_id"] for r in got.select("_source_file", "batch_id").distinct().collect()}
    for file, some in zip(files, held):
        assert found(got.where(F.col("_source_file").endswith(file.name))) == wanted(some)
        file.write_text(json.dumps(some))
    at_once = read_array(spark, str(tmp_path / "*.json"), RECORD)
    assert of == {r["_source_file"].rsplit("/", 1)[1]: r["batch_id"] for r in at_once.select("_source_file", "batch_id").distinct().collect()}


def line_items(spark, path, n, files=3):
    """``n`` rows, the last one twice, in several files; one supplier is null."""
    day = dt.datetime(2024, 1, 1)
    items = [(i, i % 7 + 1, 10 * i, None if i == 5 else i % 13, i + 0.25, day + dt.timedelta(days=i % 400), "ANR"[i % 3], float(i % 50), 0.1)
             for i in [*range(n - 1), n - 2]]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double,"
                                 "l_shipdate timestamp, l_returnflag string, l_quantity double, l_discount double"
                          ).repartition(files).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "1-URGENT", day, 5.0)], "o_orderkey long, o_custkey long, o_orderpriority string,"
                          "o_orderdate timestamp, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return Counter((f"{i:012}-{line:04}-{part:012}-{round(price * 100):014}", None if supplier is None else f"S{supplier:011}",
                    date.date(), Decimal(quantity).quantize(Decimal("0.01")), flag, f"line {line}")
                   for i, line, part, supplier, price, date, flag, quantity, _ in items for _copy in range(2))


def test_invoices_lie_on_the_disk_in_parts(spark, tmp_path, monkeypatch):
    wanted_rows = line_items(spark, tmp_path, 450)
    there = lambda: set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/invoices-*"))
    before = there()
    monkeypatch.setattr(driver_tables, "ROWS_PER_INVOICE_PART", 100)
    parts = []
    for path in driver_tables.invoice_arrays(spark, str(tmp_path)):
        assert len(there() - before) == 1                       # the part before is gone
        parts.append([r["uuid"] for f in glob.glob(f"{path.removeprefix('file:')}/part-*") for r in json.load(open(f))])
    assert there() == before
    assert len(parts) == 5 and max(map(len, parts)) <= 2 * (450 // 5 + 3)
    assert Counter(u for some in parts for u in some) == Counter(r[0] for r in wanted_rows.elements())

    got = catalog.s1_split_feed(spark, str(tmp_path))
    assert there() == before                                    # nor does the result need them
    assert Counter(map(tuple, got.select("source_doc_ref", "entity_rfc", "date", "amount", "category_name", "description").collect())) == wanted_rows


def test_number_of_invoice_parts(spark, tmp_path, monkeypatch):
    """One for a small table, a fixed number for a large one: reading the table anew for each stays linear."""
    line_items(spark, tmp_path, 60)
    seen = []
    monkeypatch.setattr(driver_tables, "feed_files", lambda spark, sf_dir, part, parts: seen.append((part, parts)) or {
        "transactions": spark.createDataFrame([("f", "[{},{}]")], "_source_file string, value string")})
    for rows_each, parts in ((60, 1), (59, 2), (1, driver_tables.INVOICE_PARTS)):
        monkeypatch.setattr(driver_tables, "ROWS_PER_INVOICE_PART", rows_each)
        seen.clear()
        assert len(list(driver_tables.invoice_arrays(spark, str(tmp_path)))) == parts
        assert seen == [(i, parts) for i in range(parts)]
