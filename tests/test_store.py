"""Publication as one commit, buckets by key, repeated micro-batches, incremental points."""

import threading

import pytest
from pyspark.sql import functions as F

from litloom.operators.graph import EDGES, point_payloads
from litloom.operators.vectors import hashing_encoder
from litloom.plans import api, ingest
from litloom.sources import shared, store
from litloom.sources.store import Conflict, Store, Transaction

STUB = "arxiv_id string, title string, year int, abstract string, pages array<string>"


def stubs(spark, *ids, text="However {} is limited. In future we try {}."):
    return spark.createDataFrame([(i, f"Paper {i}", 2020 + len(i), text.format(i, i), None) for i in ids], STUB)


def content(kept):
    """Everything readers see, but for times."""
    out = {}
    for name in ("papers", "failures", "mentions", "points", *(e[0] for e in EDGES)):
        rows = kept.read(name).drop("ts", "ingested_at")
        out[name] = sorted(str(r) for r in rows.select(*sorted(rows.columns)).collect())
    return out


def run(kept, spark, extractor=None):
    bad = F.udf(lambda p: "oops" if "Paper bad" in p else None, "string")
    good = ingest.stub_extractor()
    ingest.ingest(kept, stubs(spark, "1", "2", "bad", "1"), lambda p: F.coalesce(bad(p), good(p)), encode=hashing_encoder(8))


class Lost(RuntimeError):
    pass


def test_a_batch_lost_at_any_write_leaves_nothing_and_can_be_run_again(spark, tmp_path, monkeypatch):
    clean = Store(spark, f"file://{tmp_path}/clean")
    writes, put = [], Transaction._put
    monkeypatch.setattr(Transaction, "_put", lambda self, table, *a: (writes.append(table), put(self, table, *a)))
    ingest.ingest(clean, stubs(spark, "0"), ingest.stub_extractor(), encode=hashing_encoder(8))
    before, first = content(clean), len(writes)
    run(clean, spark)
    after, n = content(clean), len(writes) - first
    assert {"papers", "failures", "edges_limitation", "edges_future", "mentions", "points"} <= set(writes[first:])
    kept = Store(spark, f"file://{tmp_path}/lost")
    monkeypatch.setattr(Transaction, "_put", put)
    ingest.ingest(kept, stubs(spark, "0"), ingest.stub_extractor(), encode=hashing_encoder(8))
    number = kept.state()["number"]
    for at in range(n + 1):  # the last: between the data and the commit
        seen = []

        def lost(self, table, *a, at=at, seen=seen):
            put(self, table, *a)
            seen.append(table)
            if len(seen) == at + 1:
                raise Lost

        with monkeypatch.context() as m:
            m.setattr(Transaction, "_put", lost)
            if at == n:
                m.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(Lost()))
            with pytest.raises(Lost):
                run(kept, spark)
        assert kept.state()["number"] == number
    assert content(kept) == before
    run(kept, spark)
    assert content(kept) == after


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    row = spark.createDataFrame([("1", "a")], "arxiv_id string, title string")
    with pytest.raises(Conflict), kept.transaction() as t:
        t.upsert("papers", row, "arxiv_id")
        kept.append("failures", spark.createDataFrame([], "ts timestamp, arxiv_id string"))
    assert not kept.exists("papers") and kept.exists("failures")


def folders(kept, table):
    return {(b, n) for b, p in kept.state()["tables"][table]["parts"].items() for n, _ in p}


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s", bucket_rows=20)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("arxiv_id"), F.lit("old").alias("title"))
    kept.upsert("papers", rows, "arxiv_id")
    entry = kept.state()["tables"]["papers"]
    assert entry["buckets"] >= 64 and max(n for p in entry["parts"].values() for _, n in p) < 60
    old = folders(kept, "papers")
    kept.upsert("papers", rows.where("arxiv_id in ('7', '8')").withColumn("title", F.lit("new")).withColumn("extra", F.lit(1)), "arxiv_id")
    new = folders(kept, "papers")
    assert 1 <= len(new - old) <= 2 and len(old - new) == len(new - old)
    got = kept.read("papers")
    assert got.count() == 1000 and sorted((r.arxiv_id, r.extra) for r in got.where("title = 'new'").collect()) == [("7", 1), ("8", 1)]
    assert len(kept.lookup("papers", "7").inputFiles()) == 1 and kept.lookup("papers", "7").first().title == "new" and kept.lookup("papers", "none").isEmpty()
    kept.insert_absent("papers", spark.createDataFrame([("7", "no"), ("x", "yes")], "arxiv_id string, title string"), "arxiv_id")
    assert len(folders(kept, "papers") - new) == 1 and kept.lookup("papers", "x").first().title == "yes" and kept.lookup("papers", "7").first().title == "new"
    assert kept.read("papers", spark.createDataFrame([("x",)], "arxiv_id string")).count() < 60
    # Readers keep the commit they began with; what no commit lists goes.
    snapshot = kept.read("papers")
    kept.upsert("papers", spark.createDataFrame([("7", "newer")], "arxiv_id string, title string"), "arxiv_id")
    assert snapshot.where("arxiv_id = '7'").first().title == "new"
    kept.vacuum(1)
    assert kept.read("papers").count() == 1001 and len(shared.names_in(spark, f"{kept.root}/_commits")) == 1


def test_buckets_grow_with_the_table_and_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    kept = Store(spark, f"file://{tmp_path}/s", bucket_rows=8)
    for i in range(6):
        kept.insert_absent("papers", spark.range(10 * i, 10 * i + 10).select(F.col("id").cast("string").alias("arxiv_id")), "arxiv_id")
        entry = kept.state()["tables"]["papers"]
        assert kept.read("papers").count() == 10 * i + 10
        assert sum(n for p in entry["parts"].values() for _, n in p) == 10 * i + 10 <= 8 * entry["buckets"]
        assert max(len(p) for p in entry["parts"].values()) <= 3
    # A table written without a key gets one.
    kept.append("notes", spark.createDataFrame([("a", 1)], "k string, v int"))
    kept.upsert("notes", spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long"), "k")
    assert sorted(map(tuple, kept.read("notes").collect())) == [("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        kept.append("notes", kept.read("notes"))


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    broken = lambda p: F.lit("oops")
    assert tuple(ingest.ingest(kept, stubs(spark, "1", "1"), broken, stream=("in", 0)).first()) == (0, 0, 2)
    number = kept.state()["number"]
    assert tuple(ingest.ingest(kept, stubs(spark, "1", "1"), broken, stream=("in", 0)).first()) == (0, 0, 0)
    assert kept.state()["number"] == number and kept.read("failures").count() == 2
    assert tuple(ingest.ingest(kept, stubs(spark, "1"), broken, stream=("other", 0)).first()) == (0, 0, 1)
    assert kept.read("failures").count() == 3


def test_points_follow_changed_papers_only(spark, tmp_path, monkeypatch):
    kept = Store(spark, f"file://{tmp_path}/s", bucket_rows=40)
    many = [f"{i}" for i in range(300)]
    ingest.ingest(kept, stubs(spark, *many), ingest.stub_extractor(), encode=hashing_encoder(8))
    read, scan = [], Transaction._scan
    monkeypatch.setattr(Transaction, "_scan", lambda self, table, buckets=None: (read.append((table, None if buckets is None else len(buckets))), scan(self, table, buckets))[1])
    encoded = spark.sparkContext.accumulator(0)
    encode = F.udf(lambda t: (encoded.add(1), [1.0] * 8)[1], "array<float>")
    old = folders(kept, "points")
    api.ingest(kept, stubs(spark, "7", "8", "new", text="However it is limited by {}. In future {}."), ingest.stub_extractor(), "elsewhere", encode)
    assert all(n is not None and n <= 12 for table, n in read if table in ("papers", "points", "mentions", *(e[0] for e in EDGES)) and n is not None)
    # Whole tables are read for nothing but the papers' column names.
    assert {table for table, n in read if n is None} <= {"papers"}
    assert len(folders(kept, "points") - old) <= 12 and 6 <= encoded.value <= 12
    # The same points as from whole tables: the papers' old texts have moved to the new domain with them.
    p = kept.read("papers")
    want = point_payloads(p, kept.read("edges_limitation"), "limitations").unionByName(point_payloads(p, kept.read("edges_future"), "future_directions"))
    got = kept.read("points").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("domain = 'elsewhere'").count() > 6


def test_points_catch_up_after_batches_without_an_encoder(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(kept, stubs(spark, "1"), ingest.stub_extractor())
    assert kept.read("points").isEmpty()
    ingest.ingest(kept, stubs(spark, "2"), ingest.stub_extractor(), encode=hashing_encoder(8))
    assert kept.read("points").count() == 4


def test_populate_counts_once(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(kept, stubs(spark, "1", "2"), ingest.stub_extractor(), publish=False)
    assert not kept.exists("edges_limitation")
    assert {r.kind: (r.nodes_created, r.relationships_created) for r in ingest.populate(kept, encode=hashing_encoder(8)).collect()}["edges_limitation"] == (2, 2)
    assert kept.read("points").count() == 4
    again = ingest.populate(kept)
    assert all(r.nodes_created == r.relationships_created == 0 for r in again.collect())
    assert kept.read("edges_future").count() == 2


def test_scratch_of_one_thread_leaves_tables_of_others(spark):
    begun, done, kept = threading.Event(), threading.Event(), []

    def other():
        begun.wait()
        kept.append(shared.written(spark.range(3).toDF("x"), "other"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with shared.scratch(spark):
        mine = shared.written(spark.range(5).toDF("x"), "mine")
        begun.set()
        done.wait()
        with shared.scratch(spark):
            inner = shared.written(spark.range(4).toDF("x"), "inner")
        assert mine.count() == 5
    thread.join()
    assert kept[0].count() == 3
    for gone in (mine, inner):
        with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
            gone.count()


def test_texts_of_a_batch_are_written_once(spark, tmp_path, monkeypatch):
    """Repeats and stored papers included; the rest of a batch is decided on ids."""
    made, put = [], shared.written

    def seen(df, label):
        made.append((label, set(df.columns)))
        return put(df, label)

    monkeypatch.setattr(ingest, "written", seen)
    kept = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(kept, stubs(spark, "1", "2"), ingest.stub_extractor())
    for ids in (("1", "2", "3", "3"), ("1", "4", "5", "6")):
        made.clear()
        got = ingest.ingest(kept, stubs(spark, *ids), ingest.stub_extractor()).first()
        assert tuple(got) == ((1, 2, 1) if ids[-1] == "3" else (3, 1, 0))
        assert [label for label, columns in made if columns & {"abstract", "pages", "response"}] == ["stubs"]
    assert sorted(r.arxiv_id for r in kept.read("papers").collect()) == list("123456")
    assert kept.read("failures").select("arxiv_id", "reason").collect() == [("3", "duplicate")]
