import json

import pytest
from pyspark.sql import functions as F

from litloom.functions.records import LIST_FIELDS
from litloom.operators.vectors import hashing_encoder
from litloom.plans import api, ingest
from litloom.sources.store import Store
from litloom.streaming.ingest import INPUT, ingest_stream

STUB = "arxiv_id string, title string, year int, abstract string, pages array<string>"


def stubs(spark, *ids):
    return spark.createDataFrame([(i, f"Paper {i}", 2023, "However it is limited. In future we try.", None) for i in ids], STUB)


def broken():
    @F.pandas_udf("string")
    def run(p):
        return p.map(lambda x: "oops" if "bad" in x else json.dumps({f: ["x"] for f in LIST_FIELDS}))

    return run


def counts(df):
    return tuple(df.first())


def test_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert counts(api.health(store)) == ("ok", 0, 0, 0)
    assert counts(ingest.ingest(store, stubs(spark), broken())) == (0, 0, 0)
    assert counts(ingest.ingest(store, stubs(spark, "1", "bad", "1"), broken(), encode=hashing_encoder(8))) == (1, 0, 2)
    assert counts(ingest.ingest(store, stubs(spark, " 1 ", "2"), broken(), domain="mi")) == (1, 1, 0)
    assert {r.arxiv_id: r.domain for r in store.read("papers").collect()} == {"1": "computer_vision", "2": "mi"}
    assert sorted(r.reason for r in store.read("failures").collect()) == ["duplicate", "not json"]
    assert counts(api.ingest(store, stubs(spark, "1"), ingest.stub_extractor(), " mi ", hashing_encoder(8))) == (1, 0, 0)
    row = api.paper(store, "1").first()
    assert row.domain == "mi" and row.extraction_tier == "inferred" and row.limitations and row.future_directions
    assert api.paper(store, "none").isEmpty()
    # Edges of the first extraction stay: the graph only grows.
    assert {r.text for r in store.read("edges_limitation").where("arxiv_id = '1'").collect()} >= {"x", *row.limitations}
    assert api.health(store).first().papers == 2 and api.health(store).first().limitations > 0
    encode = lambda q: [1.0] * 8
    assert api.search(store, "q", encode, "mi").count() > 0 and api.search_future(store, "q", encode).count() > 0
    assert api.gaps(store, "mi").count() > 0
    assert api.cross_domain(store, "mi", "mi", threshold=-1.0).count() >= 0


def test_bounds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for call in (lambda: api.gaps(store, top_n=0), lambda: api.gaps(store, top_n=101), lambda: api.search(store, "", lambda q: [1.0]), lambda: api.search(store, "q", lambda q: [1.0], top_k=51), lambda: api.cross_domain(store, "a", "b", top_n=51), lambda: ingest.ingest(store, stubs(spark), broken(), mode="x")):
        with pytest.raises(ValueError):
            call()


def test_explain(spark):
    @F.pandas_udf("string")
    def model(p):
        return p.map(lambda x: f"  {len(x)} ")

    rows = spark.createDataFrame([("g", "s", "a_b", "c")], "source_gap string, target_solution string, source_domain string, target_domain string")
    assert int(api.explain(rows, model).first().explanation) > 0


def test_stream_ingests_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "in").mkdir()
    stubs(spark, "1", "2").write.mode("append").json(str(tmp_path / "in"))
    assert "pages" in INPUT
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), store, ingest.stub_extractor(), str(tmp_path / "cp"), "cv").awaitTermination()
    assert store.read("papers").count() == 2


def test_upsert_adds_columns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.insert_absent("papers", spark.createDataFrame([("1", "old")], "arxiv_id string, title string"), "arxiv_id")
    store.upsert("papers", spark.createDataFrame([("1", "new", 5)], "arxiv_id string, title string, extra int"), "arxiv_id")
    assert [(r.title, r.extra) for r in store.read("papers").collect()] == [("new", 5)]
