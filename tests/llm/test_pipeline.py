"""The pipeline's stages against brute force, and the registered queries on the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from litloom.llm import registry
from litloom.llm.common import shared_dir, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixture", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "sharding":
            assert out.columns == table(spark, DATA, "documents").columns
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    lost = [d for d, q in labels.items() if q == 1 and d not in kept["quality"]]
    assert len(lost) <= 0.02 * sum(labels.values())
    # Near-duplicates: no pair of 0.8 or more stays, and what goes has a partner of 0.8 or more.
    s = {d: shingles(t) for d, t in kept["quality"].items()}
    jac = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    stay = sorted(kept["near_duplicates"])
    assert not [(a, b) for i, a in enumerate(stay) for b in stay[:i] if jac(a, b) >= 0.8]
    for d in set(kept["quality"]) - set(stay):
        assert max(jac(d, e) for e in kept["quality"] if e != d) >= 0.8
    assert set(kept["mixture"]) <= set(kept["decontamination"]) <= set(stay)
    rows = docs.collect()
    counts = [sum(r.shard == k for r in rows) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    assert corpus_pipeline.run(spark, DATA).count() == len(rows)
    assert ["stage-sharding" in p.name for p in set(shared.iterdir()) - before] == [True]  # nothing else is left


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_the_fit_holds_one_copy_of_its_features(spark):
    """The classifier is fitted on the driver: beside what came from Spark it holds little more than one weighted copy. Equal to the fit in one block."""
    import tracemalloc

    from litloom.llm import knn_quality

    rng = np.random.default_rng(1)
    x = np.log1p(rng.poisson(0.3, (1500, knn_quality.TERMS + knn_quality._STYLES))).astype("<f2")
    y = (rng.random(len(x)) < 0.5).astype(np.float32)
    tracemalloc.start()
    model = knn_quality.Model(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * x.size
    whole = (x > 0).sum(axis=0)[: knn_quality.TERMS]
    assert np.array_equal(model.idf, (np.log((1 + len(x)) / (1 + whole)) + 1).astype(np.float32))
    assert np.array_equal(model.voters, model._unit(model._weighted(x.astype(np.float32)) @ model.basis))
