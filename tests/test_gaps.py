import numpy as np
import pytest
from pyspark.sql import functions as F

from litloom.operators import crossdomain, graph, scoring, vectors
from litloom.operators.cluster import ranked, seed_clusters


def clusters(spark, n, pairs, method, t=0.86):
    items = spark.createDataFrame([(i,) for i in range(1, n + 1)], "rank long")
    both = [(a, b, s) for a, b, s in pairs] + [(b, a, s) for a, b, s in pairs]
    got = seed_clusters(items, spark.createDataFrame(both, "l long, r long, sim double"), t, method).collect()
    assert len(got) == n  # a partition
    return {r["rank"]: r["seed"] for r in got}


@pytest.mark.parametrize("method", ["loop", "rounds"])
@pytest.mark.parametrize(
    ("n", "pairs", "want"),
    [
        (2, [(1, 2, 0.90)], {1: 1, 2: 1}),
        (2, [(1, 2, 0.40)], {1: 1, 2: 2}),
        (2, [(1, 2, 0.86)], {1: 1, 2: 1}),
        (3, [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.5)], {1: 1, 2: 1, 3: 3}),
        (3, [(1, 3, 0.9), (2, 3, 0.95)], {1: 1, 2: 2, 3: 1}),
        (3, [], {1: 1, 2: 2, 3: 3}),
    ],
)
def test_seed_clusters(spark, n, pairs, want, method):
    assert clusters(spark, n, pairs, method) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_loop_and_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    pairs = [(i, j, 0.9) for i in range(1, n + 1) for j in range(i + 1, n + 1) if rng.random() < 0.06]
    link = {(a, b) for a, b, _ in pairs}
    want, seeds = {}, []
    for x in range(1, n + 1):
        s = next((s for s in seeds if (s, x) in link), None)
        want[x] = s or x
        if s is None:
            seeds.append(x)
    assert clusters(spark, n, pairs, "loop") == want == clusters(spark, n, pairs, "rounds")


def test_ranks_are_by_length_then_text(spark):
    rows = ranked(spark.createDataFrame([("bb",), ("a",), ("ccc",), ("ab",)], "text string")).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r["rank"])] == ["ccc", "ab", "bb", "a"]


def rows_of(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "seed long, arxiv_id string, year int, tier string")


@pytest.mark.parametrize(
    ("rows", "total", "want"),
    [
        ([("a", 1, "explicit"), ("b", 1, "explicit")], 4, 0.5),
        ([("a", 1, "explicit"), ("b", 1, "explicit"), ("b", 1, "explicit"), ("c", 1, "explicit")], 6, 0.5),
        ([("a", 1, "explicit"), ("b", 1, "explicit"), ("c", 1, "explicit")], 2, 1.0),
        ([("a", 1, "explicit")], 0, 0.0),
        ([("a", 1, "explicit"), ("b", 1, "conclusion"), ("c", 1, "inferred")], 3, 0.75),
        ([("a", 1, "inferred"), ("a", 1, "explicit")], 2, 0.5),
        ([("a", 1, "unknown")], 1, 1.0),
    ],
)
def test_frequency(spark, rows, total, want):
    assert scoring.frequency(rows_of(spark, rows), total).first().frequency == pytest.approx(want)


@pytest.mark.parametrize(("years", "want"), [([2024, 2023], 1.0), ([2024, 2023, 2020, 2019], 0.5), ([2018, 2018], 0.0), ([None, 0], 0.5), ([2030], 1.0)])
def test_recency(spark, years, want):
    rows = [(str(i), y, "explicit") for i, y in enumerate(years)]
    assert scoring.recency(rows_of(spark, rows)).first().recency == want


@pytest.mark.parametrize(("papers", "hits", "want"), [(2, 1, 0.5), (1, 3, 0.0), (2, None, 1.0)])
def test_deficit(spark, papers, hits, want):
    rows = rows_of(spark, [(str(i), 1, "explicit") for i in range(papers)])
    n = spark.createDataFrame([] if hits is None else [(1, hits)], "seed long, n long")
    assert scoring.deficit(rows, n).first().deficit == want


def test_mode_text(spark):
    rows = spark.createDataFrame([(1, 1, "long text"), (1, 2, "twice"), (1, 3, "twice"), (2, 4, "b"), (2, 5, "a")], "seed long, rank long, text string")
    assert {r.seed: r.description for r in scoring.mode_text(rows).collect()} == {1: "twice", 2: "b"}


PAPERS = "arxiv_id string, title string, year int, domain string, methods array<string>, datasets array<string>, limitations array<string>, future_directions array<string>, extraction_tier string"


def world(spark):
    v = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    papers = spark.createDataFrame(
        [
            ("p1", "t", 2024, "cv", ["m"], [], ["limitation one", "lim two"], [], "explicit"),
            ("p2", "t", 2019, "cv", ["m", "m", ""], ["d"], ["limitation one"], ["fut a"], None),
            ("p3", "t", 0, "mi", [], [], ["lim two"], ["fut a", "fut b"], "inferred"),
        ],
        PAPERS,
    )
    edges = graph.build_graph(papers)
    pay = graph.point_payloads(papers, edges["edges_limitation"], "limitations").unionByName(graph.point_payloads(papers, edges["edges_future"], "future_directions"))
    vec = spark.createDataFrame([("limitation one", v(0)), ("lim two", v(60)), ("fut a", v(10)), ("fut b", v(61))], "text string, embedding array<float>")
    return papers, edges, vectors.embed(pay, vectors=vec, dim=2)


def test_graph_is_idempotent_and_unique(spark):
    papers, edges, points = world(spark)
    again = graph.build_graph(papers, edges)
    for name, _, item in graph.EDGES:
        assert sorted(map(tuple, again[name].collect())) == sorted(map(tuple, edges[name].collect()))
        assert graph.violations(again[name], ["arxiv_id", item]).isEmpty()
        assert graph.created(edges[name], again[name], ["arxiv_id", item]).first().n == 0
    assert sorted((r.arxiv_id, r.text, r.tier) for r in edges["edges_limitation"].collect())[2] == ("p2", "limitation one", "explicit")
    assert edges["edges_method"].count() == 2
    got = {(r.collection, r.text, r.domain): (r.paper_ids, r.year) for r in points.collect()}
    assert got[("limitations", "limitation one", "cv")] == (["p1", "p2"], 2024) and got[("limitations", "lim two", "mi")] == (["p3"], 0)


def test_last_tier_wins(spark):
    old = spark.createDataFrame([("p", "x", "explicit")], "arxiv_id string, text string, tier string")
    new = spark.createDataFrame([("p", "x", "inferred")], "arxiv_id string, text string, tier string")
    assert graph.upsert_edges(old, new, "text").first().tier == "inferred"


def test_ranking_and_matches(spark):
    papers, edges, points = world(spark)
    for limit in (None, "reference"):
        g = scoring.Gaps(papers, edges["edges_limitation"], points, "cv", neighbour_limit=limit)
        out = g.ranking().collect()
        assert [r.gap_description for r in out] == ["limitation one", "lim two"]
        one, two = out
        assert one.supporting_papers == ["p1", "p2"] and one.frequency_score == 1.0 and one.recency_score == 0.5
        assert one.proposed_solutions == ["fut a", "fut a"] and one.solution_deficit_score == 0.0
        assert two.proposed_solutions == ["fut b"] and two.recency_score == 1.0 and two.frequency_score == 0.5
        assert one.score == pytest.approx(0.4 * 1.0 + 0.35 * 0.5, abs=1e-4)
    assert crossdomain.unresolved(g).count() == 0 and crossdomain.matches(g, points, "mi").count() == 0
    g = scoring.Gaps(papers, edges["edges_limitation"], points.where("text <> 'fut b' or domain <> 'mi'"), "cv", solution_threshold=0.999)
    got = crossdomain.matches(g, points, "mi", 0.82).collect()
    assert [(r.source_gap, r.target_solution) for r in got] == [("lim two", "fut b"), ("limitation one", "fut a")]
    assert scoring.Gaps(papers, edges["edges_limitation"], points, "none").ranking().count() == 0


def test_search(spark):
    _, _, points = world(spark)
    lim = points.where("collection = 'limitations'")
    assert [r.text for r in vectors.search(lim, [1.0, 0.1], 10, "cv").collect()] == ["limitation one", "lim two"]
    assert [r.text for r in vectors.search(lim, [1.0, 0.1], 1, "mi").collect()] == ["lim two"]
    assert vectors.search(lim, [1.0, 0.1], 10, "none").isEmpty()
    assert vectors.search(lim, [0.0, 1.0], 5).first().text == "lim two"


def test_blocked_join_equals_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    left, right = df.select(F.col("id").alias("l"), "vec"), df.select(F.col("id").alias("r"), "vec")
    key = lambda d: sorted((r.l, r.r, round(r.sim, 9)) for r in d.collect())
    a, b = key(vectors.similar_pairs(left, right, 0.5)), key(vectors.similar_pairs(left, right, 0.5, broadcast_values=10, block=50))
    assert a == b and len(a) > 120


def test_wrong_dimension_is_refused(spark):
    pay = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="dimension"):
        vectors.embed(pay, vectors.hashing_encoder(4), dim=5).collect()


def test_shared_methods(spark):
    papers, edges, _ = world(spark)
    got = graph.texts_sharing(edges["edges_limitation"].select("arxiv_id", "text"), edges["edges_method"], "name").collect()
    assert [(r.text, r.other_text, r.shared) for r in got] == [("lim two", "limitation one", 1)]


def test_search_at_the_encoder_s_dimension(spark):
    """768 values a vector: similarity of every point, a zero vector included, as numpy has it."""
    import numpy as np

    from litloom.operators import vectors

    m = np.random.default_rng(2).standard_normal((300, 768)).astype(np.float32)
    m[7] = 0
    q = m[3].tolist()
    points = spark.createDataFrame([(f"t{i:03}", ["p"], "d", m[i].tolist()) for i in range(300)], "text string, paper_ids array<string>, domain string, embedding array<float>")
    got = {r.text: r.score for r in vectors.search(points, q, 300).collect()}
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    assert all(abs(got[f"t{i:03}"] - unit[i] @ unit[3]) < 1e-9 for i in range(300))


def test_store_appends_only_new_rows(spark, tmp_path, monkeypatch):
    from litloom.sources import store as st

    monkeypatch.setattr(st, "MOST_PARTS", 3)
    kept = st.Store(spark, f"file://{tmp_path}/s")
    for i in range(6):
        kept.append("failures", spark.createDataFrame([(None, str(i), "s", "r", "x")], "ts timestamp, arxiv_id string, stage string, reason string, raw string"))
    assert sorted(r.arxiv_id for r in kept.read("failures").collect()) == list("012345")
    assert [n for _, n in kept._versions("failures")] == ["v=5", "d=6"]


def test_a_long_chain_is_clustered_in_tens_of_rounds(spark):
    """A hundred thousand items, each linked to the next: every decision depends on the one before."""
    n = 100_000
    pairs = spark.range(1, n).select(F.col("id").alias("l"), (F.col("id") + 1).alias("r"), F.lit(0.9).alias("sim"))
    got = seed_clusters(spark.range(1, n + 1).toDF("rank"), pairs, 0.86)
    assert got.count() == n
    wrong = got.where(F.col("seed") != F.when(F.col("rank") % 2 == 1, F.col("rank")).otherwise(F.col("rank") - 1))
    assert wrong.isEmpty()


def test_blocks_equal_the_loop(spark):
    """Many small blocks, a hot item linked to all, and dense links."""
    from litloom.operators import cluster

    rng = np.random.default_rng(4)
    n = 400
    rows = {(int(a), int(b)) for a, b in rng.integers(1, n + 1, (900, 2)) if a < b} | {(a, n) for a in range(1, n)} | {(200, b) for b in range(201, n + 1)}
    items, links = spark.range(1, n + 1).toDF("rank"), spark.createDataFrame(sorted(rows), "src long, dst long")
    want = {r["rank"]: r["seed"] for r in cluster._loop(items, links).collect()}
    for size in (20, 100_000):
        assert {r["rank"]: r["seed"] for r in cluster._rounds(items, links, size).collect()} == want


def test_texts_of_one_length_are_ranked_over_partitions(spark):
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    got = ranked(rows).withColumn("part", F.spark_partition_id())
    assert got.groupBy("part").count().count() > 1
    texts = [r.text for r in got.orderBy("rank").select("text").collect()]
    assert texts == sorted(texts) and got.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 200_000, 200_000)


def brute_pairs(a, b, t, limit=None):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = unit(a) @ unit(b).T
    out = []
    for i, row in enumerate(s):
        hits = sorted((-x, j) for j, x in enumerate(row) if x >= t)
        out += [(i, j, round(-x, 9) + 0.0) for x, j in hits[:limit]]
    return sorted(out)


def clustered(rng, n, groups, dim, spread):
    centres = rng.standard_normal((groups, dim))
    m = centres[rng.integers(groups, size=n)] + spread * rng.standard_normal((n, dim))
    m[5] = m[9] = 0  # no direction
    m[6] = m[7]
    return np.round(m, 3)


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("t", [0.9, 0.0, -1.0])
def test_blocks_around_pivots_lose_nothing(spark, t, limit):
    rng = np.random.default_rng(11)
    a, b = clustered(rng, 90, 6, 8, 0.05), clustered(rng, 110, 6, 8, 0.05)
    frames = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{c} long, vec array<double>") for m, c in ((a, "l"), (b, "r"))]
    for broadcast in (1 << 20, 0):
        got = vectors.similar_pairs(*frames, t, broadcast_values=broadcast, block=9, limit=limit)
        key = [(r.l, r.r, round(r.sim, 9) + 0.0) for r in got.collect()]
        want = brute_pairs(a, b, t, limit)
        if limit is None:
            assert sorted(key) == want
        else:  # equal similarities may round apart
            assert [(x[0], round(x[2], 6)) for x in sorted(key, key=lambda x: (x[0], -x[2]))] == [(x[0], round(x[2], 6)) for x in sorted(want, key=lambda x: (x[0], -x[2]))]


def test_most_blocks_of_clustered_vectors_are_skipped(spark):
    rng = np.random.default_rng(12)
    m = clustered(rng, 600, 12, 16, 0.02)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    left, right = df.select(F.col("id").alias("l"), "vec"), df.select(F.col("id").alias("r"), "vec")
    cells = {t: vectors._cells(left, right, t, 25).select("cell").distinct().count() for t in (0.9, -1.0)}
    assert cells[0.9] < cells[-1.0] / 5


def test_hits_within_a_task_are_the_best(spark):
    rng = np.random.default_rng(13)
    l, r, sim = rng.integers(0, 5, 200), np.arange(200), rng.integers(0, 4, 200) / 4
    order = sorted(zip(l.tolist(), (-sim).tolist(), r.tolist(), strict=True))
    want = [x for k in range(5) for x in [o for o in order if o[0] == k][:7]]
    assert [tuple(x) for x in zip(*(v.tolist() for v in vectors.best(l, r, sim, 7)), strict=True)] == [(a, c, -b) for a, b, c in want]
    out = list(vectors.products(np.arange(3), np.eye(3), np.arange(9000), np.ones((9000, 3)), 0.5, 4))
    assert sum(b.num_rows for b in out) == 12 and out[0].column(1).to_pylist()[:4] == [0, 1, 2, 3]


def test_a_text_of_every_paper_is_many_small_rows(spark):
    n = 30_000
    papers = spark.range(n).select(F.col("id").cast("string").alias("arxiv_id"), F.lit(2020).alias("year"), F.lit("cv").alias("domain"))
    edges = papers.select("arxiv_id", F.lit("everywhere").alias("text"), F.lit("explicit").alias("tier"))
    parts = graph.limitation_parts(papers, edges, "cv", 100)
    assert parts.agg(F.sum(F.size("papers")), F.count("*")).first() == (n, 300) and parts.agg(F.max(F.size("papers"))).first()[0] < 200
    points = spark.createDataFrame([("limitations", "everywhere", "cv", ["x"], 2020, [1.0, 0.0])], "collection string, text string, domain string, paper_ids array<string>, year int, embedding array<float>")
    g = scoring.Gaps(papers, edges, points, "cv")
    assert [(r.gap_description, r.frequency_score, len(r.supporting_papers)) for r in g.ranking().collect()] == [("everywhere", 1.0, n)]
    assert "collect_list" not in g.scores()._jdf.queryExecution().toString() and "collect_set" not in g.scores()._jdf.queryExecution().toString()


@pytest.mark.parametrize(("t", "limit"), [(0.3, None), (0.0, "reference")])
def test_clusters_ask_for_hits_of_few_candidates(spark, t, limit, monkeypatch):
    """Equal to the rule over all pairs, ties at the limit in the order of texts; what seeds have taken is never compared."""
    from litloom.operators import cluster
    from litloom.sources.shared import written

    rng = np.random.default_rng(8)
    base = rng.standard_normal((100, 16))
    rows = [(f"text {i:03}", [float(x) for x in base[i % 100]]) for i in range(400)]  # each vector four times
    vec = spark.createDataFrame(rows, "text string, embedding array<double>")
    every = vec.select(F.lit("limitations").alias("collection"), "text", F.explode(F.array(F.lit("cv"), F.lit("mi"))).alias("domain"), F.array().cast("array<string>").alias("paper_ids"), F.lit(2020).alias("year"), "embedding")
    edges = vec.select(F.lit("p").alias("arxiv_id"), "text", F.lit("explicit").alias("tier"))
    papers = spark.createDataFrame([("p", 2020, "cv")], "arxiv_id string, year int, domain string")
    sim = base @ base.T / np.outer(*[np.linalg.norm(base, axis=1)] * 2)
    hit = {}
    for i in range(400):
        order = sorted((-round(sim[i % 100, j % 100], 12), j) for j in range(400) for _ in range(2) if sim[i % 100, j % 100] >= t)
        hit[i] = {j for _, j in (order[:400] if limit else order)}
    want, seeds = {}, []
    for i in range(400):
        by = [s for s in seeds if i in hit[s]]
        want[i + 1] = by[0] + 1 if by else i + 1
        seeds += [] if by else [i]
    assert not limit or min(map(len, hit.values())) < max(map(len, hit.values()))
    g = scoring.Gaps(papers, edges, every, "cv", t, neighbour_limit=limit)
    asked = []

    def hits(candidates, left):
        out = written(g._hits(candidates, left), "asked")
        asked.append((candidates.count(), out.count()))
        return out

    got = cluster.clusters_from(g.vectors.select("rank", "vec"), 800, hits, hits_a_round=1, least=16)
    assert {r["rank"]: r["seed"] for r in got.collect()} == want == {r["rank"]: r["seed"] for r in g.clusters.collect()}
    assert len(asked) > 1 and sum(n for n, _ in asked) < 400 and sum(n for _, n in asked) < sum(map(len, hit.values())) / 2


def test_ranking_makes_no_pairs_of_all_texts(spark, monkeypatch):
    """Hits come from candidates in rank order; pairs of all texts grow with their square and are for the plain rule alone."""

    def refuse(self):
        raise AssertionError("pairs of all texts")

    monkeypatch.setattr(scoring.Gaps, "pairs", property(refuse))
    rng = np.random.default_rng(3)
    vec = spark.createDataFrame([(f"text {i:02}", [float(x) for x in rng.standard_normal(8)]) for i in range(40)], "text string, embedding array<double>")
    points = vec.select(F.lit("limitations").alias("collection"), "text", F.lit("cv").alias("domain"), "embedding")
    edges = vec.select(F.lit("p").alias("arxiv_id"), "text", F.lit("explicit").alias("tier"))
    papers = spark.createDataFrame([("p", 2020, "cv")], "arxiv_id string, year int, domain string")
    got = scoring.Gaps(papers, edges, points, "cv", 0.3, 0.3)
    assert scoring.listed(got.ranking(100)).count() == got.clusters.select("seed").distinct().count()


def test_first_hits_of_bands(spark):
    rows = [(1, r, 0.5) for r in range(50)] + [(1, 100 + r, 0.5 + r / 1000) for r in range(50)] + [(2, r, 0.1 * r) for r in range(5)]
    hits = spark.createDataFrame(rows, "l long, r long, sim double")
    got = sorted((r.l, r.r) for r in vectors.first_hits(hits, 70).collect())
    assert got == sorted([(1, 100 + r) for r in range(1, 50)] + [(1, r) for r in range(21)] + [(2, r) for r in range(5)])


def test_pairs_of_texts_are_not_shuffled(spark):
    """Every pair of texts that share an item, its number of shared items as counted pair by pair, from rows in number of the texts."""
    texts = [(f"p{i}", f"text {i:03}") for i in range(300)]
    items = {i: {k for k in range(4) if i % 7 > k or i % (k + 5) == 0} for i in range(300)}
    edges = spark.createDataFrame(texts, "arxiv_id string, text string")
    other = spark.createDataFrame([(f"p{i}", f"m{k}") for i, found in items.items() for k in found], "arxiv_id string, name string")
    out = graph.texts_sharing(edges, other, "name", block=16)
    got = sorted((r.text, r.other_text, r.shared) for r in out.collect())
    want = [(texts[i][1], texts[j][1], len(items[i] & items[j])) for i in range(300) for j in range(i + 1, 300) if items[i] & items[j]]
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and len(want) > 10_000


def test_texts_that_share_an_item_are_sent_a_bounded_number_of_times(spark):
    """Three thousand texts of one kind in blocks of 16: rows written to the shuffle follow the texts, not their number of blocks."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n = 3000
    edges = spark.range(n).select(F.lit("p").alias("arxiv_id"), F.format_string("text %04d", "id").alias("text"))
    other = spark.createDataFrame([("p", "m")], "arxiv_id string, name string")
    out, was = graph.texts_sharing(edges, other, "name", block=16), sent()
    met = out.agg(F.count("*").alias("n"), F.countDistinct(F.col("text")).alias("texts"), F.sum((F.col("text") >= F.col("other_text")).cast("int")).alias("wrong")).first()
    assert (met["n"], met["texts"], met["wrong"]) == (n * (n - 1) // 2, n - 1, 0)
    assert sent() - was < 2 * (graph.MOST_PARTS + 2) * n
