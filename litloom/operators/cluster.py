"""Seed-anchored clustering: items in rank order; an unassigned item seeds a cluster and takes
every unassigned item similar enough to itself.

The seeds are the lexicographically first maximal independent set of the link graph, found in parallel
rounds (after Blelloch, Fineman and Shun 2012) over blocks of consecutive ranks. Only hits of seeds matter, so hits are
asked for the first open items alone, and what their seeds take is never asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.sources.shared import written

#: Links of a block, on average, and blocks at least: small tables end in that many rounds.
LINKS_A_BLOCK, LEAST_BLOCKS = 200_000, 8
OPEN, SEED, MEMBER = 0, 1, 2
#: Hits asked for in a round, about, and candidates of a round at least.
HITS_A_ROUND, LEAST_CANDIDATES = 8 << 20, 64


def ranked(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``rank`` from 1: longest text first, then by text.

    One range shuffle by sampled bounds of length and text; a row's rank is its place in its partition after the rows of
    earlier partitions. Texts of one length are dealt out by their order, so no task holds them all.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.length(text_col).desc(), F.col(text_col).asc())
    rows = texts.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # Spark's id of a row: the partition's number above 33 bits, its place there below.
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    counts = rows.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), F.shiftright("__at", 33) == F.col("__part")).withColumn("rank", F.col("__before") + place + 1).drop("__at", "__part", "__before")


def _loop(items: DataFrame, links: DataFrame) -> DataFrame:
    """The sequential rule in one task over links only; items without links seed themselves."""

    def run(t: pa.Table) -> pa.Table:
        into: dict[int, list[int]] = {}
        nodes: set[int] = set()
        for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True):
            into.setdefault(b, []).append(a)
            nodes |= {a, b}
        seeds: set[int] = set()
        out = []
        for x in sorted(nodes):
            seed = min((s for s in into.get(x, ()) if s in seeds), default=x)
            if seed == x:
                seeds.add(x)
            out.append((x, seed))
        return pa.table({"rank": pa.array([o[0] for o in out], pa.int64()), "seed": pa.array([o[1] for o in out], pa.int64())})

    decided = links.groupBy(F.lit(0).alias("g")).applyInArrow(run, "rank long, seed long")
    return items.select("rank").join(decided, "rank", "left").select("rank", F.coalesce("seed", "rank").alias("seed"))


def _local_rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, dst, src, state) sorted by block and dst -> items the rule decides with what a block knows: ``rank, state``.

    An item linked to a seed is a member, one linked to members only a seed; with an undecided link of an earlier block it waits.
    Holds the decisions of one block."""
    block, item, seed, waits = None, None, False, False
    known: dict[int, int] = {}
    ranks: list[int] = []
    states: list[int] = []

    def decide() -> None:
        if item is not None and (seed or not waits):
            known[item] = MEMBER if seed else SEED
            ranks.append(item)
            states.append(known[item])

    for b in batches:
        for at, dst, src, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if dst != item or at != block:
                decide()
                if at != block:
                    block = at
                    known.clear()
                item, seed, waits = dst, False, False
            state = state or known.get(src, OPEN)
            seed = seed or state == SEED
            waits = waits or state == OPEN
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(states, pa.int32())], ["rank", "state"])
        ranks.clear()
        states.clear()
    decide()
    yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(states, pa.int32())], ["rank", "state"])


def _rounds(items: DataFrame, links: DataFrame, links_a_block: int = LINKS_A_BLOCK) -> DataFrame:
    """Blocks of consecutive ranks decide what they can at once and in order; decisions reach later blocks before the next round.

    The k-th block depends on earlier ones alone, so it is through after k rounds, whatever the links; as a rule few are needed.
    """
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = items.agg(F.max("rank")).first()[0] or 1
    links = written(links, "links")
    blocks = max(LEAST_BLOCKS, -(-links.count() // links_a_block))
    first = written(items.select("rank").join(links.select(F.col("dst").alias("rank")), "rank", "left_anti"), "first-seeds")
    seeds = [first]
    state = F.when(F.col("rank").isNotNull(), SEED).otherwise(OPEN).cast("int")
    block = F.floor((F.col("dst") - 1) * blocks / F.lit(top)).cast("int")
    live = written(links.join(first, links["src"] == first["rank"], "left").select(block.alias("block"), "dst", "src", state.alias("state")), "live")
    for _ in range(blocks + 1):
        if live.isEmpty():
            break
        dealt = live.repartition(width, "block").sortWithinPartitions("block", "dst")
        found = written(dealt.mapInArrow(_local_rule, "rank long, state int"), "decided")
        seeds.append(found.where(F.col("state") == SEED).select("rank"))
        news = found.select(F.col("rank").alias("src"), F.col("state").alias("now"))
        live = live.join(found.select(F.col("rank").alias("dst")), "dst", "left_anti").join(news, "src", "left")
        live = written(live.select("block", "dst", "src", F.coalesce("now", "state").alias("state")), "live")
    else:
        raise RuntimeError(f"clusters not decided in {blocks + 1} rounds")
    seeds = reduce(DataFrame.unionByName, seeds)
    reached = links.join(seeds, links["src"] == seeds["rank"], "left_semi").groupBy("dst").agg(F.min("src").alias("seed"))
    lone = seeds.select("rank", F.col("rank").alias("seed"))
    members = reached.join(seeds, reached["dst"] == seeds["rank"], "left_anti").select(F.col("dst").alias("rank"), "seed")
    return lone.unionByName(members)


def seed_clusters(items: DataFrame, pairs: DataFrame, threshold: float, method: str = "rounds") -> DataFrame:
    """``items(rank)``, ``pairs(l, r, sim)`` between ranks (l's hits) -> ``(rank, seed)``; singletons kept.

    ``method``: ``rounds``, or ``loop``, the plain rule in one task, to compare with.
    """
    links = pairs.where((F.col("sim") >= threshold) & (F.col("l") < F.col("r"))).select(F.col("l").cast("long").alias("src"), F.col("r").cast("long").alias("dst")).distinct()
    items = items.select(F.col("rank").cast("long").alias("rank"))
    return _loop(items, links) if method == "loop" else _rounds(items, links)


def clusters_from(items: DataFrame, points: int, hits: Callable[[DataFrame, DataFrame], DataFrame], hits_a_round: int = HITS_A_ROUND, least: int = LEAST_CANDIDATES) -> DataFrame:
    """The clusters of ``seed_clusters`` without all pairs: ``items(rank, ..)`` -> ``(rank, seed)``.

    ``hits(candidates, left)``, rows of ``items`` both, gives ``(l, r)``: the ranks ``r`` among ``left`` that candidate ``l`` hits, of ``points`` at most.
    A round takes the first open items as candidates; whether one of them seeds depends on candidates alone, as earlier seeds
    have taken what they hit. What its seeds hit leaves with them. Candidates are as many as give ``hits_a_round``, by the hits of the round before.
    """
    left, done, wanted = written(items, "open"), [], max(least, hits_a_round // max(points, 1))
    while n := left.count():
        cut = None if wanted >= n else left.agg(F.percentile_approx("rank", wanted / n, 100_000)).first()[0]
        candidates = left if cut is None else left.where(F.col("rank") <= cut)
        found = written(hits(candidates, left).where("l < r").select("l", "r"), "hits")
        within = found if cut is None else found.where(F.col("r") <= cut)
        own = _rounds(candidates, within.select(F.col("l").alias("src"), F.col("r").alias("dst")).distinct())
        if cut is None:
            done.append(written(own, "clusters"))
            break
        own = written(own, "clusters")
        seeds = own.where("rank = seed").select("seed")
        taken = found.where(F.col("r") > cut).join(seeds, F.col("l") == F.col("seed"), "left_semi").groupBy(F.col("r").alias("rank")).agg(F.min("l").alias("seed"))
        done += [own, taken := written(taken, "clusters")]
        left = written(left.where(F.col("rank") > cut).join(taken.select("rank"), "rank", "left_anti"), "open")
        asked, got = own.count(), found.count()
        wanted = max(least, hits_a_round * asked // max(got, asked))
    if not done:
        return left.select("rank", F.col("rank").alias("seed"))
    return reduce(DataFrame.unionByName, done)
