"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight; within a source the
smallest keys come first (a weighted sample without replacement) until the source's word
budget is used. Complete epochs come before the fractional selection. Prefix sums are
taken in two levels (key bins of a source, then documents of a bin), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.common import given, quoted, renamed, text_of, written

#: Fixed values of the contract: weights dealt to the sources in order, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Key bins of a source.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def default_quality(size: Column, chars: Column) -> Column:
    """Weight in [0.25, 1]: lower the further the mean word length is from six characters."""
    mean = chars.cast("double") / F.greatest(size, F.lit(1))
    return F.lit(0.25) + F.lit(0.75) * F.exp(-F.abs(mean - 6.0) / 3.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> plus ``target``: shares of all words by weight, each at most ``most`` times its source.

    Water filling: sources sorted by the level at which their cap binds; the level of the
    others follows from the weight that is left. One row a source.
    """
    named = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = named.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("__bind", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__bind", "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("__total", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
    rows = rows.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    free = F.min(F.when(F.col("__level") <= F.col("__bind"), F.struct("__bind", "__rank", "__level"))).over(Window.partitionBy())
    rows = rows.withColumn("__free", free)
    target = F.when(F.col("__free").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__free.__level")))
    return rows.select("source", "source_size", target.alias("target"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality: Column | None, names: list[str]) -> DataFrame:
    """``names`` under private names, and the id, text key, source, size, key and bin of every row."""
    text = text_of(text_col)
    rows = docs.select(
        *renamed(names), quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), quoted(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.length(text).alias("chars"), (quality if quality is not None else F.lit(None).cast("double")).alias("quality"),
    )
    weight = F.greatest(F.coalesce("quality", default_quality(F.col("size"), F.col("chars"))), F.lit(1e-9))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), "doc_id", "text_key"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.withColumn("key", -F.log(unit) / weight).drop("chars", "quality")
    return rows.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int"))


def _plan(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row for all equal rows: ``doc_id, text_key, source, size, key, times`` and what decides their copies."""
    # Equal rows are counted before anything is gathered by source or bin.
    rows = rows.groupBy("doc_id", "text_key", "source", "size", "key", "bin").agg(F.count("*").alias("times"))
    rows = written(rows.withColumn("all", F.col("size") * F.col("times")), "mix")
    bins = rows.groupBy("source", "bin").agg(F.sum("all").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    prior = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "bin", F.coalesce(F.sum("bin_size").over(prior), F.lit(0)).alias("before"))
    more = ["source_size", "target", "epochs", "rest"]
    named = bins.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "bin", "before", *more)
    same = F.col("r.source").eqNullSafe(F.col("n.source")) & (F.col("r.bin") == F.col("n.bin"))
    out = rows.alias("r").join(named.alias("n"), same).select("r.*", "before", *more)
    at = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("ahead", F.col("before") + F.sum("all").over(at) - F.col("all"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, source, size, source_size, target, taken, copies``.

    The document at the budget's edge gives only its first words, so a source's ``taken`` meets its
    target. ``copies`` counts whole or partial copies. Null texts have size 0 and are never taken; a
    null source is a source of its own, the last; equal keys are ordered by id, then text; rows with
    one id, text and source follow each other. Other columns are ignored; an empty table gives no rows.
    """
    out = _plan(_drawn(docs, id_col, text_col, source_col, seed, quality, []), weights)
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    left = F.col("rest") - F.col("ahead") - F.col("nth") * F.col("size")
    out = out.withColumn("extra", F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long"))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("extra") > 0).cast("long")).otherwise(0).alias("copies")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", taken, copies)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None,
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, columns and their values as given.

    Whole documents: the one at the budget's edge is taken or not, whichever is nearer. Texts without words,
    null ones included, are never taken. Null ids are ids like any other. Rows with one id, text and source
    are counted together; where only some of them are taken once more, a hash of the whole row decides which.
    """
    rows = _drawn(docs, id_col, text_col, source_col, seed, quality, docs.columns)
    plan = _plan(rows, weights).where("size > 0")
    # The k-th of equal rows is taken once more if the middle of it lies before the budget's edge.
    more = F.floor((2 * (F.col("rest") - F.col("ahead")) - F.col("size")) / (2 * F.col("size"))) + 1
    plan = plan.withColumn("more", F.least(F.greatest(more, F.lit(0)), F.col("times"))).where("epochs > 0 or more > 0")
    plan = written(plan.select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "text_key", "source", "key", "times", "epochs", "more")]), "plan")
    same = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("text_key") == F.col("p_text_key")) & F.col("source").eqNullSafe(F.col("p_source"))
    if quality is not None:  # else the key follows from the text, and words need not be counted again
        same &= F.col("key") == F.col("p_key")

    mine = [c for c in rows.columns if c.startswith("__c")]

    def copied(out: DataFrame, once_more: Column) -> DataFrame:
        out = out.withColumn("copies", F.col("p_epochs") + once_more.cast("long")).where("copies > 0")
        return out.select(*mine, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))

    # At most one group of equal rows a source lies across the edge.
    across = (F.col("p_more") > 0) & (F.col("p_more") < F.col("p_times"))
    out = copied(rows.join(plan.where(~across), same), F.col("p_more") > 0)
    if not plan.where(across).isEmpty():
        order = Window.partitionBy("p_doc_id", "p_text_key", "p_source", "p_key").orderBy(F.xxhash64(*mine))
        some = rows.join(plan.where(across), same).withColumn("nth", F.row_number().over(order))
        out = out.unionByName(copied(some, F.col("nth") <= F.col("p_more")))
    return out.select(*given(docs.columns))
