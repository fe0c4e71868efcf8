"""Secret scanning with corpus-wide ownership frequency (built-in functions only).

Candidates are found by pattern; their hashes are counted over the corpus by distinct
repositories (documents) and owners (sources). A value that many owners hold, or few owners in many
repositories, is a widely copied example or template; one held by few owners in few repositories looks live.
Generic tokens become spans only if they look live by that test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.common import quoted, text_of, written

#: Fixed values of the contract: pattern, group that is the value, least characters of the value, in the order of the kinds.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: The kind the method adds: tokens of 20 or more characters with letters and digits.
GENERIC = ("generic", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 0, 20)
#: More owners than this make a value a widely copied example.
MOST_OWNERS = 2
#: So do more repositories than this, whoever owns them: a key of one owner's own is in some of the owner's documents, not in dozens.
MOST_REPOSITORIES = 25


_FOUND = "array<struct<kind:int,nth:int,gap:int,size:int,hash:string>>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (kind, nth, gap, size, hash): leftmost matches that do not overlap, in order.

    ``gap`` is the number of code points since the match before, ``size`` that of the match; places are
    running sums of both, taken later. The pieces between matches come from a split by the same pattern.
    ``hash`` is that of the value, null for matches to be dropped.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("g"))

    def one(r: Column, nth: Column) -> Column:
        fits = F.length(r["v"]) >= least
        if kind == len(KINDS):
            fits = fits & r["v"].rlike("[0-9]") & r["v"].rlike("[A-Za-z]")
        value_hash = F.when(fits, F.sha2(r["v"], 256))
        return F.struct(F.lit(kind).alias("kind"), nth.alias("nth"), F.length(r["g"]).alias("gap"), F.length(r["m"]).alias("size"), value_hash.alias("hash"))

    return F.when(text.rlike(pattern), F.transform(rows, one)).otherwise(F.array().cast(_FOUND))


def candidates(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per distinct (document, span): id, text key, owner, span and hash of the value. Linear in the matches of a text."""
    kinds = (*KINDS, GENERIC)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("owner"), text_of(text_col).alias("text"))
    rows = rows.where(F.greatest(*[F.col("text").rlike(k[1]) for k in kinds]))
    found = F.concat(*[matches(F.col("text"), k[1], k[2], k[3], i) for i, k in enumerate(kinds)])
    doc = ["doc_id", "owner", "text_key"]
    # The text ends here: beside explode, its hash would be taken anew for every match.
    rows = rows.select("doc_id", "owner", F.xxhash64("text").alias("text_key"), found.alias("found"))
    rows = rows.select(*doc, F.explode("found").alias("s")).select(*doc, "s.*")
    # Repeated rows are one; then all matches of a document together, lengths and hashes only.
    rows = rows.distinct().repartition(*doc)
    upto = Window.partitionBy(*doc, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).where("hash is not null")
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    # A generic token goes if a base span overlaps it: one that begins before it, or the next one.
    base = F.col("kind") < len(KINDS)
    up = Window.partitionBy(*doc).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*doc).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reach", F.max(F.when(base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(base, F.col("start"))).over(down))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return rows.where(base | apart).select(*doc, "start", "kind", "end", F.col("hash").alias("value_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_repositories, n_owners``; counted in steps, so a value in every document is no hot group."""
    once = found.select("value_hash", "owner", "doc_id", "text_key").distinct()
    held = once.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, held_by``.

    ``held_by`` lists repositories and owners of the value of each span of ``spans`` as ``repositories:owners``, in the same order. Spans are ``kind:start:end`` in code points, by start, then kind. Null text is empty;
    a null source is an owner of its own; a row repeated with the same id, source and text is one
    repository and each copy gets its spans. Other columns are ignored; an empty table gives no rows.
    """
    found = written(candidates(docs, id_col, text_col, source_col), "candidates")
    known = found.join(ownership(found), "value_hash")
    known = known.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)).where(f"kind < {len(KINDS)} or live")
    per_doc = known.groupBy("doc_id", "owner", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "n_repositories", "n_owners"))).alias("s"))
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, GENERIC)])
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("owner").alias("o"), F.col("text_key").alias("k"), "s")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("owner"), F.xxhash64(text_of(text_col)).alias("text_key"))
    rows = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("owner").eqNullSafe(F.col("o")) & (F.col("text_key") == F.col("k")), "left")
    spans = F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_repositories:bigint,n_owners:bigint>>"))
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"] < 3)
    count = lambda test: F.size(F.filter(spans, test)).cast("long")

    def of_kind(i: int) -> Column:
        return count(lambda x: x["kind"] == i)

    counts = [of_kind(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)]
    held_by = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["n_repositories"].cast("string"), x["n_owners"].cast("string"))), ",")
    return rows.select(
        "doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"), held_by.alias("held_by"),
    )
