"""Sharding by Hilbert-curve order: quantised metadata dimensions, curve index, runs cut into shards.

Rows near each other on the curve agree in most dimensions, so a run spans few values of each
and files can be pruned on any of them. A dimension is quantised by quantiles of its values in
their own order (names by their first bytes), so a range of cells is a range of values.

Ranks come from counts. Curve cells are fixed in number; a crowded cell is cut by hash into
pieces, a few for each shuffle partition, whose table is bounded by the number of partitions. Whole rows are
shuffled once, each piece to the partition its rank belongs to, and sorted there, so that every
file written from the result holds one run of the curve.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litloom.llm.common import dealt, given, quoted, renamed, shuffle_width, text_of, without

#: Bits of each dimension; three dimensions make 4,096 cells.
BITS = 4
#: Pieces for each shuffle partition.
PIECES = 8
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def hilbert_index(point: list[int], bits: int) -> int:
    """Index along the curve of a point with ``bits`` bits a coordinate (Skilling 2004, transposed form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def text_size(text_col: str = "text") -> Column:
    return (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long")


def name_value(col: str) -> Column:
    """The first six bytes of a name as a number: its order is the order of names. Null: -1."""
    lead = F.rpad(F.substring(F.hex(quoted(col).cast("string")), 1, 12), 12, "0")
    return F.coalesce(F.conv(lead, 16, 10).cast("long"), F.lit(-1).cast("long"))


def default_dimensions(size: Column) -> list[Column]:
    return [name_value("source"), name_value("lang"), size]


def quantised(rows: DataFrame, values: list[str], bits: int) -> Column:
    """One number of ``bits`` bits a column: how many quantiles lie below each value."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(v, share).alias(v) for v in values]).first()
    code = F.lit(0)
    for v in values:
        # A frequent value fills several quantiles, and the next one lies as many levels higher.
        above = Counter(cuts[v] or [])
        level = sum((F.when(F.col(v) > F.lit(c), F.lit(n)).otherwise(0) for c, n in sorted(above.items())), F.lit(0))
        code = code * (1 << bits) + level
    return code.cast("int")


def _small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table to broadcast; as Arrow, so that no Python worker is started for it."""
    kind = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return F.broadcast(spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind[t]) for i, (name, t) in enumerate(fields)})))


def shard(
    docs: DataFrame, shards: int = 8, law: str = "rows", id_col: str = "doc_id", text_col: str = "text",
    dimensions: list[Column] | None = None, bits: int = BITS, pieces: int = PIECES,
) -> DataFrame:
    """All rows and columns plus ``size, text_crc32, law, shard, slot, grown_shard, curve_index``, in order along the curve.

    ``rows``: runs of the curve with row counts at most one apart. ``bytes``: a row goes to the
    run in which the middle of its bytes falls. ``dimensions`` are numbers (source, language and
    size unless given); a null one lies in the lowest cell. Null texts have size 1 and the checksum of no bytes;
    repeated rows take a slot each (those of one id and text share a piece); an empty table gives
    no rows. Columns of the added names are replaced, all others stay as they are.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    names = without(docs.columns, ADDED)
    size, crc = text_size(text_col), F.crc32(text_of(text_col))
    values = dimensions or default_dimensions(size)
    marks = [f"__v{i}" for i in range(len(values))]
    tie = F.xxhash64(quoted(id_col), size, crc)
    rows = docs.select(*renamed(names), quoted(id_col).alias("__id"), size.alias("size"), crc.alias("text_crc32"), tie.alias("__tie"), *[v.alias(m) for v, m in zip(values, marks, strict=True)])
    rows = rows.withColumn("__code", quantised(rows, marks, bits)).drop(*marks)
    # One row a cell at most: bounded by the number of cells, whatever the input.
    counts = {r["__code"]: r["n"] for r in rows.groupBy("__code").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    aim, n_dims, mask = max(1, -(-total // (pieces * width))), len(values), (1 << bits) - 1
    cells = [(c, hilbert_index([c >> bits * (n_dims - 1 - i) & mask for i in range(n_dims)], bits), (max(1, -(-n // aim)) - 1).bit_length()) for c, n in counts.items()]
    rows = rows.join(_small_table(spark, cells, "__code int, curve_index int, __cut int"), "__code")
    rows = rows.withColumn("__sub", F.expr("shiftrightunsigned(__tie, 63 - __cut) div 2"))
    # At most two pieces for each one aimed at, and one a cell: bounded by the number of partitions.
    found = sorted(map(tuple, rows.groupBy("curve_index", "__sub").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()))
    code, table, before, before_bytes = dealt(width), [], 0, 0
    for index, sub, n, b in found:
        table.append((index, sub, before, before_bytes, code[before * width // total]))
        before, before_bytes = before + n, before_bytes + b
    placed = _small_table(spark, table, "curve_index int, __sub long, __first long, __first_bytes long, __to int")
    rows = rows.join(placed, ["curve_index", "__sub"]).repartition(width, "__to")
    at = Window.partitionBy("__to", "curve_index", "__sub").orderBy("__tie", "__id", "text_crc32")
    rows = rows.withColumn("__rank", F.col("__first") + F.row_number().over(at) - 1)
    if law == "rows":
        rows = rows.withColumn("shard", F.expr(f"cast(__rank * {shards} div {max(total, 1)} as int)"))
        rows = rows.withColumn("slot", F.expr(f"__rank - (shard * {total}L + {shards - 1}) div {shards}"))
    else:
        upto = F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__middle", 2 * (F.col("__first_bytes") + upto) - F.col("size"))
        run = F.floor(F.col("__middle").cast("double") * shards / (2.0 * max(before_bytes, 1)))
        rows = rows.withColumn("shard", F.least(run, F.lit(shards - 1)).cast("int"))
        first = rows.groupBy("shard").agg(F.min("__rank").alias("__shard_first"))
        rows = rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("__rank") - F.col("__shard_first"))
    return rows.select(*given(names), "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")
