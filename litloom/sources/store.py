"""Parquet store: immutable folders, and commits that publish changes of several tables together.

Writers only add folders (``d=N``, or ``v=N`` for a whole table). What is visible is what the newest file in
``_commits`` lists, so readers have a snapshot and a lost writer leaves nothing: running it again gives the
state of one clean run. A commit file is created only if it is not there yet; of two writers that
start from one commit the second is refused.

A table with a key is dealt to hash buckets, a folder each within ``d=N``. The commit names the folders of every bucket, so an
upsert reads and writes only the buckets its keys fall into, an insert only adds to them, and a lookup reads one. The number of buckets
doubles with the rows, which keeps a bucket's size, and with it the work of a small batch, bounded.

A commit may carry the number of a stream's micro-batch; a number that is not above the last one is a repetition.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from litloom.sources.schema import TABLES
from litloom.sources.shared import names_in, put_new, remove, text_in, written

#: Folders of a table or bucket before they are put together.
MOST_PARTS = 16
#: Rows of a bucket, on average, above which the number of buckets grows.
BUCKET_ROWS = 50_000
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Store:
    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    def _commits(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names_in(self.spark, f"{self.root}/_commits") if n.endswith(".json") and n[:-5].isdigit())

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/_commits/{number:012d}.json"

    def state(self) -> dict:
        """The newest commit."""
        numbers = self._commits()
        return json.loads(text_in(self.spark, self._commit_path(numbers[-1]))) if numbers else {"number": 0, "streams": {}, "tables": {}, "notes": {}}

    def _versions(self, table: str) -> list[tuple[int, str]]:
        """Number and name of the folders that make up the table, in order."""
        parts = self.state()["tables"].get(table, {}).get("parts", {})
        return sorted({(int(n[2:]), n) for p in parts.values() for n, _ in p})

    def exists(self, table: str) -> bool:
        return table in self.state()["tables"]

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The table as last committed, or an empty one with its schema; with ``keys`` (a column named as the key) only buckets these fall into."""
        return Transaction(self, self.state()).read(table, keys)

    def lookup(self, table: str, key: str) -> DataFrame:
        """Rows of one key, from its bucket; the filter reaches the Parquet scan."""
        return Transaction(self, self.state()).lookup(table, key)

    @contextmanager
    def transaction(self, stream: tuple[str, int] | None = None) -> Iterator[Transaction]:
        """Changes made within become visible together at its end, or not at all. ``stream``: name and number of a micro-batch."""
        t = Transaction(self, copy.deepcopy(self.state()), stream)
        yield t
        t.commit()

    def replace(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        with self.transaction() as t:
            t.replace(table, df, partition_by)

    def append(self, table: str, df: DataFrame) -> None:
        with self.transaction() as t:
            t.append(table, df)

    def insert_absent(self, table: str, df: DataFrame, key: str) -> None:
        """Rows whose key is not there yet; columns new to the table are added."""
        with self.transaction() as t:
            t.insert_absent(table, df, key)

    def upsert(self, table: str, df: DataFrame, key: str) -> None:
        with self.transaction() as t:
            t.upsert(table, df, key)

    def vacuum(self, keep: int = 10) -> None:
        """Removes commits but the last ``keep`` and folders none of these lists. No writer may be at work."""
        numbers = self._commits()
        for n in numbers[:-keep]:
            remove(self.spark, self._commit_path(n))
        used = set()
        for n in numbers[-keep:]:
            tables = json.loads(text_in(self.spark, self._commit_path(n)))["tables"]
            used |= {(t, name) for t, entry in tables.items() for p in entry["parts"].values() for name, _ in p}
        for table in names_in(self.spark, self.root):
            for name in names_in(self.spark, f"{self.root}/{table}"):
                if name[:2] in ("v=", "d=") and (table, name) not in used:
                    remove(self.spark, f"{self.root}/{table}/{name}")


class Transaction:
    def __init__(self, store: Store, state: dict, stream: tuple[str, int] | None = None) -> None:
        self.store, self.spark, self.state, self.stream = store, store.spark, state, stream
        #: Whether the micro-batch has been committed before.
        self.seen = stream is not None and stream[1] <= state["streams"].get(stream[0], -1)

    def commit(self) -> None:
        if self.seen:
            return
        if self.stream:
            self.state["streams"][self.stream[0]] = self.stream[1]
        self.state["number"] += 1
        if not put_new(self.spark, self.store._commit_path(self.state["number"]), json.dumps(self.state)):
            raise Conflict(f"commit {self.state['number']} of {self.store.root} is there already")

    @property
    def notes(self) -> dict:
        """Small values kept with the commit."""
        return self.state["notes"]

    def _entry(self, table: str) -> dict | None:
        return self.state["tables"].get(table)

    def _path(self, table: str, name: str) -> str:
        return f"{self.store.root}/{table}/{name}"

    def _scan(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        entry = self._entry(table)
        if entry is None:
            return self.spark.createDataFrame([], TABLES[table])
        schema = StructType.fromJson(entry["schema"])
        if entry["key"] is None:
            parts = [self.spark.read.schema(schema).parquet(self._path(table, n)) for n, _ in entry["parts"]["*"]]
            return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        wanted = entry["parts"] if buckets is None else [str(b) for b in buckets if str(b) in entry["parts"]]
        paths = [f"{self._path(table, n)}/{_BUCKET}={b}" for b in wanted for n, _ in entry["parts"][b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _touched(self, df: DataFrame, key: str, buckets: int) -> list[int]:
        """Buckets of the rows: at most as many as there are."""
        return sorted(r[0] for r in df.select(self._bucket(key, buckets)).distinct().collect())

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        entry = self._entry(table)
        if keys is None or entry is None or entry["key"] is None:
            return self._scan(table)
        return self._scan(table, self._touched(keys, entry["key"], entry["buckets"]))

    def lookup(self, table: str, key: str) -> DataFrame:
        entry = self._entry(table)
        if entry is None or entry["key"] is None:
            raise KeyError(f"{table} has no key")
        one = self.spark.createDataFrame([(key,)], f"`{entry['key']}` string")
        return self.read(table, one).where(F.col(entry["key"]) == key)

    def _name(self, table: str, kind: str) -> str:
        """The next folder; those of lost writers are passed over."""
        return f"{kind}={max((int(n[2:]) for n in names_in(self.spark, f'{self.store.root}/{table}') if n[:2] in ('v=', 'd=')), default=0) + 1}"

    def _put(self, table: str, name: str, df: DataFrame, *by: str) -> None:
        """Every folder of data is written here."""
        df.write.partitionBy(*by).parquet(self._path(table, name))

    @staticmethod
    def _typed(df: DataFrame, schema: StructType) -> DataFrame:
        """Columns of the table in its types."""
        types = {f.name: f.dataType for f in schema.fields}
        return df.select(*[F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) if types.get(f.name, f.dataType) != f.dataType else F.col(f"`{f.name}`") for f in df.schema.fields])

    def _merged_schema(self, table: str, df: DataFrame) -> StructType:
        """The table's columns, then those new to it."""
        entry = self._entry(table)
        old = StructType.fromJson(entry["schema"]) if entry else StructType.fromDDL(TABLES[table]) if table in TABLES else df.schema
        have = {f.name for f in old.fields}
        return StructType([*old.fields, *(f for f in df.schema.fields if f.name not in have)])

    def replace(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        name = self._name(table, "v")
        self._put(table, name, df, *partition_by)
        self.state["tables"][table] = {"schema": df.schema.jsonValue(), "key": None, "parts": {"*": [[name, None]]}}

    def append(self, table: str, df: DataFrame) -> None:
        """Writes the new rows only; after ``MOST_PARTS`` folders a whole one. The table has no key."""
        entry, schema = self._entry(table), self._merged_schema(table, df)
        if entry and entry["key"]:
            raise ValueError(f"{table} has a key: insert or upsert")
        if entry and len(entry["parts"]["*"]) > MOST_PARTS:
            self.replace(table, self._scan(table).unionByName(df, allowMissingColumns=True))
            return
        name = self._name(table, "d")
        self._put(table, name, self._typed(df, schema))
        parts = entry["parts"]["*"] if entry else []
        self.state["tables"][table] = {"schema": schema.jsonValue(), "key": None, "parts": {"*": [*parts, [name, None]]}}

    def _put_keyed(self, table: str, df: DataFrame, key: str, buckets: int) -> tuple[str, dict[str, int]]:
        """A folder of buckets and the rows of each; within a bucket rows are in key order, for lookups."""
        name = self._name(table, "d")
        df = self._typed(df, StructType.fromJson(self.state["tables"][table]["schema"])) if table in self.state["tables"] else df
        rows = df.withColumn(_BUCKET, self._bucket(key, buckets)).repartition(_BUCKET)
        self._put(table, name, rows.sortWithinPartitions(_BUCKET, key), _BUCKET)
        back = self.spark.read.schema(StructType([*df.schema.fields, StructField(_BUCKET, IntegerType())])).parquet(self._path(table, name))
        return name, {str(r[_BUCKET]): r["count"] for r in back.groupBy(_BUCKET).count().collect()}

    def _keyed(self, table: str, df: DataFrame, key: str) -> dict:
        """The table's entry, keyed from now on."""
        entry = self._entry(table)
        schema = self._merged_schema(table, df).jsonValue()
        if entry and entry["key"] not in (None, key):
            raise ValueError(f"{table} has the key {entry['key']}")
        if entry and entry["key"] is None:
            rows = self._scan(table)
            buckets = self._fit(rows.count())
            name, counts = self._put_keyed(table, rows, key, buckets)
            entry = {"key": key, "buckets": buckets, "parts": {b: [[name, n]] for b, n in counts.items()}}
        entry = self.state["tables"][table] = dict(entry or {"key": key, "buckets": 1, "parts": {}}, schema=schema)
        return entry

    def _fit(self, rows: int) -> int:
        buckets = 1
        while rows > buckets * self.store.bucket_rows:
            buckets *= 2
        return buckets

    def _settle(self, table: str) -> None:
        """Doubles the buckets of a grown table; puts the folders of buckets with many together."""
        entry = self._entry(table)
        total = sum(n for p in entry["parts"].values() for _, n in p)
        if self._fit(total) > entry["buckets"]:
            buckets = 2 * self._fit(total)  # with room, so that growth costs a constant a row
            name, counts = self._put_keyed(table, self._scan(table), entry["key"], buckets)
            entry |= {"buckets": buckets, "parts": {b: [[name, n]] for b, n in counts.items()}}
        elif many := [int(b) for b, p in entry["parts"].items() if len(p) > MOST_PARTS]:
            name, counts = self._put_keyed(table, self._scan(table, many), entry["key"], entry["buckets"])
            entry["parts"] |= {str(b): [[name, counts[str(b)]]] for b in many}

    def merge(self, table: str, df: DataFrame, key: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``how(old, new)`` of the buckets the rows fall into takes their place; all other buckets stay untouched."""
        entry = self._keyed(table, df, key)
        if entry["parts"]:
            df = written(df, "delta")  # read twice, and must be the same
        touched = self._touched(df, key, entry["buckets"]) if entry["parts"] else []
        merged = how(self._scan(table, touched), df)
        entry["schema"] = self._merged_schema(table, merged).jsonValue()
        name, counts = self._put_keyed(table, merged, key, entry["buckets"])
        parts = {b: p for b, p in entry["parts"].items() if int(b) not in touched}
        entry["parts"] = parts | {b: [[name, n]] for b, n in counts.items()}
        self._settle(table)

    def recreate(self, table: str, df: DataFrame, key: str) -> None:
        """The rows as the whole table, with a key."""
        df = written(df, "whole")
        self.state["tables"].pop(table, None)
        self.state["tables"][table] = entry = {"schema": self._merged_schema(table, df).jsonValue(), "key": key, "buckets": self._fit(df.count()), "parts": {}}
        name, counts = self._put_keyed(table, df, key, entry["buckets"])
        entry["parts"] = {b: [[name, n]] for b, n in counts.items()}

    def insert_absent(self, table: str, df: DataFrame, key: str) -> None:
        entry = self._keyed(table, df, key)
        if entry["parts"]:
            df = written(df, "delta")
            df = absent(df, self._scan(table, self._touched(df, key, entry["buckets"])), key)
        name, counts = self._put_keyed(table, df, key, entry["buckets"])
        for b, n in counts.items():
            entry["parts"][b] = [*entry["parts"].get(b, []), [name, n]]
        self._settle(table)

    def upsert(self, table: str, df: DataFrame, key: str) -> None:
        self.merge(table, df, key, lambda old, new: upserted(old, new, key))


def absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole rows replaced by key; columns of either side are kept, absent ones null. Of repeated new keys one row stays, the same each time."""
    new = new.withColumn("__tie", F.xxhash64(*new.columns))
    old = old.withColumn("__tie", F.lit(0).cast("long"))
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__v"), "__tie")
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__v", "__n", "__tie")


def by_key(papers: DataFrame, arxiv_id: str) -> DataFrame:
    """Point lookup; the filter reaches the Parquet scan. No row: empty."""
    return papers.where(F.col("arxiv_id") == arxiv_id).limit(1)
