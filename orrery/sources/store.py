"""Stored tables: writing, inserting once, upserting, scoped deletion, and the catalog of tables.

A store is a folder of Parquet versions with a pointer to the current one: a
rewrite goes to a new version and readers of the old one are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.normalise import clean_names, normalised
from orrery.operators.usage import append_once, merged


class Store:
    """One table at a path, with a fixed schema (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: list[str] = ()):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, list(partition)

    def _current(self) -> str | None:
        found = self.spark.read.schema("version string, at timestamp").json(f"{self.path}/versions") if self._exists(f"{self.path}/versions") else None
        row = found.orderBy(F.desc("at"), F.desc("version")).first() if found is not None else None
        return row["version"] if row else None

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        """The current rows; none before the first write."""
        version = self._current()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex[:12]}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.partitionBy(*self.partition).parquet(f"{self.path}/{version}")
        self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def insert_once(self, rows: DataFrame, key: str) -> None:
        """Adds rows whose key is new; repeats are left out, so a retry adds nothing."""
        old = self.read()
        self.replace(old.unionByName(append_once(old, rows.select(old.columns), key)))

    def upsert(self, rows: DataFrame, key: list[str], add: list[str] = ()) -> None:
        old = self.read()
        self.replace(merged(old, rows.select(old.columns), key, add))

    def delete(self, condition: Column) -> None:
        """Deletes rows for which the condition holds; those for which it is null stay."""
        self.replace(self.read().filter(~F.coalesce(condition, F.lit(False))))


def cascade(stores: list[Store], doc_ids: DataFrame) -> None:
    """Deletes documents from every store that has a doc_id, by an anti-join each."""
    for s in stores:
        s.replace(s.read().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"))


def chunk_id(project: Column, file: Column, page: Column, text: Column) -> Column:
    """A content key: the same chunk of a file has the same one."""
    return F.substring(F.sha2(F.concat_ws("|", project, file, page.cast("string"), text), 256), 1, 24)


CATALOG = "name string, corpus string, path string, columns array<string>, tags array<string>, rows long"


def register_catalog(spark: SparkSession, catalog: DataFrame, month_columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Views of all tables of a catalog, each Parquet path once, with ``_raw`` and ``_clean`` views where a month column is known.

    A catalog has a row a table, so its rows come to the driver; data do not.
    """
    out: dict[str, DataFrame] = {}
    for row in catalog.groupBy("path").agg(F.min_by("name", "name").alias("name")).orderBy("name").collect():
        frame = spark.read.parquet(row["path"])
        frame = frame.toDF(*clean_names(frame.columns))
        out[row["name"]] = frame
        if month := (month_columns or {}).get(row["name"]):
            raw = normalised(frame, month)
            out[f"{row['name']}_raw"], out[f"{row['name']}_clean"] = raw, raw.filter("not is_total_row")
    for name, frame in out.items():
        frame.createOrReplaceTempView(name)
    return out


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Tables, rows and distinct columns by corpus."""
    flat = catalog.select("corpus", "name", "rows", F.explode_outer("columns").alias("c"))
    per = flat.groupBy("corpus").agg(F.count_distinct("name").alias("tables"), F.count_distinct("c").alias("columns"))
    return per.join(catalog.groupBy("corpus").agg(F.sum("rows").alias("rows")), "corpus")
