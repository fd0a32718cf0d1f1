"""Stored tables: a folder of Parquet snapshots per table.

Appends go into the newest complete snapshot. A rewrite writes the next snapshot folder beside it,
so readers of the old one are not disturbed and a failed rewrite leaves nothing visible: only a
folder with a _SUCCESS mark counts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.schemas import TABLES
from codelake.sources.buckets import FOLDERS, BucketTable


class TableMissing(ValueError):
    pass


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshots(self, table: str) -> list[str]:
        fs, folder = self._fs(), self._path(f"{self.root}/{table}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(n for n in names if n.startswith("v")
                      and fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def bucketed(self, table: str) -> BucketTable:
        """The table of that name, one of those in schemas.TABLES, kept in buckets of files."""
        spec = TABLES[table]
        return BucketTable(self.spark, f"{self.root}/{table}", spec.schema, list(spec.sort_by))

    def _in_buckets(self, table: str) -> BucketTable | None:
        fs, folder = self._fs(), self._path(f"{self.root}/{table}")
        if table not in TABLES or not fs.exists(folder):
            return None
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return self.bucketed(table) if any(n.startswith(f"{FOLDERS[0]}=") for n in names) else None

    def exists(self, table: str) -> bool:
        return bool(self._in_buckets(table) or self._snapshots(table))

    def location(self, table: str) -> str:
        snapshots = self._snapshots(table)
        if not snapshots:
            raise TableMissing(f"table {table} does not exist")
        return f"{self.root}/{table}/{snapshots[-1]}"

    def _next(self, table: str) -> str:
        snapshots = self._snapshots(table)
        number = int(snapshots[-1][1:]) + 1 if snapshots else 1
        return f"{self.root}/{table}/v{number:08d}"

    def read(self, table: str) -> DataFrame:
        """The newest snapshot, with the types it was written with: values of partition folders are
        not guessed anew."""
        buckets = self._in_buckets(table)
        if buckets:
            return buckets.read()
        location = self.location(table)
        reader, note = self.spark.read, self._path(f"{location}/_schema.json")
        if self._fs().exists(note):
            text = self.spark._jvm.java.util.Scanner(self._fs().open(note), "UTF-8")
            reader = reader.schema(T.StructType.fromJson(json.loads(text.useDelimiter("\\A").next())))
            text.close()
        return reader.parquet(location)

    def _note_schema(self, location: str, schema: T.StructType) -> None:
        """Keep the schema beside the files; names with an underscore are no data to Spark."""
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        out = self._fs().create(self._path(f"{location}/_schema.json"), True)
        out.writeBytes(json.dumps(plain.jsonValue()))
        out.close()

    def _partition_columns(self, table: str) -> list[str]:
        fs, folder, names = self._fs(), self._path(self.location(table)), []
        while True:
            inner = [s.getPath() for s in fs.listStatus(folder)
                     if s.isDirectory() and "=" in s.getPath().getName()]
            if not inner:
                return names
            names.append(inner[0].getName().split("=")[0])
            folder = inner[0]

    def append(self, table: str, df: DataFrame, create: bool = True,
               schema: T.StructType | None = None, sort_by: list[str] | None = None,
               partition_by: list[str] | None = None) -> int:
        """Add rows and return how many; the first append fixes the schema.

        Later rows are aligned by name: missing columns become NULL, extra ones are dropped. An
        empty batch creates no table.
        """
        there = self.exists(table)
        if not there and not create:
            raise TableMissing(f"table {table} does not exist")
        target = self.read(table).schema if there else (schema or df.schema)
        partition_by = self._partition_columns(table) if there else (partition_by or [])
        rows = df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target])
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if partition_by and rows.select(*partition_by).distinct().limit(tasks + 1).count() > tasks:
            # more folders than tasks: else every task would write a file into every folder. The number is told,
            # because small rows would be coalesced to a task that writes all the files alone.
            rows = rows.repartition(tasks, *partition_by)
        if sort_by or partition_by:
            rows = rows.sortWithinPartitions(*partition_by, *(sort_by or []))
        written = Observation()
        out = rows.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append")
        if partition_by:
            out = out.partitionBy(*partition_by)
        path = self.location(table) if there else self._next(table)
        out.parquet(path)
        added = written.get["rows"]
        if not there:
            if added:
                self._note_schema(path, target)
            else:
                self._fs().delete(self._path(path), True)
        return added

    def replace(self, table: str, df: DataFrame, sort_by: list[str] | None = None,
                partition_by: list[str] | None = None) -> None:
        """Write a new snapshot of the whole table; `df` may read the old one."""
        rows = df.sortWithinPartitions(*sort_by) if sort_by else df
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if partition_by:
            out = out.partitionBy(*partition_by)
        path = self._next(table)
        out.parquet(path)
        self._note_schema(path, rows.schema)

    def delete_where(self, table: str, equals: dict | None = None,
                     delete_all: bool = False) -> int:
        """Delete by AND of equalities and return the number of rows removed."""
        if not equals and not delete_all:
            raise ValueError("give conditions or delete_all=True")
        buckets = self._in_buckets(table)
        if buckets:
            return buckets.delete_where(equals or {})
        df = self.read(table)
        hit = matches(equals) if equals else F.lit(True)
        removed = df.where(hit).count()
        if not removed:
            return 0
        self.replace(table, rows_without(df, equals, delete_all),
                     partition_by=self._partition_columns(table))
        return removed

    def views(self) -> list[str]:
        """Expose every stored table as a temporary view for free SQL."""
        fs, names = self._fs(), []
        for status in fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if status.isDirectory() and self.exists(name):
                self.read(name).createOrReplaceTempView(name)
                names.append(name)
        return sorted(names)

    def sql(self, query: str) -> DataFrame:
        self.views()
        return self.spark.sql(query)


def matches(equals: dict) -> Column:
    """True where every column equals its value; a NULL never matches."""
    parts = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in equals.items()]
    return reduce(lambda a, b: a & b, parts)


def rows_without(df: DataFrame, equals: dict | None, delete_all: bool = False) -> DataFrame:
    """What a delete leaves behind."""
    if not equals and not delete_all:
        raise ValueError("give conditions or delete_all=True")
    return df.where(~matches(equals)) if equals else df.where(F.lit(False))


def read_rows(df: DataFrame, key: list[str], limit: int = 1000, offset: int = 0,
              since=None, time_column: str | None = None) -> DataFrame:
    """One page of a table in key order, optionally from a point in time on."""
    if since is not None:
        df = df.where(F.col(time_column) >= F.lit(since))
    return df.orderBy(*key).offset(offset).limit(limit)


def infer_schema(df: DataFrame, json_column: str) -> DataFrame:
    """(key, type, row_count) for a column of JSON records, from all rows of the column.

    A key has one type that holds all its values. Records that are no JSON are counted in a row of
    their own, with no key and type MALFORMED.
    """
    records = df.select(F.try_parse_json(json_column).alias("_record"), F.col(json_column).alias("_text"))
    fields = records.where("_record IS NOT NULL").lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_record").outer()))
    typed = (fields.groupBy("key").agg(F.schema_of_variant_agg("value").alias("type"),
                                       F.count(F.lit(1)).alias("row_count")))
    broken = (records.where("_record IS NULL AND _text IS NOT NULL").agg(F.count(F.lit(1)).alias("row_count"))
              .where("row_count > 0"))
    return typed.unionByName(broken.select(F.lit(None).cast("string").alias("key"),
                                           F.lit("MALFORMED").alias("type"), "row_count"))


def store_totals(stats: DataFrame) -> DataFrame:
    """Tables, rows and bytes over all tables of table_stats."""
    return stats.agg(F.count(F.lit(1)).alias("table_count"),
                     F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
                     F.coalesce(F.sum("byte_size"), F.lit(0)).alias("byte_size"))


def table_stats(tables: dict[str, DataFrame], skip: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """Rows, columns and bytes per table in one frame, metadata tables left out."""
    parts = []
    for name, df in tables.items():
        if name in skip:
            continue
        files = (df.select("*", F.col("_metadata.file_path").alias("_f"),
                           F.col("_metadata.file_size").alias("_b"))
                 .groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.max("_b").alias("b")))
        parts.append(files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                               F.coalesce(F.sum("b"), F.lit(0)).alias("byte_size"))
                     .select(F.lit(name).alias("table_name"), "row_count",
                             F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                             "byte_size"))
    return reduce(DataFrame.unionByName, parts)


#: CSV that reads back as it was: quotes doubled, values over several lines, null unlike empty.
CSV = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False}


def import_rows(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV).option("multiLine", True)
    return reader.format(fmt).load(path)


def import_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON or CSV files: a record that is broken, or has a value that does not fit the
    schema, is a reject (file_path, record) and no row. Both together are the records of the files."""
    bad = "_record"
    while bad in schema.names:
        bad += "_"
    reader = (spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())]))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad))
    if fmt == "csv":
        reader = reader.options(**CSV).option("multiLine", True)
    # The reader refuses queries that ask for the record alone, so every query asks for all columns.
    parsed = F.xxhash64(*schema.names) >= F.lit(-(1 << 63))
    records = reader.format(fmt).load(path).where(parsed)
    rejects = records.where(F.col(bad).isNotNull()).select(
        F.col("_metadata.file_path").alias("file_path"), F.col(bad).alias("record"))
    return records.where(F.col(bad).isNull()).select(schema.names), rejects


def export_rows(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.options(**CSV)
    writer.format(fmt).save(path)
