"""Rows of files, kept in folders by hash of the project and of the path.

A table is Parquet under `_project=.../_bucket=.../`; both are hashes, computed from project_id and file_path,
which stay in the files. Their number is fixed for a table, so many small projects don't make many small
files, while a project is looked for in one of the first and a file in one of the second. Readers get the
schema they are told, so nothing is kept beside the data. Replacing or deleting the rows of some files rewrites
the folders of these files and no others, by Spark's dynamic partition overwrite: the old rows of a folder are
read, the new ones written beside them, and all folders are exchanged when the job commits. A rewritten folder
also gets one row without a path, which readers leave out: so a folder that loses its last row is overwritten
like any other.

A rewrite that is run again leaves the same rows. The numbers of folders are chosen when the first rows are
written and must stay the same. A reader that was planned before a rewrite must be planned anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["project_id", "file_path"]
FOLDERS = ["_project", "_bucket"]
PROJECTS = 8  # folders that projects are dealt to
BUCKETS = 4  # folders that the files of each are dealt to


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sort_by: list[str] | None = None,
                 projects: int = PROJECTS, buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path, schema
        self.sort_by, self.projects, self.buckets = list(sort_by or KEY), projects, buckets

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _folder(self, name: str, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(getattr(self, name))).cast("int")

    def _folders(self) -> list[Column]:
        return [self._folder("projects", F.col("project_id")).alias("_project"),
                self._folder("buckets", F.col("file_path")).alias("_bucket")]

    def _stored(self) -> DataFrame:
        """All rows with their folders; reading is planned anew at each call."""
        whole = T.StructType([*self.schema.fields, *[T.StructField(f, T.IntegerType()) for f in FOLDERS]])
        if not self.exists():
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def _of(self, rows: DataFrame, equals: dict) -> DataFrame:
        """The rows in the folders that equalities of the key leave; hashes of constants are constants."""
        for column, folder, name in zip(KEY, FOLDERS, ("projects", "buckets"), strict=True):
            if column in equals:
                rows = rows.where(F.col(folder) == self._folder(name, F.lit(equals[column])))
        return rows

    def read(self, project: str | None = None, file_path: str | None = None) -> DataFrame:
        """The rows of the table, of a project or of a file; only their folders are opened."""
        equals = {k: v for k, v in zip(KEY, (project, file_path), strict=True) if v is not None}
        rows = self._of(self._stored(), equals).where("file_path IS NOT NULL")
        for column, value in equals.items():
            rows = rows.where(F.col(column) == value)
        return rows.select(self.schema.names)

    def append(self, rows: DataFrame) -> None:
        """Add rows; nothing is rewritten."""
        self._write(rows.select("*", *self._folders()), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        types = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        ids = [f.name for f in self.schema if isinstance(f.dataType, T.StringType) and f.name.endswith("_id")
               and f.name not in (*KEY, *self.sort_by)]
        # Digests in hex are most of the bytes and can't be compressed to less than half: they are shuffled as bytes.
        # unhex() gives NULL where a character is no digit, and such an id goes as it is.
        bytes_ = {f"_{c}": F.when((F.octet_length(c) == 64) & (F.lower(c) == F.col(c)), F.unhex(c)) for c in ids}
        packed = rows.select(*types, *FOLDERS).withColumns(bytes_).withColumns(
            {c: F.when(F.col(f"_{c}").isNull(), F.col(c)) for c in ids})
        # a bucket of any size becomes as many files as it needs
        (packed.hint("rebalance", *FOLDERS)
         .sortWithinPartitions(*FOLDERS, *self.sort_by)
         .select(*[F.coalesce(F.lower(F.hex(f"_{c}")), c).alias(c) if c in ids else c for c in self.schema.names], *FOLDERS)
         .write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(self.path))

    def _touched(self, keys: DataFrame) -> list[tuple[int, int]]:
        """The folders of some files, of a fixed number."""
        return [tuple(r) for r in keys.select(*self._folders()).distinct().collect()]

    def _inside(self, touched: list[tuple[int, int]]) -> Column:
        """Whether a row is in the touched folders, in a form that prunes them."""
        parts = [(F.col("_project") == p) & F.col("_bucket").isin(sorted(b for q, b in touched if q == p))
                 for p in sorted({p for p, _ in touched})]
        return reduce(lambda a, b: a | b, parts)

    def _rewrite(self, kept: DataFrame, touched: list[tuple[int, int]]) -> None:
        empty = self.spark.createDataFrame(touched, "_project int, _bucket int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], *FOLDERS)
        self._write(kept.unionByName(empty), "overwrite")

    def replace_files(self, rows: DataFrame, changed: DataFrame) -> None:
        """Old rows of the changed files go, their new rows come. A row in a folder that holds no changed file
        would replace what is there, so it ends the job."""
        touched = self._touched(changed)
        if not touched:
            return
        gone = changed.select(F.col("project_id").alias("_p"), F.col("file_path").alias("_f")).distinct()
        old = self._stored().where(self._inside(touched)).where("file_path IS NOT NULL")
        kept = old.join(gone, F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("file_path") == F.col("_f")),
                        "left_anti")
        # told while the rows are dealt to folders: as a filter it would be moved before the reader's own ones
        stray = F.raise_error(F.lit("a row of a file that is not among the changed ones")).cast("int")
        new = rows.select("*", *self._folders()).withColumn(
            "_bucket", F.when(self._inside(touched), F.col("_bucket")).otherwise(stray))
        self._rewrite(kept.select([*self.schema.names, *FOLDERS])
                      .unionByName(new.select([*self.schema.names, *FOLDERS])), touched)

    def delete_where(self, equals: dict) -> int:
        """Delete by AND of equalities (all rows, if there are none); only buckets that hold such a row are
        rewritten. The rows removed."""
        tests = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in equals.items()]
        hit = reduce(lambda a, b: a & b, tests, F.lit(True))
        rows = self._of(self._stored(), equals)
        found = (rows.where(hit & F.col("file_path").isNotNull()).groupBy(*FOLDERS)
                 .agg(F.count(F.lit(1)).alias("n")).collect())
        if found:
            touched = [(r["_project"], r["_bucket"]) for r in found]
            kept = self._stored().where(self._inside(touched)).where("file_path IS NOT NULL").where(~hit)
            self._rewrite(kept, touched)
        return sum(r.n for r in found)
