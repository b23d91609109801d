"""Writing tables: upserts, deletes by key, versions that are swapped in whole."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.parse import is_identifier


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last by `order`, which should end in something unique. Null keys are equal to one another."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """`existing` with the rows of `new` put over those of equal keys; new rows beat old ones, later ones of a batch earlier ones.

    A replaced row keeps its time of creation. Null keys are equal to one another, within a batch and across.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    out = both
    if created in existing.columns:
        out = out.withColumn(created, F.min(created).over(Window.partitionBy(*keys)))
    return last_wins(out, keys, [F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in order]]).drop("_new")


def delete_by_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """`rows` without those whose key is in `keys`."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_anti")


def replace_articles(existing: DataFrame, new: DataFrame, on: str = "shortname") -> DataFrame:
    """`existing` with all rows of the articles in `new` replaced; refuses an empty `new`."""
    if new.isEmpty():
        raise ValueError("nothing was parsed; the table stays as it is")
    return delete_by_keys(existing, new, [on]).unionByName(new)


class VersionedTable:
    """A table kept as numbered versions under a folder, with a pointer file to the one that readers see.

    A build writes the next version aside; the swap renames the pointer, so readers see the old or the new version whole.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        if not is_identifier(name):
            raise ValueError(f"{name!r} is no table name")
        self.spark, self.base = spark, f"{folder.rstrip('/')}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> int | None:
        fs, Path = self._fs()
        pointer = Path(f"{self.base}/CURRENT")
        if not fs.exists(pointer):
            return None
        return int(self.spark.read.text(str(pointer)).first()[0])

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.base} has no version yet")
        return self.spark.read.parquet(f"{self.base}/v={version}")

    def stage(self, df: DataFrame, force: bool = False) -> int:
        """Write the next version without showing it; an unfinished one is only replaced by force."""
        fs, Path = self._fs()
        version = (self.current() or 0) + 1
        target = Path(f"{self.base}/v={version}")
        if fs.exists(target) and not force:
            raise FileExistsError(f"version {version} is staged already")
        df.write.mode("overwrite").parquet(str(target))
        return version

    def swap(self, version: int, min_rows: int = 0, keep: int = 1) -> int:
        """Show a staged version if it has `min_rows` rows; returns their number. `keep` older versions stay for running readers."""
        rows = self.spark.read.parquet(f"{self.base}/v={version}").count()
        if rows < min_rows:
            raise ValueError(f"version {version} has {rows} rows, fewer than {min_rows}")
        fs, Path = self._fs()
        aside, pointer = Path(f"{self.base}/.CURRENT-{uuid.uuid4().hex}"), Path(f"{self.base}/CURRENT")
        out = fs.create(aside, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, pointer, options)
        for old in range(1, version - keep):
            fs.delete(Path(f"{self.base}/v={old}"), True)
        return rows


def append_by_day(df: DataFrame, path: str, time_col: str = "created_at") -> None:
    """Append rows, a folder per day."""
    df.withColumn("day", F.to_date(time_col)).write.mode("append").partitionBy("day").parquet(path)


def audit_rows(evidence: DataFrame, query: str = "query_id", key: str = "variation_id", score: str = "similarity", place: str = "place", model: str = "spark") -> DataFrame:
    """(query_id, retrieved_variant_ids, retrieval_scores, model_version): one row per question, ids and scores in order of place."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("rank"), F.col(key).alias("id"), F.round(score, 4).alias("score"))))
    rows = evidence.groupBy(query).agg(listed.alias("_l"))
    scores = F.to_json(F.transform("_l", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["rank"].alias("rank"))))
    return rows.select(query, F.transform("_l", lambda x: x["id"]).alias("retrieved_variant_ids"), scores.alias("retrieval_scores"), F.lit(model).alias("model_version"))


def auth_event(spark: SparkSession, event: str, client_ip: str | None, success: bool) -> DataFrame:
    """One row to append to the log of sign-ins."""
    return spark.createDataFrame([(event, client_ip, success, int(time.time()))], "event string, client_ip string, success boolean, at long")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def temporary_folder(spark: SparkSession, name: str) -> str:
    from corvane.session import checkpoint_dir

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
