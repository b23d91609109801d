"""Per-key results where a few keys own most rows.

Rows are range-partitioned on the composite of key and order, with quantiles that Spark samples from the data; a heavy key
thus spreads over as many partitions as its rows need. Each partition, sorted, yields a partial state per key; only keys that
cross a partition boundary have more than one, and those few states are stitched by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def range_split(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """`df` range-partitioned and sorted by key and order; no key, however heavy, is bound to one partition.

    Equal composites stay together, so the order should end in something nearly unique.
    """
    by = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def first_per_key(df: DataFrame, key: str, item: str, order: str, n: int = 3, partitions: int | None = None) -> DataFrame:
    """Rows (key, item): for every key its `n` items with the least `order`, ties by the lesser item, each item once.

    An item's place is its least `order` under that key. Rows with a null or blank key, a null item or a null order have no
    place and are left out; a key with fewer than `n` items has all of them. Extra columns are not read.

    A partition of the sorted range needs only its own first `n` distinct items of a key: an item in the overall first `n`
    has its least order in some partition, and whatever precedes it there precedes it overall. So the stitch sees at most
    `n` rows per key and partition.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    blank = F.trim(F.col(key)) == "" if isinstance(fields[key], T.StringType) else F.lit(False)
    keyed = F.col(key).isNotNull() & ~blank & F.col(item).isNotNull() & F.col(order).isNotNull()
    rows = df.where(keyed).select(F.col(key).alias("k"), F.col(item).alias("i"), F.col(order).alias("o"))
    schema = T.StructType([T.StructField("k", fields[key]), T.StructField("i", fields[item]), T.StructField("o", fields[order])])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None  # the states of the last key, which the next batch may go on with
        for batch in batches:
            rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            kept = rows.drop_duplicates(["k", "i"])
            kept = kept[kept.groupby("k", sort=False).cumcount() < n]
            if not len(kept):
                continue
            last = kept["k"].iloc[-1]
            open_ = (kept["k"] == last).to_numpy()
            carry = kept[open_]
            if not open_.all():
                yield kept[~open_]
        if carry is not None:
            yield carry

    states = range_split(rows, "k", ["o", "i"], partitions).mapInPandas(partial, schema)
    # Stitch: at most n rows per key and partition; the aggregate keeps an item that two partitions hold once.
    once = states.groupBy("k", "i").agg(F.min("o").alias("o"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("o", "i")))
    return ranked.where(F.col("_r") <= n).select(F.col("k").alias(key), F.col("i").alias(item))


def rank_per_key(df: DataFrame, key: str, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """`df` with each row's place within its key by `order` (1, 2, ...; nulls first), without a task that holds a whole key.

    Rows that tie in all of `order` get consecutive places in an unspecified order, so end it in a unique column for a
    repeatable result. Null keys form a key of their own. The name of the new column must not be one of `df`'s.

    The partial state of a partition is its row count per key; the rows that come before a partition's share of a key are the
    sum over the partitions before it. Only keys that cross a boundary have more than one such state, so the table of offsets
    has at most one row per key and partition and is joined back on both.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    pid, at = "_corvane_pid", "_corvane_at"
    ranged = range_split(df, key, order, partitions).withColumn(pid, F.spark_partition_id())
    # The layout is an input to both branches below: it is written once, so that both see the same partitions.
    from corvane.session import cut_lineage

    fixed = cut_lineage(ranged.withColumn(at, F.monotonically_increasing_id()))
    counts = fixed.groupBy(pid, F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.min(at).alias("_least"))
    before = Window.partitionBy("_k").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(pid).alias("_p"), "_k", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = fixed.join(offsets, (F.col(pid) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    place = F.col("_before") + F.col(at) - F.col("_least") + 1
    return joined.select(*[F.col(c) for c in df.columns], place.alias(name))
