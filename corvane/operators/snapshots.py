"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that may surround or separate words; Java's \s is ASCII without the (?U) flag.
_SPACES = r"(?U)\s+"

#: Up to so many distinct releases their order is sent to every task; beyond, it is joined.
MAX_BROADCAST_RELEASES = 10_000


def comparable_text(c: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), _SPACES, " ")), F.lit(""))


def current_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per `keys`: the one with the greatest `order`, nulls counting as the least.

    Rows that tie in `order` are decided by the greatest `values`, so that the choice does not hang on row order. It is a
    plain `max` of a struct: partial maxima are taken before the shuffle, so a key with many rows costs no more than others.
    """
    best = F.max(F.struct(*[F.col(c) for c in (*order, *values)])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in values])


def _neighbours(rows: DataFrame) -> DataFrame:
    """(_release, _next, _first) for each release present; a broadcast only if their number has been found to be small."""
    found = rows.select("_release").distinct()
    few = [r[0] for r in found.limit(MAX_BROADCAST_RELEASES + 1).collect()]
    if len(few) <= MAX_BROADCAST_RELEASES:
        few.sort()
        kind = rows.schema["_release"].dataType
        schema = T.StructType([T.StructField("_release", kind), T.StructField("_next", kind), T.StructField("_first", T.BooleanType())])
        pairs = [(a, b, i == 0) for i, (a, b) in enumerate(zip(few, [*few[1:], None]))]
        return F.broadcast(rows.sparkSession.createDataFrame(pairs, schema))
    later = Window.partitionBy(F.lit(0)).orderBy("_release")
    return found.select("_release", F.lead("_release").over(later).alias("_next"), F.lag("_release").over(later).isNull().alias("_first"))


def snapshot_changes(
    df: DataFrame,
    release: str,
    key: str,
    values: Sequence[str],
    loaded: str | None = None,
    compare=comparable_text,
) -> DataFrame:
    """Rows (release, key, change_type) that were added, removed or changed from each release to the next one present.

    Within a release the row with the latest `loaded` counts for a key; ties take the greatest values. `values` are compared
    after `compare`. Rows without release or key belong to no snapshot and are left out; an empty table, or one with a
    single release, has no changes; other columns, whatever their names, are not read.

    Every current row enters two comparisons: as the new state of its own release and as the old state of the next. EXCEPT ALL
    in both directions is one aggregation over that signed multiset: identical rows cancel, what is left with a positive sign
    is new EXCEPT ALL old, with a negative sign old EXCEPT ALL new. The two residues, as small as the change is, are then
    full-joined by key. All steps after the first shuffle keep its partitioning by key.
    """
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.select(
        F.col(release).alias("_release"),
        F.col(key).alias("_key"),
        (F.col(loaded) if loaded else F.lit(0)).alias("_loaded"),
        *[compare(F.col(v)).alias(n) for v, n in zip(values, names)],
    ).where(F.col("_release").isNotNull() & F.col("_key").isNotNull())
    current = current_rows(rows, ["_key", "_release"], ["_loaded"], names)

    state = current.join(_neighbours(rows), "_release")
    signed = state.select(
        "_key",
        *names,
        F.explode(F.array(
            F.struct(F.when(~F.col("_first"), F.col("_release")).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")),
        )).alias("_side"),
    ).select("_key", *names, F.col("_side.at").alias("_at"), F.col("_side.sign").alias("_sign")).where(F.col("_at").isNotNull())
    residue = signed.groupBy("_at", "_key", *names).agg(F.sum("_sign").alias("_n")).where(F.col("_n") != 0)
    new = residue.where(F.col("_n") > 0).select("_at", "_key", F.lit(True).alias("_new"))
    old = residue.where(F.col("_n") < 0).select("_at", "_key", F.lit(True).alias("_old"))
    joined = new.join(old, ["_at", "_key"], "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return joined.select(F.col("_at").alias(release), F.col("_key").alias(key), kind.alias("change_type"))
