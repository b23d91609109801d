"""Mixing sources to target weights.

The size of the mixture is the largest at which every source can still reach its share: a source of size S that may be
repeated m times gives at most m * S. Each document of a source then has the same expected number of copies, a whole part that
it surely gets and a fraction. Fractions become whole by pivotal dependent rounding: two parties trade mass along the line that
keeps their joint size until one of them is whole; which way is drawn so that expectations are kept. Longest first, a document
trades with all shorter ones of its source as one party, which can take up what a single partner could not; in the end the
shortest is left. The longest of a source come first, the others are hashed into leaves of bounded size; what a leaf leaves,
one fraction, is traded on in a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import broadcast_if_small, cut_lineage

_EPS = 1e-9


def pivot(fractions: list[float], sizes: list[float], draws: list[float]) -> tuple[list[int], int]:
    """Pivotal rounding in order: the copies (0 or 1) of every item but at most one, and that one's index or -1.

    `fractions` is changed in place: at the index returned it holds the fraction still open. The sum of fraction * size is
    kept at every step. Items of no size are settled on their own draw, as there is no mass to keep.
    """
    out = [0] * len(fractions)
    open_ = -1
    for k, f in enumerate(fractions):
        if f <= _EPS or f >= 1 - _EPS:
            out[k] = int(f >= 1 - _EPS)
        elif sizes[k] <= 0:
            out[k] = int(draws[k] < f)
        elif open_ < 0:
            open_ = k
        else:
            i, a, b = open_, sizes[open_], sizes[k]
            # Mass that can go from i to k, and from k to i, before one of them is 0 or 1.
            there, back = min(fractions[i] * a, (1 - f) * b), min((1 - fractions[i]) * a, f * b)
            move = there if draws[k] < back / (there + back) else -back
            fractions[i] -= move / a
            fractions[k] += move / b
            open_ = -1
            for j in (i, k):
                if _EPS < fractions[j] < 1 - _EPS:
                    open_ = j
                else:
                    out[j] = int(fractions[j] >= 0.5)
    return out, open_


def pivot_group(fraction: float, sizes: list[float], rest: float, draws: list[float]) -> tuple[list[int], int, float, float]:
    """Pivotal rounding of items that all have the same `fraction`, sizes falling, each against all that come after it as one party.

    `rest` is the size of further items of that fraction that follow. Gives the copies (0 or 1) of every item but at most one, that
    one's index or -1, its fraction, and the fraction that the further items have now. The sum of fraction * size is kept at every
    step, and every item's expectation; items of no size are settled on their own draw.
    """
    out = [0] * len(sizes)
    after = rest + sum(sizes)
    f, open_, left = fraction, -1, 0.0
    for k, a in enumerate(sizes):
        after -= a
        if f <= _EPS or f >= 1 - _EPS:
            out[k] = int(f >= 0.5)
        elif a <= 0:
            out[k] = int(draws[k] < f)
        elif after <= _EPS:
            open_, left = k, f
        else:
            # Mass that can go from the item to the others, and back, before one party is whole.
            there, back = min(f * a, (1 - f) * after), min((1 - f) * a, f * after)
            move = there if draws[k] < back / (there + back) else -back
            own = f - move / a
            f += move / after
            if _EPS < own < 1 - _EPS:
                open_, left = k, own  # the others are whole
            else:
                out[k] = int(own >= 0.5)
    return out, open_, left, min(1.0, max(0.0, f))


def plan_sources(sizes: DataFrame, targets: DataFrame, source: str = "source", total: float | None = None) -> DataFrame:
    """(source, target_share, size, n_docs, expected_copies): how often a document of each source is expected.

    Shares are divided by their sum over the sources that have both a positive target and a positive size; a source on one
    side only, or with a null or negative share, has 0 expected copies. Targets that repeat a source count once, by the
    greatest share. Without `total` the mixture is the largest that reaches every share; with it, a source that cannot reach its
    share within max_repeats gives what it can. A null max_repeats is 1.
    """
    t = targets.groupBy(source).agg(F.max("target_share").alias("_share"), F.max("max_repeats").alias("_cap"))
    s = sizes.groupBy(source).agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    both = s.join(t, source, "full_outer").withColumn("size", F.coalesce("size", F.lit(0))).where(F.col(source).isNotNull())
    wanted = (F.col("_share") > 0) & (F.col("size") > 0) & (F.coalesce("_cap", F.lit(1)) > 0)
    share = F.when(wanted, F.col("_share")).otherwise(0.0)
    # One row per source, already aggregated.
    everything = Window.partitionBy(F.lit(0))
    norm = both.withColumn("target_share", F.coalesce(share / F.nullif(F.sum(share).over(everything), F.lit(0.0)), F.lit(0.0)))
    reach = F.when(F.col("target_share") > 0, F.coalesce("_cap", F.lit(1)) * F.col("size") / F.col("target_share"))
    size = F.lit(float(total)) if total is not None else F.min(reach).over(everything)
    copies = F.least(F.coalesce("_cap", F.lit(1)).cast("double"), size * F.col("target_share") / F.col("size"))
    return norm.select(
        source, "target_share", "size", "n_docs", F.when(F.col("target_share") > 0, copies).otherwise(0.0).alias("expected_copies")
    )


def _node(rows: pd.DataFrame, seed: int, level: int, rest: float | None) -> pd.DataFrame:
    """`rows`, of one source, with whole copies, but for one open fraction at most; with `rest`, all have one fraction."""
    rows = rows.sort_values(["n_tokens", "_row"], ascending=[False, True], ignore_index=True)
    sizes, fraction = rows["n_tokens"].tolist(), rows["fraction"].tolist()
    # A generator of the node's own, fed in a fixed order: a repeated task decides alike.
    draws = np.random.Generator(np.random.Philox(key=[seed, (int(rows["_row"].min()) << 8) + level])).random(len(rows)).tolist()
    left, settled = np.zeros(len(rows)), np.ones(len(rows), bool)
    if rest is None:
        whole, open_ = pivot(fraction, sizes, draws)
        after, open_fraction = 0.0, fraction[open_]
    else:
        whole, open_, open_fraction, after = pivot_group(fraction[0], sizes, rest, draws)
    if open_ >= 0:
        left[open_], settled[open_] = open_fraction, False
    return rows.assign(base=rows["base"] + np.array(whole), fraction=left, settled=settled, after=after)


def _settle(rows: DataFrame, seed: int, leaf_rows: int, fan_in: int) -> DataFrame:
    """`rows` with the whole copies that pivotal rounding gives them added to `base`: longest, leaves, reduction tree, root.

    All rows of a source have one fraction; `size` is what they have together.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("settled", T.BooleanType()), T.StructField("after", T.DoubleType())])
    # The limit is applied before the shuffle as well (WindowGroupLimit).
    longest = Window.partitionBy("source").orderBy(F.col("n_tokens").desc(), "_row")
    ranked = rows.withColumn("_rank", F.row_number().over(longest))
    first = ranked.where(F.col("_rank") <= leaf_rows).drop("_rank")
    step = cut_lineage(first.groupBy("source").applyInPandas(lambda g: _node(g, seed, 0, max(0.0, float(g["size"].iloc[0]) - float(g["n_tokens"].sum()))), schema))
    settled, open_ = step.where("settled"), step.where("NOT settled")
    # What is left of a source shares the fraction that its longest have left it; sources that are done have none.
    after = broadcast_if_small(step.groupBy("source").agg(F.max("after").alias("_after")))
    beyond = rows.join(step.select("_row"), "_row", "left_anti").join(after, "source").withColumn("fraction", F.col("_after")).drop("_after")
    leaf = cut_lineage(beyond.groupBy("source", "_node").applyInPandas(lambda g: _node(g, seed, 1, 0.0), schema))
    settled, open_ = settled.unionByName(leaf.where("settled")), open_.unionByName(leaf.where("NOT settled"))

    def at(level: int):
        return lambda node: _node(node, seed, level, None)

    nodes, level = (open_.agg(F.max("_node")).first()[0] or 0) + 1, 1
    while True:
        # A node of the tree holds at most fan_in + 1 open rows of one source.
        level, nodes = level + 1, -(-nodes // fan_in)
        up = open_.drop("settled", "after").withColumn("_node", F.floor(F.col("_node") / fan_in).cast("int"))
        step = cut_lineage(up.groupBy("source", "_node").applyInPandas(at(level), schema))
        settled, open_ = settled.unionByName(step.where("settled")), step.where("NOT settled")
        if nodes <= 1:
            break
    # The root: one fraction per source at most, settled by its own draw.
    draw = F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    last = open_.withColumn("base", F.col("base") + F.when(draw < F.col("fraction"), 1).otherwise(0))
    return settled.unionByName(last).drop("settled", "after")


def mix(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", source: str = "source", total: float | None = None, seed: int = 7, leaf_rows: int = 20_000, fan_in: int = 16) -> DataFrame:
    """(id, source, n_tokens, copies, target_share, source_share): every row of `sizes` with the copies it was given.

    Over the draws of `seed` every row's copies have the expectation of its source, exactly. A source's total misses its target by
    no more than its last open document: the shortest, or one that outweighs all shorter ones of its source together.

    A row has floor or ceiling of its source's expected copies, never more than max_repeats; 0 is "not chosen" and stays in the
    result. source_share is what the source reached of the mixture's tokens. Rows whose source is null or has no target get
    0. Rows that repeat an id are rows of their own. Null sizes count as 0. An empty table gives an empty result.
    """
    known = sizes.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    # Written once with row numbers: tokens are counted once, and every retry of a task sees the same rows.
    rows = cut_lineage(known.withColumn("_row", F.monotonically_increasing_id()))
    plan = broadcast_if_small(plan_sources(rows, targets.withColumnRenamed(source, "source"), "source", total))
    copies = F.coalesce("expected_copies", F.lit(0.0))
    leaves = F.coalesce(F.ceil(F.col("n_docs") / leaf_rows), F.lit(1))
    shape = rows.join(plan, "source", "left").select(
        "id", "source", "n_tokens", "_row",
        F.floor(copies).cast("long").alias("base"),
        (copies - F.floor(copies)).alias("fraction"),
        F.pmod(F.xxhash64("_row", F.lit(seed)), leaves).cast("int").alias("_node"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )
    open_rows = F.col("fraction") > _EPS
    whole = shape.where(~open_rows).unionByName(_settle(shape.where(open_rows), seed, leaf_rows, fan_in)).drop("size")
    whole = cut_lineage(whole)
    reached = whole.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("_t"))
    reached = reached.withColumn("source_share", F.coalesce(F.col("_t") / F.nullif(F.sum("_t").over(Window.partitionBy(F.lit(0))), F.lit(0)), F.lit(0.0)))
    shares = broadcast_if_small(reached.select(F.col("source").alias("_s"), "source_share"))
    joined = whole.join(shares, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source), "n_tokens", F.col("base").alias("copies"), "target_share", "source_share")


def mixture_report(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, chosen_docs, tokens, source_share): one row per source on either side."""
    m = mixture.groupBy(source).agg(
        F.count("*").alias("n_docs"),
        F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("chosen_docs"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
        F.max("source_share").alias("source_share"),
        F.max("copies").alias("most_copies"),
    )
    t = targets.groupBy(source).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = {"n_docs": 0, "chosen_docs": 0, "tokens": 0, "source_share": 0.0, "target_share": 0.0, "most_copies": 0}
    return t.join(m, source, "full_outer").fillna(zero)
