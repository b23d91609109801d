"""Filling containers of fixed capacity with items of varying length.

Vector best-fit: a container has a residual capacity in several dimensions at once (tokens, number of items, attention cost,
which is the sum of squared lengths); an item goes to the container whose weighted residual, after taking it, is nearest to
nothing, among those that can take it in every dimension. Items are packed longest first within groups of bounded size; what
ends in containers that are not full enough is packed again, regrouped with the leftovers of other groups.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage


@dataclass(frozen=True)
class Capacity:
    """Capacities per container, and the weight of each dimension in the residual norm."""

    tokens: int = 2048
    items: int = 256
    #: Sum of squared item lengths. The default is what one item of full length costs.
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)

    @property
    def longest(self) -> int:
        """The longest item that fits an empty container in every dimension."""
        return min(self.tokens, math.isqrt(self.attention))


def best_fit(lengths: list[int], cap: Capacity) -> list[int]:
    """Container number of every item, items taken longest first; a zero-length item needs only an item slot.

    Of the containers that can take the item in every dimension it goes to the one with the least weighted norm of what is then
    left in each; ties go to the fewer tokens left, then the lower number. Open containers are kept sorted by residual tokens,
    so those with room for the item's tokens are a suffix. The token part of the norm grows along it; the search stops when
    that part alone exceeds the best whole norm, so the choice is exact. A container that can take no item at all is closed.
    """
    wt, wi, wa = cap.weights
    open_: list[tuple[int, int]] = []  # (residual tokens, container), sorted
    items: list[int] = []
    cost: list[int] = []
    where = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        best, best_norm, best_at = -1, float("inf"), -1
        for at in range(bisect.bisect_left(open_, (n, -1)), len(open_)):
            room, c = open_[at]
            t = wt * ((room - n) / cap.tokens) ** 2
            if t >= best_norm:
                break
            left = cap.attention - cost[c] - n * n
            if left >= 0:
                norm = t + wi * (1 - (items[c] + 1) / cap.items) ** 2 + wa * (left / cap.attention) ** 2
                if norm < best_norm:
                    best, best_norm, best_at = c, norm, at
        if best < 0:
            best, room = len(items), cap.tokens
            items.append(0)
            cost.append(0)
        else:
            room = open_.pop(best_at)[0]
        items[best] += 1
        cost[best] += n * n
        where[k] = best
        if items[best] < cap.items:
            bisect.insort(open_, (room - n, best))
    return where


def pieces(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, token_start, n_tokens): one row per item, several only for an item over the capacity.

    An item over the capacity is cut into full pieces and a rest. Negative or null sizes count as 0.
    """
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(size / capacity).cast("long") - 1, F.lit(0).cast("long"))
    rows = df.select(F.col(id_col).alias("id"), size.alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return rows.select("id", "piece_no", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("_size") - start).alias("n_tokens"))


def fill_containers(
    df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", cap: Capacity = Capacity(), group_items: int = 5_000, full: float = 0.98, rounds: int = 3
) -> DataFrame:
    """(id, piece_no, token_start, n_tokens, container_id): where every item, or piece of one over the capacity, lies.

    Every row of `df` is placed, rows that repeat an id included; a row of size 0 takes an item slot and no tokens. An item that
    exceeds an empty container in tokens or attention is cut, into pieces as long as fit. Pieces that fill a container alone
    are not grouped at all. The others are hashed into groups of about
    `group_items`, so no task holds more than its group whatever the input; after each round containers filled to `full` or
    more stay, and the items of the others go into the next round, where groups are of the same size but fewer. The last
    round keeps everything. An empty table has no containers.
    """
    if cap.tokens < 1 or cap.items < 1 or cap.attention < 1:
        raise ValueError("a container must be able to hold an item")
    kind = df.schema[id_col].dataType.simpleString()
    # Row numbers are written with the rows: they name containers and spread rows that repeat an id.
    parts = cut_lineage(pieces(df, id_col, size_col, cap.longest).withColumn("_row", F.monotonically_increasing_id()))
    full_piece = (F.col("n_tokens") == cap.tokens) | (F.col("n_tokens") == cap.longest) & F.lit(cap.attention == cap.longest**2)
    whole = parts.where(full_piece).withColumn("container_id", F.concat_ws("-", F.lit("w"), "_row")).drop("_row")
    rest = parts.where(~full_piece)
    schema = f"id {kind}, piece_no long, token_start long, n_tokens long, _row long, container_id string, fill long"
    done = None
    for r in range(rounds):
        count = rest.count()
        if not count:
            break
        groups = max(1, -(-count // group_items))

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["n_tokens", "_row"], kind="stable", ignore_index=True)
            at = pd.Series(best_fit(rows["n_tokens"].tolist(), cap))
            fill = rows["n_tokens"].groupby(at).transform("sum")
            names = f"{r}-{key[0]}-" + at.astype(str)
            return rows[["id", "piece_no", "token_start", "n_tokens", "_row"]].assign(container_id=names, fill=fill)

        group = F.pmod(F.xxhash64("_row", F.lit(r)), F.lit(groups))
        packed = cut_lineage(rest.withColumn("_group", group).groupBy("_group").applyInPandas(pack, schema))
        final = r == rounds - 1 or groups == 1
        keep = packed if final else packed.where(F.col("fill") >= full * cap.tokens)
        done = keep if done is None else done.unionByName(keep)
        if final:
            break
        rest = packed.where(F.col("fill") < full * cap.tokens).drop("container_id", "fill")
    out = whole if done is None else whole.unionByName(done.drop("fill", "_row"))
    return out.withColumnRenamed("id", id_col)
