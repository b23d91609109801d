"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

A table's hash of a unit vector x is floor((a.x + b) / w) for several Gaussian directions a, which are p-stable for the
Euclidean distance; for unit vectors that distance and the cosine order alike. A vector lies in its own bucket of every table
and also visits the buckets that a near vector would most likely have fallen into: those reached by moving the coordinates
that lie nearest to a cell border, in the order of the sum of squared distances to the borders, which is the order of
estimated success. Vectors that meet in a bucket are candidates. What most of them come to is an upper bound of their cosine,
from an outline of each vector that travels with its bucket entries; only candidates whose bound reaches the wanted cosine are
compared in full. The bound is never less than the cosine, so it loses nothing: the buckets alone decide what is found.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.retrieve import SLICE, RunningTop
from corvane.session import broadcast_if_small, cut_lineage, spread


@dataclass(frozen=True)
class Hashing:
    """Parameters of the index. Width is in units of Euclidean distance between unit vectors.

    With these values two vectors of cosine 0.95 share a bucket with a probability of 0.996 (64 dimensions), nearer ones with
    a greater one; the README has the recall by cosine.
    """

    tables: int = 8
    hashes: int = 11
    width: float = 1.2
    #: Buckets that a vector visits in each table besides its own.
    probes: int = 4
    seed: int = 11
    #: A bucket of about so many members is spread over tasks in blocks. Both ways compare exactly, so this sets no result.
    crowd: int = 2_048
    #: Vectors in a block of such a bucket.
    block: int = 4_096
    #: One record in so many is hashed ahead to find such buckets.
    sample: int = 16


#: Coordinates of a vector's outline; a last byte holds the length of the rest.
OUTLINE = 23


@lru_cache(8)
def _directions(h: Hashing, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(h.seed)
    a = rng.standard_normal((dim, h.tables * h.hashes)).astype(np.float32)
    b = rng.random(h.tables * h.hashes, dtype=np.float32) * h.width
    # The first coordinates of a random rotation, which the bound needs to be one.
    axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :OUTLINE]
    mix = rng.integers(1, 2**63 - 1, h.hashes, dtype=np.int64) | 1
    return a, b, axes, mix


@lru_cache(8)
def probe_sets(hashes: int, probes: int) -> np.ndarray:
    """The first `probes` sets of ranks to perturb, in estimated success order.

    A coordinate can move to the cell below or above; ranked by distance to the border, rank j of 2 * hashes has an expected
    squared distance that depends on j only, so the order of the sets is the same for every vector and is found once. A set
    that moves a coordinate both ways is left out.
    """
    m = 2 * hashes
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    high = 1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, low, high)
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < probes:
        c, s = heapq.heappop(heap)
        ranks = set(s)
        if not any(m - 1 - r in ranks for r in s):
            out.append([int(r in ranks) for r in range(m)])
        if s[-1] + 1 < m:
            heapq.heappush(heap, (c - cost[s[-1]] + cost[s[-1] + 1], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (c + cost[s[-1] + 1], (*s, s[-1] + 1)))
    return np.array(out, dtype=np.int64).reshape(len(out), m)


def bucket_keys(x: np.ndarray, h: Hashing, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: the own bucket first, then the probes in estimated success order."""
    a, b, _, mix = _directions(h, x.shape[1])
    n = len(x)
    at = ((x.astype(np.float32) @ a + b) / h.width).reshape(n, h.tables, h.hashes)
    cell = np.floor(at)
    frac = at - cell
    with np.errstate(over="ignore"):
        base = (cell.astype(np.int64) * mix).sum(-1)
        # Moving coordinate i by -1 or +1 changes the key by -mix[i] or +mix[i].
        out = np.empty((n, h.tables, 1 + probes), np.int64)
        out[:, :, 0] = base
        if probes:
            border = np.concatenate([frac, 1 - frac], axis=-1)  # distance to the border below, above
            delta = np.concatenate([-mix, mix])
            order = np.argsort(border, axis=-1, kind="stable")
            step = delta[order]
            for p, ranks in enumerate(probe_sets(h.hashes, probes)):
                out[:, :, 1 + p] = base + (step * ranks).sum(-1)
        # The table is part of the bucket.
        out = (out ^ (out >> 29)) * np.int64(-4658895280553007687) + np.arange(h.tables, dtype=np.int64)[None, :, None] * np.int64(7046029254386353131)
    return out


def _outline(x: np.ndarray, h: Hashing) -> np.ndarray:
    """(rows, 3) numbers of 64 bits: of each unit vector OUTLINE rotated coordinates in steps of 1/127, and the length of the rest, rounded up."""
    y = x.astype(np.float64) @ _directions(h, x.shape[1])[2]
    out = np.zeros((len(x), OUTLINE + 1), np.uint8)
    out[:, : y.shape[1]] = np.rint(np.clip(y, -1, 1) * 127).astype(np.int8).view(np.uint8)
    rest = np.sqrt(np.maximum(0, 1 + 1e-5 - (y * y).sum(1)))
    out[:, OUTLINE] = np.minimum(255, np.ceil(rest * 255)).astype(np.uint8)
    return out.view(np.int64)


def _unfold(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, their length, length of the rest) from the three columns of an outline."""
    raw = np.stack(columns, 1).view(np.uint8)
    q = raw[:, :OUTLINE].view(np.int8).astype(np.float32) / 127
    return q, np.sqrt((q * q).sum(1)), raw[:, OUTLINE].astype(np.float32) / 255


#: How far a coordinate's rounding can move the outline.
_ROUNDING = math.sqrt(OUTLINE) / 254


def _bound(a: tuple, b: tuple) -> np.ndarray:
    """No less than the cosine of two vectors, from their unfolded outlines.

    The product of the outlines, what their rounding can add to it, and the product of the lengths of the rests (Cauchy-Schwarz).
    """
    return (a[0] * b[0]).sum(1) + _ROUNDING * (a[1] + b[1] + _ROUNDING) + a[2] * b[2] + 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(column), -1)


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for every dimension among the lists of a column without nulls."""
    size = np.asarray(column.value_lengths())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, _matrix(column.take(pa.array(at)) if len(at) < len(column) else column)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1).astype(np.float32))


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, vkey, v): every usable vector divided by its length and rounded to six decimals; vkey is a digest of that.

    A vector that is null, empty, of length zero, or holds a null or a number that is not finite takes no part, nor does a
    row without id, nor, if `dim` is given, a vector of another dimension.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            size = np.asarray(vecs.value_lengths().fill_null(0))
            for d in np.unique(size[size > 0]) if dim is None else [dim]:
                at = np.flatnonzero((size == d) & np.asarray(ids.is_valid()))
                if not len(at):
                    continue
                flat = vecs.take(pa.array(at)).flatten()
                x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, d)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(1, keepdims=True)  # scaled first, so that squares neither vanish nor overflow
                    x = x / top
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                good = np.isfinite(x).all(1)
                at, grid = at[good], np.rint(x[good] * 1e6).astype(np.int32)
                keys = [md5(g.tobytes()).digest() for g in grid]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys, pa.binary()), _lists((grid / 1e6).astype(np.float32)) if len(grid) else pa.array([], pa.list_(pa.float32()))], ["id", "vkey", "v"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))).mapInArrow(clean, f"id {kind}, vkey binary, v array<float>")


def _candidates(entries: DataFrame, kind: str, min_cosine: float) -> DataFrame:
    """(a, b): pairs a < b that share a bucket and whose cosine may be `min_cosine` or more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is held is the bucket that may go on in the next batch, in the pieces it came in.
        held: list[list[np.ndarray]] = []

        def joined() -> list[np.ndarray]:
            return held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held)]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held and held[-1][0][-1] != cols[0][0]:
                yield from pairs(*joined())
                held = []
            cut = np.searchsorted(cols[0], cols[0][-1])
            if cut:
                held.append([c[:cut] for c in cols])
                yield from pairs(*joined())
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield from pairs(*joined())

    def pairs(bucket: np.ndarray, ids: np.ndarray, *outline: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1]
        size = np.diff(np.r_[start, len(bucket)])
        each = np.repeat(size, size)
        inside = (np.arange(len(bucket)) - np.repeat(start, size)).astype(np.int64)
        shape = _unfold(list(outline))
        # The j-th step compares every row with the one j places on in its bucket: all pairs, one vector operation each.
        x = np.arange(len(bucket))
        for step in range(1, int(size.max(initial=1))):
            x = x[inside[x] + step < each[x]]
            y = x + step
            near = _bound(tuple(c[x] for c in shape), tuple(c[y] for c in shape)) >= min_cosine
            p, q = ids[x[near]], ids[y[near]]
            if len(p):
                both = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0)
                both = both[both[:, 0] < both[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    together = entries.repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(meet, f"a {kind}, b {kind}")


def _crowd_pairs(crowds: DataFrame, reps: DataFrame, kind: str, h: Hashing, k: int, least: float) -> DataFrame:
    """(a, b) within crowded buckets: of every member the `k` nearest of each block, by exact cosines.

    A crowd of m vectors is cut into blocks of `h.block`; every two blocks meet in a task of their own, so no task holds the
    crowd and nothing is left out. The work grows with the square of a crowd's different directions, copies being one.
    """
    sizes = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / h.block).cast("int").alias("blocks"))
    # Members of one crowd are spread over its blocks by hash.
    placed = crowds.join(sizes, "crowd").withColumn("at", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.withColumn("o", other).select("crowd", "a", "at", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"))
    rows = met.join(reps.select(F.col("rep").alias("a"), "v"), "a")

    def nearest(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        x = np.stack(g["v"].to_numpy())
        ids, at = g["a"].to_numpy(), g["at"].to_numpy()
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        cos = x[left] @ x[right].T
        if i == j:
            np.fill_diagonal(cos, -2)
        out = []
        for c, l, r in ((cos, left, right), (cos.T, right, left)):
            if c.size:
                n = min(k, c.shape[1])
                best = np.argpartition(-c, n - 1, axis=1)[:, :n] if n < c.shape[1] else np.tile(np.arange(n), (len(c), 1))
                near = np.take_along_axis(c, best, 1) >= least - 1e-3
                out.append(np.stack([np.repeat(ids[l], n)[near.ravel()], ids[r][best.ravel()][near.ravel()]], 1))
        p = np.concatenate(out) if out else np.empty((0, 2), ids.dtype)
        return pd.DataFrame({"a": p.min(1), "b": p.max(1)}) if len(p) else pd.DataFrame({"a": ids[:0], "b": ids[:0]})

    return rows.groupBy("crowd", "i", "j").applyInPandas(nearest, f"a {kind}, b {kind}")


#: Copies of one vector that are joined to their class in one task.
HOT_CLASS = 200_000


def similar_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 5, min_cosine: float = 0.95, h: Hashing = Hashing(), dim: int | None = None) -> DataFrame:
    """(id, other, cosine, place): for every record its `k` most similar others, as far as their cosine is `min_cosine` or more.

    Places follow the cosine, ties the lesser id. Vectors are compared by direction to six decimals. Vectors that
    `clean_vectors` leaves out take no part; a record of several rows counts once, with the vector of the greatest digest.
    Vectors of different dimensions are not compared. Records are distinct ids; ids must be integers. An empty table has no neighbours; columns besides the two are not read.

    Copies, records of one direction, are one class. A class is hashed, visited and compared once, whatever its size; its
    members name one another by the lesser ids, and name members of other classes after them. So a vector that a third of
    all rows share costs no more than any other, and no pairs are made within it beyond the `k` of each record.
    """
    kind = df.schema[id_col].dataType.simpleString()
    clean = clean_vectors(df, id_col, vec_col, dim)
    record = clean.groupBy("id").agg(F.max("vkey").alias("vkey"))
    record = cut_lineage(record)
    by_id = Window.partitionBy("vkey").orderBy("id")
    # The limit is applied before the shuffle as well (WindowGroupLimit).
    least = record.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1)
    heads = least.groupBy("vkey").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = clean.groupBy("vkey").agg(F.first("v").alias("v"))
    reps = cut_lineage(heads.join(vectors, "vkey"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_dimension(b.column(1)):
                ids = b.column(0).to_numpy(zero_copy_only=False)[at]
                # Vectors of different dimensions never meet.
                with np.errstate(over="ignore"):
                    keys = bucket_keys(x, h, h.probes).reshape(len(x), -1) ^ (np.int64(x.shape[1]) * np.int64(0x5851F42D4C957F2D))
                n = keys.shape[1]
                outline = _outline(x, h)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, n)), *[pa.array(np.repeat(outline[:, i], n)) for i in range(3)]], ["bucket", "id", "o0", "o1", "o2"])

    entered = lambda rows: rows.select("rep", "v").mapInArrow(enter, f"bucket long, id {kind}, o0 long, o1 long, o2 long")
    # Crowded buckets are found on a sample before any task is given one, and spread; an overlooked one is only slower.
    part = reps.where(F.pmod(F.xxhash64("rep"), F.lit(h.sample)) == 0)
    crowded = entered(part).groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") * h.sample >= h.crowd).select("bucket")
    crowded = cut_lineage(crowded)
    entries = entered(reps)
    if crowded.isEmpty():
        pairs = _candidates(entries, kind, min_cosine).distinct()
    else:
        known = broadcast_if_small(crowded, 100_000)
        crowds = cut_lineage(entries.join(known, "bucket", "left_semi").select(F.col("id").alias("a"), F.col("bucket").alias("crowd")).distinct())
        pairs = _candidates(entries.join(known, "bucket", "left_anti"), kind, min_cosine)
        pairs = pairs.unionByName(_crowd_pairs(crowds, reps, kind, h, k, min_cosine)).distinct()
    pairs = cut_lineage(pairs)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_dimension(b.column(2)):
                some = pa.array(at)
                x, y = x.astype(np.float64), _matrix(b.column(3).take(some)).astype(np.float64)
                cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array(cos)], ["a", "b", "cosine"])

    va, vb = reps.select(F.col("rep").alias("a"), F.col("v").alias("va")), reps.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    scored = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(exact, f"a {kind}, b {kind}, cosine double")
    scored = scored.where(F.col("cosine") >= min_cosine)
    both = scored.select("a", "b", "cosine", F.explode(F.array(F.lit(True), F.lit(False))).alias("_f")).select(
        F.when(F.col("_f"), F.col("a")).otherwise(F.col("b")).alias("rep"), F.when(F.col("_f"), F.col("b")).otherwise(F.col("a")).alias("near"), "cosine"
    )
    # k other classes hold at least k records, so no more of them can matter.
    by_cos = Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "near")
    near = both.withColumn("_r", F.row_number().over(by_cos)).where(F.col("_r") <= k).drop("_r")
    ids = reps.select(F.col("rep").alias("near"), F.col("ids").alias("_ids"))
    outside = near.join(ids, "near").select("rep", "cosine", F.explode("_ids").alias("other"))
    inside = reps.where(F.size("ids") > 1).select("rep", F.lit(1.0).alias("cosine"), F.explode("ids").alias("other"))
    by_place = Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "other")
    # A record needs k others; its own id may be among the first, hence one more.
    lists = inside.unionByName(outside).withColumn("_r", F.row_number().over(by_place)).where(F.col("_r") <= k + 1)
    named = lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("list"))
    classes = reps.select("vkey", "rep").join(named, "rep").select("vkey", "rep", "list")
    # A class of very many copies meets its members in as many tasks as it has shares of `block` members.
    hot = record.groupBy("vkey").agg(F.ceil(F.count("*") / HOT_CLASS).cast("int").alias("_shares")).where(F.col("_shares") > 1)
    hot = broadcast_if_small(hot, 100_000)
    spread_out = classes.join(hot, "vkey", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    member = record.join(hot, "vkey", "left").withColumn("_share", F.pmod(F.xxhash64("id"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    joined = member.join(spread_out, ["vkey", "_share"])
    # A class of one lists only others; a member of a greater class lists its class first, its own id left out.
    others = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)
    out = joined.select("id", F.posexplode(others).alias("_p", "_x"))
    return out.select(F.col("id").alias(id_col), F.col("_x.other").alias("other"), (-F.col("_x.far")).alias("cosine"), (F.col("_p") + 1).alias("place"))


def neighbour_pairs(near: DataFrame, id_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once: records of which one is a neighbour of the other."""
    return near.select(F.least(id_col, "other").alias("id_a"), F.greatest(id_col, "other").alias("id_b")).distinct()


#: The index for searching the k nearest of any distance: wide cells, many probes; see the README for its measured recall.
SEARCH = Hashing(tables=8, hashes=8, width=1.5, probes=150)


def search_neighbours(rows: DataFrame, key: str, vec: str, queries: DataFrame, query: str, qvec: str, k: int = 5, h: Hashing = SEARCH, own: str | None = None, block: int = 2_048) -> DataFrame:
    """(query, key, cosine, place): for every query the `k` records of greatest cosine among those its probes visit.

    Every record is indexed, by its own bucket in each table; a query visits its own and the perturbed buckets in estimated
    success order, and what it meets is ranked by exact cosine. Records are hashed where they lie: the stated set of queries
    comes to them, `block` at a time, and each task keeps only its first `k` per query.
    A record of several rows counts once; with `own`, a column of `queries` with the query's own key, that record is left
    out. Vectors that `clean_vectors` leaves out take no part. Ties go to the lesser key.
    """
    ktype, qtype = rows.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    one = clean_vectors(rows, key, vec).groupBy("id").agg(F.max(F.struct("vkey", "v")).alias("_x"))
    # Written once: every block of queries reads the records again.
    clean = cut_lineage(one.select("id", F.col("_x.v").alias("v")))
    wanted = queries.select(F.col(query).alias("q"), (F.col(own) if own else F.lit(None).cast(ktype)).alias("own"), F.col(qvec).cast("array<double>").alias("v"))
    wanted = wanted.where(F.col("q").isNotNull() & F.col("v").isNotNull()).orderBy("q")
    schema = f"q {qtype}, id {ktype}, cosine double"
    out = None
    for qs, owns, x in _query_blocks(wanted, block):
        keys = bucket_keys(x, h, h.probes)
        tables = []
        for t in range(h.tables):
            flat = keys[:, t].ravel()
            order = np.argsort(flat, kind="stable")
            tables.append((flat[order], order // keys.shape[2]))
        shared = rows.sparkSession.sparkContext.broadcast((qs, owns, x, tables))

        def visit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qs, owns, x, tables = shared.value
            best = RunningTop(len(qs), k)
            for b in batches:
                for start in range(0, b.num_rows, SLICE):
                    part = b.slice(start, SLICE)
                    ids, v = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))
                    if v.shape[1] != x.shape[1]:
                        continue
                    met = np.zeros((len(qs), len(v)), bool)
                    for t, at in enumerate(bucket_keys(v, h, 0)[:, :, 0].T):
                        sorted_keys, who = tables[t]
                        low, high = np.searchsorted(sorted_keys, at, "left"), np.searchsorted(sorted_keys, at, "right")
                        n = high - low
                        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                        met[who[place], np.repeat(np.arange(len(v)), n)] = True
                    if own:
                        met &= owns[:, None] != ids[None, :]
                    v = v.astype(np.float64)
                    best.add(np.where(met, x @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, -np.inf), ids)
            q, ids, cos = best.result()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(ids), pa.array(cos)], ["q", "id", "cosine"])

        part = clean.mapInArrow(visit, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "id")
    best = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.select(F.col("q").alias(query), F.col("id").alias(key), "cosine", "place")


def _query_blocks(wanted: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, own keys, unit vectors), fetched a block at a time."""
    held: list = []

    def pack() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array([r[2] for r in held], dtype=np.float64)
        n = np.linalg.norm(x, axis=1)
        ok = np.isfinite(n) & (n > 0)
        return np.array([r[0] for r in held])[ok], np.array([-1 if r[1] is None else r[1] for r in held])[ok], x[ok] / n[ok, None]

    for r in wanted.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield pack()
            held = []
    if held:
        yield pack()
