"""Retrieval over a table of records: exact tokens, ranked keys, vectors, trigrams and both blended.

Questions are a table of their own, so that one question is the one-row case of a batch. Every order ends in the record's key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.similarity import weighted_blend
from corvane.session import spread

#: Questions whose vectors go to every task at once; more of them are taken in blocks of this size.
QUERY_BLOCK = 4_096
#: Records that meet a block of questions in one product.
SLICE = 1_024


class RunningTop:
    """The first `k` keys per query by score, ties by key, over matrices of scores that come one after the other.

    What does not reach a query's worst kept score is dropped at once, so after a few matrices little is left to sort.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.s, self.keys = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """`scores` is queries x keys; a score that is not finite is none. A key must come once only."""
        floor = self.floor
        if scores.shape[1] > self.k and not np.isfinite(floor).all():
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        if not len(q):
            return
        new = keys[c]
        self.q, self.s = np.concatenate([self.q, q]), np.concatenate([self.s, scores[q, c]])
        self.keys = new if self.keys is None else np.concatenate([self.keys, new])
        order = np.lexsort((self.keys, -self.s, self.q))
        sorted_q = self.q[order]
        start = np.r_[0, np.flatnonzero(np.diff(sorted_q)) + 1]
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        order = order[rank < self.k]
        self.q, self.s, self.keys = self.q[order], self.s[order], self.keys[order]
        worst = rank[rank < self.k] == self.k - 1
        self.floor[self.q[worst]] = self.s[worst]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of what is kept."""
        return self.q, self.keys if self.keys is not None else np.empty(0, np.int64), self.s


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first `k` rows per `by`, with their place as `place`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def exact_match(df: DataFrame, column: str, tokens: list[list[str]], k: int, key: str, gene: str | None = None, gene_col: str = "gene", escape: bool = False) -> DataFrame:
    """Records whose `column` holds, in any case, one form of every token; the first `k` by key.

    As in the pattern language, _ and % in a token match anything unless `escape` is set. No token, no records.
    """
    if not tokens:
        return df.limit(0)
    hit = F.lit(True)
    for forms in tokens:
        one = F.lit(False)
        for t in forms:
            pattern = t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else t
            one = one | F.ilike(F.col(column), F.lit(f"%{pattern}%"))
        hit = hit & one
    if gene is not None:
        hit = hit & (F.col(gene_col) == gene)
    return df.where(hit).orderBy(key).limit(k)


def ranked_by_key(df: DataFrame, queries: DataFrame, on: str, rank: Column, key: str, k: int, query: str = "query_id") -> DataFrame:
    """Per query the first `k` records of its key value, best rank first.

    The first `k` of every key value are found once, with a limit before the shuffle, whatever the number of queries on it; so a
    value that owns a tenth of all records costs a query no more than any other.
    """
    first = top_k(df.withColumn("rank", rank), k, [on], [F.col("rank"), F.col(key)])
    return queries.select(query, on).join(first, on)


def vector_top_k(corpus: DataFrame, key: str, vec: str, queries: DataFrame, query: str, qvec: str, k: int, threshold: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, similarity): per query the `k` records of greatest cosine, over `threshold` if given; ties by key.

    Vectors that are null, of another dimension or of length zero take no part. Exact: every record meets every query, as a
    product of matrices, a slice of records at a time; each task keeps only its own first `k` per query before anything is
    shuffled. Keys must be distinct. Queries are a stated set; they are sent to the tasks in blocks of `block`, whatever their number.
    """
    spark = corpus.sparkSession
    ktype, qtype = corpus.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    wanted = queries.where(F.col(qvec).isNotNull()).select(F.col(query).alias("q"), F.col(qvec).cast("array<double>").alias("v")).orderBy("q")
    rows = corpus.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("v"))
    schema = f"`{query}` {qtype}, `{key}` {ktype}, similarity double"
    out = None
    pieces = _blocks(wanted, block)
    for ids, matrix in pieces:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = RunningTop(len(ids), k)
            for b in batches:
                for start in range(0, len(b), SLICE):
                    part = b.iloc[start : start + SLICE]
                    ok = np.array([v is not None and len(v) == q.shape[1] for v in part["v"]], bool)
                    if not ok.any():
                        continue
                    x = np.stack(part["v"].to_numpy()[ok]).astype(np.float64)
                    with np.errstate(all="ignore"):
                        sim = (q @ x.T) / np.linalg.norm(x, axis=1)
                    if threshold is not None:
                        sim[~(sim > threshold)] = -np.inf
                    best.add(np.where(np.isnan(sim), -np.inf, sim), part["key"].to_numpy()[ok])
            at, keys, sims = best.result()
            yield pd.DataFrame({query: ids[at], key: keys, "similarity": sims})

        part = rows.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    return top_k(out, k, [query], [F.col("similarity").desc(), F.col(key)])


def _blocks(wanted: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the queries, fetched a block at a time."""
    ids, vecs = [], []

    def pack() -> tuple[np.ndarray, np.ndarray]:
        x = np.array(vecs, dtype=np.float64)
        n = np.linalg.norm(x, axis=1)
        return np.array(ids)[n > 0], x[n > 0] / n[n > 0, None]

    for q, v in wanted.toLocalIterator():
        ids.append(q)
        vecs.append(v)
        if len(ids) == block:
            yield pack()
            ids, vecs = [], []
    if ids:
        yield pack()


def trigram_set(text: str | None) -> set[str]:
    """The trigrams that `corvane.functions.similarity.trigrams` gives, in Python."""
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def trigram_scores(corpus: DataFrame, key: str, fields: list[str], queries: DataFrame, query: str, text: str, k: int | None = None, block: int = 512) -> DataFrame:
    """(query, key, lexical): the greatest trigram similarity of any field with the query, where they share a trigram.

    With `k`, only the best `k` per query and task, ties by key: the overall best are among them, if keys are distinct. The stated set
    of queries comes to the records as an inverted index, trigram to queries, `block` queries at a time. A record's own
    trigrams are looked up and counted where it is read, so no pair is made before its similarity is known, and nothing is
    shuffled but results. A null text has no trigrams.
    """
    spark = corpus.sparkSession
    ktype, qtype = corpus.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    rows = spread(corpus.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]))
    schema = f"`{query}` {qtype}, `{key}` {ktype}, lexical double"
    out = None
    for ids, sizes, index in _indexes(queries.select(F.col(query).alias("q"), F.col(text).alias("t")).orderBy("q"), block):
        shared = spark.sparkContext.broadcast((ids, sizes, index))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, sizes, index = shared.value
            none = np.empty(0, np.int64)
            top = RunningTop(len(ids), k) if k is not None else None
            for b in batches:
                for start in range(0, len(b), SLICE):
                    part = b.iloc[start : start + SLICE]
                    best = np.zeros((len(part), len(ids)))
                    for i in range(len(fields)):
                        for r, value in enumerate(part[f"f{i}"]):
                            grams = trigram_set(value if isinstance(value, str) else None)
                            met = [index[g] for g in grams if g in index]
                            if met:
                                n = np.bincount(np.concatenate([none, *met]), minlength=len(ids))
                                np.maximum(best[r], n / (sizes + len(grams) - n), out=best[r])
                    keys = part["key"].to_numpy()
                    if top is not None:
                        top.add(np.where(best > 0, best, -np.inf).T, keys)
                    else:
                        r, q = np.nonzero(best)
                        yield pd.DataFrame({query: ids[q], key: keys[r], "lexical": best[r, q]})
            if top is not None:
                q, keys, scores = top.result()
                yield pd.DataFrame({query: ids[q], key: keys, "lexical": scores})

        part = rows.mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    # A record of several rows counts once.
    return out.groupBy(query, key).agg(F.max("lexical").alias("lexical"))


def _indexes(wanted: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(ids, numbers of trigrams, trigram to places) of the queries, fetched a block at a time."""
    ids, sets = [], []

    def pack() -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        index: dict[str, list[int]] = {}
        for i, grams in enumerate(sets):
            for g in grams:
                index.setdefault(g, []).append(i)
        return np.array(ids), np.array([len(x) for x in sets]), {g: np.array(v, dtype=np.int64) for g, v in index.items()}

    for q, t in wanted.toLocalIterator():
        ids.append(q)
        sets.append(trigram_set(t))
        if len(ids) == block:
            yield pack()
            ids, sets = [], []
    if ids:
        yield pack()


def min_max(c: str, by: list[str]) -> Column:
    """A column scaled to its range within `by`; 0 where the range is 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return (F.col(c) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def blend_pools(semantic: DataFrame, lexical: DataFrame, key: str, query: str, k: int, alpha: float, floor: float) -> DataFrame:
    """(query, key, score, semantic, lexical, place) of two candidate pools with places.

    Pools are merged in full, a missing score being 0. Candidates below the lexical `floor` go, so that the vectors only
    reorder what the words found; what is left is scaled to its range and blended. Ties keep the pools' places, the
    semantic one first.
    """
    s = semantic.select(query, key, F.col("similarity").alias("semantic"), F.col("place").alias("_sp"))
    x = lexical.select(query, key, "lexical", F.col("place").alias("_lp"))
    merged = s.join(x, [query, key], "full_outer").withColumn("semantic", F.coalesce("semantic", F.lit(0.0))).withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    left = merged.where(F.col("lexical") >= floor)
    scored = left.withColumn("_s", min_max("semantic", [query])).withColumn("_l", min_max("lexical", [query]))
    scored = scored.withColumn("score", weighted_blend(F.col("_s"), F.col("_l"), alpha))
    order = [F.col("score").desc(), F.col("_sp").asc_nulls_last(), F.col("_lp").asc_nulls_last(), F.col(key)]
    return top_k(scored, k, [query], order).select(query, key, "score", "semantic", "lexical", "place")


def hybrid(corpus: DataFrame, key: str, vec: str, fields: list[str], queries: DataFrame, query: str = "query_id", text: str = "text", qvec: str = "qvec", k: int = 5, alpha: float = 0.3, pool: int = 50, floor: float = 0.45) -> DataFrame:
    """Lexical and vector retrieval in one: two pools of `pool` candidates per query, merged, floored, scaled and blended."""
    semantic = vector_top_k(corpus, key, vec, queries, query, qvec, pool)
    lexical = top_k(trigram_scores(corpus, key, fields, queries, query, text, k=pool), pool, [query], [F.col("lexical").desc(), F.col(key)])
    return blend_pools(semantic, lexical, key, query, k, alpha, floor)


def filtered(chunks: DataFrame, genes: list[str] | None = None, types: list[str] | None = None, include_retired: bool = False) -> DataFrame:
    """Chunks that share a gene, have a section type in the list and are not retired; a null list filters nothing."""
    out = chunks if include_retired else chunks.where(~F.col("retired"))
    if genes:
        out = out.where(F.arrays_overlap("gene_symbols", F.array(*[F.lit(g) for g in genes])))
    if types:
        out = out.where(F.col("section_type").isin(types))
    return out
