"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse vectors: terms with integer weights. Candidates are dealt into blocks and queries into blocks, and every
query block meets every candidate block in one task, so no table is broadcast and no group grows with the input. In a
task the candidates become postings, one list of (row, weight) per term. A query goes through its terms one at a time
and adds weight times posting weights into a dense array of scores, one cell per candidate; the k best are then cut out
by partition selection. What is left, k rows for each query and candidate block, is merged by rank.

Scores are exact 64-bit integers. Ties go to the smaller id. A vector that is null, or holds a null or a non-finite
component, takes no part, as query or candidate; nor does a row without id. Vectors may differ in length: a term that
one side lacks adds nothing, and an empty vector scores 0. Rows that repeat an id are candidates of their own; as
queries they share one ranking, and a query never meets a candidate with its own id. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import importable

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(id, vec double) -> (id, w bigint): floor(scale * x), of rows whose vector is whole and finite."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "id", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("bigint")).alias("w"))


def matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors, as rows that are as wide as the longest; terms that a vector lacks weigh 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]] if need else level[:0]
        chosen = np.concatenate([above, level])
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def search_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of this block for every query of this block."""
    ids, weights = candidates["id"].to_numpy(), matrix(candidates["w"])
    postings = []
    for term in weights.T:
        rows = np.flatnonzero(term)
        # a term that all rows have needs no list of rows
        postings.append((slice(None) if len(rows) == len(term) else rows, term[rows]))
    found = []
    for query, terms in zip(queries["id"].to_pylist(), matrix(queries["w"])):
        scores = np.zeros(len(ids), np.int64)
        for term in np.flatnonzero(terms[:len(postings)]):
            rows, w = postings[term]
            scores[rows] += terms[term] * w
        others = np.flatnonzero(ids != query)
        top = others[best(scores[others], ids[others], k)]
        found += [(query, int(i), int(s)) for i, s in zip(ids[top], scores[top])]
    return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()),
                     "score": pa.array([x[2] for x in found], pa.int64())})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(id, w) and (id, w) -> query_id, rank, vec_id, score: each query's k best candidates, all if there are fewer."""
    importable(queries.sparkSession)
    query_blocks = F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))
    blocks = F.lit(max(1, -(-candidates.count() // CANDIDATE_BLOCK)))
    # dealt round by their content, so a run that is repeated deals alike; ids that repeat are spread by hash as well
    own = lambda n: F.pmod(F.xxhash64("id", "w"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    left = queries.select("id", "w", own(query_blocks).alias("q"), every(blocks).alias("c"))
    right = candidates.select("id", "w", every(query_blocks).alias("q"), own(blocks).alias("c"))
    each = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(
        lambda a, b: search_block(a, b, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
