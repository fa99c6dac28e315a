"""Exact top-k search by inner product: MaxScore over shards of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import stored

#: Rows of a shard and of a block of queries, at most about; shards at least (so that all executors have work).
SHARD_ROWS, BLOCK_QUERIES, LEAST_SHARDS = 65_536, 16_384, 24
#: Postings that are traversed at once (few at first, so that the k-th best score soon cuts), and queries whose scores are held at once.
FIRST, STRIDE, HELD = 64, 2_048, 256

#: Stands for no score yet; its negative is a long, too.
NOTHING = -(1 << 62)


def quantised(vector: Column, scale: int = 64) -> Column:
    """Each component x as floor(scale * x), x as double; null for a vector that is null, or holds null or a component that isn't finite."""
    x = F.transform(vector, lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(vector.isNull() | F.coalesce(bad, F.lit(True)), None).otherwise(F.transform(x, lambda e: F.floor(e * scale).cast("long")))


def search_shard(queries: np.ndarray, own: np.ndarray, postings: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, ids, scores) of the k best of a shard, ties to the smaller id.

    queries: a row of term weights each; postings: the same terms by row, documents by column, ids
    rising. MaxScore: the bound of a term is its weight times the largest (or least) posting. Terms are
    taken as non-essential, smallest bounds first, for as long as their bounds together stay below the
    k-th best score so far; no document can enter by them alone. The essential postings are traversed;
    a document is competitive while its partial score and the bounds of the terms left reach the k-th
    best score, and the non-essential terms are probed, largest bound first, for competitive ones only.
    """
    width, n = postings.shape
    at_least = np.full((len(queries), k), NOTHING)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    start, stride = 0, FIRST
    while start < n:
        block = np.ascontiguousarray(postings[:, start : start + stride])
        names = ids[start : start + stride]
        start, stride = start + stride, min(4 * stride, STRIDE)
        low, high = block.min(axis=1), block.max(axis=1)
        bounds = np.maximum(queries * low, queries * high)
        order = np.argsort(bounds, axis=1, kind="stable")
        rising = np.take_along_axis(bounds, order, 1)
        # sums of the smallest bounds; a negative one may not be left out of a prefix sum's worst case
        total = np.cumsum(np.maximum(rising, 0), axis=1)
        bar = at_least[:, -1]
        spare = (total < bar[:, None]).sum(axis=1)
        essential = np.ones_like(queries, bool)
        np.put_along_axis(essential, order, np.arange(width)[None, :] >= spare[:, None], 1)
        rest = np.where(spare > 0, np.take_along_axis(total, np.maximum(spare - 1, 0)[:, None], 1)[:, 0], 0)
        partial = np.zeros((len(queries), block.shape[1]))
        many = 4 * essential.sum(axis=1) > width  # these traverse the postings that any of them needs together, the others their own
        terms = essential[many].any(axis=0)
        partial[many] = np.where(essential[many][:, terms], queries[many][:, terms], 0) @ block[terms]
        for i in np.flatnonzero(~many & essential.any(axis=1)):
            partial[i] = queries[i, essential[i]] @ block[essential[i]]
        row, col = np.nonzero(partial >= (bar - rest)[:, None])
        other = names[col] != own[row]
        row, col = row[other], col[other]
        score = partial[row, col].astype(np.int64)
        left = rest[row].copy()
        step = spare[row] - 1
        live = np.nonzero(step >= 0)[0]
        while len(live):
            r, s = row[live], step[live]
            term = order[r, s]
            score[live] += (queries[r, term] * block[term, col[live]]).astype(np.int64)
            left[live] -= np.maximum(rising[r, s], 0).astype(np.int64)
            step[live] -= 1
            dead = score[live] + left[live] < bar[r]
            score[live[dead]] = NOTHING
            live = live[~dead & (step[live] >= 0)]
        good = (score >= bar[row]) & (score > NOTHING)
        row, col, score = row[good], col[good], score[good]
        by = np.lexsort((names[col], -score, row))
        row, col, score = row[by], col[by], score[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, score, place = (x[place < k] for x in (row, col, score, place))
        new_score = np.full((len(queries), k), NOTHING)
        new_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        new_score[row, place], new_id[row, place] = score, names[col]
        both, both_id = np.hstack([at_least, new_score]), np.hstack([best_id, new_id])
        by = np.lexsort((both_id, -both), axis=1)[:, :k]
        at_least, best_id = np.take_along_axis(both, by, 1), np.take_along_axis(both_id, by, 1)
    for i in range(len(queries)):
        real = at_least[i] > NOTHING
        if real.any():
            yield i, best_id[i][real], at_least[i][real]


def top_k(vectors: DataFrame, asked: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of vectors (vec_id, embedding) that ``asked`` picks, its k best others.

    Score: the integer inner product of the quantised vectors; ties go to the smaller vec_id; all
    candidates where there are fewer than k. A query's own vec_id is no candidate of it. Vectors that
    are null or hold null or non-finite components take no part, nor do rows without a vec_id; vectors
    of different lengths are compared as if the missing components were zero. A row that is repeated
    as a whole counts once; of different vectors under one vec_id all are candidates and the smallest
    (by components) is the query. An empty table gives no rows; other columns are not read. Components so
    large that a score could reach 2^53 are an error.

    Rows are dealt into shards and queries into blocks of bounded size, both by a hash of the id; each
    pair of block and shard is one group, in which MaxScore keeps the k best. A window merges the
    shards' lists by query (at most k a shard).
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("q"), F.coalesce(asked, F.lit(False)).alias("asked"))
    clean, _ = stored(clean.where("vec_id is not null and q is not null").dropDuplicates(["vec_id", "q"]), "vectors")
    wanted = clean.where("asked").groupBy("vec_id").agg(F.min("q").alias("q"))
    largest = F.max(F.coalesce(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q"), largest.alias("largest"), F.max(F.size("q")).alias("width")).first()
    if size["n"] and size["largest"] ** 2 * max(1, size["width"]) >= 1 << 53:
        raise ValueError("components are too large: scores of 2^53 or more are not exact in the product")
    shards = max(LEAST_SHARDS, -(-size["n"] // SHARD_ROWS))
    blocks = max(1, -(-size["q"] // BLOCK_QUERIES))
    group = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select(group(blocks, 1).alias("block"), every(shards).alias("shard"), F.col("vec_id"), "q")
    right = clean.select(every(blocks).alias("block"), group(shards, 2).alias("shard"), F.col("vec_id"), "q")

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        lists = column.combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        return out

    def search(ask: pa.Table, stock: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
        if len(ask) and len(stock):
            stock = stock.sort_by("vec_id")
            width = max(pc.max(pc.list_value_length(t["q"])).as_py() for t in (ask, stock))
            postings = matrix(stock["q"], width).T.copy()
            ids, own = stock["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
            for at in range(0, len(ask), HELD):
                part = ask.slice(at, HELD)
                for i, names, scores in search_shard(matrix(part["q"], width), own[at : at + HELD], postings, ids, k):
                    found.append((np.full(len(names), own[at + i]), names, scores))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    lists = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
