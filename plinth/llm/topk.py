"""Exact top-k search by integer inner product: tiles of queries times shards of vectors, and a tree that merges the lists.

Vectors are dealt to shards, and queries to blocks, by a hash of their id, and every block meets every shard once: a tile.
A tile is one matrix product, of which each query keeps its k best. A query's lists are merged in a tree of bounded fan, so
no task holds more than a tile and no query's candidates meet in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import settle, ship

#: Vectors of a shard and queries of a block, about, and queries that are multiplied at once: a tile needs SHARD + BLOCK vectors
#: and a product of SHARD * ROWS cells. A vector is sent once to each block of queries.
SHARD, BLOCK, ROWS = 8192, 8192, 256
#: Lists that one step of the merging tree takes together.
FAN = 64
#: Products of integers are exact in doubles up to here.
EXACT = float(2**53)


def whole(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double; null for a null vector, or one with a null, NaN or infinite component."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of a row, ties to smaller ids; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)[: k - len(above)]
        at = np.concatenate((above, ties))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as integers; one that no long holds is an error."""
    most = np.abs(q.astype(np.float64)).max(initial=0) * np.abs(v.astype(np.float64)).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ v.T
    product = q.astype(object) @ v.astype(object).T
    if np.abs(product).max(initial=0) >= 2**63:
        raise OverflowError("an inner product is beyond 64 bits; scale the vectors down")
    return product.astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: each query's k highest scores (all, if fewer), ties to smaller vec_id.

    vectors: vec_id, embedding. Candidates are all rows but those of the query's own id. Rows with a null id or a vector that
    is null, empty or holds null, NaN or infinite components take no part; vectors of another length than the query's are no candidates;
    rows that repeat an id and vector count once. An empty table gives an empty result; a score that no long holds is an error.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null and size(v) > 0").distinct()
    ship(vectors.sparkSession)
    own = settle(own, "vectors")
    n = own.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-own.where(is_query).count() // BLOCK))
    spread = lambda of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int")
    rows = own.select("vec_id", "v", spread(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asks = own.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("at_shard"), spread(blocks, 2).alias("at_block"))

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            ours, theirs = dict(_by_length(left, "query_id", "q")), dict(_by_length(right, "vec_id", "v"))
            for length in ours.keys() & theirs.keys():
                (asked, q), (ids, v) = ours[length], theirs[length]
                for i in range(0, len(asked), ROWS):
                    for who, scores in zip(asked[i : i + ROWS].tolist(), _product(q[i : i + ROWS], v), strict=True):
                        keep = ids != who
                        others, s = ids[keep], scores[keep]
                        out += [(who, int(others[c]), int(s[c])) for c in _best(others, s, k)]
        columns = {name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))}
        return pa.table(columns | {"shard": pa.array([key[0].as_py()] * len(out), pa.int32())})

    tiles = asks.groupBy("at_shard", "at_block").cogroup(rows.groupBy("shard", "block")).applyInArrow(tile, "query_id long, vec_id long, score long, shard int")
    best = tiles.select("query_id", "shard", F.array(F.struct((-F.col("score")).alias("down"), "vec_id")).alias("top"))
    while True:
        shards = -(-shards // FAN)
        best = best.groupBy("query_id", F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(_top(F.flatten(F.collect_list("top")), k).alias("top"))
        if shards == 1:
            break
    return best.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.down")).alias("score"))


def _by_length(t: pa.Table, ids: str, vectors: str):
    """(length, (ids, matrix)) of the vectors of each length."""
    lists = t.column(vectors).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    own, lengths = t.column(ids).to_numpy(), lists.value_lengths().to_numpy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, (own[at], lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n))


def _top(lists: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(lists)), 1, k)
