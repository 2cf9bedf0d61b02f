"""Exact top-k inner products by no-random-access aggregation.

Each block of vectors keeps one sorted list for each dimension. A query reads all lists in step,
best contributions first. What it has read of a vector gives the vector's lower bound (unread
dimensions at their lists' ends) and upper bound (unread dimensions at the lists' current places).
It stops when only few vectors' upper bounds reach the k-th lower bound, and resolves their final
scores. Blocks of queries meet blocks of vectors in a grid, so neither side is broadcast.

Defined results: a vector that is null, empty, or holds null or non-finite components takes no
part; vectors of different lengths never meet; ties go to the smaller vec_id; a row whose id equals
the query's is not its candidate, and repeated ids are rows of their own; empty tables give no
rows; other columns are not read. Scaled components must stay below 2**26 in absolute value for exact sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BLOCK, QUERIES = 8192, 2048
#: Final scores are resolved once no more than this share of a block can qualify.
RESOLVE_SHARE = 8


def read_lists(ids: np.ndarray, v: np.ndarray, order: np.ndarray, ranked: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, position) of one query in a block; order and ranked: each dimension's ascending list and its values."""
    n = len(ids)
    live = np.flatnonzero(q)
    rest = np.arange(n)
    enough = max(k, n // RESOLVE_SHARE)
    if len(live):
        part, seen = np.zeros(n), np.zeros((len(live), n), np.float32)
        place, worst = np.zeros(len(live)), np.zeros(len(live))
        done, other = 0, ids != own
        for upto in (n // 2, n * 3 // 4, n * 7 // 8):
            for j, d in enumerate(live):
                down = q[d] > 0
                piece = slice(n - upto, n - done) if down else slice(done, upto)
                at = order[d, piece]
                part[at] += ranked[d, piece] * float(q[d])
                seen[j, at] = 1
                place[j] = ranked[d, n - upto - 1 if down else upto] * float(q[d])
                worst[j] = ranked[d, 0 if down else n - 1] * float(q[d])
            done = upto
            # Single precision is enough for bounds that give way by their rounding.
            slack = 1 + 1e-5 * (np.abs(place).sum() + np.abs(worst).sum())
            upper = part + place.sum() - place.astype(np.float32) @ seen
            lower = (part + worst.sum() - worst.astype(np.float32) @ seen)[other]
            if len(lower) <= k:
                break
            floor = np.partition(lower, len(lower) - k)[len(lower) - k]
            rest = np.flatnonzero(upper >= floor - slack)
            if len(rest) <= enough:
                break
    rest = rest[ids[rest] != own]
    score = v[rest] @ q
    best = np.lexsort((ids[rest], -score))[:k]
    return score[best], rest[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows by the product of floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    usable = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = cut(vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"), is_query.alias("q"), F.monotonically_increasing_id().alias("row")))  # kept, so that a row's number stays
    n, nq = rows.count(), rows.where("q").count()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-nq // QUERIES))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for (part, dims), g in frame.groupby([frame["part"], frame["v"].map(len)]):
                v = np.stack(g["v"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"part": [part], "dims": [dims], "ids": [g[["vec_id", "row"]].to_numpy(np.int64).tobytes()], "data": [v.tobytes()]})

    def packed(df: DataFrame, parts: int) -> DataFrame:
        dealt = df.select("vec_id", "v", "row", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
        return dealt.repartition("part").mapInPandas(pack, "part int, dims int, ids binary, data binary")

    queries = packed(rows.where("q"), chunks).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("part").cast("long") * blocks + b)))
    stock = packed(rows, blocks).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: c.cast("long") * blocks + F.col("part"))))

    def opened(frame: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = frame[frame["dims"] == dims]
        ids = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in mine["ids"]])
        return ids[:, 0], ids[:, 1], np.concatenate([np.frombuffer(b, np.int64).reshape(-1, dims) for b in mine["data"]])

    def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims in sorted(set(qs["dims"]) & set(vs["dims"])):
            ids, _, v = opened(vs, dims)
            qids, qrow, qv = opened(qs, dims)
            order = np.argsort(v, axis=0, kind="stable").T.copy()
            ranked = np.take_along_axis(v.T, order, axis=1).astype(float)
            for i in range(len(qids)):
                score, at = read_lists(ids, v, order, ranked, qv[i], qids[i], k)
                out.append(pd.DataFrame({"query_id": np.full(len(at), qids[i]), "row": qrow[i], "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")

    met = queries.groupBy("cell").cogroup(stock.groupBy("cell")).applyInPandas(meet, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return met.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def topk_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by 100."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
