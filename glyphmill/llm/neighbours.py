"""Approximate nearest neighbours by randomly rotated one-bit codes, reranked within error bounds.

Vectors are scaled to length one, so that the largest cosine is the largest inner product. A
coarse quantiser (spherical k-means, fitted on a bounded sample) deals them out into lists;
every row is indexed. In its list, a vector is a residual from the centre; after a random
rotation only its signs are kept (a bit a dimension) with two numbers: the residual's length,
and the inner product of the residual's direction with its own code. They give an unbiased
estimate of the inner product with any query and a bound of its error; a candidate whose
upper bound stays under the k-th best lower bound is dropped, the others are computed in
double precision on the original vectors.

A query looks into its `probes` nearest lists (by default as many as hold `recall` of the true
neighbours of some rows of the sample, found by brute force there), and into further ones until these hold
`enough` rows, so that it finds k rows where there are any. A list of more than `ROWS` rows is
split by a hash of the id into parts that are searched apart; many queries of one list are
split into blocks the same way. Both sizes come from counts, so no task holds a whole list.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; rows that repeat an id take part each, a query never
meets a row with its own id; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The sample that centres are fitted on, rows of one list part, and queries of one block.
SAMPLE = 20_000
ROWS = 20_000
QUERIES = 20_000
#: Width of the error bound in standard deviations.
WIDTH = 2.5


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_611).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-30), c)
    return c.astype(np.float32)


def _enough_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many lists hold `recall` of the k nearest rows, by brute force for some rows of the sample."""
    asked = sample[:queries]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    where = (sample @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, where[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    odd = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    out = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & ~odd)
    return out.filter(F.exists("v", lambda e: e != 0))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, lists: int | None = None, probes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding", enough: int = 2000, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_type = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out_type)
    dim, total = dims["d"], dims["count"]
    rows = rows.filter(F.size("v") == dim)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.stack(fitted.to_list()).astype(np.float64)
    sample = (sample / np.abs(sample).max(1, keepdims=True))
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    lists = lists or int(min(4096, max(1, total ** 0.5 / 4), max(1, len(sample) // 8)))
    centres = _centres(sample, lists)
    probes = probes or min(lists, max(4, _enough_probes(sample, centres, k, recall)))
    turn = _rotation(dim)
    turned = centres @ turn
    shared = spark.sparkContext.broadcast((centres, turn, turned))

    def unit(column) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def indexed(frames):
        c, q, _ = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            x = unit(pdf["v"])
            near = (x @ c.T).argmax(1)
            rest = (x - c[near]) @ q
            length = np.linalg.norm(rest, axis=1)
            dir_ = rest / np.maximum(length, 1e-12)[:, None]
            own = np.abs(dir_).sum(1) / np.sqrt(x.shape[1])
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "list": near.astype(np.int64), "code": [r.tobytes() for r in np.packbits(rest > 0, axis=1)], "length": length.astype(float), "own": own.astype(float)})

    index = cut(rows.mapInPandas(indexed, "id long, v array<double>, list long, code binary, length double, own double"))
    held = index.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q")).collect()  # a row a list
    size = np.zeros(lists, np.int64)
    for r in held:
        size[r.list] = r.n
    sizes = spark.sparkContext.broadcast(size)
    parts = np.maximum(1, -(-size // ROWS))

    def probing(frames):
        c = shared.value[0]
        n = sizes.value
        for pdf in frames:
            if not len(pdf):
                continue
            order = np.argsort(-(unit(pdf["v"]) @ c.T), axis=1, kind="stable")
            seen = np.cumsum(n[order], axis=1) - n[order]
            take = (np.arange(c.shape[0])[None, :] < probes) | (seen < enough)
            take &= n[order] > 0
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "list": [o[t].tolist() for o, t in zip(order, take)]})

    asked = index.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v").mapInPandas(probing, "id long, v array<double>, list array<long>")
    asked = cut(asked.select("id", "v", F.explode("list").alias("list")))
    load = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}  # a row a list
    keys = ["list", "part", "block"]
    table = [(i, int(parts[i]), int(-(-load.get(i, 1) // QUERIES))) for i in range(lists)]
    plan = lambda: F.broadcast(spark.createDataFrame(table, "list long, parts int, blocks int"))  # noqa: E731  a row a list, at most 4096
    cand = index.join(plan(), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "id", "v", "code", "length", "own")
    ask = asked.join(plan(), "list").withColumn("block", F.pmod(F.xxhash64("id", "list"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "id", "v")

    def search(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(q) or not len(c):
            return empty
        _, turn, turned = shared.value
        centre = shared.value[0][key[0]]
        ids, exact = c["id"].to_numpy(), np.stack(c["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(exact, axis=1)
        sign = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in c["code"]]), axis=1, count=turn.shape[0]).astype(np.float32) * 2 - 1
        length, own = c["length"].to_numpy().astype(np.float32), np.maximum(c["own"].to_numpy(), 1e-6).astype(np.float32)
        spread = (WIDTH * np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(1, turn.shape[0] - 1))).astype(np.float32)
        got_q, got_v, got_s = [], [], []
        step = max(1, 4_000_000 // len(c))
        every_query = np.stack(q["v"].to_numpy()).astype(np.float64)
        for lo in range(0, len(q), step):
            raw = every_query[lo : lo + step]
            x = unit(q["v"].iloc[lo : lo + step])
            rotated = x @ turn - turned[key[0]]  # the query's residual, rotated
            # <query, row> = <query, centre> + <query - centre, residual> + <centre, residual>
            code = (rotated @ sign.T) / np.float32(np.sqrt(turn.shape[0]))
            rest = length * (code / own)
            fixed = length * ((turned[key[0]] @ sign.T) / np.float32(np.sqrt(turn.shape[0])) / own)
            guess = (x @ centre)[:, None] + rest + fixed
            error = length * spread * (np.linalg.norm(x @ turn, axis=1, keepdims=True))
            own_row = q["id"].to_numpy()[lo : lo + step, None] == ids[None, :]
            low = np.where(own_row, -np.inf, guess - error)
            kth = np.partition(low, -min(k, low.shape[1]), axis=1)[:, -min(k, low.shape[1])]
            hopeful = (guess + error >= kth[:, None]) & ~own_row
            for i in range(len(raw)):
                at = np.flatnonzero(hopeful[i])
                if not len(at):
                    continue
                s = exact[at] @ raw[i] / (norm[at] * np.linalg.norm(raw[i]))
                top = np.lexsort((ids[at], -s))[:k]
                got_q.append(np.full(len(top), q["id"].iloc[lo + i]))
                got_v.append(ids[at][top])
                got_s.append(s[top])
        if not got_q:
            return empty
        return pd.DataFrame({"query_id": np.concatenate(got_q), "vec_id": np.concatenate(got_v), "score": np.concatenate(got_s)})

    found = ask.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
