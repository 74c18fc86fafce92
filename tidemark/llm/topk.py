"""Operator 4: exact top-k inner-product search by pivot-table elimination.

Vectors are scaled to integers (floor of SCALE times each component). PIVOTS reference vectors, chosen farthest-first
from a bounded sample, get their distances to every vector precomputed. By the triangle inequality the largest
difference of two vectors' pivot distances is a lower bound of their distance, and so an upper bound of their inner
product: (q.q + x.x - bound**2) / 2. A query evaluates candidates in the order of that bound and stops exactly when
the next bound is below its k-th score so far.

Scale: vectors are packed into blocks of the same nearest pivot, hot cells are split by a hash of the id. Each query
first meets a block of its own cell, which gives it a k-th score to beat. Then a block of queries is sent only to
the blocks whose intervals of pivot distances and norms could still beat the worst of those. Only the blocks' intervals
are shared with all tasks; at most MOST_BLOCKS of them, as blocks grow beyond that.

Components are 32-bit where a vector's all fit, else 64-bit in blocks of their own; scores are exact integers. Scaled
components and scores beyond a long count as the nearest long.

Vectors that are null or empty, or hold a null or a non-finite component, take no part, nor do null ids. Vectors meet only those of their own length. A query's own id is no candidate. Repeated identical
rows are one query, and a candidate each. Fewer than k candidates give them all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

K, SCALE, PIVOTS, SAMPLE = 20, 64, 16, 2000
BLOCK, QUERY_BLOCK, MOST_BLOCKS, WIDE = 8192, 1024, 100_000, 1_000_000_000


def scaled(col: pa.Array, scale: int = SCALE) -> list[np.ndarray | None]:
    """Integer vectors; None for those that take no part."""
    out: list[np.ndarray | None] = []
    for v in col:
        if not v.is_valid or not len(v.values) or v.values.null_count:
            out.append(None)
            continue
        x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if not np.isfinite(x).all():
            out.append(None)
        elif (np.abs(x) < 2**31).all():
            out.append(x.astype(np.int32))
        else:
            out.append(np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    return out


class Pivots:
    """Reference vectors of one length."""

    def __init__(self, sample: list[np.ndarray], count: int):
        lengths = [len(v) for v in sample]
        self.dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
        own = np.array([v for v in sample if len(v) == self.dim], dtype=np.float64).reshape(len(sample) and lengths.count(self.dim), self.dim)
        picked, far = [], np.full(len(own), np.inf)
        while len(picked) < min(count, len(own)):
            k = int(np.argmax(far)) if picked else 0
            if picked and far[k] <= 0:
                break
            picked.append(k)
            far = np.minimum(far, np.sqrt(((own - own[k]) ** 2).sum(axis=1)))
        self.vectors = own[picked]

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Rows' distances to each pivot; none for vectors of another length."""
        if not len(self.vectors) or v.shape[1] != self.dim:
            return np.zeros((len(v), 0))
        v = v.astype(np.float64)
        return np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] - 2 * v @ self.vectors.T + (self.vectors**2).sum(axis=1)[None], 0))


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, np.int64 if len(vectors) == 8 * dim * len(own) else np.int32).reshape(-1, dim)


def _products(x: np.ndarray, q: np.ndarray, size: float) -> np.ndarray:
    """Inner products of integer vectors, none above `size` in magnitude."""
    if size < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    found = x.astype(object) @ q.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in found], np.int64)


def _slack(scale) -> np.ndarray:
    """What rounding may cost a bound."""
    return 1e-9 * scale + 0.5


def search_block(q_ids, q, floor, x_ids, x, pivots: Pivots, k: int):
    """For each query its best k of a block with scores of at least its floor: (query's place, candidates' places, scores)."""
    dq, dx = pivots.distances(q), pivots.distances(x)
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    qq, xx = (qf**2).sum(axis=1), (xf**2).sum(axis=1)
    size = float(np.sqrt(qq.max(initial=0)) * np.sqrt(xx.max(initial=0)))
    exact = size < 2**52
    columns = np.ascontiguousarray(dx.T)
    for i in range(len(q_ids)):
        bound = np.zeros(len(x))
        for p in range(dq.shape[1]):
            np.maximum(bound, np.abs(columns[p] - dq[i, p]), out=bound)
        upper = (qq[i] + xx - bound**2) / 2
        upper += _slack(qq[i] + xx)
        if not dq.shape[1]:
            upper[:] = np.inf
        least = floor[i]
        left = np.flatnonzero((upper >= least) & (x_ids != q_ids[i]))
        best_s, best_x, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 8 * k
        while len(left):
            # The next candidates by their bounds, in growing portions; those below the k-th score never are.
            if len(left) > step:
                part = np.argpartition(-upper[left], step - 1)
                take, left = left[part[:step]], left[part[step:]]
            else:
                take, left = left, left[:0]
            if not exact:
                s = _products(x[take], q[i], size)
            else:
                s = ((xf @ qf[i])[take] if 3 * len(take) > len(x) else xf[take] @ qf[i]).astype(np.int64)
            high = s >= least
            best_s, best_x = np.concatenate([best_s, s[high]]), np.concatenate([best_x, take[high]])
            if len(best_s) > k:
                kth = np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                high = best_s >= kth
                best_s, best_x = best_s[high], best_x[high]
                rank = np.lexsort((x_ids[best_x], -best_s))[:k]
                best_s, best_x = best_s[rank], best_x[rank]
            if len(best_s) == k:
                least = max(least, best_s.min())
            left = left[upper[left] >= least]
            step *= 6
        good = best_s >= floor[i]
        yield i, best_x[good], best_s[good]


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the best k candidates of each query (default: rows whose id divides by 20)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = rows.where("vec_id % 20 = 0") if queries is None else queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")

    total = rows.count()
    rate = min(1.0, 2 * SAMPLE / max(1, total))
    few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) <= rate * 1_000_003).orderBy("vec_id").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(Pivots([v for v in scaled(pa.array([r["v"] for r in few], pa.list_(pa.float64())), scale) if v is not None], pivots))

    def placed(batches):
        """vec_id, cell (nearest pivot and, for other lengths, -length), vector."""
        pv = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vs = scaled(part.column(1), scale)
                keep = [i for i, v in enumerate(vs) if v is not None]
                cells = [-len(vs[i]) for i in keep]
                wide = [WIDE * (vs[i].itemsize == 8) for i in keep]
                same = [j for j, i in enumerate(keep) if len(vs[i]) == pv.dim]
                if same and len(pv.vectors):
                    near = np.argmin(pv.distances(np.array([vs[keep[j]] for j in same])), axis=1)
                    for j, c in zip(same, near.tolist(), strict=True):
                        cells[j] = c
                yield pa.record_batch([part.column(0).take(pa.array(keep, pa.int64())), pa.array([c + w if c >= 0 else c - w for c, w in zip(cells, wide, strict=True)], pa.int32()), pa.array([vs[i].tobytes() for i in keep], pa.binary())], names=["vec_id", "cell", "v"])

    def packed(df: DataFrame, size: int, name: str, each: bool) -> DataFrame:
        """Blocks of up to about `size` vectors of a cell; each: equal rows stay apart."""
        flat = common.written(df.mapInArrow(placed, "vec_id long, cell int, v binary"), name)
        if not each:
            flat = flat.dropDuplicates(["vec_id", "v"])
        counts = {r["cell"]: r["n"] for r in flat.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot or length
        parts = F.lit(1)
        for cell, n in counts.items():
            parts = F.when(F.col("cell") == cell, F.lit(-(-n // size))).otherwise(parts)
        split = flat.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), parts).cast("int"))

        def pack(table):
            v = table.column("v").combine_chunks()
            data = b"".join(v.to_pylist())
            width = 8 if abs(table.column("cell")[0].as_py()) >= WIDE else 4
            return pa.table({"cell": table.column("cell")[:1], "part": table.column("part")[:1], "ids": pa.array([np.array(table.column("vec_id").to_pylist(), np.int64).tobytes()], pa.binary()), "vectors": pa.array([data], pa.binary()), "dim": pa.array([len(data) // width // table.num_rows], pa.int32()), "n": pa.array([table.num_rows], pa.int32())})

        blocks = split.groupBy("cell", "part").applyInArrow(pack, "cell int, part int, ids binary, vectors binary, dim int, n int")
        return common.written(blocks.withColumn("block", F.col("cell").cast("long") * 1_000_000 + F.col("part")), name + "-blocks")

    x_blocks = packed(rows, max(BLOCK, total // MOST_BLOCKS), "vectors", True)
    q_blocks = packed(asked, QUERY_BLOCK, "queries", False)

    def first(batches):
        """A block's queries with the k-th score that their own cell's first block already gives them."""
        pv = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = _unpack(r["ids"], r["vectors"], r["dim"])
                floor = np.full(len(q_ids), -np.inf)
                if r["x_ids"] is not None:
                    x_ids, x = _unpack(r["x_ids"], r["x_vectors"], r["dim"])
                    for i, _, s in search_block(q_ids, q, floor.copy(), x_ids, x, pv, k):
                        if len(s) >= k:
                            least = float(s.min())  # rounded down where a float can't hold it
                            floor[i] = least if abs(least) < 2**53 else np.nextafter(least, -np.inf)
                yield pa.record_batch({"ids": pa.array([r["ids"]], pa.binary()), "vectors": pa.array([r["vectors"]], pa.binary()), "dim": pa.array([r["dim"]], pa.int32()), "floors": pa.array([floor.tobytes()], pa.binary())})

    home = x_blocks.where("part = 0").select("cell", F.col("ids").alias("x_ids"), F.col("vectors").alias("x_vectors"))
    begun = q_blocks.select("cell", "ids", "vectors", "dim").join(home, "cell", "left").mapInArrow(first, "ids binary, vectors binary, dim int, floors binary")

    def interval(batches):
        pv = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                _, x = _unpack(r["ids"], r["vectors"], r["dim"])
                d, xx = pv.distances(x), (x.astype(np.float64) ** 2).sum(axis=1)
                yield pa.record_batch({"block": pa.array([r["block"]], pa.int64()), "dim": pa.array([r["dim"]], pa.int32()), "low": pa.array([d.min(axis=0).tolist()], pa.list_(pa.float64())), "high": pa.array([d.max(axis=0).tolist()], pa.list_(pa.float64())), "top": pa.array([float(xx.max())], pa.float64())})

    bounds = x_blocks.select("block", "ids", "vectors", "dim").mapInArrow(interval, "block long, dim int, low array<double>, high array<double>, top double").collect()  # at most about MOST_BLOCKS
    summary = spark.sparkContext.broadcast([(r["block"], r["dim"], np.array(r["low"]), np.array(r["high"]), r["top"]) for r in bounds])

    def routed(batches):
        """The blocks that could hold a result of one of the queries."""
        pv = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                _, q = _unpack(r["ids"], r["vectors"], r["dim"])
                floor, dq, qq = np.frombuffer(r["floors"], np.float64), pv.distances(q), (q.astype(np.float64) ** 2).sum(axis=1)
                to = []
                for block, dim, low, high, top in summary.value:
                    if dim != r["dim"]:
                        continue
                    gap = np.maximum(np.maximum(low - dq, dq - high), 0).max(axis=1) if dq.shape[1] else np.zeros(len(q))
                    if ((qq + top - gap**2) / 2 + _slack(qq + top) >= floor).any():
                        to.append(block)
                if to:
                    n = len(to)
                    yield pa.record_batch({"block": pa.array(to, pa.int64()), "ids": pa.array([r["ids"]] * n, pa.binary()), "vectors": pa.array([r["vectors"]] * n, pa.binary()), "floors": pa.array([r["floors"]] * n, pa.binary())})

    def joined(batches):
        pv = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = _unpack(r["ids"], r["vectors"], r["dim"])
                x_ids, x = _unpack(r["x_ids"], r["x_vectors"], r["dim"])
                a, b, c = [], [], []
                for i, at, s in search_block(q_ids, q, np.frombuffer(r["floors"], np.float64), x_ids, x, pv, k):
                    a.append(np.full(len(at), q_ids[i]))
                    b.append(x_ids[at])
                    c.append(s)
                if a:
                    yield pa.record_batch([pa.array(np.concatenate(z), pa.int64()) for z in (a, b, c)], names=["query_id", "vec_id", "score"])

    pairs = begun.mapInArrow(routed, "block long, ids binary, vectors binary, floors binary").join(x_blocks.select("block", "dim", F.col("ids").alias("x_ids"), F.col("vectors").alias("x_vectors")), "block")
    found = pairs.mapInArrow(joined, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e::DOUBLE[], x.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
