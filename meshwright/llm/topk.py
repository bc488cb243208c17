"""Exact top-k inner products by norm-sorted blocks, partial sums in rotated coordinates, and Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import common

#: Vectors of a candidate block, queries of a query block, blocks that one task goes through in descending order of length.
BLOCK, QUERY_BLOCK, SPAN = 4096, 2048, 2
#: Query blocks that share one copy of the longest block's join key.
LANE = 64
_QUERIES_AT_ONCE = 128
_EDGE = 2.0**62


def _integers(batches):
    """Valid vectors as floor(256 x): vec_id, dim, norm, components (int64 bytes)."""
    for batch in batches:
        vectors = batch.column("embedding")
        ids, rows = batch.column("vec_id").to_pylist(), []
        for k, v in enumerate(vectors):
            if ids[k] is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(x).all():
                scaled = np.clip(np.floor(256 * x), -_EDGE, _EDGE)
                rows.append((ids[k], len(x), float(np.sqrt((scaled * scaled).sum())), scaled.astype(np.int64).tobytes()))
        columns, kinds = list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int32(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["vec_id", "dim", "norm", "data"])


def _grams(batches):
    """For each task and dimension, the sum of outer products."""
    from pyspark import TaskContext

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        data = batch.column("data").to_pylist()
        for d in np.unique(dims).tolist():
            v = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(dims == d)), np.int64).reshape(-1, d).astype(np.float64)
            sums[d] = sums.get(d, 0) + v.T @ v
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part % 64] * len(sums), pa.int32()), pa.array([g.tobytes() for g in sums.values()], pa.binary())], ["dim", "part", "gram"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(g, np.float64) for g in rows["gram"])
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "part": [0], "gram": [total.tobytes()]})


_BLOCK_COLUMNS = "dim int, part int, nth long, longest double, ids binary, data binary"


def _blocks(size: int):
    def blocks(batches):
        """Runs of `size` vectors of one dimension in the order in which they come; nth counts those of a partition and dimension."""
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), {}
        held: dict[int, list] = {}

        def flush(d):
            ids, norms, data = zip(*held.pop(d))
            made[d] = made.get(d, -1) + 1
            columns = {"dim": pa.array([d], pa.int32()), "part": pa.array([part], pa.int32()), "nth": [made[d]], "longest": [max(norms)]}
            own = {"ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "data": pa.array([b"".join(data)], pa.binary())}
            return pa.RecordBatch.from_pydict(columns | own)

        for batch in batches:
            for i, d, norm, data in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "norm", "data"))):
                held.setdefault(d, []).append((i, norm, data))
                if len(held[d]) >= size:
                    yield flush(d)
        for d in list(held):
            yield flush(d)

    return blocks


def _numbered(blocks: DataFrame) -> DataFrame:
    """blocks with their number (from 0) among all of their dimension, partition by partition."""
    per_part = blocks.groupBy("dim", "part").agg(F.count("*").alias("made"))
    # a row for each partition and dimension
    before = F.sum("made").over(Window.partitionBy("dim").orderBy("part")) - F.col("made")
    firsts = per_part.select("dim", "part", before.alias("first"))
    return blocks.join(firsts, ["dim", "part"]).withColumn("number", F.col("first") + F.col("nth")).drop("part", "nth", "first")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; beyond 64 bits they stop at the ends of the range."""
    bound = float(np.sqrt((q.astype(float) ** 2).sum(1).max()) * np.sqrt((v.astype(float) ** 2).sum(1).max()))
    if bound < 2.0**52:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**62:
        return q @ v.T
    wide = q.astype(object) @ v.T.astype(object)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


class TopK:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        """least: for each query a score that its k best are known to reach."""
        self.k, self.floor = k, np.full(queries, -np.inf) if least is None else least
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.filled = np.zeros(queries, np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """Below this nothing counts any more."""
        return np.maximum(self.floor[rows], np.where(self.filled[rows] >= self.k, self.scores[rows, -1].astype(np.float64), -np.inf))

    def add(self, rows: np.ndarray, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates: q says of which of `rows` each is."""
        if not len(q):
            return
        q = np.concatenate([q, np.repeat(np.arange(len(rows)), self.k)])
        ids = np.concatenate([ids, self.ids[rows].ravel()])
        scores = np.concatenate([scores, self.scores[rows].ravel()])
        order = np.lexsort((ids, -scores.astype(np.float64) if np.abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) < 2**52 else ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.ids[rows] = ids[best].reshape(len(rows), self.k)
        self.scores[rows] = scores[best].reshape(len(rows), self.k)
        self.filled[rows] = (self.ids[rows] != np.iinfo(np.int64).max).sum(1)


def search_block(best: TopK, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, turn: np.ndarray) -> int:
    """Offers best the vectors of one block, those pruned excepted; returns how many pairs were scored."""
    scored = 0
    q_norm = np.sqrt((q.astype(float) ** 2).sum(1))
    v_norm = np.sqrt((v.astype(float) ** 2).sum(1))
    head = max(1, q.shape[1] // 4)
    vr = v.astype(float) @ turn
    v_rest = np.sqrt(np.maximum(v_norm**2 - (vr[:, :head] ** 2).sum(1), 0))
    for i in range(0, len(q), _QUERIES_AT_ONCE):
        rows = np.arange(i, min(len(q), i + _QUERIES_AT_ONCE))
        # the longest vector left can't reach what the query has
        rows = rows[q_norm[rows] * v_norm.max() * (1 + 1e-9) + 1e-6 >= best.least(rows)]
        if not len(rows):
            continue
        least = best.least(rows)
        qr = q[rows].astype(float) @ turn
        q_rest = np.sqrt(np.maximum(q_norm[rows] ** 2 - (qr[:, :head] ** 2).sum(1), 0))
        slack = 1e-9 * q_norm[rows][:, None] * v_norm + 1e-6
        may = qr[:, :head] @ vr[:, :head].T + q_rest[:, None] * v_rest + slack >= least[:, None]
        if may.mean() > 0.02:
            scores = exact_scores(q[rows], v)
            scored += may.size
        else:
            scored += int(may.sum())
            scores = np.full(may.shape, np.iinfo(np.int64).min)
            for column in np.flatnonzero(may.any(0)):
                hit = np.flatnonzero(may[:, column])
                scores[hit, column] = exact_scores(q[rows[hit]], v[column : column + 1])[:, 0]
        may &= ids[None, :] != q_ids[rows][:, None]
        scores = np.where(may, scores, np.iinfo(np.int64).min)
        if scores.shape[1] > best.k:
            may &= scores >= np.maximum(np.partition(scores, -best.k, 1)[:, -best.k], np.where(best.filled[rows] >= best.k, best.scores[rows, -1], np.iinfo(np.int64).min))[:, None]
        a, b = np.nonzero(may)
        best.add(rows, a, ids[b], scores[a, b])
    return scored


def search(asked: pd.DataFrame, blocks: pd.DataFrame, k: int, turn: np.ndarray) -> tuple[np.ndarray, TopK, int]:
    """A block of queries through blocks of candidates, longest first: (query ids, their best, pairs scored)."""
    d = turn.shape[0]
    ids, data, least = (asked[c].iloc[0] for c in ("ids", "data", "least"))
    q_ids, q = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, d)
    best, scored = TopK(len(q), k, None if least is None else np.frombuffer(least, np.float64)), 0
    for ids, data in blocks.sort_values(["longest", "number"], ascending=[False, True])[["ids", "data"]].itertuples(index=False):
        ids, v = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, d)
        order = np.argsort(ids, kind="stable")
        scored += search_block(best, q_ids, q, ids[order], v[order], turn)
    return q_ids, best, scored


_FOUND = "query_id long, vec_id long, score long"
_ASKED = "dim int, asked long, ids binary, data binary, least binary, reach double"


def _starting(k: int, turns: dict[int, np.ndarray]):
    def start(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """A block of queries with each one's k-th score among the longest vectors, and the length from which a vector may matter."""
        if not len(asked):
            return asked
        turn = turns[int(asked["dim"].iloc[0])]
        _, best, _ = search(asked, blocks, k, turn)
        least = best.least(np.arange(len(best.scores)))
        q = np.frombuffer(asked["data"].iloc[0], np.int64).reshape(-1, turn.shape[0]).astype(float)
        norms = np.sqrt((q * q).sum(1))
        # a vector of another length than this can't reach any query's least (a null query reaches 0 with all)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(norms > 0, (least - 1e-6) / (norms * (1 + 1e-9)), np.where(least <= 0, -np.inf, np.inf))
        return asked.assign(least=[least.tobytes()], reach=[float(reach.min())])

    return start


def _searching(k: int, turns: dict[int, np.ndarray]):
    def searched(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(blocks):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        q_ids, best, _ = search(asked, blocks, k, turns[int(asked["dim"].iloc[0])])
        real = best.ids != np.iinfo(np.int64).max
        return pd.DataFrame({"query_id": q_ids[np.nonzero(real)[0]], "vec_id": best.ids[real], "score": best.scores[real]})

    return searched


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """The k highest inner products of floor(256 x) for each query of vectors(vec_id long, embedding array<float>).

    Queries are the rows whose vec_id is divisible by query_every, candidates all rows with another vec_id. Returns query_id, rank (from 1),
    vec_id, score: exact integers, ties to the smaller vec_id, fewer than k where there are fewer candidates.

    Candidates are dealt by descending length and packed into blocks. Each block of queries first meets the longest block alone; the k-th
    score that it finds for a query goes with the query to all spans of SPAN blocks, and spans whose longest vector can't reach any query's
    are never joined. Within a span, longest first, a query leaves a block whose longest vector can't reach its k-th score; a vector
    is scored only if its partial sum over the first quarter of SVD-rotated coordinates, plus the product of the residual
    lengths, may reach it. Query blocks meet spans by equal keys, so memory is bounded by the blocks; what a task finds,
    k for each query at most, is ranked at the end.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no part. Vectors of other
    lengths than the query's aren't compared with it. Rows that share an id are candidates each (but not of a query with
    that id, which is searched as often as it's there, and answered once). Components stop at 2**62, scores at the ends
    of a long. Empty table: no rows. Other columns are ignored.
    """
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = common.checkpoint(read.mapInArrow(_integers, "vec_id long, dim int, norm double, data binary"))
    gram = "dim int, part int, gram binary"
    grams = rows.mapInArrow(_grams, gram).groupBy("dim", "part").applyInPandas(_added, gram).groupBy("dim").applyInPandas(_added, gram)
    # one row of dim x dim numbers for each dimension
    turns = {r["dim"]: np.linalg.svd(np.frombuffer(r["gram"], np.float64).reshape(r["dim"], -1))[0] for r in grams.collect()}

    order = [F.col("norm").desc(), F.xxhash64("vec_id")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = common.checkpoint(_numbered(common.checkpoint(sorted_rows.mapInArrow(_blocks(BLOCK), _BLOCK_COLUMNS))))
    queries = rows.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "data"])
    dealt = queries.repartition(max(1, -(-queries.count() // QUERY_BLOCK)), "vec_id").mapInArrow(_blocks(QUERY_BLOCK), _BLOCK_COLUMNS)
    asked = _numbered(common.checkpoint(dealt)).select(
        "dim", F.col("number").alias("asked"), "ids", "data", F.lit(None).cast("binary").alias("least"), F.lit(0.0).alias("reach")
    )

    # each block of queries and a copy of the longest block of its dimension
    asked = common.checkpoint(asked)
    lane = F.expr(f"asked div {LANE}").alias("lane")
    lanes = asked.groupBy("dim").agg(F.max(lane).alias("last"))
    longest = blocks.filter("number = 0").join(lanes, "dim").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    longest = longest.join(asked.select("dim", "asked", lane), ["dim", "lane"])
    longest = longest.toDF(*longest.columns)  # names of its own, as asked has given it some
    started = asked.groupBy("dim", "asked").cogroup(longest.groupBy("dim", "asked")).applyInPandas(_starting(k, turns), _ASKED)
    asked = common.checkpoint(started)

    blocks = blocks.withColumn("span", F.expr(f"number div {SPAN}"))
    spans = blocks.groupBy("dim", "span").agg(F.max("longest").alias("longest"))
    last = spans.groupBy("dim").agg(F.max("span").alias("last"))
    pairs = asked.select("dim", "asked", "reach").join(last, "dim")
    pairs = pairs.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).join(spans, ["dim", "span"])
    pairs = common.checkpoint(pairs.filter("longest >= reach").select("dim", "asked", "span"))
    left, right = asked.join(pairs, ["dim", "asked"]), blocks.join(pairs, ["dim", "span"])
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    by = ("dim", "asked", "span")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searching(k, turns), _FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
