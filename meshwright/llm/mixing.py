"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import common

#: Fixed values of the mix: weights of the sources in turn, and how often a source may repeat.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents that one task balances, and tasks whose open documents meet in one.
CHUNK_ROWS, FAN_IN = 4096, 1024
_ZERO = 1e-9


#: Open documents among which a step's direction is chosen, and how much longer than the last of them the first may be.
_OPEN, _UNEVEN = 6, 3


def fly(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves chances to 0 or 1 along directions that leave their sum and their sum of sizes as they are.

    Three open documents always leave such a direction; two at most stay open. Documents come in the order given, largest
    first, and each step moves the largest that is open as fast as the constraints let it (the projection of its axis on
    their null-space). Where the few that are open are too small to carry it, the step is spread over all that wait. So
    small ones stay to the end.
    """
    out = chances.astype(float).copy()
    waiting = np.flatnonzero((out > _ZERO) & (out < 1 - _ZERO))
    draws, at, open_ = rng.random(2 * len(out) + 3), 0, []
    for draw in draws:
        while len(open_) < _OPEN and at < len(waiting):
            if _ZERO < out[waiting[at]] < 1 - _ZERO:
                open_.append(int(waiting[at]))
            at += 1
        if len(open_) < 3:
            break
        rest = waiting[at:] if sizes[open_[0]] > _UNEVEN * sizes[open_[-1]] else waiting[:0]
        rest = rest[(out[rest] > _ZERO) & (out[rest] < 1 - _ZERO)]
        if not (len(rest) and _spread(out, np.concatenate([open_, rest]), sizes, draw)):
            _move(out, open_, _direction([float(sizes[i]) for i in open_]), draw)
        open_ = [i for i in open_ if _ZERO < out[i] < 1 - _ZERO]
    return out


def _spread(out: np.ndarray, where: np.ndarray, sizes: np.ndarray, draw: float) -> bool:
    """One step over all of `where`, in the direction that moves the first fastest; False if the others can't carry it."""
    s = sizes[where].astype(float)
    off = s - s.mean()
    way = -1 / len(s) - off[0] / (off @ off) * off
    way[0] += 1
    pi, up = out[where], way > 0
    if way[0] < 1e-6:
        return False
    way[np.abs(way) < 1e-15] = 0
    moves = way != 0
    ahead = (np.where(up, 1 - pi, pi)[moves] / np.abs(way[moves])).min()
    back = (np.where(up, pi, 1 - pi)[moves] / np.abs(way[moves])).min()
    moved = pi + (ahead if draw * (ahead + back) < back else -back) * way
    out[where] = np.where(moved < _ZERO, 0.0, np.where(moved > 1 - _ZERO, 1.0, moved))
    return True


def _direction(sizes: list[float]) -> list[float]:
    n = len(sizes)
    off = [s - sum(sizes) / n for s in sizes]
    spread = sum(o * o for o in off)
    for a in range(n):
        lean = off[a] / spread if spread > 1e-9 * n * max(sizes) ** 2 else 0.0
        way = [(i == a) - 1 / n - lean * o for i, o in enumerate(off)]
        if way[a] > 1e-9:
            return [w if abs(w) > 1e-12 else 0.0 for w in way]
    raise ArithmeticError("three open documents always leave a direction")


def land(chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the few that are open: first keeping their sum, then the last one by its chance."""
    out = chances.astype(float).copy()
    open_ = [int(i) for i in np.flatnonzero((out > _ZERO) & (out < 1 - _ZERO))]
    while len(open_) > 1:
        _move(out, open_[:2], (1.0, -1.0), rng.random())
        open_ = [i for i in open_ if _ZERO < out[i] < 1 - _ZERO]
    for i in open_:
        out[i] = float(rng.random() < out[i])
    return np.round(out)


def _move(out: np.ndarray, where: list[int], way: list[float] | tuple, draw: float) -> None:
    ahead = min(((1 - out[i]) / w if w > 0 else out[i] / -w) for i, w in zip(where, way) if w)
    back = min((out[i] / w if w > 0 else (1 - out[i]) / -w) for i, w in zip(where, way) if w)
    step = ahead if draw * (ahead + back) < back else -back
    for i, w in zip(where, way):
        moved = out[i] + step * w
        out[i] = 0.0 if moved < _ZERO else 1.0 if moved > 1 - _ZERO else moved


def targets(sources: DataFrame) -> DataFrame:
    """Target words of each row of sources(source, source_size): shares by weight, none above MOST times its own size.

    A source that would get more stops there, and the excess is shared again by weight: the level that every other source gets for each
    unit of weight is the highest of the levels found with the k first sources (by size for their weight) stopped.
    The table has one row for each source; its windows see no documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = F.col("source_size") * MOST
    by_room = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = sources.withColumn("_weight", weight).withColumn("_cap", cap)
    before = F.sum("_cap").over(by_room) - F.col("_cap")
    others = F.sum("_weight").over(everything) - F.sum("_weight").over(by_room) + F.col("_weight")
    found = found.withColumn("_level", (F.sum("source_size").over(everything) - before) / others)
    level = F.max("_level").over(everything)
    return found.select(*sources.columns, F.least(F.col("_cap").cast("double"), F.col("_weight") * level).alias("target"))


def _balancing(seed: int, last: bool):
    def balance(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("_order", "ascending"), ("doc_id", "ascending")])
        rng = np.random.default_rng([seed, rows["_source"][0].as_py() & (2**63 - 1), rows["_chunk"][0].as_py()])
        chances = fly(rows["size"].to_numpy(), rows["_chance"].to_numpy(), rng)
        chances = pa.array(land(chances, rng) if last else chances, pa.float64())
        return rows.set_column(rows.column_names.index("_chance"), "_chance", chances)

    return balance


def words(text: Column) -> Column:
    """Number of words of a text; none of a null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """How often each of docs(doc_id long, text string, source string) is taken so that sources get their target words.

    One row for each input row: doc_id, size (words), source, source_size, target, copies, taken (size * copies) and sure (the copies that
    every document of the source gets). A source's documents share one expected number of copies, target / source_size; its whole part is sure, its fraction is a chance that the cube
    method turns into 0 or 1 while it balances words and documents. Chunks of about CHUNK_ROWS documents of one source are
    balanced by one task each; two documents at most stay open in a chunk, meet in the next round FAN_IN chunks to a
    task, and the last one or two of a source are rounded.

    The same documents give the same result, however they are partitioned: chunks and order come from a hash of the id, the size and the
    row's place among rows equal in these and the source, which are alike here and counted before they are dealt. Nulls: a null text has no
    words, a null source is a source of its own (last), null ids are rows as any other. Sources without words get nothing. Very long texts are sized whole. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"))
    rows = rows.groupBy("doc_id", "size", "source").agg(F.count("*").alias("_n"))
    rows = common.checkpoint(rows.select("doc_id", "size", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_place")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = targets(sources).withColumn("_source", F.xxhash64("source"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # rounding must not turn a whole number of copies into one less and a chance of almost 1
    whole = F.floor(each + F.lit(_ZERO)).cast("int")
    sources = common.checkpoint(sources.withColumn("_whole", whole).withColumn("_chance", F.greatest(each - F.col("_whole"), F.lit(0.0))).withColumn("_chunks", F.greatest(F.lit(1), F.ceil(F.col("_n") / CHUNK_ROWS)).cast("int")))
    most = sources.agg(F.max("_chunks")).first()[0] or 1
    own = ["r.doc_id", "r.size", "_place", F.lit(seed)]
    joined = common.beside(rows, sources.drop("_n"), "source").select("r.doc_id", "r.size", "r.source", "r._place", "source_size", "target", "_source", "_whole", "_chance", F.pmod(F.xxhash64(*own), F.col("_chunks")).cast("int").alias("_chunk"), F.xxhash64(*own, F.lit("order")).alias("_order"))
    schema = joined.schema
    state = common.checkpoint(joined.groupBy("_source", "_chunk").applyInArrow(_balancing(seed, False), schema))
    is_open = (F.col("_chance") > _ZERO) & (F.col("_chance") < 1 - _ZERO)
    done, left = [state.filter(~is_open)], state.filter(is_open)
    last = False
    while not last:
        last, most, seed = most <= FAN_IN, -(-most // FAN_IN), seed + 1
        left = common.checkpoint(left.withColumn("_chunk", F.floor(F.col("_chunk") / FAN_IN).cast("int")).groupBy("_source", "_chunk").applyInArrow(_balancing(seed, last), schema))
        done.append(left.filter(~is_open))
        left = left.filter(is_open)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("_whole") + F.round("_chance").cast("int")
    taken = (F.col("size") * copies).cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, "source", copies.alias("copies"), F.col("_whole").alias("sure"))
