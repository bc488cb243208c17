"""A uniform shuffle into shards of exact sizes, with DataFrame functions only."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm import common

#: Rows of one block, which is permuted by one task; and the number of blocks above which they are made larger.
BLOCK_ROWS, MOST_BLOCKS = 1 << 17, 4096
#: Parts by which a shard's rows are put in order.
SLOT_PARTS = 64


def _hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Good ones among `draws` of good + bad, by inversion that starts at the mode and walks outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows each block sends each shard: a draw with these margins, as a uniform permutation would give."""
    rng, room, out = random.Random(seed), list(shards), []
    for n in rows:
        left, total, line = n, sum(room), []
        for free in room:
            total -= free
            k = _hypergeometric(free, total, left, rng)
            line.append(k)
            left -= k
        room = [a - b for a, b in zip(room, line)]
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Deals docs(doc_id, text string) into shards of sizes at most one apart (law `rows`), in uniformly random order.

    One row for each input row: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32 (unsigned), law, shard, slot (the row's place
    in its shard, gapless from 0), grown_shard (null under this law).

    Blocks are runs of BLOCK_ROWS rows of an input partition. Where these would be over MOST_BLOCKS they are longer, and of more
    partitions than that neighbours share a block; so the driver sees twice MOST_BLOCKS row counts at most, whatever the input. For each
    it draws how many rows go to each shard; a block's rows in the order of a seeded hash of their place (the local permutation) fill these counts in turn.
    A shard's rows are again in the order of another hash; their slots come from counts of SLOT_PARTS ranges of it, so that no
    task holds a whole shard. Places, not contents, are hashed: copies and hot keys spread as any rows do. The text is
    read once; only ids, sizes and checksums are shuffled. The same files and settings give the same result.

    Nulls: a null text has no bytes (size 16, checksum 0); a null or repeated doc_id is a row as any other. Empty table: no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = common.checkpoint(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    # a row's number is its partition's, shifted by 33 bits, and its place there
    n, last = rows.agg(F.count("*"), F.max(F.shiftright("_row", 33))).first()
    run, share = max(BLOCK_ROWS, -(-n // MOST_BLOCKS)), (last or 0) // MOST_BLOCKS + 1
    within = F.expr(f"(_row & {(1 << 33) - 1}) div {run}") if share == 1 else F.lit(0).cast("long")
    rows = rows.withColumn("_block", F.shiftleft(F.expr(f"shiftright(_row, 33) div {share}"), 33) + within)
    counts = sorted((r["_block"], r["n"]) for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    upto = [{"b": b, "u": [sum(line[: k + 1]) for k in range(shards)]} for (b, _), line in zip(counts, matrix)]
    # one short row for each block, in pieces that a literal can hold
    bounds = None
    for i in range(0, max(1, len(upto)), 2000):
        listed = F.from_json(F.lit(json.dumps(upto[i : i + 2000])), "array<struct<b:long,u:array<long>>>")
        piece = spark.range(1).select(F.inline(listed)).toDF("_block", "_upto")
        bounds = piece if bounds is None else bounds.unionByName(piece)
    local = Window.partitionBy("_block").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")
    dealt = rows.withColumn("_at", F.row_number().over(local) - 1).join(bounds, "_block")
    dealt = dealt.withColumn("shard", F.size(F.filter("_upto", lambda u: u <= F.col("_at"))))
    order = F.xxhash64("_row", F.lit(seed + 1), F.lit("slot"))
    dealt = dealt.select("doc_id", "size", "text_crc32", "_row", "shard", order.alias("_order"))
    part = F.pmod(F.shiftrightunsigned("_order", 57).cast("int"), F.lit(SLOT_PARTS))
    dealt = common.checkpoint(dealt.withColumn("_part", part))
    # SLOT_PARTS rows for each shard, whatever the input
    per_part = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = per_part.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("shard", "_part").orderBy("_order", "_row")
    out = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(before), ["shard", "_part"])
    slot = (F.col("_before") + F.col("_in")).cast("long").alias("slot")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, F.col("shard").cast("int").alias("shard"), slot, grown)
