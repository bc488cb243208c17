"""Near duplicates by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

Passes over the text: one estimates the document frequency of every shingle (an additive sketch of bounded size); one takes each
document's weighted samples and bands them; a last one, over candidates only, gives the weighted sets by which pairs are verified.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common
from meshwright.llm.shingles import STEP, Shingler, distinct, mixed
from meshwright.operators.components import connected_components

WORDS, SIMILARITY = 5, 0.8
#: Sixteen bands of five samples find a pair of similarity 0.8 with a chance of 0.998, one of 0.5 with 0.4.
BANDS, ROWS = 16, 5
#: Rows and columns (a power of two) of the sketch of document frequencies.
DEPTH, BITS = 3, 18
#: A shingle of one document alone weighs 1 + IDF_SHARE, one of all documents a little over 1.
IDF_SHARE = 0.5
#: Sketches that one task adds.
FAN_IN = 64
#: Weights are powers of this, so that a set's entry holds its weight in 8 bits.
LEVEL = 1.02
#: Members of a bucket that one join key or one group gathers.
BLOCK = 512
#: Keys over which a bucket is dealt before its size is known.
SALT = 16
#: Of 80 samples, a pair of similarity 0.8 shares fewer than this share with a chance of 1 in 10 000.
LEAST_SHARED = 0.63


def _cells(shingles: np.ndarray) -> list[np.ndarray]:
    """The column of each shingle in each row of the sketch: bits of their own, as shingles are hashes."""
    mask = np.uint64((1 << BITS) - 1)
    return [((shingles >> np.uint64(BITS * k)) & mask).astype(np.int32) for k in range(DEPTH)]


def _packed(table: np.ndarray) -> bytes:
    return zlib.compress(table.astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64).reshape(DEPTH, 1 << BITS)


def _steps(batches):
    """Record batches in steps of bounded text."""
    for batch in batches:
        lengths = np.diff(common.utf8(batch.column("text"))[1])
        for i, j in common.slices(lengths, STEP):
            yield batch.slice(i, j - i)


_SKETCH = "part int, docs long, sketch binary"
_SKETCH_ARROW = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("sketch", pa.binary())])


def _sketches(batches):
    from pyspark import TaskContext

    table, docs, shingler = np.zeros((DEPTH, 1 << BITS), np.int64), 0, Shingler(WORDS)
    for step in _steps(batches):
        keys, _, counts = distinct(*shingler(step.column("text")))
        for row, cells in zip(table, _cells(keys)):
            row += np.bincount(cells, minlength=1 << BITS)
        docs += int((counts > 0).sum())
    if docs:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "sketch": [_packed(table)]}, _SKETCH_ARROW)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    table = np.zeros((DEPTH, 1 << BITS), np.int64)
    for sketch in rows["sketch"]:
        table += _unpacked(sketch)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "docs": [rows["docs"].sum()], "sketch": [_packed(table)]})


class Weights:
    """Weight of a shingle in a document: (1 + ln tf) * (1 + IDF_SHARE * ln(1 + n / df) / ln(1 + n)), as a power of LEVEL.

    The document frequency df is an estimate for every shingle: the least, over the sketch's rows, of its cell less the row's median cell,
    which is what other shingles add by chance; 1 at least. As it depends on the shingle alone, all documents are compared alike.
    """

    def __init__(self, docs: int, table: np.ndarray):
        frequency = np.maximum(table - np.median(table, axis=1, keepdims=True), 1)
        self.ln_idf = np.log1p(IDF_SHARE * np.log1p(docs / frequency) / np.log1p(max(docs, 1))).astype(np.float32)

    def __call__(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The exponent of LEVEL for each shingle."""
        ln_idf = np.max([row[cells] for row, cells in zip(self.ln_idf, _cells(shingles))], axis=0)
        return np.minimum(np.rint((ln_idf + np.log1p(np.log(tf))) / np.log(LEVEL)), 255).astype(np.uint8)


_LN_LEVELS = (np.arange(256) * np.log(LEVEL)).astype(np.float32)
_LEVELS = LEVEL ** np.arange(256.0)


def document_frequencies(texts: DataFrame) -> Weights:
    """Weights from all rows of texts(text): one pass; partitions' sketches are added FAN_IN at a time, and the driver gets one."""
    sketches, parts = texts.mapInArrow(_sketches, _SKETCH), texts.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        met = sketches.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        sketches = met.groupBy("part").applyInPandas(_merged, _SKETCH)
        if parts <= 1:
            break
    row = sketches.first()
    if row is None:
        return Weights(0, np.zeros((DEPTH, 1 << BITS), np.int64))
    return Weights(row["docs"], _unpacked(row["sketch"]))


class Sampler:
    """Consistent weighted samples: for each draw the least of a = c / (y exp r), where y = exp(r (t - b)), t = floor(ln w / r + b).

    r and c are Gamma(2, 1), b is uniform; all three follow from the shingle and the draw through tables of 2**16 quantiles. The least a
    stands for the sampled (shingle, t): other pairs give another a.
    """

    def __init__(self, draws: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, draws, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray, ln_w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row of samples (bits of the least a) for each document; counts are positive."""
        starts, ln_w = np.cumsum(counts) - counts, ln_w.astype(np.float32)
        out = np.empty((len(counts), len(self.seeds)), np.uint32)
        for k, seed in enumerate(self.seeds):
            x = mixed(shingles ^ seed)
            r = self.r[(x & np.uint64(0xFFFF)).astype(np.int32)]
            b = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
            ln_c = self.ln_c[(x >> np.uint64(48)).astype(np.int32)]
            t = np.floor(ln_w / r + b)
            out[:, k] = np.minimum.reduceat(ln_c - r * (t - b) - r, starts).view(np.uint32)
        return out


def _fingerprints(shingles: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that two documents share if they have the same shingles as often."""
    starts = np.cumsum(counts) - counts
    parts = [np.add.reduceat(mixed(shingles ^ mixed(np.uint64(k) + tf.astype(np.uint64))), starts) for k in (11, 12)]
    both = np.stack([mixed(p) for p in parts], 1)
    return [row.tobytes() for row in both]


_SIGNED = "doc_id long, sha binary, key binary, weight float, samples binary, bands array<long>"


def _signing(weights: Weights):
    def sign(batches):
        """Of each document: key (None without words), total weight, a byte of each sample, and the bucket of each band."""
        shingler, sampler = Shingler(WORDS), Sampler(BANDS * ROWS)
        factors = mixed(np.arange(1, ROWS + 1, dtype=np.uint64))
        for step in _steps(batches):
            shingles, tf, counts = distinct(*shingler(step.column("text")))
            some = np.flatnonzero(counts)
            keys, parts, bands = (np.full(len(counts), None, object) for _ in range(3))
            total = np.zeros(len(counts), np.float32)
            if len(some):
                levels, sizes = weights(shingles, tf), counts[some]
                total[some] = np.add.reduceat(_LEVELS[levels], np.cumsum(sizes) - sizes)
                samples = sampler(shingles, _LN_LEVELS[levels], sizes)
                banded = (samples.reshape(len(some), BANDS, ROWS) * factors).sum(2, dtype=np.uint64)
                buckets = mixed(banded ^ mixed(np.arange(BANDS, dtype=np.uint64))).view(np.int64)
                keys[some] = _fingerprints(shingles, tf, sizes)
                for i, row, sample in zip(some.tolist(), buckets, samples.astype(np.uint8)):
                    bands[i], parts[i] = row, sample.tobytes()
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), step.column("sha"), pa.array(keys, pa.binary()), pa.array(total), pa.array(parts, pa.binary())]
                + [pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "sha", "key", "weight", "samples", "bands"],
            )

    return sign


def _sets(weights: Weights):
    def sets(batches):
        """Fingerprint and weighted set of each document with words: ascending words of 56 bits of a shingle and 8 of its weight."""
        shingler = Shingler(WORDS)
        for step in _steps(batches):
            shingles, tf, counts = distinct(*shingler(step.column("text")))
            some = counts[counts > 0]
            if len(some):
                entries = (shingles & ~np.uint64(255)) | weights(shingles, tf)
                ends = np.cumsum(some)
                own = [entries[e - n : e].tobytes() for e, n in zip(ends, some)]
                keys = _fingerprints(shingles, tf, some)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(own, pa.binary())], ["key", "entries"])

    return sets


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of ascending entries."""
    x, y = a >> np.uint64(8), b >> np.uint64(8)
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[place] == x
    wa, wb = _LEVELS[(a & np.uint64(255)).astype(np.int32)], _LEVELS[(b & np.uint64(255)).astype(np.int32)]
    shared = np.minimum(wa[both], wb[place[both]]).sum()
    return shared / (wa.sum() + wb.sum() - shared)


def _alike(x, y, least: float):
    """Whether total weights allow a similarity of `least` (of arrays, or of columns through F.least)."""
    return np.minimum(x, y) >= np.maximum(x, y) * (least - 1e-5)


_LINKS = "a binary, b binary"


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    left, right = ([p[k] for p in pairs] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _verifying(least: float):
    def verify(batches):
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("leader", "key", "of_leader", "entries")))
            sets = ((a, b, *(np.frombuffer(s.as_buffer(), np.uint64) for s in both)) for a, b, *both in rows)
            yield _links([(a.as_py(), b.as_py()) for a, b, x, y in sets if similarity(x, y) >= least])

    return verify


def _runs(batches, by: tuple[str, ...]):
    """Tables of rows that agree in the integer columns `by`, from batches sorted by these."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(batch)]
        for i, j in itertools.pairwise(cuts):
            if held and (i or tuple(ids[0]) != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
        last = tuple(ids[-1])
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _candidates(rows: pa.Table, least: float, least_shared: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group that may be linked, best first: (rows of members, rows of others, number of samples shared).

    A pair counts in the first band that it shares and, if both are others, in one order; pairs of a component, pairs with the bucket's
    leader (tried before), and those too unlike in weight or in samples are left out.
    """
    side = rows["other"].to_numpy()
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    part = rows["part"].combine_chunks().dictionary_encode().indices.to_numpy()
    weight, leads, main = (rows[c].to_numpy() for c in ("weight", "leads", "main"))
    samples, keys = _matrix(rows["samples"], np.uint8, BANDS * ROWS), _matrix(rows["key"], ">u8", 2)
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    band = int(rows["band"][0].as_py())
    found = []
    for r in right[~leads[right]].tolist():
        ahead = (keys[left, 0] < keys[r, 0]) | ((keys[left, 0] == keys[r, 0]) & (keys[left, 1] < keys[r, 1]))
        some = left[(part[left] != part[r]) & ~leads[left] & (main[left] | ahead) & _alike(weight[left], weight[r], least)]
        shared = (samples[some] == samples[r]).sum(1)
        near = shared >= least_shared * BANDS * ROWS
        some, shared = some[near], shared[near]
        first = ~(bands[some, :band] == bands[r, :band]).any(1)
        found.append((some[first], np.full(int(first.sum()), r), shared[first]))
    a, b, shared = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    order = np.argsort(-shared, kind="stable")
    return a[order], b[order], shared[order]


_GROUP = ("bucket", "i", "j")


def _wanting(least: float, least_shared: float):
    def wanting(batches):
        """The rows of each group that some candidate pair needs."""
        for rows in _runs(batches, _GROUP):
            a, b, _ = _candidates(rows, least, least_shared)
            if len(a):
                yield from rows.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    return wanting


def _linking(least: float, least_shared: float):
    def link(batches):
        """Links between a group's members; components that a link has joined aren't compared further."""
        for rows in _runs(batches, _GROUP):
            a, b, _ = _candidates(rows, least, least_shared)
            part = rows["part"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
            keys, sets = rows["key"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["entries"].to_pylist()]
            found = []
            for x, y in zip(a.tolist(), b.tolist()):
                if part[x] != part[y] and similarity(sets[x], sets[y]) >= least:
                    found.append((keys[x], keys[y]))
                    part[part == part[y]] = part[x]
            if found:
                yield _links(found)

    return link


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, least_shared: float = LEAST_SHARED) -> DataFrame:
    """Classes of docs(doc_id long, text string) linked by a weighted similarity of `least` or more over shingles of five words.

    One row for each input row: doc_id, class_id (the class's smallest doc_id), class_size (rows), kept (one row of each class: the least
    by doc_id, nulls last, then text_sha256) and text_sha256, which with doc_id tells rows of different texts apart.

    Texts with the same shingles are one node from the start, so copies are never paired. Two nodes are candidates if they share a bucket
    (a band's samples), and linked if the weighted Jaccard similarity of their whole sets is at least `least`. First every member of a
    bucket is held against its leader, the member whose buckets are fullest: in a group of near copies that is the text they derive from,
    and the components that follow join nearly all. Then buckets whose members are still in different components are searched whole, in
    blocks: each member outside the bucket's largest component against all members of other components. So every pair that shares a
    bucket is decided, and buckets of one component cost as much as they have members. In this last search a pair whose samples agree in
    less than `least_shared` isn't verified; 0 verifies every one.

    Nulls: a null or empty text, or one without words, resembles nothing and is a class of its own. Null ids are linked as any; a class's
    id is null only if all its ids are, and one of its rows is kept all the same. Rows that share an id are rows of their own. Very long
    texts are taken whole. Empty table: no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    weights = document_frequencies(texts.select("text"))
    hashed = texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = common.checkpoint(hashed.mapInArrow(_signing(weights), _SIGNED))
    own = ("doc_id", "weight", "samples", "bands")
    nodes = rows.filter("key is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in own))
    nodes = common.checkpoint(nodes)
    members = _members(nodes)
    pairs = common.checkpoint(_led(members, least))

    _, near = common.split_by_ids(texts, members.select("doc_id"))
    sets = near.mapInArrow(_sets(weights), "key binary, entries binary").join(members.select("key").distinct(), "key", "left_semi")
    sets = common.checkpoint(sets.dropDuplicates(["key"]))

    parts = common.checkpoint(connected_components(common.checkpoint(_verified(pairs, sets, least)), "a", "b"))
    found = common.checkpoint(_found_in_open(members, nodes, sets, parts, least, least_shared))
    if not found.isEmpty():
        parts = _joined(parts, found)
    return _classes(rows, parts)


def _members(nodes: DataFrame) -> DataFrame:
    """(key, doc_id, weight, band, bucket, n, blocks, block, leads) of every node in buckets of two or more; n counts the bucket."""
    buckets = nodes.select("key", "doc_id", "weight", F.posexplode("bands").alias("band", "bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("bucket", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    buckets = buckets.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    members = buckets.join(sizes, ["bucket", "salt"]).drop("salt").withColumn("blocks", F.expr(f"n div {BLOCK} + 1"))
    members = common.checkpoint(members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))))
    central = members.groupBy("key").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "key").groupBy("bucket").agg(F.max(F.struct("central", "key", "weight")).alias("leader"), F.max("blocks").alias("blocks"))
    return common.checkpoint(members.join(_dealt(leaders).select("bucket", "block", "leader"), ["bucket", "block"]))


def _dealt(buckets: DataFrame) -> DataFrame:
    """A row for each block of each bucket."""
    return buckets.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))


def _led(members: DataFrame, least: float) -> DataFrame:
    """Each pair (leader, key) once whose weights allow a similarity of `least`, in blocks of a leader."""
    alike = F.least("leader.weight", "weight") >= F.greatest("leader.weight", "weight") * F.lit(least - 1e-5)
    pairs = members.filter((F.col("leader.key") != F.col("key")) & alike).select(F.col("leader.key").alias("leader"), "key", "blocks")
    pairs = pairs.groupBy("leader", "key").agg(F.max("blocks").alias("blocks"))
    return pairs.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among pairs; a leader's set meets its pairs in blocks."""
    place = ["leader", "blocks", "block"]
    leaders = pairs.select(*place).distinct().join(sets.toDF("leader", "of_leader"), "leader")
    both = pairs.join(sets, "key").join(leaders, place).select("leader", "key", "of_leader", "entries")
    return both.mapInArrow(_verifying(least), _LINKS)


def _found_in_open(members: DataFrame, nodes: DataFrame, sets: DataFrame, parts: DataFrame, least: float, least_shared: float) -> DataFrame:
    """Links (a, b) that leaders haven't shown, from buckets whose members are in several components."""
    where = members.join(parts.toDF("key", "part"), "key", "left").withColumn("part", F.coalesce("part", "key"))
    counted = where.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    split = counted.groupBy("bucket").agg(
        F.max(F.struct("n", "part")).alias("big"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("blocks").alias("blocks")
    )
    # a bucket of two is decided by its leader
    split = split.filter("parts > 1 and n > 2").select(
        "bucket", "blocks", F.col("big.part").alias("largest"), F.expr(f"(n - big.n) div {BLOCK} + 1").alias("turns")
    )
    rows = where.join(_dealt(split).drop("blocks"), ["bucket", "block"])
    rows = rows.select(
        "bucket", "band", "key", "part", "weight", "blocks", "block", "turns",
        (F.col("leader.key") == F.col("key")).alias("leads"), (F.col("part") == F.col("largest")).alias("main"),
    ).join(nodes.select("key", "samples", "bands"), "key")
    turn = F.pmod(F.xxhash64("key", F.lit("turn")), F.col("turns"))
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    held = rows.withColumns({"other": F.lit(False), "i": F.col("block"), "j": F.explode(until("turns"))})
    others = rows.filter("not main").withColumns({"other": F.lit(True), "i": F.explode(until("blocks")), "j": turn})
    columns = [*_GROUP, "other", "band", "key", "part", "weight", "leads", "main", "samples", "bands"]
    groups = held.select(*columns).unionByName(others.select(*columns))
    wanted = _grouped(groups).mapInArrow(_wanting(least, least_shared), groups.schema)
    return _grouped(wanted.join(sets, "key")).mapInArrow(_linking(least, least_shared), _LINKS)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _joined(parts: DataFrame, found: DataFrame) -> DataFrame:
    """parts(node, component) after new links found(a, b): only components are searched, not their nodes."""
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    alone = ends.join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
    parts = common.checkpoint(parts.unionByName(alone))
    touched = found.join(parts.toDF("a", "u"), "a").join(parts.toDF("b", "v"), "b").select("u", "v").distinct()
    moved = connected_components(common.checkpoint(touched), "u", "v").toDF("component", "now")
    moved = parts.join(moved, "component", "left")
    return common.checkpoint(moved.select("node", F.coalesce("now", "component").alias("component")))


def _classes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The result for every row from the components of nodes."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha"))
    copies = rows.filter("key is not null").groupBy("key").agg(first.alias("first"), F.count("*").alias("rows"))
    # nodes of one row without a link are classes of their own and take no part in what follows
    grouped = copies.join(parts.withColumnRenamed("node", "key"), "key", "left").filter("component is not null or rows > 1")
    grouped = grouped.withColumn("component", F.coalesce("component", "key"))
    classes = grouped.groupBy("component").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size"))
    named = grouped.select("key", "component").join(classes, "component")
    out = common.checkpoint(rows.filter("key is not null").select("doc_id", "sha", "key").join(named, "key", "left"))
    single = rows.filter("key is null").select("doc_id", "sha").unionByName(out.filter("component is null").select("doc_id", "sha"))
    single = single.withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    both = single.unionByName(_first_kept(out.filter("component is not null")))
    return both.select("doc_id", "class_id", "class_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _first_kept(rows: DataFrame) -> DataFrame:
    """kept: the row with its class's first id and text, one where several have both."""
    from pyspark.sql import Window

    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.lit(1)))
    one = rows.filter(first).withColumn("kept", nth == 1)
    both = one.unionByName(rows.filter(~first).withColumn("kept", F.lit(False)))
    return both.select("doc_id", "sha", F.col("first.doc_id").alias("class_id"), "class_size", "kept")
