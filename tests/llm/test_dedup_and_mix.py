import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwright.llm import common, exact_dedup, golomb, mixing, near_dedup, sharding
from meshwright.llm.shingles import Shingler, distinct


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n, span in ((0, 10), (1, 2**48), (500, 2**40), (1000, 500)):
        values = np.sort(rng.integers(0, span, n)).astype(np.uint64)
        low = golomb.parameter(n, span)
        assert golomb.decode(golomb.encode(values, low), n, low).tolist() == values.tolist()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((str(i), str(keep), len(ids), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup_matches_brute_force(spark, odd_docs, sf_dir):
    copies = spark.createDataFrame([(i, "the very same text" if i % 3 else f"text {i}") for i in range(400)], "doc_id long, text string").repartition(9)
    for docs in (odd_docs, copies, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.find_duplicates(docs).collect())
        assert got == brute_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FINGERPRINT_BITS", 4)
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(180)], "doc_id long, text string")
    got = exact_dedup.find_duplicates(docs, owners=3).collect()
    assert len(got) == 180 and all(r.group_size == 2 and r.keep_id == r.doc_id % 90 for r in got)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    """A hash that knows only how a text begins: the bytes decide."""
    monkeypatch.setattr(exact_dedup, "_digest", lambda body: F.unhex(F.sha2(F.substring(F.col(body), 1, 1).cast("binary"), 256)))
    rows = [(i, f"{'abc'[i % 3]}{i % 4}") for i in range(24)] + [(None, "a0"), (24, "z"), (0, "a0")]
    got = exact_dedup.find_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), owners=3).collect()
    assert sorted(r[:4] for r in map(tuple, got) if r[0] is not None) == sorted(r[:4] for r in brute_exact_ids(rows) if r[0] is not None)
    assert sum(r.kept for r in got) == 13 and len(got) == 27


def brute_exact_ids(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for ids in groups.values():
        keep, seen = min(i for i in ids if i is not None), False
        for i in ids:
            kept = i == keep and not seen
            seen = seen or kept
            yield i, keep, len(ids), kept


def test_hot_texts_send_each_fingerprint_once(spark):
    """A text that nearly all rows share is one fingerprint of a packet."""
    sent = []
    made = exact_dedup._answer
    docs = spark.createDataFrame([(i, "the very same text" if i % 50 else f"text {i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    rows = docs.select("doc_id", exact_dedup._digest("text").alias("sha"))
    packets = rows.mapInArrow(exact_dedup._send(4, 48), exact_dedup._SENT).toPandas()
    assert packets["n"].sum() == 60 + 3 and packets["doc_ids"].map(len).sum() == 3000
    for _, of in packets.groupby("owner"):
        sent += made(of)["bitmap"].tolist()
    assert len(sent) == len(packets)
    got = exact_dedup.find_duplicates(docs).collect()
    assert Counter(r.group_size for r in got) == Counter({2940: 2940, 1: 60}) and sum(r.kept for r in got) == 61


def test_ids_and_hashes_stay_where_they_are(spark):
    """The join of packets and bitmaps shuffles the bitmaps alone; the packets' table goes when it is done."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(99)] + [(None, "text 1")], "doc_id long, text string").repartition(3)
    packets = docs.select("doc_id", exact_dedup._digest("text").alias("sha")).mapInArrow(exact_dedup._send(4, 48), exact_dedup._SENT)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with common.bucketed(packets, "source") as sent:
            prints = sent.select("source", "owner", "n", "low", "prints", "here")
            bitmaps = prints.groupBy("owner").applyInPandas(exact_dedup._answer, "source long, owner int, bitmap binary")
            joined = exact_dedup._at_home(sent, bitmaps)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert joined.select(F.sum(F.size("doc_ids"))).first()[0] == 100
        shuffled = [line for line in plan.split("\n") if "Exchange" in line]
        # fingerprints to their owners, bitmaps to their sources
        assert plan.count("SortMergeJoin") == 1 and "Bucketed: true" in plan
        assert ["owner" in line for line in shuffled] == [False, True] and "source" in shuffled[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert exact_dedup.find_duplicates(docs).count() == 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_owners_follow_the_rows_and_files_lie_in_the_shared_folder(spark, monkeypatch):
    """No owner gets many more fingerprints than OWNED; the bucketed table's files aren't the warehouse's and go with it."""
    monkeypatch.setattr(exact_dedup, "OWNED", 50)
    seen = []
    send = exact_dedup._send
    monkeypatch.setattr(exact_dedup, "_send", lambda owners, bits: seen.append(owners) or send(owners, bits))
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, exact_dedup.find_duplicates(docs).select("doc_id", "keep_id", "group_size").collect())) == [(i, i % 700, 2 if i % 700 < 300 else 1) for i in range(1000)]
    assert seen == [20]
    prints = docs.select("doc_id", exact_dedup._digest("text").alias("sha")).mapInArrow(send(20, 48), exact_dedup._SENT)
    assert prints.groupBy("owner").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 100
    with common.bucketed(prints, "source") as table:
        (folder,) = {re.sub("^file:/+", "/", f.rsplit("/", 1)[0]) for f in table.inputFiles()}
        assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_many_sources_meet_their_rows_under_several_keys(spark, monkeypatch):
    """More sources than a broadcast may hold: the same mix, a null source included."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 70}") for i in range(400)], "doc_id long, text string, source string").repartition(4)
    want = sorted(map(str, mixing.mix(docs).collect()))
    staged = sorted(map(str, corpus_pipeline.mixed(spark, docs, None).collect()))
    monkeypatch.setattr(common, "MOST_SENT", 3)
    assert sorted(map(str, mixing.mix(docs).collect())) == want
    assert sorted(map(str, corpus_pipeline.mixed(spark, docs, None).collect())) == staged


def test_the_last_search_may_verify_every_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rows: sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in rows)
    assert key(near_dedup.near_duplicates(docs, least_shared=0).collect()) == key(near_dedup.near_duplicates(docs).collect())


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.find_duplicates(no_docs).count() == 0


def test_shards_are_exact_and_gapless(spark, odd_docs, no_docs):
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.select("doc_id", "text").collect()}
    for r in sharding.shard(odd_docs, 40).collect():
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
    for docs, n in ((odd_docs, 12), (spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 7 AS int)) AS text"), 5000), (no_docs, 0)):
        rows = sharding.shard(docs, 40).collect()
        assert len(rows) == n and all(r.law == "rows" and r.grown_shard is None for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by.get(k, [])) for k in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_blocks_grow_with_the_input(spark, monkeypatch):
    """More runs, and more partitions, than the driver may draw for."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    monkeypatch.setattr(sharding, "MOST_BLOCKS", 4)
    seen, draw = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda rows, *a: seen.append(len(rows)) or draw(rows, *a))
    for parts in (2, 15):
        docs = spark.range(0, 900, 1, parts).selectExpr("id AS doc_id", "'x' AS text")
        by = Counter(r.shard for r in sharding.shard(docs, 7).collect())
        assert sum(by.values()) == 900 and max(by.values()) - min(by.values()) <= 1 and seen[-1] <= 8


def test_communication_matrix_has_its_margins_and_spread():
    rows, shards = [1000, 1, 0, 300], [400, 401, 500]
    draws = np.array([sharding.communication_matrix(rows, shards, s) for s in range(400)])
    assert (draws.sum(2) == rows).all() and (draws.sum(1) == shards).all()
    want = np.outer(rows, shards) / 1301
    assert np.abs(draws.mean(0) - want)[0].max() < 1.5
    variance = 300 * (400 / 1301) * (901 / 1301) * (1001 / 1300)
    assert 0.75 < draws[:, 3, 0].var() / variance < 1.3


def words(text):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def brute_weights(rows):
    """Each document's shingles and weights, from exact document frequencies."""
    counts = []
    for i, t in rows:
        w = words(t)
        counts.append((i, Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()))
    frequency = Counter(s for _, c in counts for s in c)
    n = sum(bool(c) for _, c in counts)

    def weight(shingle, tf):
        raw = (1 + math.log(tf)) * (1 + 0.5 * math.log1p(n / frequency[shingle]) / math.log1p(n))
        return 1.02 ** round(math.log(raw) / math.log(1.02))

    return [(i, {s: weight(s, tf) for s, tf in c.items()}) for i, c in counts]


def jaccard(x, y):
    shared = sum(min(w, y[s]) for s, w in x.items() if s in y)
    return shared / (sum(x.values()) + sum(y.values()) - shared) if shared else 0.0


def brute_classes(rows, least=0.8):
    sets = brute_weights(rows)
    root, holders = list(range(len(sets))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, x) in enumerate(sets):
        for a in {a for s in x for a in holders[s]}:
            if find(a) != find(k) and jaccard(sets[a][1], x) >= least:
                root[find(k)] = find(a)
        for s in x:
            holders[s].append(k)
    classes = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        classes[find(k)].append(i)
    return {frozenset(Counter(map(str, v)).items()) for v in classes.values()}


def edited(base, rng, share):
    return " ".join(f"new{rng.integers(10**9)}" if rng.random() < share else w for w in base)


def test_near_duplicates_match_brute_force(spark, odd_docs, sf_dir):
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(10**6)}" for _ in range(400)]
    planted = spark.createDataFrame([(i, edited(base, rng, 0.008)) for i in range(40)] + [(100 + i, edited([f"v{rng.integers(10**6)}" for _ in range(60)], rng, 0)) for i in range(60)], "doc_id long, text string").repartition(5)
    for docs in (odd_docs, planted, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = near_dedup.near_duplicates(docs).collect()
        classes = defaultdict(list)
        for k, r in enumerate(got):
            classes[r.class_id if r.class_size > 1 else f"alone {k}"].append(r.doc_id)
            assert r.class_size >= 1
        assert all(len(v) == r.class_size for r in got if r.class_size > 1 for v in [classes[r.class_id]])
        assert {frozenset(Counter(map(str, v)).items()) for v in classes.values()} == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sum(r.kept for r in got) == len(classes)


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_samples_agree_as_often_as_weighted_similarity_says():
    sampler, rng = near_dedup.Sampler(2000), np.random.default_rng(5)
    keys = rng.integers(1, 2**63, 200, dtype=np.uint64)
    wa, wb = rng.uniform(0.5, 3, 150), rng.uniform(0.5, 3, 150)
    wb[:50] = wa[50:100]  # the shared ones weigh differently
    a, b = keys[:150], keys[50:]
    shared = np.minimum(wa[50:], wb[:100]).sum()
    want = shared / (wa.sum() + wb.sum() - shared)
    got = (sampler(a, np.log(wa), np.array([150])) == sampler(b, np.log(wb), np.array([150]))).mean()
    assert abs(got - want) < 0.05


def test_shingles_of_a_batch():
    keys, counts = Shingler(5)(pa.array(["a b c d e f", "A, b; c d e", "", "x y", "a b c d e f a b c d e"]))
    assert counts.tolist() == [2, 1, 0, 1, 7] and keys[0] == keys[2] and len(distinct(keys, counts)[0]) == 2 + 1 + 1 + 6


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    for sizes in (np.sort(rng.integers(1, 900, 300))[::-1], np.array([9, 9, 9, 9, 9]), np.array([100, 3, 3, 3]), np.array([7]), np.array([], int), np.array([10**9] + [1] * 40)):
        chances = np.full(len(sizes), 0.3)
        out = mixing.fly(sizes, chances, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - chances.sum()) < 1e-6 and abs((out * sizes).sum() - (chances * sizes).sum()) < 1e-5 * max(1, sizes.sum())
        assert set(mixing.land(out, rng)) <= {0.0, 1.0}
    drawn = np.mean([mixing.land(mixing.fly(np.array([900, 50, 40, 30, 20, 20, 10, 9, 8, 7]), np.full(10, 0.3), rng), rng) for _ in range(3000)], 0)
    assert np.abs(drawn - 0.3).max() < 0.05


def brute_targets(sizes):
    names = sorted([n for n in sizes if n is not None]) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, out = float(sum(sizes.values())), {}
    while True:
        free = [n for n in names if n not in out]
        if not free:
            return out
        level = (total - sum(out.values())) / sum(weight[n] for n in free)
        over = [n for n in free if weight[n] * level > 3 * sizes[n]]
        if not over:
            return out | {n: weight[n] * level for n in free}
        out |= {n: 3.0 * sizes[n] for n in over}


def test_mix_meets_its_targets(spark, odd_docs, sf_dir):
    skewed = spark.createDataFrame([(i, "w " * (1 + i % 50), "tiny" if i < 3 else "huge" if i % 3 else f"s{i % 4}") for i in range(900)], "doc_id long, text string, source string").repartition(6)
    for docs in (odd_docs, skewed, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got, again = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(2)))
        assert got == again
        rows, sizes = mixing.mix(docs).collect(), Counter()
        for r in docs.select("text", "source").collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want, taken, largest = brute_targets(dict(sizes)), Counter(), Counter()
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        assert all(abs(taken[s] - want[s]) <= 1.01 * largest[s] + 1 for s in want)


def test_mix_keeps_large_ids_beside_null_ones(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 2**53 + 1, -(2**62) - 1, None]
    docs = spark.createDataFrame([(i, "w " * (k + 1), "s") for k, i in enumerate(ids)], "doc_id long, text string, source string").repartition(2)
    assert sorted((r.doc_id or 0, r.size) for r in mixing.mix(docs).collect()) == sorted((i or 0, k + 1) for k, i in enumerate(ids))


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_ids_filter_is_exact(spark, odd_docs):
    ids = spark.createDataFrame([(2,), (None,), (9,), (999,)], "doc_id long")
    assert sorted(str(r.doc_id) for r in common.with_ids(odd_docs, ids).collect()) == ["2", "9", "9", "None"]
    assert common.with_ids(odd_docs, ids).count() + common.without_ids(odd_docs, ids).count() == odd_docs.count()


def test_pipeline_stages_keep_columns_and_act(spark, odd_docs, no_docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert stages[name](spark, odd_docs, sf_dir).columns == odd_docs.columns
        assert stages[name](spark, no_docs, sf_dir).count() == 0
    exact = stages["exact_dedup"](spark, odd_docs, sf_dir).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in exact) == sorted(["1", "3", "4", "6", "7", "8", "9", "None", "12"])
    near = stages["near_dedup"](spark, odd_docs, sf_dir).select("doc_id").collect()
    assert Counter(str(r.doc_id) for r in near) == Counter(["1", "2", "3", "4", "6", "7", "8", "9", "None", "12"])
    copies = Counter(str(r.doc_id) for r in stages["mixing"](spark, odd_docs, sf_dir).select("doc_id").collect())
    assert copies == Counter({k: v for k, v in Counter([str(r.doc_id) for r in mixing.mix(odd_docs).collect() for _ in range(r.copies)]).items() if v})


def test_pipeline_mixes_rows_that_repeat(spark, sf_dir):
    """Sources taken 0 to 3 times, ids that several rows share, null ids and sources: each row comes as often as its group is taken."""
    rows = [(None if i % 11 == 0 else i // 2 if i % 7 == 0 else i, "w " * (i % 9), ("a", "b", "c", None)[min(3, i % 13 % 4)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_copy", F.lit("x")).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size, r.source] += r.copies
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split()), r.source) for r in got.collect()) == Counter({k: v for k, v in want.items() if v})


def test_pipeline_of_odd_and_of_no_documents(spark, odd_docs, no_docs, sf_dir, tmp_path):
    """All stages in turn, packing too, on rows with nulls, repeats and clashing names, and on an empty table."""
    labels = spark.createDataFrame([(10**9 + i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 6, 7, 8, 9, 12, None} and bool(rows) == (name == "odd")
        tokens = defaultdict(int)
        for r in rows:
            tokens[r.doc_id, r.doc_tokens] += r.length
        assert all(n % k[1] == 0 for k, n in tokens.items())


def test_pipeline_end_to_end(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def same_buckets(monkeypatch):
    """All texts share all buckets, and no two can be told apart by their samples."""

    class Same(near_dedup.Sampler):
        def __call__(self, shingles, ln_w, counts):
            return np.zeros((len(counts), len(self.seeds)), np.uint32)

    monkeypatch.setattr(near_dedup, "Sampler", Same)


def found_classes(docs):
    classes = defaultdict(list)
    for r in near_dedup.near_duplicates(docs).collect():
        classes[r.class_id].append(r.doc_id)
    return {frozenset(Counter(map(str, v)).items()) for v in classes.values()}


def test_chains_in_large_buckets_are_followed(spark, monkeypatch):
    """Texts that drift apart step by step, all in one bucket: its leader resembles few of them."""
    same_buckets(monkeypatch)
    rng = np.random.default_rng(8)
    text, rows = [f"w{k}" for k in range(300)], []
    for i in range(24):
        rows.append((i, " ".join(text)))
        text[3 + i * 9] = f"other{rng.integers(10**9)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("block", [512, 16])
def test_large_buckets_are_decided_whole(spark, monkeypatch, block):
    """One class that fills a bucket, and pairs and single texts beside it; also where a bucket is many blocks."""
    same_buckets(monkeypatch)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    bases = [[f"b{k}w{rng.integers(10**6)}" for _ in range(200)] for k in range(21)]
    rows = [(i, edited(bases[0], rng, 0.005)) for i in range(120)] + [(300 + i, " ".join(bases[13 + i])) for i in range(8)]
    rows += [(200 + i, edited(bases[1 + i // 2], rng, 0.005)) for i in range(24)]
    assert found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_classes(rows)


def test_buckets_of_over_a_thousand(spark):
    """1500 near copies of one text, some of them linked only to each other, and texts that share its first half."""
    rng = np.random.default_rng(12)
    base = [f"w{rng.integers(10**6)}" for _ in range(60)]
    far = base[:44] + [f"f{k}" for k in range(16)]
    rows = [(i, edited(base, rng, 0.004)) for i in range(1500)] + [(2000 + i, edited(far, rng, 0.004)) for i in range(60)]
    rows += [(3000 + i, " ".join(base[:30] + [f"x{rng.integers(10**6)}" for _ in range(30)])) for i in range(200)]
    assert found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_classes(rows)


def test_weights_decide(spark):
    """Two texts of one similarity by counts: linked where what they share is rare, not where it is in most documents."""
    common_line, rare = [f"c{k}" for k in range(84)], [f"r{k}" for k in range(84)]
    rows = [(k, " ".join(common_line + [f"d{k}w{j}" for j in range(300)])) for k in range(200)]
    rows += [(1000 + k, " ".join(common_line + [f"e{k}w{j}" for j in range(8)])) for k in range(2)]
    rows += [(2000 + k, " ".join(rare + [f"g{k}w{j}" for j in range(8)])) for k in range(2)]
    classes = found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert classes == brute_classes(rows)
    assert frozenset({("2000", 1), ("2001", 1)}) in classes and frozenset({("1000", 1), ("1001", 1)}) not in classes


def test_near_dedup_stage_tells_rows_of_one_id_apart(spark, sf_dir):
    rng = np.random.default_rng(6)
    base = [[f"c{k}w{rng.integers(10**6)}" for _ in range(150)] for k in range(8)]

    def near(k, n):
        return " ".join([*base[k][:-n], *("other" for _ in range(n))])

    rows = [(1, near(0, 1)), (None, near(0, 2)), (None, " ".join(base[1])), (None, " ".join(base[2])), (None, ""), (None, ""), (None, None)]
    rows += [(5, " ".join(base[3])), (5, near(0, 3)), (5, " ".join(base[4])), (3, near(5, 1)), (3, near(6, 1)), (4, near(5, 2)), (4, near(6, 2))]
    rows += [(None, near(7, 1)), (None, near(7, 2)), (None, near(7, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir).collect()]
    nameless = [x for x in got if x in rows[-3:]]
    want = [rows[k] for k in (0, 2, 3, 4, 5, 6, 7, 9, 10, 11)]
    assert len(nameless) == 1 and Counter(x for x in got if x not in nameless) == Counter(want)
    classes = near_dedup.near_duplicates(docs)
    assert Counter(r.class_size for r in classes.filter("kept").collect()) == Counter({1: 7, 2: 2, 3: 2})


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    """A line that 0.5 % of documents hold, one that 2 % hold, and words of one document."""
    seldom, often = "seldom seen line of words ", "often seen line of words "
    rows = [((seldom if i % 200 == 0 else "") + (often if i % 50 == 1 else "") + " ".join(f"d{i}w{k}" for k in range(30)),) for i in range(2000)]
    weights = near_dedup.document_frequencies(spark.createDataFrame(rows, "text string").repartition(7))
    keys = Shingler(5)(pa.array([seldom, often, "d7w1 d7w2 d7w3 d7w4 d7w5"]))[0]
    want = 1 + 0.5 * np.log1p(2000 / np.array([10, 40, 1])) / np.log1p(2000)
    assert 1.02 ** weights(keys, np.ones(3)).astype(float) == pytest.approx(want, rel=0.011)


def test_ids_filter_of_many_ids(spark, odd_docs, monkeypatch):
    """A filter that is full, and more ids than a filter can hold."""
    ids = spark.range(0, 4000, 2).toDF("doc_id")
    for most in (1 << 10, 1 << 4):
        monkeypatch.setattr(common, "MOST_BITS", most)
        far, near = common.split_by_ids(odd_docs, ids)
        assert far.count() + near.count() == odd_docs.count() and far.columns == near.columns == odd_docs.columns
        assert sorted(str(r.doc_id) for r in common.with_ids(odd_docs, ids).collect()) == ["12", "2", "4", "6", "8"]


def test_rows_that_share_an_id_are_dealt_over_chunks(spark, monkeypatch):
    made = mixing._balancing

    def bounded(seed, last):
        balance = made(seed, last)

        def checked(rows):
            assert len(rows) <= 300
            return balance(rows)

        return checked

    monkeypatch.setattr(mixing, "_balancing", bounded)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 100)
    docs = spark.createDataFrame([(None if i % 2 else 5, "w " * (1 + (i % 9 == 0) * i), "s") for i in range(4000)], "doc_id long, text string, source string").repartition(5)
    got, again = (Counter(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(2)))
    assert got == again and sum(got.values()) == 4000
