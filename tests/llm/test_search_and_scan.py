import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwright.llm import secrets, topk


#: The contract's rules, written out: kind, expression, group that counts, its least length.
CONTRACT = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
     r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]


def brute_secrets(text):
    text, found, counts = text or "", [], [0, 0, 0]
    for rank, (_, pattern, group, least) in enumerate(CONTRACT):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), rank, m.end()))
                counts[rank] += 1
    spans = ",".join(f"{CONTRACT[r][0]}:{a}:{b}" for a, r, b in sorted(found))
    return (*counts, hashlib.sha256(spans.encode()).hexdigest())


def test_secrets_match_brute_force(spark, odd_docs, sf_dir):
    more = spark.createDataFrame([(100, "PASSWD:shortshort1x api_key=\"ABCDEFGHIJKLM\" apikey='shrt'"), (101, "ſecret=abcdefghijklmnop"), (102, "deadbeef" * 3 + "g"), (103, "deadbeef"), (104, "beefbeef12345678")], "doc_id long, text string")
    for docs in (odd_docs, more, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sorted(map(tuple, secrets.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=str)
        assert got == sorted(((r.doc_id, *brute_secrets(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)


def test_secrets_of_nothing(no_docs):
    assert secrets.find_secrets(no_docs).count() == 0


def test_more_rules_add_spans(spark):
    row = secrets.find_secrets(spark.createDataFrame([(1, "x ghp_" + "a1B2" * 9)], "doc_id long, text string")).first()
    assert row.spans == "github:2:42" and row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.found[0].text.startswith("ghp_")


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets._trigrams(secrets.trigram_query("AKIA[A-Z0-9]+")) == {int.from_bytes(b, "big") for b in (b"aki", b"kia")}
    assert secrets.trigram_query("abc|x") is None
    assert secrets.trigram_query("(abc|xyz)?def") == int.from_bytes(b"def", "big") or secrets._trigrams(secrets.trigram_query("(abc|xyz)?def")) >= {int.from_bytes(b"def", "big")}


def brute_top(rows, k, every):
    out = []
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    """Also with many blocks, spans and blocks of queries, with rows that share an id, and with columns named as the operator's own."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(2, block // 8))
    monkeypatch.setattr(topk, "LANE", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + i % 3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, []), (402, [1.0, None] * 4), (403, [float("nan")] * 8)]
    rows += [(404, [float("inf")] * 8), (None, rows[0][1]), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (550, [0.0] * 8)]
    rows += [rows[50], rows[50], rows[8], (8, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    names = ("dim", "norm", "data", "ids", "rank", "score", "query_id", "span", "part", "asked", "least", "number", "lane", "longest")
    df = df.withColumns({c: F.lit("x") for c in names}).repartition(5)
    got = sorted(map(tuple, topk.top_k(df, 5, 50).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows, 5, 50)
    assert topk.top_k(df.limit(0), 5, 50).count() == 0


def uneven_vectors():
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 100, (3000, 16)) * rng.gamma(1, 1, (3000, 1))).astype(np.int64)
    scores = v[:40] @ v.T
    scores[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    want = np.lexsort((np.broadcast_to(np.arange(3000), scores.shape), ~scores))[:, :5]
    return v, want, np.linalg.svd(v.T.astype(float) @ v)[0], np.argsort(-np.linalg.norm(v, axis=1))


def test_pruned_blocks_lose_nothing():
    v, want, turn, order = uneven_vectors()
    best = topk.TopK(40, 5)
    for i in range(0, 3000, 500):
        part = np.sort(order[i : i + 500])
        topk.search_block(best, np.arange(40), v[:40], part, v[part], turn)
    assert (best.ids == want).all()


def test_thresholds_travel_from_the_longest_block_to_all_spans():
    """Each span alone finds what it has of the best, but scores few of its vectors; many spans aren't joined at all."""
    v, want, turn, order = uneven_vectors()
    cuts = [order[i : i + 250] for i in range(0, 3000, 250)]
    norms = np.linalg.norm(v, axis=1)
    blocks = [{"ids": c.tobytes(), "data": v[c].tobytes(), "longest": norms[c].max(), "number": n} for n, c in enumerate(cuts)]
    asked = pd.DataFrame([{"dim": 16, "asked": 0, "ids": np.arange(40).tobytes(), "data": v[:40].tobytes(), "least": None, "reach": 0.0}])
    started = topk._starting(5, {16: turn})(asked, pd.DataFrame(blocks[:1]))
    found, scored, alone, skipped = [], 0, 0, 0
    for i in range(0, len(blocks), 2):
        span = pd.DataFrame(blocks[i : i + 2])
        alone += topk.search(asked, span, 5, turn)[2]
        if span["longest"].max() < started["reach"].iloc[0]:
            skipped += 1
            continue
        q_ids, best, n = topk.search(started, span, 5, turn)
        scored += n
        found += [(q, -int(s), int(i)) for q, ids, scores in zip(q_ids, best.ids, best.scores) for i, s in zip(ids, scores)]
    first = [[i for _, _, i in sorted(f for f in found if f[0] == q)[:5]] for q in range(40)]
    assert first == want.tolist()
    assert scored < 0.25 * 40 * 3000 and scored < 0.5 * alone


def test_large_scores_stay_exact():
    a = np.array([[2**40 + 1, 3]])
    assert topk.exact_scores(a, np.array([[5, 7]]))[0, 0] == (2**40 + 1) * 5 + 21
    assert topk.exact_scores(np.array([[2**62]]), np.array([[2**62]]))[0, 0] == 2**63 - 1


def test_near_ties_at_the_end(spark):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(60), "embedding": [[1.0, 0.0]] * 60}))
    got = topk.top_k(df, 5, 50).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_unknown_parts_amid_a_pattern_lose_no_match(spark):
    patterns = ["foo([0-9]+)bar", "foo[0-9]{4}bar", "foo[0-9]?bar", "foo(?:[0-9]+ab)bar", "foo(x|[0-9]+y)?bar", "foo(?:[0-9]z){2}bar"]
    texts = ["foo12bar", "x foo1234bar", "foobar", "foo7bar foo77bar", "foo5abbar", "foo5ybar", "fooxbar", "foo1z2zbar", "food bark", None]
    rules = tuple(secrets.Rule(f"rule{k}", p, 0, 0) for k, p in enumerate(patterns))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, f.kind, f.start) for r in secrets.find_secrets(docs, rules).collect() for f in r.found}
    assert got == {(i, f"rule{k}", m.start()) for i, t in enumerate(texts) for k, p in enumerate(patterns) for m in re.finditer(p, t or "", re.ASCII)}
