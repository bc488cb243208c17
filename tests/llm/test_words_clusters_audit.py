import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshwright.llm import centroids, filter_audit, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


LIBRARY = Tokenizer.from_file(WORD_BPE)


def by_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def odd_texts(n):
    rng = random.Random(11)
    parts = ["a", "B", "'", "'s", "'T", "'re", "'LL", "ll", "É", "é", "é", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "​", "1", "٣", "Ⅷ", "½", "!", "?", "Σ", "ΑΣ", "İ", "ß", "ſ", "中文", "한국", "가", "हिन्दी", "😀", "👩‍🚀", "\x00", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "ǅ", "Ꭰ", "ᲀ", "\U00010400"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_words_are_those_of_the_library():
    splitter, tokenizer = words.WordSplitter.of(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in odd_texts(4000):
        assert [i for w in splitter.words(text) for i in splitter.ids(w)] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_steps_lose_no_character(monkeypatch):
    monkeypatch.setattr(words, "STEP", 7)
    for text in [*odd_texts(300), "", "x" * 40, "a b " * 20]:
        parts = list(words._steps(text))
        assert "".join(parts) == text and [w for p in parts for w in words.WordSplitter.of(WORD_BPE).words(p)] == words.WordSplitter.of(WORD_BPE).words(text)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_round_trip_equals_the_library(spark, odd_docs, sf_dir, monkeypatch, block):
    """Nulls, empty, long and repeated rows, clashing names; many small lists of words; ids that are sent in many parts."""
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(words, "HELD", 500)
    more = spark.createDataFrame([(2**60 + i // 2, t) for i, t in enumerate(odd_texts(600))] + [(None, "x" * 5000), (None, "x" * 5000)], "doc_id long, text string")
    for docs in (odd_docs, more.repartition(5), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids, text = by_library(r.text or "")
            want[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text), tuple(ids), text)] += 1
        got = words.encode(docs, WORD_BPE)
        assert Counter((*r[:4], tuple(r.ids), r.decoded) for r in got.collect()) == want
        assert Counter(map(tuple, words.encode(docs, WORD_BPE, whole=False).collect())) == Counter(x[:4] for x in want.elements())


def test_decoding_any_ids(spark, monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 3)
    rng, tokenizer = random.Random(1), Tokenizer.from_file(WORD_BPE)
    lists = [[rng.randrange(49408) for _ in range(rng.randint(0, 20))] for _ in range(60)] + [[], None, [5, None, 7], [49407, 10**6, 3], [7] * 500, [7] * 500]
    rows = spark.createDataFrame([(i, x, "x") for i, x in enumerate(lists)], "k int, ids array<int>, decoded string").withColumn("_row", F.lit(1)).repartition(3)
    got = {r.k: r.decoded for r in words.decode(rows, WORD_BPE).collect()}
    assert got == {i: tokenizer.decode([t for t in x or [] if t is not None], skip_special_tokens=False) for i, x in enumerate(lists)}
    assert words.decode(rows.limit(0), WORD_BPE).count() == 0


def test_no_words(no_docs, spark):
    assert words.encode(no_docs, WORD_BPE).count() == 0
    row = words.encode(spark.createDataFrame([(1, " \n")], "doc_id long, text string"), WORD_BPE).first()
    assert (row.n_tokens, row.ids, row.decoded, row.ids_sha256) == (0, [], "", sha(""))
    with pytest.raises(ValueError):
        words.encode(no_docs, public_tokenizers.path("byte_bpe_50k.json"))


def brute_clusters(rows, k, rounds, scale, size, seed="1:"):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    centers = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}{r[0]}"), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min(range(len(centers)), key=lambda c: (gap(v, centers[c]), c))
    for _ in range(rounds):
        own = [place(v) for _, v in kept]
        for c in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, place(v), v) for i, v in kept]
    inertia = Counter()
    for _, c, v in found:
        inertia[c] += gap(v, centers[c])
    return Counter((i, c, gap(v, centers[c]), inertia[c], sum(inertia.values()), sha(",".join(map(str, centers[c])))) for i, c, v in found)


@pytest.mark.parametrize("heavy", [1024, 4])
def test_clusters_match_brute_force(spark, monkeypatch, heavy):
    """A third of all rows in one vector, repeated and null ids, ties, vectors that take no part, clashing names."""
    monkeypatch.setattr(centroids, "HEAVY", heavy)
    rng = np.random.default_rng(3)
    rows = [(i if i % 9 else None, rng.normal(0, 1, 4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(100)] + [(5, rows[5][1])] * 3
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0]), (2003, [float("nan"), 0.0, 0.0, 0.0]), (2004, [float("-inf"), 0.0, 0.0, 0.0]), (2005, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumns({c: F.lit("x") for c in ("point", "weight", "cluster", "distance", "inertia", "sums", "dim")}).repartition(5)
    got = Counter(map(tuple, centroids.cluster(df, k=5, scale=8, size=4).collect()))
    assert got == brute_clusters(rows, 5, 3, 8, 4)
    few = df.filter("vec_id in (1, 2)")
    assert Counter(map(tuple, centroids.cluster(few, k=5, scale=8, size=4).collect())) == brute_clusters([r for r in rows if r[0] in (1, 2)], 5, 3, 8, 4)
    assert centroids.cluster(df.limit(0), k=5, size=4).count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>"), size=2).collect()


def test_sums_beyond_64_bits(spark):
    """Weighted sums that no long holds are floored right."""
    distinct = spark.createDataFrame([([2**28, -(2**28)], 2**40), ([2**28 - 1, 3], 2**40 + 1)], "point array<long>, weight long")
    total = 2**28 * 2**40 + (2**28 - 1) * (2**40 + 1), -(2**28) * 2**40 + 3 * (2**40 + 1)
    got = centroids.lloyd(distinct, np.array([[0, 0]], np.int64), 1)
    assert got.tolist() == [[t // (2**41 + 1) for t in total]]


def brute_audit(docs, labels):
    label = lambda column: {r["doc_id"] for r in labels if r[column] == 1 and r["doc_id"] is not None}
    good, toxic, least, rows = label("quality"), label("toxic"), {}, []
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    for r in docs:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search("[#$%&*|]", text)), "E": r.doc_id is not None and r.doc_id > least[text]}
        rows.append((r.lang or "", {k for k in mask if mask[k]}, r.doc_id in good, r.doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                there = [(not set(order[:step]) & fails, f in fails, fails == {f}, g, t) for p, fails, g, t in rows if p == part]
                removed = [x for x in there if x[0] and x[1]]
                out[part, "".join(order), step + 1] = (
                    sum(x[0] and not x[1] for x in there), len(removed), sum(x[1] and not x[0] for x in there), sum(x[2] for x in there),
                    sum(x[3] for x in removed), sum(x[4] for x in removed),
                )
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_brute_force(spark, odd_docs):
    """Copies with and without ids, ids that repeat, ids with several labels, labels that are null, clashing names."""
    rows = [(i % 40 if i % 7 else None, ["word " * 300, "Short $ text", "", None, " ".join(f"w{j}" for j in range(220)), "ABC DEF", " x y"][i % 7 - i % 3], ["en", "de", None, ""][i % 4]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "sha", "n", "good", "salt")}).unionByName(odd_docs.select("doc_id", "text", "lang"), allowMissingColumns=True).repartition(4)
    told = [(i % 45 if i % 5 else None, [1, 0, None][i % 3], [0, 1, None][i % 4 % 3]) for i in range(90)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    want = brute_audit(docs.collect(), [r.asDict() for r in labels.collect()])
    got = filter_audit.audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)
    assert all(r.filter == r.filter_order[r.step - 1] for r in got)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}
