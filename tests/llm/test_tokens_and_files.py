import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meshwright.llm import common, packing, simple8b
from meshwright.llm.queries import tokenizer_path
from meshwright.llm.tokens import BatchEncoder


def test_encoder_equals_the_library():
    encoder, rng = BatchEncoder.of(tokenizer_path()), random.Random(4)
    parts = ["a", "b", "'", "'s", "'t", "'re", "'ll", "ll", "v", "e", " ", "  ", "\n", "\t", "\r\n", "1", "22", "!", "?", "é", "ñ", "ß", "Ω", "中", "\xa0", "\x85", "\x1c", "́", "😀", "'D", "<|endoftext|>", "_", "²", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["x " * 700_000, "y" * 1_100_000]
    ids, counts = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3], [2**63 + 5, 1, 2**61, 15 << 60, 3] * 500, [2**60 - 1, 2**30, 1], list(range(5000)), [1] * 3000, [50256] * 2049])
def test_simple8b_round_trip(ids):
    words, offsets = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets.astype(np.int64)).tolist() == ids
    assert simple8b.unpack_segment(simple8b.pack_segment(np.array(ids, np.uint64), [len(ids)]))[0].tolist() == ids


def test_simple8b_refuses_other_bytes():
    with pytest.raises(ValueError):
        simple8b.unpack_segment(b"x" * 64)


def encoded(docs, end):
    encoder = BatchEncoder.of(tokenizer_path())
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    return [(i, np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_files_round_trip(spark, odd_docs, tmp_path):
    simple8b.write_ids(odd_docs, str(tmp_path / "ids"), tokenizer_path())
    got = simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    want = encoded(odd_docs, 0)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and got[0].doc_id is None
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, r.ids) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes()), x.tolist()) for i, x in want)


def test_no_documents_no_ids(spark, no_docs, tmp_path):
    simple8b.write_ids(no_docs, str(tmp_path / "none"), tokenizer_path())
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


def check_packed(rows, want, length=2048):
    spent, pieces = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        spent.setdefault(r.sequence_id, []).append(r)
    for window in spent.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    by = {}
    for i, x in want:
        by.setdefault((i, len(x)), []).append(x)
    assert set(by) == set(pieces)
    for k, parts in pieces.items():
        copies = len(by[k])
        assert sum(r.length for r in parts) == copies * k[1]
        if copies == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(by[k][0][at : at + r.length].tobytes())
                at += r.length
    return len(spent)


def test_packing_places_each_id_once(spark, odd_docs, sf_dir):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(70)):
        want = encoded(docs, 1)
        windows = check_packed(packing.pack_documents(docs, tokenizer_path()).collect(), want)
        total = sum(len(x) for _, x in want)
        assert windows * 2048 - total <= 2048 + 16 * windows


def test_packing_nothing_and_with_ids(no_docs, odd_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0
    for r in packing.pack_documents(odd_docs, tokenizer_path(), include_ids=True).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 2**53 + 1, -(2**62) - 1, None]
    rows = [(i, f"text number {k} " * (k + 1) * 40) for k, i in enumerate(ids)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        check_packed(packing.pack_documents(docs, tokenizer_path()).collect(), encoded(docs, 1))


def test_rows_of_one_id_lie_in_several_files(spark, tmp_path):
    """A third of all rows without an id, a third of one id, half of them of one text; large ids too."""
    rows = [((None, 7, 2**60 + i)[i % 3], f"text {i // 6 if i % 2 else 'again'} " * 9) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    simple8b.write_ids(docs, str(tmp_path / "ids"), tokenizer_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "ids")).collect()
    assert max(len(r.doc_ids) for r in files) < 1200 and len({r.part for r in files if 7 in r.doc_ids}) > 1
    got = simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = Counter((str(i), x.tobytes()) for i, x in encoded(docs, 0))
    assert Counter((str(r.doc_id), np.array(r.ids, "<u4").tobytes()) for r in got) == want


def test_windows_fit_best_and_emit_the_fullest():
    w = packing.Windows(10, 2, 3)
    ids = np.arange(30, dtype="<u4")
    w.add(1, 0, ids[:6], 6)
    w.add(2, 0, ids[:8], 8)
    w.add(3, 0, ids[:2], 2)  # fits both; best in the second
    assert [len(x) for x in w.out] == [2] and w.out[0][1][0] == 3
    w.add(4, 0, ids[:9], 9)
    w.add(5, 0, ids[:5], 5)  # none fits: the fullest lacks one id, too few for a cut, and goes padded
    assert sum(len(p[2]) for p in w.out[1]) == 9
    w.finish()
    assert sum(len(p[2]) for x in w.out for p in x) == 30


def test_slices_cover_everything():
    assert list(common.slices(np.array([3, 3, 9, 1, 0]), 6)) == [(0, 2), (2, 3), (3, 5)]
