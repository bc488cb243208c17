"""Token ids of texts by way of a table of distinct words, and texts from ids.

For vocabularies whose words are coded one by one: a text is cut into words, each distinct word goes through the library's model
once, and its ids come back to every position that holds the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshwright.llm import common
from meshwright.llm.tokens import _byte_letters as byte_letters

#: Characters of texts whose words share a list of distinct words (a longer text has a list of its own).
BLOCK = 32 << 20
#: Characters that are cut into words at a time.
STEP = 1 << 20
#: Words whose ids are held before they are sent to their blocks.
HELD = 1 << 20
#: Ids that decode() joins and puts in order as one group.
CHUNK = 4096

_ZSTD = pa.Codec("zstd")


class WordSplitter:
    """words(text): the vocabulary's words, in order, as plain text. Strings of added tokens are words of their own, as in the library.

    The tokenizer's own expression runs on lower-cased text. Each new character is first tried in both; texts with
    one that the two treat differently, and texts that aren't in NFC, go through the library, as do all texts where a tokenizer has
    other rules.
    """

    _held: dict[str, WordSplitter] = {}

    @classmethod
    def of(cls, path: str) -> WordSplitter:
        """One for each worker process and vocabulary."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that depend on what stands around them aren't supported")
        self.added = {t.content for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.bytes = {c: b for b, c in byte_letters().items()}
        self.pattern = self._expression()
        #: The final sigma depends on what follows in Python, not in the library.
        self.fine, self.odd = set(), {"Σ"}
        self._try(set(map(chr, range(128))))
        odd = "".join(sorted(c for c in self.odd if c.isascii()))
        self.odd_ascii = re.compile(f"[{re.escape(odd)}]") if odd else None

    def _expression(self) -> regex.Pattern | None:
        """The expression that finds words, where normalizer and pre-tokenizer are those that the fast way can do."""
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        normal, pre = state(self.tokenizer.normalizer).get("normalizers", []), state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if normal != [{"type": "NFC"}, spaces, {"type": "Lowercase"}] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            return None
        split, letters = pre
        if split["behavior"] != "Removed" or not split["invert"] or letters["use_regex"] or letters["add_prefix_space"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _try(self, new: set[str]) -> None:
        for c in new:
            text = f"a{c}a 1{c}1 !{c}! {c}{c} {c}"
            same = self.pattern is not None and self.pattern.findall(text.lower()) == self._by_library(text)
            (self.fine if same else self.odd).add(c)

    def _by_library(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in pieces]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            if self.pattern is not None and not (self.odd_ascii and self.odd_ascii.search(text)):
                return self.pattern.findall(text.lower())
            return self._by_library(text)
        chars = set(text)
        self._try(chars - self.fine - self.odd)
        if self.odd.isdisjoint(chars) and unicodedata.is_normalized("NFC", text):
            return self.pattern.findall(text.lower())
        return self._by_library(text)

    def words(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def ids(self, word: str) -> list[int]:
        """The ids of one of the words."""
        if word in self.added:
            return [self.tokenizer.token_to_id(word)]
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]


_LETTERS = str.maketrans({chr(b): c for b, c in byte_letters().items()})


def _steps(text: str) -> Iterator[str]:
    """A text in parts of about STEP characters: no word goes over a space."""
    at = 0
    while len(text) - at > STEP:
        cut = text.rfind(" ", at + 1, at + STEP)
        cut = cut if cut > 0 else text.find(" ", at + STEP)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31, their bytes plane by plane."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = _ZSTD.decompress(blob[8:], 4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int32)


def _listed(words: list[str]) -> bytes:
    """Words as one value; no text holds the byte between them."""
    raw = b"\xff".join(w.encode() for w in words)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unlisted(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], n, asbytes=True).split(b"\xff") if n else []


_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, places binary, words binary"


def _splitting(path: str):
    def split(batches):
        """Blocks of texts: their distinct words, frequent ones first, and at each position the number of its word there."""
        from pyspark import TaskContext

        splitter, block = WordSplitter.of(path), TaskContext.get().partitionId() << 32
        names, sizes, places, chars, numbers = [], [], [], 0, defaultdict(count().__next__)

        def flush():
            at = np.concatenate(places or [np.zeros(0, np.int32)])
            order = np.argsort(-np.bincount(at, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            words = list(numbers)
            row = (block, names, sizes, _packed(rank[at]), _listed([words[i] for i in order.tolist()]))
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["block", "doc_ids", "sizes", "places", "words"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                text, before = text.as_py(), len(places)
                for part in _steps(text):
                    words = splitter.words(part)
                    places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                names.append(name.as_py())
                sizes.append(sum(map(len, places[before:])))
                chars += len(text)
                if chars >= BLOCK:
                    yield flush()
                    block += 1
                    names, sizes, places, chars, numbers = [], [], [], 0, defaultdict(count().__next__)
        if names:
            yield flush()

    return split


def _listing(block: pa.Table) -> pa.Table:
    """A row for each distinct word of a block, with its number there."""
    words = pa.array(_unlisted(block["words"][0].as_py()), pa.binary()).cast(pa.string())
    same = np.full(len(words), block["block"][0].as_py(), np.int64)
    return pa.table({"block": same, "number": np.arange(len(words), dtype=np.int32), "word": words})


_FOUND = "block long, numbers array<int>, sizes array<int>, ids array<int>"


def _coding(path: str):
    def code(batches):
        """The ids of each word (rows come in the order of their words), for each block that holds it."""
        splitter, last = WordSplitter.of(path), (None, [])
        blocks, numbers, sizes, ids, held = [], [], [], [], 0

        def flush():
            block, number, size = np.concatenate(blocks), np.concatenate(numbers), np.concatenate(sizes)
            flat, ends = np.concatenate(ids), np.cumsum(size)
            order = np.argsort(block, kind="stable")
            size_there = size[order]
            upto = np.cumsum(size_there)
            flat = flat[np.repeat(ends[order] - upto, size_there) + np.arange(len(flat))]
            each, first = np.unique(block[order], return_index=True)
            of = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
            cuts = np.append(first, len(block))
            columns = [pa.array(each, pa.int64()), of(number[order], cuts), of(size_there, cuts), of(flat, np.concatenate([[0], upto])[cuts])]
            return pa.RecordBatch.from_arrays(columns, ["block", "numbers", "sizes", "ids"])

        for batch in batches:
            words = batch.column("word").dictionary_encode()
            table = []
            for word in words.dictionary.to_pylist():
                if word != last[0]:
                    last = (word, splitter.ids(word))
                table.append(last[1])
            at = words.indices.to_numpy()
            size = np.array([len(t) for t in table], np.int64)
            flat, start = np.array([i for t in table for i in t], np.int64), np.cumsum(size) - size
            size_at = size[at]
            upto = np.cumsum(size_at)
            blocks.append(batch.column("block").to_numpy())
            numbers.append(batch.column("number").to_numpy())
            sizes.append(size_at)
            ids.append(flat[np.repeat(start[at] - (upto - size_at), size_at) + np.arange(upto[-1] if len(upto) else 0)])
            held += len(batch)
            if held >= HELD:
                yield flush()
                blocks, numbers, sizes, ids, held = [], [], [], [], 0
        if held:
            yield flush()

    return code


def _joining(whole: bool):
    def join(block: pa.Table, found: pa.Table) -> pa.Table:
        """The ids and pieces of each of the block's texts."""
        lists = lambda name: found[name].combine_chunks().flatten().to_numpy()
        is_word = found["piece"].is_null()
        pieces = dict(zip(found.filter(pc.invert(is_word))["id"].to_pylist(), found.filter(pc.invert(is_word))["piece"].to_pylist()))
        found = found.filter(is_word)
        number, size, ids = lists("numbers"), lists("sizes"), lists("ids")
        n, ends = len(number), np.cumsum(size)
        decimals, spelled = [""] * n, [""] * n
        ids_of = [None] * n
        for k, a, b in zip(number.tolist(), (ends - size).tolist(), ends.tolist()):
            own = ids[a:b].tolist()
            decimals[k], spelled[k] = " ".join(map(str, own)), " ".join(map(pieces.__getitem__, own))
            ids_of[k] = own
        size_of = np.zeros(n, np.int64)
        size_of[number] = size
        places, at, out = _unpacked(block["places"][0].as_py()), 0, []
        for name, words in zip(block["doc_ids"][0].as_py(), block["sizes"][0].as_py()):
            here = places[at : at + words]
            at += words
            listed = here.tolist()
            text = " ".join(map(spelled.__getitem__, listed))
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(decimals.__getitem__, listed)), text)]
            out.append((name, int(size_of[here].sum()), *sha, *(([i for k in listed for i in ids_of[k]], text) if whole else ())))
        schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        schema += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if whole else []
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), schema)], [k for k, _ in schema])

    return join


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of a tokenizer as a table: id, piece. As many rows as it has ids."""
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    table = pa.table({"id": pa.array(list(vocab.values()), pa.int32()), "piece": pa.array(list(vocab), pa.string())})
    return docs.sparkSession.createDataFrame(table)


def encode(docs: DataFrame, path: str, whole: bool = True) -> DataFrame:
    """The ids of docs(doc_id long, text string) under the tokenizer at path, without special tokens, and what they decode to.

    One row for each input row: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space), decoded_sha256 and, if whole, ids and
    decoded (the ids' pieces joined by a space, as the library joins them where a tokenizer has no decoder; others are refused).

    Texts are cut into words in blocks of BLOCK characters, each with a list of its distinct words and, for each position, a number in that list. The
    lists' words meet in a table sorted by word, where each distinct word is coded once; its ids go to each block that has the
    word and are joined to positions there. Pieces come by a join of each block's distinct ids with the vocabulary, which is
    broadcast: it has as many rows as the tokenizer has ids. Texts are never shuffled; what is, is one number for each word and the lists. A word that every text
    holds is one row for each block, so it's no hot key.

    Nulls: a null text is empty; an empty text and one of white space alone have no ids. A null id stays null; rows that repeat come as often as they are there. A
    very long text is a block of its own, cut whole. Empty table: no rows. Other columns are ignored.
    """
    if Tokenizer.from_file(path).decoder is not None:
        raise ValueError("decode() reads the ids of this tokenizer: its decoder does more than to join pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    # both sides read whole rows of one shuffle, so texts are cut once and both know the same numbers
    blocks = rows.mapInArrow(_splitting(path), _BLOCKS).repartition("block")
    uses = blocks.groupBy("block").applyInArrow(_listing, "block long, number int, word string")
    found = uses.repartition("word").sortWithinPartitions("word").mapInArrow(_coding(path), _FOUND)
    ids = found.select("block", F.explode(F.array_distinct("ids")).alias("id")).distinct()
    pieces = ids.join(F.broadcast(vocabulary(docs, path)), "id")
    none = F.array().cast("array<int>")
    known = found.select("*", F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("piece"))
    known = known.unionByName(pieces.select("block", none.alias("numbers"), none.alias("sizes"), none.alias("ids"), "id", "piece"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_joining(whole), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """coded with a column `decoded`: the pieces of each row's ids, joined by a space.

    Ids are joined with the vocabulary (broadcast: as many rows as the tokenizer has ids) and put in order in groups of CHUNK positions. Null ids and
    ids without a piece are passed over; a null or empty array gives the empty text; a very long one is many groups. Rows that repeat stay apart. Empty table: no rows. A
    column named `decoded` is replaced.
    """
    coded = coded.drop("decoded")
    row, part, at, number, piece = common.fresh(coded, "_row", "_part", "_at", "_id", "_piece")
    # the numbers of rows must be the same for both sides of the join
    rows = common.checkpoint(coded.withColumn(row, F.monotonically_increasing_id()))
    each = rows.select(row, F.posexplode(ids).alias(at, number))
    table = F.broadcast(vocabulary(coded, path).select(F.col("id").alias(number), F.col("piece").alias(piece)))
    joined = each.join(table, number).withColumn(part, F.floor(F.col(at) / CHUNK))
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), " ")
    parts = joined.groupBy(row, part).agg(in_order(at, piece).alias(piece))
    texts = parts.groupBy(row).agg(in_order(part, piece).alias("decoded"))
    out = rows.join(texts, row, "left").drop(row)
    return out.withColumn("decoded", F.coalesce("decoded", F.lit("")))
