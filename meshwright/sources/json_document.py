"""One JSON document of any size, read in byte ranges: {"nodes": [{...}, ...], "edges": [{...}, ...], ...}.

Spark cuts the files into ranges and each range into pieces at every `}`, wherever that stands. Whether a range starts within a text, and
how deep, depends on all ranges before it; so a first pass finds what each range changes if it starts within a text and if it doesn't, running sums over
the ranges (a row each) tell how each really starts, and a second pass takes the elements out. An element that goes over the end of a range is
put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The depth of an element: within the document's object and one of its lists.
_DEPTH = 2
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
#: Bytes before a bracket in which its key is looked for at first.
_NEAR = 256


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value (what stands between two closing braces), file, block (where its range starts) and length (of the file)."""
    told = ["_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size"]
    return spark.read.option("lineSep", "}").text(path).select("value", *(F.col(c).alias(a) for c, a in zip(told, ("file", "block", "length"))))


def _runs(batches) -> Iterator[tuple[tuple, bytes, int, dict]]:
    """(file, block), text, bytes read and the first row's values, for each stretch of a batch that is of one range.

    A piece has the brace before it; only a file's first piece has none. So what is left open is whether a file ends with a brace.
    """
    last = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
        n = len(files)
        cuts = [0, *(i for i in range(1, n) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), n]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            values = batch.column("value").slice(i, j - i).to_pylist()
            key = (files[i], int(blocks[i]))
            text = "}".join(values).encode()
            size = len(text) + 1
            told = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "value"}
            yield key, text if key != last and key[1] == 0 else b"}" + text, size, told
            last = key


def _structure(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Where brackets stand, whether an odd number of quotes stands before each, and the number of all quotes."""
    raw = np.frombuffer(text, np.uint8)
    quote = raw == 0x22
    if b"\\" in text:
        at = np.arange(len(raw))
        plain = np.maximum.accumulate(np.where(raw == 0x5C, -1, at))
        # backslashes right before each byte
        before = np.concatenate([[0], at[:-1] - plain[:-1]])
        quote &= before % 2 == 0
    quotes = np.cumsum(quote)
    where = np.flatnonzero((raw == 0x7B) | (raw == 0x7D) | (raw == 0x5B) | (raw == 0x5D))
    return where, quotes[where] % 2 == 1, int(quotes[-1]) if len(quotes) else 0


def _opened(text: bytes, at: int) -> str:
    """What opens at a place: a brace, or a square bracket and the list's key."""
    if text[at] != 0x5B:
        return "{"
    found = _KEY.search(text[max(0, at - _NEAR) : at]) or _KEY.search(text[:at])
    return "[" + (found.group(1).decode() if found else "")


def _opens(text: bytes, where: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)[where]
    return (raw == 0x7B) | (raw == 0x5B)


_CHANGES = "file string, block long, length long, bytes long, quotes long, change0 long, change1 long, opened0 map<long,string>, opened1 map<long,string>"


def _changes(batches):
    """For each range its quotes, and for both ways to start the change of depth and the last bracket opened at each relative depth."""

    def row(key, length, state):
        return {"file": key[0], "block": key[1], "length": length, "bytes": state["bytes"], "quotes": state["quotes"],
                "change0": state["depth"][0], "change1": state["depth"][1], "opened0": list(state["opened"][0].items()), "opened1": list(state["opened"][1].items())}

    kinds = pa.map_(pa.int64(), pa.string())
    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "length", "bytes", "quotes", "change0", "change1")), ("opened0", kinds), ("opened1", kinds)])
    held, length, state = None, 0, {}
    for key, text, size, told in _runs(batches):
        if key != held:
            if held:
                yield pa.RecordBatch.from_pylist([row(held, length, state)], schema)
            held, length, state = key, told["length"], {"bytes": 0, "quotes": 0, "depth": [0, 0], "opened": [{}, {}]}
        where, odd, quotes = _structure(text)
        opens = _opens(text, where)
        for start in (0, 1):
            outside = odd == bool((state["quotes"] + start) % 2)
            here, up = where[outside], opens[outside]
            depth = state["depth"][start] + np.cumsum(np.where(up, 1, -1))
            before = depth[up] - 1
            # the last of each depth
            for d, i in zip(*np.unique(before[::-1], return_index=True)):
                state["opened"][start][int(d)] = _opened(text, int(here[up][len(before) - 1 - i]))
            state["depth"][start] = int(depth[-1]) if len(depth) else state["depth"][start]
        state["quotes"] += quotes
        state["bytes"] += size
    if held:
        yield pa.RecordBatch.from_pylist([row(held, length, state)], schema)


def _starts(changes: DataFrame) -> DataFrame:
    """file, block, odd, depth, section, inside, closed: how each range starts, whether within an element, and whether a brace follows its last piece."""
    order = Window.orderBy("file", "block")  # a row for each range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    out = changes.withColumn("closed", (F.col("block") == F.max("block").over(whole)) & (F.sum("bytes").over(whole) == F.col("length")))
    out = out.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    plain = F.col("odd") == 0
    change = F.when(plain, F.col("change0")).otherwise(F.col("change1")) - F.col("closed").cast("long")
    out = out.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    opened = F.when(plain, F.col("opened0")).otherwise(F.col("opened1"))
    at = {f"at{d}": F.try_element_at(opened, F.lit(d) - F.col("depth")) for d in (_DEPTH - 1, _DEPTH)}
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    section, holder = (last(c) for c in at)
    inside = F.coalesce((F.col("depth") > _DEPTH) & (holder == "{"), F.lit(False)).alias("inside")
    return out.withColumns(at).select("file", "block", "odd", "depth", F.substring(section, 2, 1 << 30).alias("section"), inside, "closed")


#: What part of an element a row is.
_REST, _WHOLE, _START = 0, 1, 2
_PARTS = "file string, block long, part int, section string, value string"


def _elements(batches):
    """The elements of each range; of one that goes over an end, what lies in the range."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("section", pa.string()), ("value", pa.string())])
    held, state = None, {}

    def take(text, out):
        where, odd, quotes = _structure(text)
        outside = odd == bool(state["odd"])
        here = where[outside]
        up = _opens(text, here)
        depth = state["depth"] + np.cumsum(np.where(up, 1, -1))
        object_ = np.isin(np.frombuffer(text, np.uint8)[here], (0x7B, 0x7D))
        opens = up & object_ & (depth == _DEPTH + 1)
        closes = ~up & object_ & (depth == _DEPTH)
        sections = up & (depth == _DEPTH)
        at = 0
        for i in np.flatnonzero(opens | closes | sections).tolist():
            place = int(here[i])
            if sections[i]:
                state["section"] = _opened(text, place)[1:]
            elif opens[i]:
                state["open"], state["early"], at = [], False, place
            elif state["open"] is not None:
                state["open"].append(text[at : place + 1])
                out.append((*held, _REST if state["early"] else _WHOLE, state["section"], b"".join(state["open"]).decode()))
                state["open"], state["early"] = None, False
        if state["open"] is not None:
            state["open"].append(text[at:])
        state["odd"] = (state["odd"] + quotes) % 2
        state["depth"] = int(depth[-1]) if len(depth) else state["depth"]

    def end(out):
        if state["closed"]:
            take(b"}", out)
        if state["open"] is not None:
            out.append((*held, _REST if state["early"] else _START, state["section"], b"".join(state["open"]).decode()))

    for key, text, _, told in _runs(batches):
        out = []
        if key != held:
            if held:
                end(out)
            inside = told["inside"]
            held, state = key, {**{c: told[c] for c in ("odd", "depth", "section", "closed")}, "open": [] if inside else None, "early": inside}
        take(text, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), schema)], schema=schema)
    out = []
    if held:
        end(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), schema)], schema=schema)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """section (the key of the list) and value (JSON text) of each object in a list of the document's top object.

    A folder's files, in the order of their paths, are one document or several one after the other, so parts written by many tasks are read as one. Lists may hold
    other values, which aren't elements, as aren't objects deeper or elsewhere; white space may stand anywhere, and texts may hold brackets, quotes and
    escapes. Files are UTF-8. An element is held whole by one task, a range never is. No file or an empty one: no elements.
    """
    pieces = _pieces(spark, path)
    starts = _starts(pieces.mapInArrow(_changes, _CHANGES))
    # a row for each range of spark.sql.files.maxPartitionBytes
    ranges = pieces.drop("length").join(F.broadcast(starts), ["file", "block"])
    found = ranges.select("value", "file", "block", "odd", "depth", "section", "inside", "closed").mapInArrow(_elements, _PARTS)
    # two cut elements for each range at most
    cut = found.filter(F.col("part") != _WHOLE)
    in_order = Window.orderBy("file", "block", "part")
    number = F.sum((F.col("part") == _START).cast("int")).over(in_order)
    joined = cut.withColumn("number", number).groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("file", "block", "part", "section", "value"))).alias("p")
    )
    joined = joined.select(F.col("p")[0]["section"].alias("section"), F.array_join(F.transform("p", lambda p: p["value"]), "").alias("value"))
    return found.filter(F.col("part") == _WHOLE).select("section", "value").unionByName(joined).filter("section != ''")
