"""Secrets in texts, found through a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that every match must hold. A segment of texts is indexed
(trigram -> sorted numbers of its texts), postings are united and intersected as the query says, and only the texts
that remain are searched with the expression itself. A rule without mandatory trigrams searches all texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common

try:  # the parser of Python's own expressions
    from re import _constants as _sre
    from re import _parser as _parse
except ImportError:  # pragma: no cover
    import sre_constants as _sre
    import sre_parse as _parse


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts (0: the whole match) and how long it must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further public formats of credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
)

#: A query: None (any text), a trigram (int), or ("and" | "or", queries).
Query = object


def _fold(char: int) -> int:
    return char + 32 if 65 <= char <= 90 else char


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None or a == b else ("and", (a, b))


def _either(items: list) -> Query:
    return None if any(x is None for x in items) else items[0] if len(items) == 1 else ("or", tuple(items))


def _of_text(text: bytes) -> Query:
    out: Query = None
    for i in range(len(text) - 2):
        out = _both(out, text[i] << 16 | text[i + 1] << 8 | text[i + 2])
    return out


#: More exact strings than this are not followed as one set.
_MOST = 64


def _analyse(tree) -> tuple[list[bytes] | None, Query]:
    """(all strings that the tree can match, if few; what any match must hold)."""
    exact: list[bytes] | None = [b""]
    needs: Query = None
    closed = False

    def close():
        nonlocal exact, needs, closed
        closed = True
        if exact is not None:
            needs = _both(needs, _either([_of_text(x) for x in exact]))
        exact = None

    for op, arg in tree:
        own: list[bytes] | None
        if op is _sre.LITERAL:
            own, more = ([bytes([_fold(arg)])] if arg < 128 else None), None
        elif op is _sre.SUBPATTERN:
            own, more = _analyse(arg[3])
        elif op is _sre.BRANCH:
            found = [_analyse(x) for x in arg[1]]
            own = [s for e, _ in found for s in e] if all(e is not None for e, _ in found) else None
            more = None if own is not None else _either([_either([_of_text(s) for s in e]) if e is not None else q for e, q in found])
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT):
            least, most, body = arg
            e, q = _analyse(body)
            if e is not None and most == 1:
                own, more = (e if least else [b"", *e]), None
            elif e is not None and least == most and least * max(map(len, e), default=0) <= 16 and len(e) == 1:
                own, more = [e[0] * least], None
            else:
                own, more = None, (_both(q, _either([_of_text(s) for s in e]) if e is not None else None) if least else None)
        elif op is _sre.IN and len(arg) <= 8 and all(o is _sre.LITERAL and x < 128 for o, x in arg):
            own, more = sorted({bytes([_fold(x)]) for _, x in arg}), None
        elif op is _sre.AT:
            continue
        else:
            own, more = None, None
        if own is None:
            close()
            needs = _both(needs, more)
            exact = [b""]
        else:
            joined = {a + b for a in exact for b in own}
            if len(joined) > _MOST:
                close()
                exact = sorted(set(own))
            else:
                exact = sorted(joined)
    if closed:  # what follows an unknown part isn't all that the tree matches
        close()
    return exact, needs


def trigram_query(pattern: str) -> Query:
    """What every match must hold, in trigrams of bytes with ASCII letters lowered; None if nothing is certain."""
    exact, needs = _analyse(_parse.parse(pattern, re.ASCII))
    return _both(needs, _either([_of_text(x) for x in exact]) if exact is not None else None)


def _trigrams(query: Query) -> set[int]:
    return set() if query is None else {query} if isinstance(query, int) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of the wanted trigrams over one segment of texts (bytes and offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, lookup: np.ndarray):
        self.count = len(offsets) - 1
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
        codes = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        places = np.flatnonzero(lookup[codes])
        owner = np.searchsorted(offsets, places, "right") - 1
        inside = places + 3 <= offsets[owner + 1]
        pairs = np.unique(codes[places[inside]].astype(np.int64) * self.count + owner[inside])
        trigram, text = pairs // max(self.count, 1), pairs % max(self.count, 1)
        cuts = np.searchsorted(trigram, wanted)
        ends = np.searchsorted(trigram, wanted, "right")
        self.postings = {int(w): text[i:j] for w, i, j in zip(wanted, cuts, ends)}

    def find(self, query: Query) -> np.ndarray:
        """Numbers of the texts that satisfy the query, ascending."""
        if query is None:
            return np.arange(self.count)
        if isinstance(query, int):
            return self.postings[query]
        kind, parts = query
        found = [self.find(x) for x in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        out = min(found, key=len)
        for x in found:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


#: Bytes of text that one index covers.
SEGMENT = 4 << 20


def find_secrets(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Finds secrets in docs(doc_id, text string).

    One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base rules' spans), spans (all of them) and
    found, an array of (kind, start, end, text). A rule's matches are leftmost and don't overlap; those that are too short
    drop. Spans are listed as kind:start:end by start, then by rule; offsets are code points, the end is exclusive.

    Each task indexes its own texts, SEGMENT bytes at a time, so nothing is shuffled and memory is bounded by a segment or
    the longest text. A null text is empty (no spans); null and repeated ids pass through. Empty table: no rows. Other columns are ignored.
    """
    rules = (*BASE_RULES, *more_rules)
    plans = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
    wanted = np.array(sorted(set().union(*(_trigrams(q) for _, _, q in plans))), np.int64)
    base = len(BASE_RULES)

    def scan(batches):
        lookup = np.zeros(1 << 24, bool)
        lookup[wanted] = True
        for batch in batches:
            column = batch.column("text")
            for i, j in common.slices(np.diff(common.utf8(column)[1]), SEGMENT):
                part = column.slice(i, j - i)
                data, offsets = common.utf8(part)
                index = Index(data[offsets[0] : offsets[-1]], offsets - offsets[0], wanted, lookup)
                texts, found = {}, [[] for _ in range(j - i)]
                for rank, (rule, pattern, query) in enumerate(plans):
                    candidates = index.find(query)
                    if rule.kind == "hex":
                        candidates = candidates[_has_run(data[offsets[0] : offsets[-1]], offsets - offsets[0], rule.least)[candidates]]
                    for k in candidates.tolist():
                        text = texts.get(k) or texts.setdefault(k, part[k].as_py())
                        for m in pattern.finditer(text):
                            if len(m.group(rule.group)) >= rule.least:
                                found[k].append((m.start(), rank, m.end(), m.group()))
                yield _batch(batch.column("doc_id").slice(i, j - i), found, rules, base)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string>>"
    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(scan, schema)


_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def _has_run(data: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Which texts hold a run of lower-case hex digits of at least that length: every byte is looked at."""
    edges = np.diff(np.concatenate([[0], _HEX[data].view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    first, last = np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, ends - 1, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(first.tolist(), last.tolist()):  # a run may reach into the next text; both are searched
        out[a : b + 1] = True
    return out


def _batch(ids: pa.Array, found: list, rules: tuple, base: int) -> pa.RecordBatch:
    counts, hashes, spans, details = [[0] * len(found) for _ in range(3)], [], [], []
    for k, matches in enumerate(found):
        matches.sort()
        listed = [(rank, f"{rules[rank].kind}:{start}:{end}") for start, rank, end, _ in matches]
        for rank, _ in listed:
            if rank < 3:
                counts[rank][k] += 1
        hashes.append(hashlib.sha256(",".join(x for rank, x in listed if rank < base).encode()).hexdigest())
        spans.append(",".join(x for _, x in listed))
        details.append([{"kind": rules[rank].kind, "start": start, "end": end, "text": text} for start, rank, end, text in matches])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes), pa.array(spans), pa.array(details, kind)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])
