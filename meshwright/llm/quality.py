"""Document quality by a byte-level convolutional network over overlapping chunks."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common
from meshwright.llm.convnet import ByteConvNet, FrozenNet, cut, windows

#: Bytes of a chunk, and what neighbours share.
CHUNK, OVERLAP = 256, 32
FILTERS, HIDDEN = {6: 24, 3: 8}, 16
#: Bounds of the training sample: documents of each label, UTF-8 characters of a document, chunks of a document.
PER_LABEL, LONGEST, CHUNKS = 1500, 60_000, 6
#: Bytes of text for one vectorised step.
STEP = 1 << 20


class QualityModel:
    """score(bytes, offsets) -> probability that each text's label is 1."""

    def __init__(self, net: FrozenNet, combine: np.ndarray):
        self.net, self.combine = net, combine

    @staticmethod
    def fit(texts: list[str], labels: list[int], seed: int = 0) -> QualityModel:
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:  # nothing to tell apart: the label that there is, or undecided
            return QualityModel(ByteConvNet(FILTERS, HIDDEN, 2, seed).frozen(), np.array([0, 0, 0, 4.0 * (2 * y[0] - 1) if len(y) else 0.0]))
        data, offsets = common.utf8(pa.array(texts, pa.large_string()))
        start, end, owner = windows(data, offsets, CHUNK, OVERLAP)
        rng = np.random.default_rng(seed)
        order = np.lexsort((rng.random(len(owner)), owner))
        rank = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        taken = np.sort(order[rank < CHUNKS])
        x, of = cut(data, start[taken], end[taken], CHUNK), owner[taken]
        per_doc = 1 / np.bincount(of, minlength=len(y))[of]
        weight = per_doc / np.bincount(y, minlength=2)[y[of]]
        net = ByteConvNet(FILTERS, HIDDEN, 2, seed).fit(x, y[of], weight, seed=seed).frozen()
        model = QualityModel(net, np.zeros(4))
        z = model._features(net.logits(x), of, len(y))
        model.combine = _logistic(z, y)
        return model

    @staticmethod
    def _features(logits: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """A document's mean, lowest and highest chunk, and 1."""
        z = np.clip(logits[:, 1] - logits[:, 0], -8, 8).astype(np.float64)
        first = np.searchsorted(owner, np.arange(count))
        return np.stack([np.add.reduceat(z, first) / np.bincount(owner, minlength=count), np.minimum.reduceat(z, first), np.maximum.reduceat(z, first), np.ones(count)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, end, owner = windows(data, offsets, CHUNK, OVERLAP)
        logits = np.concatenate([self.net.logits(cut(data, start[i : i + 4096], end[i : i + 4096], CHUNK)) for i in range(0, len(start), 4096)])
        return 1 / (1 + np.exp(-self._features(logits, owner, len(offsets) - 1) @ self.combine))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column is the constant. Both labels weigh alike."""
    w = np.zeros(x.shape[1])
    each = (0.5 / np.bincount(y, minlength=2))[y]
    for _ in range(30):
        q = 1 / (1 + np.exp(-(x @ w)))
        keep = penalty * np.diag([1.0] * (len(w) - 1) + [0.01])
        grad = x.T @ (each * (q - y)) + keep @ w
        w -= np.linalg.solve((x * (each * q * (1 - q))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), grad)
    return w


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on labels(doc_id, quality) of documents that are not held out: PER_LABEL of each label at most, by a hash of the id.

    The sample is bounded, so one task may hold it: ids are chosen from the labels alone, then their texts are read, and the driver gets
    the model. Rows with a null id or label, or another label than 0 and 1, teach nothing.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out("doc_id", 4, 2)).select("doc_id", "quality").distinct()
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL) for q in (0, 1)]
    some = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(some, "doc_id").select("doc_id", "quality", common.text_or_empty().alias("text"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "quality"]).sort_values(["doc_id", "quality"])
        return pd.DataFrame({"model": [pickle.dumps(QualityModel.fit(rows["text"].tolist(), rows["quality"].astype(int).tolist()))]})

    made = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else QualityModel.fit([], [])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """Scores docs(doc_id, text string): doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Every byte of a text lies in a chunk; chunks are max-pooled and combined into one probability. One row for each input row, in
    one pass without a shuffle. A null text counts as empty and is scored as such; ids may be null or repeated. Very long texts are cut
    into chunks as any other. Empty table: no rows. Other columns are ignored.
    """

    def scores(batches):
        for batch in batches:
            texts = batch.column("text")
            for i, j in common.slices(np.diff(common.utf8(texts)[1]), STEP):
                data, offsets = common.utf8(texts.slice(i, j - i))
                found = model.score(data[offsets[0] : offsets[-1]], offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(scores, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns.

    Null and empty texts score as the empty text, very long ones whole; repeated rows stay or go together; empty table: no rows.
    """

    def keep(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for i, j in common.slices(np.diff(common.utf8(texts)[1]), STEP):
                data, offsets = common.utf8(texts.slice(i, j - i))
                found = model.score(data[offsets[0] : offsets[-1]], offsets - offsets[0])
                yield batch.slice(i, j - i).filter(pa.array(found >= threshold))

    return docs.mapInArrow(keep, docs.schema)
