"""Language of a text by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm import common
from meshwright.llm.convnet import ByteConvNet, FrozenNet, cut, windows

WINDOW = 192
FILTERS, HIDDEN = {2: 8, 3: 12, 4: 12}, 16
#: Bounds of the training sample: documents of each language, windows of a document.
PER_LANGUAGE, PER_DOCUMENT = 300, 6
#: UTF-8 characters of a training document.
LONGEST = 60_000
STEP = 1 << 20
UNDETERMINED = "und"


class LanguageModel:
    def __init__(self, net: FrozenNet, names: list[str]):
        self.net, self.names = net, names

    @staticmethod
    def fit(texts: list[str], names: list[str], seed: int = 0) -> LanguageModel:
        known = sorted(set(names))
        y = np.searchsorted(known, names) if known else np.zeros(0, np.int64)
        net = ByteConvNet(FILTERS, HIDDEN, max(1, len(known)), seed)
        if len(known) > 1:
            data, offsets = common.utf8(pa.array(texts, pa.large_string()))
            start, end, owner = windows(data, offsets, WINDOW)
            rng = np.random.default_rng(seed)
            order = np.lexsort((rng.random(len(owner)), owner))
            rank = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
            taken = order[rank < PER_DOCUMENT]
            x, of = cut(data, start[taken], end[taken], WINDOW), owner[taken]
            # some windows are cut short, as short texts are
            short = rng.random(len(x)) < 0.3
            x[short] *= np.arange(WINDOW) < rng.integers(12, WINDOW, (int(short.sum()), 1))
            net.fit(x, y[of], 1 / np.bincount(y[of])[y[of]], steps=600, seed=seed)
        return LanguageModel(net.frozen(), known)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, its mean probability over the windows) of each text."""
        start, end, owner = windows(data, offsets, WINDOW)
        logits = np.concatenate([self.net.logits(cut(data, start[i : i + 4096], end[i : i + 4096], WINDOW)) for i in range(0, len(start), 4096)]).astype(np.float64)
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        first = np.searchsorted(owner, np.arange(len(offsets) - 1))
        mean = np.add.reduceat(q, first) / np.bincount(owner, minlength=len(offsets) - 1)[:, None]
        best = mean.argmax(1)
        return best, np.minimum(mean[np.arange(len(best)), best], 1.0)


def train(docs: DataFrame) -> LanguageModel:
    """Fits on text and non-null lang of docs that are not held out: about PER_LANGUAGE documents of each language.

    The share taken of a language follows from its count, by a hash of the id, so the sample that one task gets is bounded by
    the number of languages, not by the input; the driver gets the model.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & F.col("text").isNotNull() & ~common.held_out("doc_id", 3, 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel.fit([], [])
    share = F.create_map(*[x for name, n in sorted(counts.items()) for x in (F.lit(name), F.lit(min(1.0, PER_LANGUAGE / n)))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter((F.length("text") <= LONGEST) & (place < share[F.col("lang")])).select("doc_id", "lang", "text")

    def fit(some: pd.DataFrame) -> pd.DataFrame:
        some = some.drop_duplicates().sort_values(["doc_id", "lang", "text"]).groupby("lang").head(2 * PER_LANGUAGE)
        return pd.DataFrame({"model": [pickle.dumps(LanguageModel.fit(some["text"].tolist(), some["lang"].tolist()))]})

    made = some.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else LanguageModel.fit([], [])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Predicts the language of docs(doc_id, text string): doc_id, lang_pred, score (0 to 1).

    Windows cover the whole text; their mean probabilities decide. A text that is null or has no letter is `und` with score 0, and so is
    every text where nothing could be learned. One row for each input row, in one pass without a shuffle; ids may be null or repeated.
    Empty table: no rows. Other columns are ignored.
    """

    def predict(batches):
        names = np.array([*model.names, UNDETERMINED], object)
        for batch in batches:
            texts = batch.column("text")
            for i, j in common.slices(np.diff(common.utf8(texts)[1]), STEP):
                part = texts.slice(i, j - i)
                data, offsets = common.utf8(part)
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                best, score = model.predict(data, offsets)
                upto = np.concatenate([[0], np.cumsum(_LETTER[data])])
                plain = upto[offsets[1:]] > upto[offsets[:-1]]
                lettered = plain | np.array([not p and any(map(str.isalpha, part[k].as_py())) for k, p in enumerate(plain)], bool)
                known = lettered & (len(model.names) > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(names[np.where(known, best, len(model.names))], pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
