"""Language identification with string kernels.

The kernel of two texts compares the sets of their character n-grams of 1 to
``GRAMS`` letters (a blended spectrum, by presence): the size of the
intersection over the geometric mean of both sizes. Texts are lower-cased and
runs of other characters than letters become one blank. All n-grams of a text
count, of any script; an n-gram is one 64-bit number made of its code points,
so different n-grams never meet.

``fit`` draws at most ``each`` labelled texts of a language and ``most`` in
all, takes ``landmarks`` of them, maps all by the Nystrom method to the
landmarks' space and solves one ridge regression for each language against the
rest. ``predict`` writes a batch of texts as presence matrices over blocks of
the landmarks' n-grams and scores it by matrix products. Whole texts are read;
the n-grams of a long one are taken from overlapping parts.

The score is the share of the best language in the sum of all: it compares
languages and doesn't fall with the length of the text.

Defined results: a null text or one without letters is ``und`` with score 0;
ties go to the language that sorts first; equal texts get equal results; null
ids are predicted too and aren't held out; extra columns are ignored; an
empty table, or one without labels, predicts ``und`` everywhere.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .samples import balanced, remainder

GRAMS = 3
LANDMARKS = 160
EACH = 400
MOST = 20_000
SAMPLE_BYTES = 20_000
RIDGE = 1e-2
PART = 1 << 18
#: Landmark n-grams of a presence matrix.
BLOCK = 8192
_OTHERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a whole text, sorted; a code point takes 21 bits."""
    clean = " " + _OTHERS.sub(" ", text.lower()).strip() + " "
    found = []
    for a in range(0, len(clean), PART):
        points = np.frombuffer(clean[a : a + PART + GRAMS - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        value = points
        found.append(value)
        for n in range(1, GRAMS):
            value = (value[: len(points) - n] << 21) | points[n:]
            found.append(value)
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    labels: list[str]
    features: np.ndarray  # n-grams of the landmarks, sorted
    bits: np.ndarray  # features x landmarks, packed
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x labels

    def kernel(self, texts: list[str]) -> np.ndarray:
        """The kernel of texts and landmarks."""
        size, rows, columns = [], [], []
        for row, text in enumerate(texts):
            found = grams(text)
            size.append(len(found))
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            at = at[self.features[at] == found]
            rows.append(np.full(len(at), row))
            columns.append(at)
        row, column = np.concatenate(rows), np.concatenate(columns)
        both = np.zeros((len(texts), len(self.sizes)))
        for a in range(0, len(self.features), BLOCK):
            marks = self._marks(a)
            some = slice(None) if len(self.features) <= BLOCK else (column >= a) & (column < a + BLOCK)
            presence = np.zeros((len(texts), len(marks)), np.float32)
            presence[row[some], column[some] - a] = 1
            both += presence @ marks
        return both / np.sqrt(np.outer(size, self.sizes))

    def _marks(self, a: int) -> np.ndarray:
        """The presence of a block of features in the landmarks; the first block is kept."""
        if a == 0 and getattr(self, "_first", None) is not None:
            return self._first
        out = np.unpackbits(self.bits[a : a + BLOCK], axis=1, count=len(self.sizes)).astype(np.float32)
        if a == 0:
            self._first = out
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_first"}


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> Model | None:
    """A model from labelled texts; the first texts of each label, or of as many labels as there may be landmarks, are the landmarks. None without labelled letters."""
    known = [(t, k) for t, k in zip(texts, labels) if _LETTER.search(t)]
    texts, labels = [t for t, _ in known], [k for _, k in known]
    kinds = sorted(set(labels))
    if not kinds:
        return None
    number = {k: i for i, k in enumerate(kinds)}
    of = np.array([number[x] for x in labels])
    each = max(1, landmarks // len(kinds))
    order = np.argsort(of, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    chosen = order[place < each].tolist()
    if len(chosen) > landmarks:  # more languages than landmarks: those of some, evenly
        chosen = [chosen[i] for i in np.linspace(0, len(chosen) - 1, landmarks).round().astype(int).tolist()]
    sets = [grams(texts[i]) for i in chosen]
    features = np.unique(np.concatenate(sets))
    presence = np.zeros((len(features), len(chosen)), bool)
    for column, found in enumerate(sets):
        presence[np.searchsorted(features, found), column] = True
    model = Model(kinds, features, np.packbits(presence, axis=1), np.array([len(x) for x in sets], float), np.eye(len(chosen)))
    inner = model.kernel([texts[i] for i in chosen])
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([model.kernel(texts[a : a + 64]) for a in range(0, len(texts), 64)]) @ nystrom
    sums = np.zeros((len(kinds), mapped.shape[1]))
    np.add.at(sums, of, mapped)
    gram = mapped.T @ mapped + RIDGE * len(texts) / len(kinds) * np.eye(mapped.shape[1]) * 0.1
    model.weights = nystrom @ np.linalg.solve(gram, sums.T)
    return model


def train(docs: DataFrame, divisor: int, held_out: int, each: int = EACH) -> Model | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) that aren't held out, at most ``each`` of a language and MOST in all."""
    rows = docs.filter(remainder("doc_id", divisor) != held_out)
    drawn = balanced(rows, "lang", "doc_id", each, MOST, SAMPLE_BYTES)
    return fit([r["text"] for r in drawn], [r["label"] for r in drawn])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (with text) and lang_pred, score, which replace columns of these names; others are kept."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LANDMARKS texts of SAMPLE_BYTES

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            names, scores = [], []
            for a in range(0, batch.num_rows, 64):
                some = texts.slice(a, 64).to_pylist()
                known = [i for i, t in enumerate(some) if model and t and _LETTER.search(t)]
                lang, score = ["und"] * len(some), [0.0] * len(some)
                if known:
                    raw = np.clip(model.scores([some[i] for i in known]), 0, 1)
                    best = raw.argmax(axis=1)
                    top = np.round(raw.max(axis=1) / np.maximum(raw.sum(axis=1), 1e-300), 6)
                    for i, b, s in zip(known, best.tolist(), top.tolist()):
                        lang[i], score[i] = model.labels[b], s
                names += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + ", lang_pred string, score double")


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learnt from those with remainder 0 or 2."""
    small_batches(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    model = train(docs, 3, 1)
    wanted = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(wanted, model).drop("text")
