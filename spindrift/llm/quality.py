"""Quality scores: random-indexing word vectors, pooled, and a small network.

Each word has a sparse random index vector. A word's vector is the sum of the
index vectors of its neighbours over the training texts (random indexing),
scaled to length one, plus its own index vector; rare and new words share
one. A text is the mean of its words' vectors, with marks for capitals, for a
word that repeats the one before it, and for lines that occurred before in
the text. Two dense layers in numpy give a logit; a temperature and a shift
fitted on texts that the network hasn't seen turn it into a probability.

``fit`` uses at most ``each`` labelled texts of a class, weighted by the
class's share of the labels; of rows with one id it takes the smallest text.
Scoring reads whole texts in parts.

Defined results: null and empty texts are scored as texts without words;
equal texts get equal scores; null ids are scored and aren't held out; with
labels of one class or none the score is that class's share (0.5 for none);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .samples import remainder

DIM = 96
NONZERO = 8
VOCABULARY = 6_000
HIDDEN = 32
EACH = 2_000
SAMPLE_BYTES = 20_000
THRESHOLD = 0.3
PART = 1 << 19
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
RARE, NUMBER, CAPITALS, AGAIN, LINE = range(5)
MARKS = 5


def index_vector(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of a word's index vector."""
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")))
    return rng.choice(DIM, NONZERO, replace=False), rng.integers(0, 2, NONZERO) * 2 - 1


class Ids(dict):
    """Ids of words as they are written; those looked up are kept up to a bound. Capitalized words have a negative id."""

    def __init__(self, words: dict[str, int], bound: int = 200_000):
        super().__init__()
        self.words, self.bound = words, bound

    def __missing__(self, word: str) -> int:
        low = word.lower()
        known = self.words.get(low[:3] if not low[0].isalnum() else low, RARE)
        if low.isdigit():
            known = NUMBER
        if len(word) > 1 and word.isupper():
            known = -1 - known
        if len(self) < self.bound:
            self[word] = known
        return known


def _tokens(text: str, ids: Ids) -> np.ndarray:
    """Ids of a text's words and marks."""
    found, again = _words(text, ids, [])
    if not len(found):
        return found
    lines = text.split("\n")
    doubled = sum(len(x) for x in lines) - sum(len(x) for x in dict.fromkeys(lines))
    return np.concatenate([found, np.repeat([AGAIN, LINE], [again, doubled // 6])])


def _words(text: str, ids: Ids, last: list[str]) -> tuple[np.ndarray, int]:
    """Ids of the words and of the marks for capitals of a part of a text, and how many words repeat the one before; ``last`` is the word before, then the last of the part."""
    words = _WORDS(text)
    if not words:
        return np.zeros(0, np.int64), 0
    found = np.array([ids[w] for w in words], np.int64)
    capitals = found < 0
    again = sum(a == b for a, b in zip(words, words[1:])) + (last == words[:1])
    last[:] = words[-1:]
    return np.concatenate([np.where(capitals, -1 - found, found), np.full(int(capitals.sum()), CAPITALS)]), again


class _Lines:
    """The characters in lines that occurred before, over the parts of a text; a line is known by a digest of 128 bits."""

    def __init__(self):
        self.doubled, self._seen = 0, set()
        self._begin()

    def _begin(self) -> None:
        self._hash, self._size = hashlib.blake2b(digest_size=16), 0

    def feed(self, part: str) -> None:
        for k, piece in enumerate(part.split("\n")):
            if k:
                self.end()
            self._hash.update(piece.encode("utf-8", "surrogatepass"))
            self._size += len(piece)

    def end(self) -> None:
        key = self._hash.digest()
        if key in self._seen:
            self.doubled += self._size
        self._seen.add(key)
        self._begin()


@dataclass
class Model:
    words: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    shift: float
    prior: float | None = None

    def features(self, texts: list[str], ids: Ids | None = None) -> np.ndarray:
        ids = Ids(self.words) if ids is None else ids
        out = np.zeros((len(texts), DIM))
        for row, text in enumerate(texts):
            n, total = 0, np.zeros(DIM)
            for found in _counted(text, ids):
                n += len(found)
                total += np.bincount(found, minlength=len(self.vectors)) @ self.vectors if len(found) > 4 * len(self.vectors) else self.vectors[found].sum(axis=0)
            out[row] = total / max(1, n)
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        w1, b1, w2, b2 = self.layers
        return (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, texts: list[str], ids: Ids | None = None) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        z = (self.logits(self.features(texts, ids)) + self.shift) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _counted(text: str | None, ids: Ids):
    """The ids of a whole text: of a long one in parts, with what the marks need carried from part to part."""
    if not text or len(text) <= PART:
        yield _tokens(text or "", ids)
        return
    lines, last, total, some = _Lines(), [], 0, False
    for part in parts(text):
        found, again = _words(part, ids, last)
        lines.feed(part)
        total += again
        some |= len(found) > 0
        yield found
    lines.end()
    if some:
        for mark, n in ((AGAIN, total), (LINE, lines.doubled // 6)):
            for a in range(0, n, PART):
                yield np.full(min(PART, n - a), mark)


def parts(text: str | None):
    """A text in parts of PART characters or more, which end at white space, so that no word is cut."""
    at = 0
    while text and at < len(text):
        end = at + PART
        if end < len(text):
            gap = max(text.rfind(c, at, end) for c in " \n\t")
            if gap < at:
                gap = min((x for x in (text.find(c, end) for c in " \n\t") if x >= 0), default=len(text) - 1)
            end = gap + 1
        yield text[at:end]
        at = end


def _vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary and the random-indexing vectors of its words."""
    counts: dict[str, int] = {}
    for text in texts:
        for w in _WORDS(text):
            w = w.lower()
            w = w if w[0].isalnum() else w[:3]
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, n in counts.items() if n >= 3 and not w.isdigit()), key=lambda w: (-counts[w], w))[:VOCABULARY]
    words = {w: i + MARKS for i, w in enumerate(common)}
    names = [f"\0{i}" for i in range(MARKS)] + common
    at, sign = map(np.stack, zip(*map(index_vector, names)))
    size = len(names)
    ids, pairs = Ids(words), []
    for text in texts:
        found = _tokens(text, ids)
        for step in (1, 2):
            pairs += [found[step:] * size + found[:-step], found[:-step] * size + found[step:]]
    codes, times = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
    one, other = codes // size, codes % size
    vectors = np.zeros(size * DIM)
    for k in range(NONZERO):
        vectors += np.bincount(one * DIM + at[other, k], sign[other, k] * times, size * DIM)
    vectors = vectors.reshape(size, DIM)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    np.add.at(vectors, (np.repeat(np.arange(size), NONZERO), at.ravel()), sign.ravel() / NONZERO**0.5)
    return words, vectors


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400) -> list[np.ndarray]:
    """Two layers by Adam on all rows, with weight decay."""
    rng = np.random.Generator(np.random.PCG64(20260103))
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 1)) / HIDDEN**0.5, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(x @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip((h @ w2 + b2)[:, 0], -30, 30)))
        dz = ((p - y) * weight)[:, None]
        dh = dz @ w2.T * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ dz + 1e-4 * w2, dz.sum(axis=0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Temperature and shift with the least log loss, on a grid."""
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.3, 8, 40):
        for s in np.linspace(-2, 2, 21):
            q = (z + s) / t
            loss = float(((np.logaddexp(0, q) - y * q) * weight).sum())
            best = min(best, (loss, float(t), float(s)))
    return best[1], best[2]


def fit(texts: list[str], labels: list[int], shares: dict[int, float]) -> Model:
    """A model from texts labelled 0 or 1; ``shares`` are the classes' shares of all labels."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model({}, np.zeros((MARKS, DIM)), np.zeros(DIM), np.ones(DIM), [], 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    words, vectors = _vectors(texts)
    model = Model(words, vectors, np.zeros(DIM), np.ones(DIM), [], 1.0, 0.0)
    x = model.features(texts)
    weight = np.array([shares[k] / labels.count(k) for k in (0, 1)])[y.astype(int)]
    seen = np.arange(len(y)) % 5 != 0
    model.mean, model.spread = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-6
    model.layers = _train((x[seen] - model.mean) / model.spread, y[seen], weight[seen])
    model.temperature, model.shift = _calibrate(model.logits(x[~seen]), y[~seen], weight[~seen])
    return model


def train(docs: DataFrame, labels: DataFrame, divisor: int, held_out: int, each: int = EACH) -> Model:
    """Fit on labelled rows that aren't held out: ``docs`` (doc_id, text), ``labels`` (doc_id, quality).

    Ids are drawn from the labels alone by a hash; their number is bounded,
    so they are sent to the scan and only their texts reach the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", divisor) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    scale = 1 << 30
    h = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(scale))
    keep = F.lit(False)
    for value, n in counts.items():
        share = scale if n <= each else int(scale * min(1.0, (each + 4 * each**0.5 + 8) / n))
        keep = keep | ((F.col("quality") == value) & (h < share))
    ids: dict[int, list] = {}
    for row in sorted(known.filter(keep).select(h.alias("h"), "doc_id", "quality").collect()):
        ids.setdefault(row["quality"], []).append((row["doc_id"], row["quality"]))
    drawn = [r for some in ids.values() for r in some[:each]]
    wanted = docs.sparkSession.createDataFrame(drawn, "doc_id long, quality int")
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter((F.octet_length("text") <= SAMPLE_BYTES))
    rows = usable.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # at most 2 * each short rows
    order = sorted(rows, key=lambda r: hashlib.blake2b(str(r["doc_id"]).encode()).digest())
    return fit([r["text"] for r in order], [r["quality"] for r in order], {k: n / total for k, n in counts.items()})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with text) and score, which replaces a column of this name; others are kept."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and DIM

    def run(batches):
        model = shared.value
        ids = Ids(model.words)
        for batch in batches:
            texts = batch.column("text")
            scores = [np.zeros(0)] + [model.scores(texts.slice(a, 256).to_pylist(), ids) for a in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(np.concatenate(scores), 6))], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + ", score double")


def op8_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all ``documents``, learnt from labels with remainders 1 to 4."""
    small_batches(spark)
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    model = train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")), 5, 0)
    wanted = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(wanted, model).drop("text").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
