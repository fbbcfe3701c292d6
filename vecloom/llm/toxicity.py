"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another.  Each category has a linear SVM over the binary
presence of selected text features plus the probabilities of all earlier categories; what it learns
from are out-of-fold probabilities (each row's from models, and from features selected, without its
fold), so a later model meets at training the same kind of earlier prediction it meets in use.  Margins become probabilities
by a sigmoid fitted on out-of-fold margins.

Features are words, their prefixes of 4 to 8 letters (so that inflected forms share evidence), runs of
symbols, and coarse length, capital and symbol shares - of the whole text.  Those most associated with
a category in the training rows (likelihood ratio of presence against category) are kept, at most
``selected``.  Presence rather than frequency: one insult weighs the same in a long text.

Fitting uses a bounded sample: at most ``per_class`` labelled rows with and without each category, by
the order of a hash of the id.  Scale: labels meet documents in one join on doc_id in which only
sampled ids take part; the sample's hashed features come to the driver (bounded); scoring is a narrow
Arrow map over whole texts with the broadcast model, no shuffle.

Defined results: null and wordless texts have the features of an empty text; labels null or other than
0/1 are not learned from; of several labels for an id the largest counts; a category with a single
class gets that class's value as probability 0 or 1 (0 without any label); repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.svm import fit_sigmoid, sigmoid, train_svm
from vecloom.llm.tables import mapped, quoted
from vecloom.plans.durable import materialize

FOLDS = 3
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
PREFIXES = (4, 5, 6, 7, 8)
CACHE = 300_000


def word_features(token: str) -> list[int]:
    """Hashes of the features one token brings."""
    found = [zlib.crc32(f"w{token}".encode("utf-8", "replace"))]
    if token[0].isalpha():
        found += [zlib.crc32(f"{k}{token[:k]}".encode("utf-8", "replace")) for k in PREFIXES if len(token) >= k]
    return found


def shape_features(text: str) -> list[int]:
    n = max(1, len(text))
    upper = sum(map(str.isupper, text))
    symbols = len(re.findall(r"[^\w\s]", text))
    names = (f"length {len(text).bit_length()}", f"upper {10 * upper // n}", f"symbols {10 * symbols // n}")
    return [zlib.crc32(x.encode()) for x in names]


def text_features(text: str | None) -> np.ndarray:
    text = text or ""
    found = set(shape_features(text))
    for token in set(TOKEN.findall(text.lower())):
        found.update(word_features(token))
    return np.fromiter(found, np.uint32, len(found))


@dataclass
class ChainModel:
    categories: list[str]
    features: np.ndarray  # selected feature hashes, sorted
    scale: np.ndarray  # of each feature: rare ones count for more
    steps: list[tuple]  # (weights, bias, slope, shift) or (constant,)

    def presence(self, texts) -> np.ndarray:
        if not hasattr(self, "known"):
            self.number = {int(f): k for k, f in enumerate(self.features)}
            self.known: dict[str, tuple[int, ...]] = {}
        rows = np.zeros((len(texts), len(self.features)), dtype=np.float32)
        number, known = self.number, self.known
        for i, text in enumerate(texts):
            text = text or ""
            at = {number[f] for f in shape_features(text) if f in number}
            for token in set(TOKEN.findall(text.lower())):
                own = known.get(token)
                if own is None:
                    own = tuple(number[f] for f in word_features(token) if f in number)
                    if len(known) >= CACHE:
                        known.clear()
                    known[token] = own
                if own:
                    at.update(own)
            rows[i, list(at)] = 1
        return rows * self.scale

    def predict(self, texts) -> np.ndarray:
        """Probabilities, one column a category, each step fed with those before it."""
        x = self.presence(texts).astype(np.float64)
        done = np.zeros((len(texts), 0))
        for step in self.steps:
            if len(step) == 1:
                p = np.full(len(texts), step[0])
            else:
                w, bias, slope, shift = step
                p = sigmoid((np.hstack([x, done]) @ w + bias) * slope + shift)
            done = np.hstack([done, p[:, None]])
        return done


def select_features(rows: list[np.ndarray], y: np.ndarray, selected: int, least: float = 12.0) -> np.ndarray:
    """Hashes most associated with any category by the likelihood ratio (2 n times the mutual
    information in nats) of presence against category; below ``least`` it could be chance."""
    every, counts = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint32), return_counts=True)
    every, held = every[counts > 1], counts[counts > 1].astype(np.float64)
    best = np.zeros(len(every))
    n = max(1, len(rows))
    for j in range(y.shape[1]):
        own = [r for r, label in zip(rows, y[:, j]) if label]
        seen, counts = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)
        in1 = np.zeros(len(every))
        shared = np.isin(seen, every, assume_unique=True)
        in1[np.searchsorted(every, seen[shared])] = counts[shared]
        n1 = len(own)
        ratio = np.zeros(len(every))
        for cell, row, column in ((in1, held, n1), (held - in1, held, n - n1), (n1 - in1, n - held, n1), (n - n1 - held + in1, n - held, n - n1)):
            ratio += 2 * cell * np.log(np.maximum(cell, 1e-9) * n / np.maximum(row * column, 1e-9))
        best = np.maximum(best, ratio)
    order = np.lexsort((every, -best))
    order = order[best[order] >= least][:selected]
    return np.sort(every[order])


def presence_matrix(rows: list[np.ndarray], features: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
    """(presence of the features, scaled, and ``more`` free columns; the scale of each feature)."""
    width = len(features)
    x = np.zeros((len(rows), width + more), dtype=np.float32)
    for i, row in enumerate(rows):
        at = np.searchsorted(features, row)
        at[at == width] = 0
        if width:
            x[i, at[features[at] == row]] = 1
    scale = 1 / np.sqrt(x[:, :width].sum(axis=0) + 1)
    x[:, :width] *= scale
    largest = max(1e-9, float(np.sqrt((x[:, :width] ** 2).sum(axis=1).max(initial=0))))
    x[:, :width] /= largest
    return x, (scale / largest).astype(np.float32)


def fit(rows: list[np.ndarray], y: np.ndarray, categories: list[str], selected: int = 2048) -> ChainModel:
    features = select_features(rows, y, selected)
    x, scale = presence_matrix(rows, features, len(categories))
    model = ChainModel(categories, features, scale, [])
    fold = np.arange(len(rows)) % FOLDS
    without = []  # per fold: the rows in features chosen without it
    for k in range(FOLDS):
        own = select_features([r for r, f in zip(rows, fold) if f != k], y[fold != k], selected)
        without.append((presence_matrix(rows, own, len(categories))[0], len(own)))
    width = len(features)
    for j in range(len(categories)):
        target = np.where(y[:, j] > 0, 1, -1)
        if len(set(target.tolist())) < 2:
            constant = float(target[0] > 0) if len(target) else 0.0
            model.steps.append((constant,))
            p = np.full(len(rows), constant)
        else:
            margin = np.zeros(len(rows))
            for k, (z, size) in enumerate(without):
                if (fold == k).any():
                    w, bias = train_svm(z[:, : size + j], target, reg=1e-5, steps=200, use=fold != k)
                    margin[fold == k] = z[fold == k, : size + j] @ w + bias
            slope, shift = fit_sigmoid(margin, target)
            w, bias = train_svm(x[:, : width + j], target, reg=1e-5, steps=400)
            model.steps.append((w.astype(np.float64), bias, slope, shift))
            p = sigmoid(margin * slope + shift)  # what later categories learn from: out of fold
        x[:, width + j] = p
        for z, size in without:
            z[:, size + j] = p
    return model


def training_sample(docs: DataFrame, labels: DataFrame, categories: dict, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(h, text, one 0/1 column a category) of the sampled labelled documents."""
    names = [f"c{k}" for k in range(len(categories))]
    given = labels.select(F.col(quoted(id_col)).alias("id"), *[c.cast("int").alias(n) for n, c in zip(names, categories.values())])
    clean = given.where("id is not null and " + " and ".join(f"{n} in (0, 1)" for n in names)).groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    clean = materialize(clean.withColumn("h", F.xxhash64("id", F.lit(7))), "labels")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    counts = clean.agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("n")).first()
    parts = None
    for n in names:
        for value in (0, 1):
            size = (counts[n] or 0) if value else counts["n"] - (counts[n] or 0)
            some = clean.where((F.col(n) == value) & (unit < min(1.0, (2.0 * per_class + 40) / max(1, size))))
            some = some.orderBy("h").limit(per_class).select("id", "h", *names)
            parts = some if parts is None else parts.unionByName(some)
    chosen = materialize(parts.distinct(), "sampled")
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most 2 * per_class ids a category
    first = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    return joined.withColumn("r", F.row_number().over(first)).where("r = 1").select("h", "text", *names)


def train(docs: DataFrame, labels: DataFrame, categories: dict, per_class: int = 1000, selected: int = 2048, id_col="doc_id", text_col="text") -> ChainModel:
    sample = training_sample(docs, labels, categories, per_class, id_col, text_col)
    names = sample.columns[2:]

    def features(batches):
        for batch in batches:
            rows = pa.array([text_features(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, *batch.columns[2:]], names=["h", "x", *names])

    got = sample.mapInArrow(features, "h long, x binary, " + ", ".join(f"{n} int" for n in names)).orderBy("h").collect()
    rows = [np.frombuffer(r["x"], np.uint32) for r in got]
    y = np.array([[r[n] for n in names] for r in got], dtype=np.float64).reshape(len(got), len(names))
    return fit(rows, y, list(categories), selected)


def with_probabilities(rows: DataFrame, model: ChainModel, prefix: str = "p_") -> DataFrame:
    """Replaces the last column, the text, by a probability for each category; its names must be free."""
    at = len(rows.columns) - 1
    clash = {f"{prefix}{c}".lower() for c in model.categories} & {c.lower() for c in rows.columns[:at]}
    if clash:
        raise ValueError(f"the input already has columns named {sorted(clash)}")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}{c}" for c in model.categories]
    schema = T.StructType([*rows.schema.fields[:at], *[T.StructField(n, T.DoubleType()) for n in names]])

    def scan(batches):
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                p = np.round(known.predict([x.as_py() for x in part.column(at)]), 6)
                fields = [*list(batch.schema)[:at], *[pa.field(n, pa.float64()) for n in names]]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *[pa.array(p[:, k]) for k in range(len(names))]], schema=pa.schema(fields))

    return mapped(rows, scan, schema)


def document_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every document.

    The labels table annotates two categories of unwanted text; the chain predicts low quality first
    and feeds its probability to the toxicity model.
    """
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    model = train(docs, labels, categories)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return with_probabilities(slim, model).withColumn("toxic", F.col("p_toxic") >= threshold)
