"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

A text is the unit vector of square roots of its hashed byte-trigram frequencies (whole text, letters
only).  One linear SVM a family (one against the rest) picks the family; within it a linear SVM for
every pair of its languages votes.  The score is P(family) times the least calibrated probability of
the chosen language in its pairs, which does not shrink with the number of languages in the family.

Learning uses only text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not 2, of which
a bounded sample is taken: at most ``per_language`` rows a language and ``max_rows`` in all (but two rows
of each language, however many there are), by the order of a hash of the id.  Scale: counting labels and drawing the sample move ids only; features of
the sample come to the driver (max_rows x dims floats, 20 MB by default); prediction is a narrow Arrow
map with the broadcast model, linear in the text, no shuffle.

Defined results: null texts and texts without letters are ``und`` with score 0, and so is everything
when no row can be learned from; repeated rows each give a row; rows with a null id are learned from
and are not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.ngrams import root_frequencies
from vecloom.llm.svm import fit_sigmoid, out_of_fold, sigmoid, train_svm
from vecloom.llm.tables import free_name, mapped, quoted

UNKNOWN = "und"
DIMS = 4096
HELD_OUT = 2

# Families of languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy br gd",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn mr gu pa ne si ur",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    dims: int
    weights: np.ndarray  # (machines, dims): first one a family (if several), then one a pair
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        spoken = np.array([bool(t and _LETTER.search(t)) for t in texts], dtype=bool)
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = root_frequencies(texts, self.dims).astype(np.float64)
        p = sigmoid((x @ self.weights.T + self.bias) * self.slope + self.shift).reshape(len(texts), -1)
        names = list(self.families)
        at = len(names) if len(names) > 1 else 0
        family = p[:, :at] / p[:, :at].sum(axis=1, keepdims=True) if at else np.ones((len(texts), 1))
        chosen = family.argmax(axis=1)
        labels = np.empty(len(texts), dtype=object)
        score = np.zeros(len(texts))
        for f, name in enumerate(names):
            languages = self.families[name]
            mine = chosen == f
            votes = np.zeros((len(texts), len(languages)))
            belief = np.zeros((len(texts), len(languages)))
            least = np.ones((len(texts), len(languages)))
            for a, b in combinations(range(len(languages)), 2):
                first = p[:, at]
                at += 1
                votes[:, a] += first >= 0.5
                votes[:, b] += first < 0.5
                belief[:, a] += first
                belief[:, b] += 1 - first
                least[:, a] = np.minimum(least[:, a], first)
                least[:, b] = np.minimum(least[:, b], 1 - first)
            best = (votes + belief / (2 * len(languages))).argmax(axis=1)
            labels[mine] = np.array(languages, dtype=object)[best[mine]]
            score[mine] = (family[:, f] * least[np.arange(len(texts)), best])[mine]
        labels[~spoken], score[~spoken] = UNKNOWN, 0.0
        return labels.tolist(), np.round(np.clip(score, 0, 1), 6)


def _machine(x: np.ndarray, y: np.ndarray, fold: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, float, float, float]:
    use = np.ones(len(y), dtype=bool) if use is None else use
    w, b = train_svm(x, y, use=use)
    slope, shift = fit_sigmoid(out_of_fold(x, y, fold, 2, use, steps=100)[use], y[use])
    return w, b, slope, shift


def fit(x: np.ndarray, lang: np.ndarray, dims: int = DIMS) -> LanguageModel:
    families: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        families.setdefault(FAMILY_OF.get(code, f"only {code}"), []).append(code)
    family = np.array([FAMILY_OF.get(code, f"only {code}") for code in lang])
    fold = np.arange(len(lang)) % 2
    machines = []
    if len(families) > 1:
        machines += [_machine(x, np.where(family == f, 1, -1), fold) for f in families]
    for languages in families.values():
        for a, b in combinations(languages, 2):
            machines.append(_machine(x, np.where(lang == a, 1, -1), fold, (lang == a) | (lang == b)))
    w = np.array([m[0] for m in machines], dtype=np.float32).reshape(len(machines), dims)
    rest = np.array([m[1:] for m in machines], dtype=np.float64).reshape(len(machines), 3)
    return LanguageModel(families, dims, w, rest[:, 0], rest[:, 1], rest[:, 2])


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(quoted(id_col)).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, max_rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang) of at most ``per_language`` rows a language that may be learned from."""
    usable = docs.where(~held_out(id_col) & F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    keyed = usable.select(
        F.xxhash64(F.col(quoted(id_col)), F.lit(5)).alias("h"), F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("string").alias("text")
    )
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return keyed.select("text", "lang").limit(0)
    each = min(per_language, max(2, max_rows // len(counts)))
    # a share of each language by hash, about twice what is wanted; then exactly the first by hash
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    share = F.coalesce(*[F.when(F.col("lang") == code, F.lit(min(1.0, 2.0 * each / n + 40.0 / n))) for code, n in counts.items()])
    some = keyed.where(unit < share)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return ranked.where(F.col("rank") <= each).select("text", "lang")


def train(docs: DataFrame, per_language: int = 300, max_rows: int = 1200, dims: int = DIMS, id_col="doc_id", text_col="text", lang_col="lang") -> LanguageModel:
    sample = training_sample(docs, per_language, max_rows, id_col, text_col, lang_col)

    def features(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0)]
            rows = [r.tobytes() for r in root_frequencies(texts, dims)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "lang"])

    got = sample.mapInArrow(features, "x binary, lang string").orderBy("lang", "x").collect()
    if not got:
        return LanguageModel({}, dims, np.zeros((0, dims), np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    order = np.random.default_rng(3).permutation(len(got))
    lang = np.array([got[i]["lang"] for i in order], dtype=object)
    x = np.empty((len(got), dims), dtype=np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(got[i]["x"], np.float32)
    del got
    return fit(x, lang, dims)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; the names must be free."""
    if {lang_name.lower(), score_name.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has a column named {lang_name} or {score_name}")
    return _predicted(docs.select("*", F.col(quoted(text_col)).cast("string").alias(free_name(docs, "text"))), model, lang_name, score_name)


def _predicted(rows: DataFrame, model: LanguageModel, lang_name: str, score_name: str) -> DataFrame:
    """Replaces the last column, the text, by the prediction."""
    at = len(rows.columns) - 1
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields[:at], T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def scan(batches):
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                labels, score = known.predict([x.as_py() for x in part.column(at)])
                fields = [*list(batch.schema)[:at], pa.field(lang_name, pa.string()), pa.field(score_name, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(labels, pa.string()), pa.array(score, pa.float64())], schema=pa.schema(fields))

    return mapped(rows, scan, schema)


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    slim = docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return _predicted(slim, train(docs), "lang_pred", "score")


def keep_recognised(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Documents in a learned language; ``und`` and scores below ``min_score`` go.  Columns stay as they are."""
    lang, score = free_name(docs, "lang"), free_name(docs, "score")
    judged = with_language(docs, train(docs), lang_name=lang, score_name=score)
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*[F.col(quoted(c)) for c in docs.columns])
