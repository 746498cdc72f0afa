"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give every word a probability. A
text's evidence is the difference of its log-likelihoods divided by its words,
and the same of its most suspicious window of ``WINDOW`` words; a logistic curve
over both and the text's length, fitted on labelled rows the models haven't
seen, makes them a score.

*Counts* are Kneser-Ney continuation counts: how many different words an
expression follows in texts of the class, so copies of a text count once.
*Backoff*: a word falls back on its first five letters, those on the shared
counts of both classes, which are taken over all texts of the corpus:

    P(word)      = (n(word) - D) / N + G * P(beginning) * shared(word | beginning)
    P(beginning) = (n(beginning) - D') / N + G' * shared(beginning)

The discount D of a count n is the smaller of n and ``DISCOUNT`` times its root, as
chance makes counts err by about their root; G and G' are the discounted shares,
so both models are distributions, and a rare expression has what the shared
counts say. An expression that is discounted altogether isn't stored: its words
differ between the models by G alone.

The models are fitted on a bounded sample of labelled rows that aren't held out:
``sample`` texts of each class, the first by a hash of the id, and ``calibration``
texts of each for the curve; class weights count all labels of the folds that
aren't held out. What is broadcast (stored expressions of the sample) is bounded
by these parameters. Shared counts are a table over the cluster that grows with
the corpus; they and the scores cover every text in whole.

Defined cases: a null or empty text has the evidence 0; rows whose id is null
are held out; of repeated labels of an id the largest counts; a label that is
null is none; without labels of both classes every score is 0; repeated rows get
equal scores; neither labels, language, source nor id is an input of a score;
columns of other names than the key, the text and the label play no part, and
``keep`` returns them as they are, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .memory import tidy

SAMPLE, CALIBRATION = 3000, 1500
#: Times the root of a count.
DISCOUNT = 2.5
#: Letters of a beginning.
BEGINNING = 5
#: Words that are judged together.
WINDOW = 4
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
#: Words that a worker remembers before it starts afresh.
MEMO = 50_000

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode())


def beginning(word: str) -> str:
    """The first letters, with a mark where the word goes on; a short word is its own beginning."""
    return word[:BEGINNING] + "*" if len(word) > BEGINNING else word


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _training(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key, toxic, fold of each labelled id that isn't held out."""
    named = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(f"`{label}`").alias("toxic"))
    return named.withColumn("fold", fold(F.col("key"))).where(F.col("fold") != HELD_OUT)


def _sampled(training: DataFrame, sample: int, calibration: int) -> DataFrame:
    """key, toxic, part (0 counts, 1 curve): at most 2 * (sample + calibration) rows."""
    named = training.withColumn("rank", F.md5(F.col("key").cast("string")))
    out = None
    for toxic in (0, 1):
        for part, most in ((0, sample), (1, calibration)):
            own = named.where((F.col("toxic") == toxic) & ((F.col("fold") == CALIBRATE) == bool(part)))
            own = own.orderBy("rank", "key").limit(most).select("key", F.lit(toxic).alias("toxic"), F.lit(part).alias("part"))
            out = own if out is None else out.unionByName(own)
    return out


def continuation_counts(fit: DataFrame) -> DataFrame:
    """fit: toxic, text. For each word the number of different words before it in either class: word, n0, n1."""

    def pairs(batches):
        for b in batches:
            seen = set()
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before = b"^"
                for w in words_of(text):
                    seen.add((toxic, before, w))
                    before = w
            own = sorted(seen)
            for lo in range(0, len(own), 50_000):
                part = own[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int32()), *[pa.array([x[k].decode(errors="replace") for x in part]) for k in (1, 2)]],
                    names=["toxic", "before", "word"],
                )

    found = fit.mapInArrow(tidy(pairs), "toxic int, before string, word string").distinct()
    return found.groupBy("word").agg(*[F.count_if(F.col("toxic") == k).alias(f"n{k}") for k in (0, 1)])


def shared_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n: occurrences of every word of all texts."""

    def count(batches):
        own: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode(errors="replace") for w in own]), pa.array(list(own.values()), pa.int64())], names=["word", "n"])
            own.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                own.update(words_of(t))
                if len(own) > MEMO:
                    yield rows()
        if own:
            yield rows()

    found = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit(""))).mapInArrow(tidy(count), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _begin(word: str) -> Column:
    return F.when(F.char_length(word) > BEGINNING, F.concat(F.substring(word, 1, BEGINNING), F.lit("*"))).otherwise(F.col(word))


def discount(n: float) -> float:
    return min(n, DISCOUNT * math.sqrt(n))


def _survives(n: Column) -> Column:
    """What a discount leaves something of."""
    return n > DISCOUNT * F.sqrt(n)


@dataclass
class Model:
    """Both classes' models. masses: form to discounted shares of the classes 0 and 1, words and beginnings apart."""

    words: dict[str, tuple[float, float]] = field(default_factory=dict)
    beginnings: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: The shares that fall back, by class, of words and of beginnings.
    back_words: tuple[float, float] = (1.0, 1.0)
    back_beginnings: tuple[float, float] = (1.0, 1.0)
    #: Shared probabilities: of beginnings, and of words given their beginnings, for those that masses need.
    shared: dict[str, float] = field(default_factory=dict)
    given: dict[str, float] = field(default_factory=dict)

    def probability(self, word: str, toxic: int, shared: float | None = None, given: float | None = None) -> float:
        """P(word | class). shared, given: the shared probabilities where the model doesn't hold them."""
        b = beginning(word)
        shared = self.shared.get(b, shared) if shared is None else shared
        given = self.given.get(word, given) if given is None else given
        own = self.beginnings.get(b, (0.0, 0.0))[toxic] + self.back_beginnings[toxic] * shared
        return self.words.get(word, (0.0, 0.0))[toxic] + self.back_words[toxic] * own * given

    def evidence(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary); shared probabilities that cancel out are left out."""
        b = beginning(word)
        if b in self.shared:
            given = self.given.get(word, 1.0)  # cancels unless the word itself is stored
            return math.log(self.probability(word, 1, self.shared[b], given) / self.probability(word, 0, self.shared[b], given))
        return math.log(self.back_words[1] * self.back_beginnings[1] / (self.back_words[0] * self.back_beginnings[0]))


class Evidence(dict):
    """Word to log-likelihood ratio, filled as words come."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = self.model.evidence(word.decode(errors="replace"))
        return value


def features(text: str, memo: Evidence) -> tuple[float, float, float]:
    """Evidence for each word, that of the window with most, and the logarithm of the length."""
    own = [memo[w] for w in words_of(text)]
    if not own:
        return 0.0, 0.0, 0.0
    total = math.fsum(own)
    if len(own) <= WINDOW:
        best = total
    else:
        sums = np.concatenate([[0.0], np.cumsum(own)])
        best = float((sums[WINDOW:] - sums[:-WINDOW]).max())
    return total / len(own), best / WINDOW, math.log1p(len(own))


def curve_at(curve: list[float], x: tuple[float, float, float]) -> float:
    z = curve[0] + math.fsum(c * v for c, v in zip(curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slopes, for columns as they are."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * w)
    slopes = w[1:] / scale
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def _model(counts: DataFrame, shared: DataFrame) -> Model | None:
    """counts: word, n0, n1; shared: word, n, over the corpus that has all these words."""
    begun = counts.groupBy(_begin("word").alias("form")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model, kept = Model(), []
    for level, forms in enumerate((counts.withColumnRenamed("word", "form"), begun)):
        lost = lambda n: F.sum(F.least(F.col(n).cast("double"), DISCOUNT * F.sqrt(n)))
        n0, n1, lost0, lost1 = forms.agg(F.sum("n0"), F.sum("n1"), lost("n0"), lost("n1")).first()
        if not n0 or not n1:
            return None
        rows = forms.where(_survives(F.col("n0")) | _survives(F.col("n1"))).select("form", "n0", "n1")
        masses = {r.form: ((r.n0 - discount(r.n0)) / n0, (r.n1 - discount(r.n1)) / n1) for r in rows.collect()}
        back = lost0 / n0, lost1 / n1
        if level:
            model.beginnings, model.back_beginnings = masses, back
        else:
            model.words, model.back_words = masses, back
    spark = counts.sparkSession
    # as many rows as the sample has stored expressions
    kept = spark.createDataFrame([(w, beginning(w)) for w in model.words] + [(None, b) for b in model.beginnings], "word string, form string")
    by_form = shared.groupBy(_begin("word").alias("form")).agg(F.sum("n").alias("of_form"))
    every = shared.agg(F.sum("n")).first()[0] or 1
    forms = F.broadcast(kept.select("form").distinct())
    of_form = {r.form: r.of_form for r in by_form.join(forms, "form").collect()}
    of_word = {r.word: r.n for r in shared.join(F.broadcast(kept.where("word IS NOT NULL").select("word")), "word").collect()}
    # a word or beginning of the sample that the corpus lacks counts once
    model.shared = {f: max(1, of_form.get(f, 0)) / every for f in {r.form for r in kept.collect()}}
    model.given = {w: min(1.0, max(1, of_word.get(w, 0)) / max(1, of_form.get(beginning(w), 0))) for w in model.words}
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, calibration: int = CALIBRATION) -> tuple[Model, list[float]] | None:
    """The models and the curve; None without labels of both classes."""
    spark = docs.sparkSession
    training = _training(labels, key, label)
    chosen = F.broadcast(_sampled(training, sample, calibration))  # bounded by the parameters
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(chosen, "key")
    texts = materialise(spark, texts.select("part", "toxic", "text"), "toxicity-sample")
    sizes = {(r.part, r.toxic): r.n for r in texts.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get((0, 0)) or not sizes.get((0, 1)):
        return None
    counts = materialise(spark, continuation_counts(texts.where("part = 0").select("toxic", "text")), "toxicity-counts")
    shared = materialise(spark, shared_counts(docs, text), "toxicity-shared")
    model = _model(counts, shared)
    if model is None:
        return None
    part = 1 if sizes.get((1, 0)) and sizes.get((1, 1)) else 0

    def judge(batches):
        memo = Evidence(model)
        for b in batches:
            rows = [features(t, memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], names=["toxic", "a", "b", "c"])

    seen = texts.where(F.col("part") == part).select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(tidy(judge), "toxic long, a double, b double, c double").collect()
    x = np.array([(r.a, r.b, r.c) for r in seen])
    y = np.array([float(r.toxic) for r in seen])
    # each class weighs as it does among all labelled rows that aren't held out
    prior = {r.toxic: r.n for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    whole = sum(prior.values())
    weight = np.where(y == 1, prior[1] / whole / max(1, (y == 1).sum()), prior[0] / whole / max(1, (y == 0).sum())) * len(y)
    return model, _logistic(x, y, weight).tolist()


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] | None = None, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """``keep`` columns (the key alone by default) and, last, score of every row; a kept column named score is replaced."""
    keep = [c for c in ([key] if keep is None else keep) if c != "score"]
    fitted = fit(docs, labels, key, text, label, sample, calibration)
    own = [F.col(f"`{c}`") for c in keep]
    if fitted is None:
        return docs.select(*own, F.lit(0.0).alias("score"))
    model, curve = fitted
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches):
        memo = Evidence(model)
        for b in batches:
            new = pa.array([curve_at(curve, features(t, memo)) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], names=[f.name for f in schema])

    return docs.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit(""))).mapInArrow(tidy(run), schema)


def filter_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with their columns."""
    fitted = fit(docs, labels, key, text, label)
    if fitted is None:
        return docs
    model, curve = fitted

    def keep(batches):
        memo = Evidence(model)
        for b in batches:
            out = [curve_at(curve, features(t, memo)) < limit for t in b.column(b.num_columns - 1).to_pylist()]
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(out, pa.bool_()))

    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return own.mapInArrow(tidy(keep), docs.schema)
