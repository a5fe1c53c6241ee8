"""Toxicity by a convolutional text classifier in numpy (operator 3).

A word's embedding is the sum of hashed embeddings: of the word, and of its
beginnings of ``STEMS`` letters, so that words of one stem share what is
learned and languages with few labelled rows learn from few. Filters of several
widths run over the whole text; each filter keeps its largest answer (max
pooling); a logistic layer gives the probability. Max pooling sends the
gradient of a document back through one place per filter, so a step touches a
handful of embeddings.

One coordinate of the embeddings starts from how much more often a word or stem
is in toxic than in other documents of the training rows, which gives the
filters a direction to begin with.

Thresholds are calibrated by language on all labelled rows that the network did
not learn from, through histograms of their scores. The language is inferred
from the text itself (the best of the trigram profiles), never taken from a
column. A language's threshold is shrunk towards that of all languages, the
more the fewer rows it has; where no threshold reaches an even chance of being
right, it is ``STRICT``. The published score is the probability with its log
odds moved by those of the threshold, so that 0.5 is the threshold in every
language.

The network learns from a bounded sample: three quarters of about ``SAMPLE``
labelled documents chosen by a hash of the doc_id, alike on every run, one row
of each doc_id and none of more than ``SAMPLE_CHARS`` characters. Their hashed
words come to the driver, which trains; scoring runs on the executors over
whole texts.

Defined results: a null or wordless text gets the score of an empty one; with
no labelled rows, or labels of one kind only, every score is 0; a null label
teaches nothing, and neither does a doc_id with both labels; repeated rows are
scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language
from .common import broadcast_if_small, ship

SAMPLE = 6000
SAMPLE_CHARS = 200_000
BUCKETS = 1 << 17
#: Letters of the beginnings of a word that have embeddings of their own.
STEMS = (2, 3, 4, 5, 6)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, RATE, DECAY = 8, 0.05, 1e-4
#: Rows of a language's calibration at which its own threshold and the common one have equal weight.
PRIOR_ROWS = 50
STRICT = 0.98
#: Parts of the histograms that thresholds are chosen from.
BINS = 1000
_WORDS = re.compile(r"[^\W_]+")
_MEMO_ENTRIES = 250_000


def parts_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; 0 where it has none."""
    names = [word, *(f"{word[:n]}-" if len(word) > n else "" for n in STEMS)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 if x else 0 for x in names]


def words_of(text: str | None) -> list[str]:
    """The words of a text, filled up to the widest filter with empty ones."""
    found = _WORDS.findall(text.lower()) if text else []
    return found + [""] * (max(WIDTHS) - len(found))


def tokens_of(text: str | None) -> np.ndarray:
    """(words, 1 + len(STEMS)) buckets of a text."""
    return np.array([parts_of(w) if w else [0] * (1 + len(STEMS)) for w in words_of(text)], dtype=np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


class Network:
    """Embeddings (BUCKETS, DIM), filters of each width (width, DIM, FILTERS), and the logistic layer."""

    def __init__(self, words: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.embed[:, 0] = words
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + np.float32(0.3 / len(f))
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.2, dtype=np.float32)
        self.const = np.float32(-2.0)

    def _pool(self, tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest answer of each filter, and where it was."""
        x = self.embed[tokens].sum(axis=1)
        tops, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = len(tokens) - w + 1
            conv = x[:n] @ f[0]
            for j in range(1, w):
                conv += x[j : j + n] @ f[j]
            at = conv.argmax(axis=0)
            tops.append(conv[at, np.arange(FILTERS)] + b)
            places.append(at)
        return np.concatenate(tops), places

    def train(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """Adagrad, one document a step."""
        rng = np.random.default_rng(seed)
        g_embed = np.full(self.embed.shape, 1e-2, dtype=np.float32)
        g_filters = [np.full(f.shape, 1e-2, dtype=np.float32) for f in self.filters]
        g_bias = [np.full(b.shape, 1e-2, dtype=np.float32) for b in self.bias]
        g_out, g_const = np.full(self.out.shape, 1e-2, dtype=np.float32), 1e-2
        for _ in range(EPOCHS):
            for d in rng.permutation(len(docs)):
                tokens = docs[d]
                top, places = self._pool(tokens)
                seen = np.maximum(top, 0)
                wrong = np.float32(_sigmoid(seen @ self.out + self.const) - labels[d])
                if abs(wrong) < 0.01:
                    continue
                back = np.where(top > 0, wrong * self.out, 0)
                step = wrong * seen + DECAY * self.out
                g_out += step * step
                self.out -= RATE * step / np.sqrt(g_out)
                g_const += float(wrong * wrong)
                self.const -= np.float32(RATE * wrong / np.sqrt(g_const))
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    b = back[k * FILTERS : (k + 1) * FILTERS]
                    if not b.any():
                        continue
                    rows = tokens[places[k][None, :] + np.arange(w)[:, None]]  # (w, FILTERS, parts)
                    x = self.embed[rows].sum(axis=2)  # (w, FILTERS, DIM)
                    step = x.transpose(0, 2, 1) * b + DECAY * f
                    pull = (f.transpose(0, 2, 1) * b[None, :, None]).reshape(-1, DIM)
                    g_filters[k] += step * step
                    f -= RATE * step / np.sqrt(g_filters[k])
                    g_bias[k] += b * b
                    self.bias[k] -= RATE * b / np.sqrt(g_bias[k])
                    flat = rows.reshape(-1)
                    pull = np.repeat(pull, rows.shape[2], axis=0)
                    np.add.at(g_embed, flat, pull * pull)
                    np.add.at(self.embed, flat, -RATE * pull / np.sqrt(g_embed[flat]))
                    self.embed[0] = 0

    def answers(self, tokens: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place of it."""
        x = self.embed[tokens].sum(axis=1)
        return np.concatenate([x @ f[j] for w, f in zip(WIDTHS, self.filters) for j in range(w)], axis=1)

    def score(self, answers: np.ndarray) -> float:
        """The probability, from the answers of a text's words."""
        n = len(answers)
        tops, k = [], 0
        for w, b in zip(WIDTHS, self.bias):
            conv = answers[: n - w + 1, k : k + FILTERS]
            for j in range(1, w):
                k += FILTERS
                conv = conv + answers[j : n - w + 1 + j, k : k + FILTERS]
            k += FILTERS
            tops.append(conv.max(axis=0) + b)
        return float(_sigmoid(np.maximum(np.concatenate(tops), 0) @ self.out + self.const))


class Scorer:
    """Scores texts; the answers of each distinct word are made once and kept in a table."""

    def __init__(self, network: Network):
        self.network = network
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, FILTERS * sum(WIDTHS)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        """Rows for new words; one that is empty has none of its own answers."""
        first, last = len(self.rows), len(self.rows) + len(words)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        buckets = np.array([parts_of(w) if w else [0] * (1 + len(STEMS)) for w in words], dtype=np.int32)
        for at in range(0, len(words), 1 << 12):
            self.table[first + at : min(last, first + at + (1 << 12))] = self.network.answers(buckets[at : at + (1 << 12)])
        self.rows.update(zip(words, range(first, last)))

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if len(self.rows) > _MEMO_ENTRIES:
            self.rows.clear()
        new = set(words).difference(self.rows)
        if new:
            self._learn(sorted(new))
        rows = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
        return self.network.score(self.table[rows])


def _odds(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a word's document rate in toxic against other rows, scaled to about 1."""
    seen = np.zeros((2, BUCKETS))
    for tokens, y in zip(docs, labels):
        seen[int(y), np.unique(tokens)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)
    seen[:, 0] = 0
    rate = (seen + 2.0 * (seen.sum(axis=0) / n.sum())[None, :] + 0.5) / (n + 3.0)[:, None]
    return (np.log(rate[1] / rate[0]) / 3).astype(np.float32)


@dataclass
class Classifier:
    network: Network | None
    profiles: language.Profiles
    thresholds: dict[str, float]
    common: float

    def threshold(self, lang: str) -> float:
        return self.thresholds.get(lang, self.common)


def _best_threshold(hits: np.ndarray, others: np.ndarray) -> float:
    """The threshold with the best F1 among those that are right at least every second time, from counts by score in ``BINS`` parts."""
    right, n = np.cumsum(hits[::-1])[::-1], np.cumsum((hits + others)[::-1])[::-1]
    f1 = np.where((2 * right >= n) & (right > 0), 2 * right / np.maximum(n + hits.sum(), 1), 0)
    if f1.max() <= 0:
        return STRICT
    best = np.flatnonzero(f1 == f1.max())  # parts without scores between: the middle of them
    return float(min(max((best[0] + best[-1]) / 2 / BINS, 0.02), STRICT))


def single_language(profiles: language.Profiles, text: str | None) -> str:
    """The one language whose profile explains the text best."""
    if not text or not profiles.languages:
        return language.UNKNOWN
    at, counts = language.features(text)
    return profiles.languages[int(np.argmax(counts @ profiles.log[at]))] if len(at) else language.UNKNOWN


def fit(docs: DataFrame, labels: DataFrame, profiles: language.Profiles, sample: int = SAMPLE) -> Classifier:
    """A classifier from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample is drawn from the labels, so the texts are not shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    n = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(4)) == 0
    drawn = (place < F.lit(min(1.0, sample / max(n, 1)))) & ~fold
    chosen = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(broadcast_if_small(known.where(drawn)), "doc_id")
    # one row of each doc_id, the same on every run
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [tokens_of(t).tobytes() for t in b["text"]], "toxic": b["toxic"]})

    rows = chosen.mapInPandas(hashed, "doc_id long, tokens binary, toxic int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")  # the order of partitions must not matter
    own = [np.frombuffer(t, dtype=np.int32).reshape(-1, 1 + len(STEMS)) for t in rows["tokens"]]
    truth = rows["toxic"].to_numpy(dtype=np.int64)
    if not len(own) or truth.min() == truth.max():
        return Classifier(None, profiles, {}, 0.5)
    network = Network(_odds(own, truth))
    network.train(own, truth.astype(np.float32))

    shared = spark.sparkContext.broadcast((network, profiles))

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, langs = shared.value
        scorer = Scorer(model)
        for b in batches:
            found = [min(int(scorer.score(t) * BINS), BINS - 1) for t in b["text"]]
            yield pd.DataFrame({"lang": [single_language(langs, t) for t in b["text"]], "bin": found, "toxic": b["toxic"]})

    others = docs.join(broadcast_if_small(known.where(~drawn)), "doc_id").select("text", "toxic")
    counts = others.mapInPandas(bins, "lang string, bin int, toxic int").groupBy("lang", "bin", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    table: dict[str, np.ndarray] = {}
    for lang, i, y, k in counts.itertuples(index=False):
        table.setdefault(lang, np.zeros((2, BINS)))[y, i] = k
    whole = sum(table.values(), np.zeros((2, BINS)))
    common = _best_threshold(whole[1], whole[0]) if table else 0.5
    thresholds = {}
    for lang, found in sorted(table.items()):
        weight = found.sum() / (found.sum() + PRIOR_ROWS)
        own_best = _best_threshold(found[1], found[0])
        thresholds[lang] = float(_sigmoid(weight * _logit(own_best) + (1 - weight) * _logit(common)))
    return Classifier(network, profiles, thresholds, common)


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, predicted, and the probability before calibration."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        scorer = Scorer(own.network) if own.network else None
        for batch in batches:
            raw, moved = [], []
            for t in batch:
                p = scorer.score(t) if scorer else 0.0
                raw.append(p)
                moved.append(float(_sigmoid(_logit(p) - _logit(own.threshold(single_language(own.profiles, t))))) if own.network else 0.0)
            yield pd.DataFrame({"score": moved, "probability": raw}, dtype="float64")

    made = F.pandas_udf(rate, "score double, probability double")
    out = docs.select(*keep, made(F.col(text)).alias("_s"))
    return out.select(*keep, "_s.score", F.when(F.col("_s.score") >= 0.5, 1).otherwise(0).alias("predicted"), "_s.probability")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of all ``docs(doc_id, text, lang)``, learned from labels outside the held-out fold."""
    held = language.in_fold(F.col("doc_id"), 5, 0)
    learn = docs.where(~held).select("doc_id", "text", "lang")
    profiles = language.fit_profiles(learn, sample=500)
    own = labels.where(~language.in_fold(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    model = fit(learn.select("doc_id", "text"), own, profiles)
    return score(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))
