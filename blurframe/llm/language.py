"""Language identification by multilingual mixture inference (operator 1).

A language is a distribution over hashed character trigrams. A document is
taken as a mixture: expectation-maximisation estimates the proportion of each
language from the likelihoods of its trigrams, and the set of languages is
chosen by penalised likelihood, from all languages down by the one with the
smallest proportion. The prediction is the language with the
largest proportion in that set, and the score is that proportion.

Trigrams overlap, so each character is counted about three times; the
likelihood is divided by that before the penalty (half the logarithm of the
number of characters for each language after the first) is taken off.

The profiles are fitted on a bounded sample: at most about ``SAMPLE`` labelled
documents of each language, chosen by a hash of the doc_id, so that the same
documents are chosen on every run and at every size. Their trigrams are
counted in the tasks that read them; the driver gets a table of languages
times ``BUCKETS``. Whole texts are used, both in fitting and in prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled document every text is ``und``; ties go to the language
that is first by code point; repeated rows are predicted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ORDER = 3
BUCKETS = 1 << 16
#: Labelled documents per language that profiles are fitted on.
SAMPLE = 1500
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ROUNDS, _SETTLED = 30, 1e-4


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed trigrams of a text and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # every run of characters that are no letters counts as one space, near enough: ASCII up to 'a' and the rest of its signs
    codes = np.where((codes < 97) | ((codes > 122) & (codes < 192)), np.uint32(32), codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    if len(codes) < ORDER:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    n = len(codes) - ORDER + 1
    key = np.zeros(n, dtype=np.uint32)
    for i in range(ORDER):
        key = (key ^ codes[i : i + n]) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
    key %= np.uint32(BUCKETS)
    if n < 4096:
        found, counts = np.unique(key, return_counts=True)
        return found.astype(np.int64), counts.astype(np.float64)
    counts = np.bincount(key, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


@dataclass
class Profiles:
    """Log probabilities (BUCKETS, languages) of the learned languages, in code point order."""

    languages: list[str]
    log: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Profiles:
        # what a language lacks is filled in with a little of what all have
        common = counts.sum(axis=0) + 0.5
        common /= common.sum()
        smooth = counts + 200.0 * common[None, :] + 0.01
        return cls(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64))

    def mixture(self, text: str | None) -> dict[str, float]:
        """The languages of a text and their proportions; empty if it has no letter."""
        if not text or not self.languages or not _LETTER.search(text):
            return {}
        at, counts = features(text)
        if not len(at):
            return {self.languages[0]: 1.0}
        log, total = self.log[at], counts.sum()
        single = counts @ log
        best = int(np.argmax(single))
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}
        # likelihoods relative to the best of each trigram, so that nothing underflows
        top = log.max(axis=1)
        like, base = np.exp(log - top[:, None]), float(counts @ top)
        chosen = list(range(len(self.languages)))
        # a language that could add less than it costs even with perfect trigrams is no candidate
        penalty = 0.5 * np.log(max(total, 2.0)) * ORDER
        if base - single[best] <= penalty:
            return {self.languages[best]: 1.0}
        found, share = ([best], np.ones(1)), None
        value = float(single[best])
        share, likely = _expect(like[:, chosen], counts)
        while len(chosen) > 1:
            gained = likely + base - (len(chosen) - 1) * penalty
            if gained > value:
                value, found = gained, (list(chosen), share)
            # the smallest goes, and with it all that explain less than one trigram
            stay = (share * total >= 1) & (np.arange(len(share)) != np.argmin(share))
            chosen = [c for c, s in zip(chosen, stay) if s]
            if len(chosen) > 1:
                share, likely = _expect(like[:, chosen], counts)
        return {self.languages[i]: float(s) for i, s in zip(*found)}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        if not found:
            return UNKNOWN, 0.0
        best = max(sorted(found), key=found.__getitem__)
        return best, min(1.0, max(0.0, found[best]))


def _expect(like: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood that they reach."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    total = counts.sum()
    for _ in range(_ROUNDS):
        seen = like @ share
        new = share * ((counts / seen) @ like) / total
        moved, share = np.abs(new - share).max(), new
        if moved < _SETTLED:
            break
    return share, float(counts @ np.log(np.maximum(like @ share, 1e-300)))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the crc32 of the doc_id as text leaves ``fold`` when divided by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_profiles(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from ``labelled(doc_id, text, lang)``; null languages and texts teach nothing.

    Of a language with n documents, those are used whose hash falls into the
    first ``sample`` / n of the range.
    """
    spark = labelled.sparkSession
    ship(spark)
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return Profiles([], np.zeros((BUCKETS, 0)))
    languages = sorted(sizes)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("profiles")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                at, n = features(text)
                i = number[lang]
                if i not in sums:
                    sums[i] = np.zeros(BUCKETS, dtype=np.int64)
                sums[i][at] += n.astype(np.int64)
        for i, array in sums.items():
            at = np.flatnonzero(array)
            yield pd.DataFrame({"lang": i, "bucket": at, "n": array[at]})

    rows = chosen.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=float)
    return Profiles.fit(languages, counts)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, and the mixture as a map from language to proportion."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(profiles)

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [model.mixture(t) for t in batch]
            best = [max(sorted(f), key=f.__getitem__) if f else UNKNOWN for f in found]
            yield pd.DataFrame({"lang_pred": best, "score": [min(1.0, f.get(b, 0.0)) for f, b in zip(found, best)], "mixture": found})

    made = F.pandas_udf(guess, "lang_pred string, score double, mixture map<string,double>")
    return docs.select(*keep, made(F.col(text)).alias("_p")).select(*keep, "_p.*")


def identify(docs: DataFrame) -> DataFrame:
    """Prediction for all ``docs(doc_id, text, lang)``, learned from those outside the held-out fold."""
    held = in_fold(F.col("doc_id"), 4, 2)
    profiles = fit_profiles(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs.withColumn("held_out", held), profiles, keep=("doc_id", "held_out"))
