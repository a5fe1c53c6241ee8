"""Host-level quality rules (operator 8).

Every document gets counts; rules turn them into failures; failures are summed
by host; a host's failure rate of each rule is shrunk towards the corpus with
a beta prior fitted to all hosts; and the verdict on the host goes back to its
documents.

Defined results: a null text has no words; a null host is a host of its own;
an empty table gives an empty result; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, packed, ship

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A tenth of a document's words in symbols, or three tenths of its lines repeated, fail the softer rules.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WINDOW = 8
#: A host falls when the lower bound of its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Standard deviations of the posterior between its mean and that bound.
HOST_SIGMAS = 3.0

METRICS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
RULES = ("short", "repeat", "symbols", "dup_lines")

_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_MULTIPLIERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, dtype=np.uint64))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window which occurs twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count(1)), dtype=np.uint64, count=len(words))
    if len(seen) == len(words):
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        key += ids[j : j + n] * _MULTIPLIERS[j]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # equal keys are compared word by word, so that a collision cannot count
    at = np.flatnonzero(twice)
    exact: dict[bytes, list[int]] = {}
    for i in at.tolist():
        exact.setdefault(ids[i : i + WINDOW].tobytes(), []).append(i)
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    for group in exact.values():
        if len(group) > 1:
            np.add.at(hit, np.array(group), 1)
            np.add.at(hit, np.array(group) + WINDOW, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The six counts of one text, given as UTF-8."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def _measure_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=[c.split()[0] for c in METRICS.split(", ")], dtype="int64")


def metrics_column(text: Column) -> Column:
    """A struct with the counts of :func:`measure`."""
    return F.pandas_udf(_measure_batches, METRICS)(text.cast("binary"))


def rule_columns(m: str = "m") -> dict[str, Column]:
    """Failures of each rule, from the struct of counts."""
    c = lambda name: F.col(f"{m}.{name}")
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeat": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"),
    }


def host_verdicts(flags: DataFrame) -> DataFrame:
    """(host, n_docs, rate_<rule>, host_bad) from one row of flags per document.

    The prior of a rule is the beta distribution with the mean of the corpus
    and, by moments, the spread of the rates between hosts beyond what draws
    alone give. Its strength is at least 2 documents, and it is 1000 documents
    where hosts do not differ.
    """
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    moments = []
    for r in RULES:
        moments += [F.sum(r).alias(f"k_{r}"), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"q_{r}")]
    total = hosts.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), *moments).first()
    n, h = total["docs"] or 0, total["hosts"] or 0
    cols, bad = [], F.lit(False)
    for r in RULES:
        mean = (total[f"k_{r}"] or 0) / n if n else 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        spread = (total[f"q_{r}"] or 0.0) - n * mean * mean  # sum of n (rate - mean)^2
        noise = mean * (1 - mean)
        between = (spread - (h - 1) * noise) / n if n else 0.0
        strength = min(max(noise / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
        a = F.col(r) + F.lit(mean * strength)
        s = F.col("n") + F.lit(strength)
        rate = a / s
        low = rate - HOST_SIGMAS * F.sqrt(rate * (1 - rate) / (s + 1))
        cols.append(rate.alias(f"rate_{r}"))
        bad = bad | (low > HOST_LIMIT)
    return hosts.select("host", F.col("n").alias("n_docs"), *cols, bad.alias("host_bad"))


def _flags(measured: DataFrame) -> DataFrame:
    return measured.select("host", *[c.alias(r) for r, c in rule_columns().items()])


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base failure and verdict of every document; ``keep`` columns come along, whatever their names."""
    ship(docs.sparkSession)
    measured = materialize(docs.select(F.struct(*keep).alias("k"), F.col(host).alias("host"), metrics_column(F.col(text)).alias("m")), "quality")
    verdicts = host_verdicts(_flags(measured)).withColumnRenamed("host", "judged")
    out = measured.join(broadcast_if_small(verdicts), F.col("host").eqNullSafe(F.col("judged")), "left")
    rules = rule_columns()
    base = rules["short"] | rules["repeat"]
    counts = [F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("k.*", *counts, base.alias("base_failed"), (~base & ~F.coalesce("host_bad", F.lit(False))).alias("kept"), "n_docs", *[f"rate_{r}" for r in RULES])


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns and no others.

    Repeated rows are judged and kept one by one. Columns may have any names.
    The texts are measured once: the measured table is written before the
    verdicts on hosts are known.
    """
    ship(docs.sparkSession)
    measured = materialize(docs.select(packed(docs).alias("d"), F.col(host).alias("host"), metrics_column(F.col(text)).alias("m")), "quality")
    rules = rule_columns()
    verdicts = materialize(host_verdicts(_flags(measured)), "hosts")
    bad = verdicts.where("host_bad").select(F.col("host").alias("judged"))
    good = measured.where(~(rules["short"] | rules["repeat"]))
    return good.join(broadcast_if_small(bad), F.col("host").eqNullSafe(F.col("judged")), "left_anti").select("d.*")
