"""Token counts by byte-pair merging on a heap and a linked list (operator 2).

The count of a word is its initial symbols less the merges made on it. The
symbols stand in a doubly linked list; a heap holds the adjacent pairs that
have a merge rank; the lowest rank, leftmost first, is popped, and a pair
that has changed since it was pushed is passed over. Only ranks and symbol
numbers are used and no ids are emitted.

Everything is read from the tokenizer's own file: its special strings, which
count as one token each wherever they stand in the raw text; its pattern; its
suffix for word ends; and its merges. A text is cut at white space first,
which no token crosses, and each distinct run is counted once per worker.

Defined results: a null or blank text has no tokens; repeated rows are counted
one by one; an empty table gives an empty result. Long texts and long words
are counted whole: a word of n characters takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

LIMIT = 2048
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MEMO_ENTRIES = 300_000
_MEMO_CHARS = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves; the others take the code points
    from 256 on, in order.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that are left of a word after all merges."""

    def __init__(self, merges: list[tuple[str, str]]):
        number: dict[str, int] = {}
        self.number = number
        of = lambda s: number.setdefault(s, len(number))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for at, (a, b) in enumerate(merges):
            self.rank[of(a), of(b)] = (at, of(a + b))

    def count(self, symbols: list[str]) -> int:
        number, rank = self.number, self.rank
        # a symbol that no merge names gets -1, which no pair contains
        kind = [number.get(s, -1) for s in symbols]
        n = len(kind)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, kind[i], kind[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((kind[i], kind[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if kind[i] != left or j >= n or kind[j] != right:
                continue
            kind[i], kind[j] = new, -2
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if r := rank.get((new, kind[k])):
                    heapq.heappush(heap, (r[0], i, new, kind[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get((kind[h], new))):
                heapq.heappush(heap, (r[0], h, kind[h], new, r[1]))
            merged += 1
        return n - merged


class _Memo(dict):
    """Counts of runs, made on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, run: str) -> int:
        value = self.make(run)
        if len(run) <= _MEMO_CHARS:
            if len(self) > _MEMO_ENTRIES:
                self.clear()
            self[run] = value
        return value


class TokenCounter:
    """Counts of texts for a word-end byte-level BPE vocabulary file with a lower-casing normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merger = MergeCounter(merges)
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.runs = re.compile(f"[^{_WS}]+")
        self.word_memo, self.run_memo = _Memo(self._word), _Memo(self._run)

    def _word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        return self.merger.count(symbols)

    def _plain(self, text: str) -> int:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isalpha():  # letters alone are one word
            return self.word_memo[text]
        if text[-1] in ",." and text[:-1].isalpha():  # so is a mark after them
            return self.word_memo[text[:-1]] + self.word_memo[text[-1]]
        return sum(map(self.word_memo.__getitem__, self.words.findall(text)))

    def _run(self, run: str) -> int:
        """Tokens of a text without white space, which is not empty."""
        if not any(m in run for m in self.marks):
            return self._plain(run)
        return len(self.special.findall(run)) + sum(self._plain(t) for t in self.special.split(run) if t)

    def count(self, text: str | None) -> int:
        return sum(map(self.run_memo.__getitem__, self.runs.findall(text))) if text else 0


def counter(path: str) -> TokenCounter:
    """The counter of this Python worker; it outlives a task."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if path not in kept:
        kept[path] = TokenCounter(path)
    return kept[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of every document."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(tokenizer)
        for batch in batches:
            yield pd.Series([tokens.count(t) for t in batch], dtype="int64")

    counted = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.pandas_udf(count, "long")(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
