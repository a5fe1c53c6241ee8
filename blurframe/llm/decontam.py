"""Benchmark decontamination through a prefix-filtered set join (operator 6).

DataFrame functions only. An item of the benchmark is cut into windows of 13
consecutive words (a shorter item is one window). A document that contains a
window contains every shingle of it, so one shingle is enough to find it: the
rarest one, by how many documents of the corpus hold it. That shingle is the
window's necessary prefix.

1. One pass over the texts keeps the postings (document, position, shingle) of
   shingles that the benchmark uses. The documents' other shingles never leave
   the task that reads them.
2. Shingles are ordered by the documents that hold them, and each window is
   joined at its rarest shingle only.
3. The aligned window must lie inside the document (length and position).
4. Every other shingle of the window must stand at its place in the document.
   Shingles are compared as text when they become postings, so containment is
   exact.

Windows with equal words are one window, whatever the number of items that
hold them. The benchmark's tables are broadcast only after a count proves them
small; else the joins are shuffled.

Defined results: a null or wordless document has no words, no hits and is not
contaminated; a null or wordless item has no windows; an empty benchmark hits
nothing; rows that repeat a doc_id are judged one by one; a null item_id
counts as an item but has no place in the list of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import BROADCAST_ROWS
from .common import broadcast_if_small, lower_ascii, materialize, packed

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: A document is contaminated from one hit word in this many on.
HIT_RATIO = 20


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD_RE), F.lit(0))


def _shingles(size: int) -> str:
    """SQL for the shingles of ``size`` words of the array ``w``, in order."""
    if size == 1:
        return "w"
    parts = ", ".join(f"w[i + {j}]" for j in range(size))
    return f"if(size(w) < {size}, array(), transform(sequence(0, size(w) - {size}), i -> concat_ws(' ', {parts})))"


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, w) with their words, and (wid, item) of the items that hold them."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("a")).where("size(a) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(size(a) - {window}, 0)), i -> slice(a, i + 1, {window}))")
    held = materialize(items.select("item", "row", F.explode(cut).alias("w")), "windows").select("item", "row", "w", F.array_join("w", " ").alias("line"))
    distinct = held.groupBy("line").agg(F.first("w").alias("w"))
    numbered = materialize(distinct.withColumn("wid", F.monotonically_increasing_id()), "window_ids")
    return numbered.select("wid", "w"), held.join(numbered.select("line", "wid"), "line").select("wid", "row", "item").distinct()


def find_windows(docs: DataFrame, windows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """All documents (row, *keep, n_words), and all occurrences (row, wid, start, len) of ``windows``.

    The shingles of up to ``limit`` rows are broadcast; more are shuffled.
    """
    sized = windows.select("wid", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"))
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # 1 to SHINGLE: three rows at most
    # the windows' shingles in order: (wid, len, off, size, s)
    parts = None
    for size in sizes:
        one = sized.where(F.col("size") == size).select("wid", "len", "size", F.posexplode(F.expr(_shingles(size))).alias("off", "s"))
        parts = one if parts is None else parts.unionByName(one)
    keep_cols = [F.col(k) for k in keep]
    if parts is None:
        docs = docs.select(F.monotonically_increasing_id().alias("row"), *keep_cols, F.size(words(F.col(text))).alias("n_words"))
        none = docs.select("row", F.lit(0).cast("long").alias("wid"), F.lit(0).alias("start"), F.lit(0).alias("len")).where("false")
        return docs, none
    ids = materialize(parts.select("s").distinct().withColumn("sid", F.monotonically_increasing_id()), "shingle_ids")
    parts = materialize(parts.join(ids, "s").select("wid", "len", "off", "sid"), "window_shingles")

    every = [f"transform({_shingles(size)}, (s, p) -> struct(p AS pos, s AS s))" for size in sizes]
    if ids.limit(limit + 1).count() <= limit:
        # one pass over the texts; the empty shingle stands for the document itself
        own = docs.select(F.monotonically_increasing_id().alias("row"), *keep_cols, words(F.col(text)).alias("w"))
        spread = own.select("row", *keep, F.size("w").alias("n_words"), F.explode(F.expr(f"concat(array(struct(-1 AS pos, '' AS s)), {', '.join(every)})")).alias("x"))
        marks = ids.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("s"), F.lit(-1).cast("long").alias("sid")))
        found = spread.select("row", *keep, "n_words", "x.pos", "x.s").join(F.broadcast(marks), "s").drop("s")
        found = materialize(found, "postings")
        listed = found.where("sid = -1").select("row", *keep, "n_words")
        postings = found.where("sid >= 0").select("row", "n_words", "pos", "sid")
    else:
        # documents are numbered first, and only their shingles are shuffled
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), *keep_cols, F.col(text).alias("body"), F.size(words(F.col(text))).alias("n_words"))
        numbered = materialize(numbered, "numbered")
        listed = numbered.select("row", *keep, "n_words")
        spread = numbered.select("row", "n_words", words(F.col("body")).alias("w")).select("row", "n_words", F.explode(F.expr(f"concat({', '.join(every)})")).alias("x"))
        postings = materialize(spread.select("row", "n_words", "x.pos", "x.s").join(ids, "s").drop("s"), "postings")

    # necessary prefix: the shingle of the window that fewest documents hold; one that none holds ends the search
    rarity = postings.select("sid", "row").distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("df"))
    ranked = parts.join(rarity, "sid", "left").select("wid", "len", "off", "sid", F.coalesce("df", F.lit(0)).alias("df"))
    rarest = ranked.groupBy("wid").agg(F.min_by(F.struct("len", "off", "sid", "df"), F.struct("df", "off")).alias("p"))
    prefix = materialize(rarest.where("p.df > 0").select("wid", "p.len", "p.off", "p.sid"), "prefixes")
    start = F.col("pos") - F.col("off")
    met = postings.join(broadcast_if_small(prefix), "sid").select("row", "wid", "len", start.alias("start"), "n_words")
    fits = met.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).drop("n_words")

    # verification: each shingle of the window at its place
    need = fits.join(broadcast_if_small(parts.select("wid", "off", "sid")), "wid").select("row", "wid", "start", "len", (F.col("start") + F.col("off")).alias("pos"), "sid")
    stands = need.join(postings.select("row", "pos", "sid"), ["row", "pos", "sid"])
    held = stands.groupBy("row", "wid", "start", "len").agg(F.count(F.lit(1)).alias("n"))
    return listed, held.where(F.col("n") == F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1))).select("row", "wid", "start", "len")


def overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, n_items, items (sorted ids) and contaminated. ``keep`` columns may have any names."""
    windows, holders = benchmark_windows(benchmark)
    docs = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    listed, held = find_windows(docs, windows, "text", ("kept",), limit)
    held = materialize(held, "occurrences")

    # hit words: the union of the windows' spans, start by start
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = held.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    hits = spans.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))

    items = held.select("row", "wid").distinct().join(broadcast_if_small(holders.withColumnRenamed("row", "item_row")), "wid").select("row", "item_row", "item").distinct()
    items = items.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    out = listed.join(hits, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "kept.*",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (HIT_RATIO * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever the names.

    Rows that repeat a doc_id are one document: where one of them is
    contaminated, all go. A null doc_id is a value like any other.
    """
    own = docs.select(packed(docs).alias("d"), F.coalesce(F.col(doc_id), F.lit(-(1 << 63)).cast("long")).alias("key"), F.col(text).alias("text"))
    dirty = overlap(own, benchmark, keep=("key",)).where("contaminated").select("key").distinct()
    return own.join(dirty, "key", "left_anti").select("d.*")
