"""SimHash near-duplicates through multi-index hashing (operator 7).

Fingerprints within ``RADIUS`` bits are linked. The 64 bits are cut into two
segments of 32. Two fingerprints within 2 bits differ by at most 1 bit in the
first segment or by none in the second, so a table of fingerprints per segment
answers every search: 33 probes of the first (its ball of radius 1) and one of
the second. Candidates are verified on all 64 bits.

Equal fingerprints are one node from the start, so copies never form pairs. A
table entry with more than ``BUCKET`` fingerprints is not paired. Instead all
fingerprints that meet there are linked through the points between them: two
fingerprints lie within 2 bits just when some 64-bit value lies within 1 bit
of both, so hanging every fingerprint on the smallest one around each of its
65 neighbouring values keeps exactly the same components, with work in
proportion to the fingerprints.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; an empty table gives an empty result; repeated rows share a
fingerprint; a null doc_id is only chosen as a class id if a class has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, ship
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET = 64
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit SimHash of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))]
    array = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(array), _BLOCK):
        bits = np.unpackbits(array[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(_WEIGHT[2 * ones > len(array)].sum(dtype=np.uint64).astype(np.int64))


def _batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(*keep, F.pandas_udf(_batches, "long")(F.col(text).cast("binary")).alias("fp"))


def _segments(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table entries (key, fp) and probes (key, fp). Keys carry their segment in bit 32."""
    low = F.expr("fp & 4294967295L")
    high = F.expr("(shiftrightunsigned(fp, 32) & 4294967295L) | 4294967296L")
    entries = fps.select("fp", F.explode(F.array(low, high)).alias("key"))
    ball = F.array(low, *[low.bitwiseXOR(F.lit(1 << i)) for i in range(32)], high)
    probes = fps.select("fp", F.explode(ball).alias("key"))
    return entries, probes


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` that leave the components of all links within 2 bits."""
    entries, probes = _segments(fps)
    # only entries with company are searched: one other probe at least leads there
    size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = materialize(size.where(F.col("n") > bucket).select("key"), "crowded")
    met = probes.join(entries.withColumnRenamed("fp", "other").join(crowded, "key", "left_anti"), "key")
    close = met.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    pairs = close.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return pairs
    there = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    between = there.select("fp", F.explode(around).alias("mid"))
    hub = between.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("mid", "b")
    through = between.join(hub, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(through)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id of its class)."""
    prints = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(links(nodes.select("fp")), "simhash")
    classed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay: the one with the smallest doc_id of each class, with their own columns, whatever the names.

    Rows that repeat a doc_id stand for one document, so one of them stays;
    a null doc_id counts as the smallest value.
    """
    first = F.lit(-(1 << 63)).cast("long")
    stay = classes(docs, text, doc_id).where("doc_id <=> component_id").select(F.coalesce("doc_id", first).alias("key")).distinct()
    own = docs.select(packed(docs).alias("d"), F.coalesce(F.col(doc_id), first).alias("key"))
    return own.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("d.*")
