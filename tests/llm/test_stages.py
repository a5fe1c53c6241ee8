"""Odd tables in every operator that returns documents."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blurframe.llm import decontam, mixing, quality, simhash

CLASHES = (
    "_bad _m _key _size _taken _words _host a b b_src base_failed before component_id contaminated d doc_row end epochs extra first fp fresh host host_bad"
    " held item judged k kept key len m n n_docs n_hit n_words node off one ord p part pos root row row_hash s seq shift sid size src start stop t taken target w wid x y z"
).split()


def stages(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    return {"good": quality.keep_good, "first": simhash.keep_first, "clean": lambda docs: decontam.keep_clean(docs, items), "draw": mixing.draw}


def texts(n):
    rng = random.Random(n)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(25, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["good", "first", "clean", "draw"])
def test_columns_with_any_name(spark, docs, name):
    """Columns that are named like an operator's own come through with their values."""
    table = docs(texts(12), sources=["a", "b"] * 6)
    wide = table.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES if c != "size"}).withColumn("a.b", F.lit(1)).withColumn("Ünï", F.lit(2))
    stage = stages(spark)[name]
    out = stage(wide)
    assert out.dtypes == wide.dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES if c != "size")
    plain = Counter((r["doc_id"], r["text"]) for r in stage(table).collect())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == plain


@pytest.mark.parametrize("name", ["good", "first", "clean", "draw"])
def test_odd_rows(docs, odd, spark, name):
    """Null ids, null sources, repeated rows, odd texts and an empty table."""
    stage = stages(spark)[name]
    some = texts(6)
    table = docs(odd + some + some, sources=[None, "a"] * 11, ids=[None, None, *range(20)])
    out = stage(table)
    assert out.columns == table.columns
    out.collect()
    assert stage(docs([])).collect() == []


def test_repeated_rows_are_drawn_for_what_the_mix_takes(docs):
    some = texts(8)
    rows = [t for t in some for _ in range(3)]
    table = docs(rows, sources=["a" if i < 12 else "b" for i in range(24)], ids=[i // 3 for i in range(24)])
    taken = Counter()
    for r in mixing.mix(table).collect():
        taken[r["doc_id"]] += r["taken"]
    drawn = Counter()
    for r in mixing.draw(table).collect():
        drawn[r["doc_id"]] += len(r["text"].split())
    assert drawn == +taken
