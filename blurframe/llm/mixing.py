"""Mixing sources to target weights (operator 10).

Documents get hash-random keys; they are range-sorted by source and key;
prefix sums of their sizes are made per partition and shifted by the sums of
the partitions before; and every source is cut at its exact budget, the
document at the cut giving only the words that are left. A source whose budget
exceeds its size is repeated in whole epochs first.

Budgets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ...
They share all words in proportion, none beyond ``MAX_EPOCHS`` times its size;
what is over goes to the others by weight. That fixed point is found at once:
with sources sorted by cap / weight, a share per weight is raised until it is
used up.

Defined results: a null or wordless text has size 0 and nothing is taken of
it; a null source is a source; repeated rows are drawn one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, broadcast_if_small, materialize, n_shuffle, packed

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> dict[str | None, float]:
    """The words that each source gives to the mix."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, over = sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(names, key=lambda s: Fraction(max_epochs * sizes[s], weight[s])):
        if max_epochs * sizes[s] * over > left * weight[s]:
            break
        out[s] = float(max_epochs * sizes[s])  # it can give less than its share
        left, over = left - max_epochs * sizes[s], over - weight[s]
    return {s: out[s] if s in out else weight[s] * (left / over) for s in names}


def _taken(docs: DataFrame, source: str, text: str, doc_id: str) -> DataFrame:
    """Per row: doc_id, size, source_size, target, epochs, extra (words beyond whole epochs), and row_hash of doc_id, source and text."""
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("src"), size_of(F.col(text)).alias("size"), key.alias("key"), row_hash(source, text, doc_id).alias("row_hash"))
    order = ["src", "key", "doc_id", "size"]
    ranged = sized.repartitionByRange(n_shuffle(spark), *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")  # the partition of a row is fixed from here on

    sums = ranged.groupBy("src", "part").agg(F.sum("size").alias("s"))
    sums = materialize(sums, "sums")  # a row for each source and partition that holds some of it
    whole = {r["src"]: r["t"] for r in sums.groupBy("src").agg(F.sum("s").alias("t")).collect()}  # a row for each source
    plan = [(s, whole[s], t, int(t // whole[s]) if whole[s] else 0) for s, t in targets(whole).items()]
    budget = spark.createDataFrame(plan, "b_src string, source_size long, target double, epochs long")
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(F.col("src").alias("o_src"), F.col("part").alias("o_part"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("shift"))
    shift = shift.join(broadcast_if_small(budget), F.col("o_src").eqNullSafe(F.col("b_src"))).drop("b_src")

    local = Window.partitionBy("part", "src").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(local), F.lit(0)))
    placed = placed.join(broadcast_if_small(shift), (F.col("part") == F.col("o_part")) & F.col("src").eqNullSafe(F.col("o_src")))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size") - F.col("shift") - F.col("before")
    return placed.select("doc_id", "size", "source_size", "target", "epochs", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long").alias("extra"), "row_hash")


def row_hash(source: str, text: str, doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(source), F.lit("")), F.col(source).isNull(), F.col(text))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (the words that the mix takes, repeats counted)."""
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return _taken(docs, source, text, doc_id).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def draw(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as it is taken, the one at a source's cut shortened to its first words.

    The shortened text has single spaces between its words. The result has the
    columns of ``docs``, whatever their names. Rows with equal doc_id, source and
    text are drawn one by one: together they give what :func:`mix` takes of them.
    """
    # what equal rows give together; they have one size and one source
    take = _taken(docs, source, text, doc_id).groupBy("row_hash").agg(F.max("size").alias("size"), F.max("epochs").alias("epochs"), F.sum("extra").alias("extra")).where("epochs * size + extra > 0")
    own = docs.select(packed(docs).alias("d"), F.col(text).alias("text"), row_hash(source, text, doc_id).alias("row_hash")).join(take, "row_hash")
    number = F.row_number().over(Window.partitionBy("row_hash").orderBy("row_hash")) - 1
    mine = own.withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0), F.col("extra") - number * F.col("size")))).withColumn("taken", F.expr("epochs * size + extra")).where("taken > 0")
    copies = mine.withColumn("n", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size))")))
    part = F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(_first_words(F.col("text"), F.col("n")))
    return copies.select(F.col("d").withField("`" + text.replace("`", "``") + "`", part).alias("d")).select("d.*")


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")
