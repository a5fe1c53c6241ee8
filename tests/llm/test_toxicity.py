import random
import zlib

from blurframe.llm import toxicity


def corpus(n=600):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(60)}" for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_odd_rows(docs, spark, odd):
    texts, labels = corpus()
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.classify(docs(texts + odd), table).collect()}
    assert len(rows) == len(texts) + len(odd)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i in held) and sum(r["held_out"] for r in rows.values() if r["doc_id"] < len(texts)) == len(held)
    assert sum(rows[i]["predicted"] == labels[i] for i in held) / len(held) > 0.9
    for r in rows.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_nothing_to_learn(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs(["a b", None]), none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.classify(docs(["a b", "c d"]), one).collect()} == {0}
    assert toxicity.classify(docs([]), none).count() == 0


def test_held_out_rows_of_all_languages(spark):
    """Ranking and recall on the held-out labelled documents of sf0.1, over all and in each language."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    pairs = lambda rows: (rows[rows.toxic == 1].score.to_numpy()[:, None] > rows[rows.toxic == 0].score.to_numpy()[None, :]).mean()
    caught = lambda rows: rows[rows.toxic == 1].predicted.mean()
    assert pairs(out) > 0.93 and caught(out) > 0.75 and out[out.toxic == 0].predicted.mean() < 0.05
    for _, rows in out.groupby("lang"):
        assert pairs(rows) > 0.85 and caught(rows) >= 0.5


def test_labels_that_disagree_and_long_texts(docs, spark):
    """A doc_id with both labels teaches nothing; a text beyond the sample's bound is scored whole."""
    texts, labels = corpus(200)
    table = [(i, y) for i, y in enumerate(labels)]
    model = [r["score"] for r in toxicity.classify(docs(texts), spark.createDataFrame(table, "doc_id long, toxic int")).orderBy("doc_id").collect()]
    both = [(i, y) for i, y in table] + [(1000, 1), (1000, 0)]
    long = "w " * toxicity.SAMPLE_CHARS + " idiot scum moron"
    rows = toxicity.classify(docs([*texts, "idiot", long], ids=[*range(200), 1000, 1001]), spark.createDataFrame(both, "doc_id long, toxic int")).orderBy("doc_id").collect()
    assert [r["score"] for r in rows[:200]] == model and rows[-1]["predicted"] == 1
