import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from blurframe.llm import queries
from tests.compare import assert_same, connect
from tests.llm.test_decontam import slow as slow_overlap
from tests.llm.test_quality import slow as slow_counts
from tests.llm.test_simhash import slow_classes, slow_print

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    con = connect(SF)
    for name, sql in queries.SQL.items():
        assert_same(queries.QUERIES[name](spark, SF), con, sql)


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = []
    for d in docs:
        n, _, _, _, _, repeat = slow_counts(d["text"])
        if n >= 20 and 100 * repeat <= 30 * n:
            good.append(d)
    # no host of this table falls
    classes = slow_classes({d["doc_id"]: slow_print(d["text"]) for d in good})
    good = [d for d in good if classes[d["doc_id"]] == d["doc_id"]]
    dirty = [x[3] for x in slow_overlap([d["text"] for d in good], items)]
    good = [d for d, x in zip(good, dirty) if not x]
    stage = spark.createDataFrame([tuple(d[c] for c in corpus_pipeline.COLUMNS) for d in good], "doc_id long, text string, lang string, source string, n_chars long")
    drawn = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.source_mix(spark, stage, SF).collect()))
    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want, at = [], 0
    for doc_id, text in drawn:
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "source_mix", "token_output"]
