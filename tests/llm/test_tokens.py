import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blurframe.llm import elias_fano, token_counts, token_files

BYTE, WORD = (str(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=300), st.booleans())
def test_elias_fano_round_trip(values, dense):
    values = sorted(v % 50 if dense else v for v in values)
    code = elias_fano.encode(np.array(values, dtype=np.int64))
    ef = elias_fano.EliasFano(b"xx" + code, 2)
    assert ef.select_range(0, len(values)).tolist() == values and [ef.select(i) for i in range(len(values))] == values and ef.end == len(code) + 2


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000))
    assert len(elias_fano.encode(values)) * 8 / len(values) < 2.1 + np.log2(values[-1] / len(values))
    ef = elias_fano.EliasFano(elias_fano.encode(values))
    assert [ef.select(i) for i in range(0, 20_000, 777)] == values[::777].tolist()
    for first, last in ((0, 1), (0, 513), (511, 700), (5000, 15_000), (19_999, 20_000), (7, 7)):
        assert ef.select_range(first, last).tolist() == [ef.select(i) for i in range(first, last)]
    with pytest.raises(IndexError):
        ef.select(20_000)
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def texts():
    rng = random.Random(2)
    alphabet = "abTSI'’ΣςéÅİ \n\t  \x1c\x85　 ​ñ1⅓２中กำ\U0001f44d́'ll've.,!?-#"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return out + [t + s + u for t, s, u in zip(out[:200], ["<|endoftext|>", "<|startoftext|>"] * 100, out[200:400])]


def test_counts_equal_the_library():
    lib, own = Tokenizer.from_file(WORD), token_counts.TokenCounter(WORD)
    for t in texts():
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)
    assert own.count(None) == own.count("") == 0


def test_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(BYTE), token_files.Encoder(BYTE, 2)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_blocks_of_texts_equal_the_library(monkeypatch):
    # pieces are cut in bytes of several texts at once, nulls and special tokens between them
    lib, own = Tokenizer.from_file(BYTE), token_files.Encoder(BYTE, 2)
    spaces = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000\x1c\u180e\u200b"
    many = texts() + [f"{x}{s}{t}{y}" for x in ("a", "é", "中", "") for s in spaces for t in (" ", "  ", "") for y in ("b", "é", "中", "ё", "", "!")]
    random.Random(3).shuffle(many)
    many[::50] = [None] * len(many[::50])
    want = [lib.encode(t or "", add_special_tokens=False).ids + [0] for t in many]
    for block in (1, 40, 1 << 23):
        monkeypatch.setattr(token_files, "_BLOCK", block)
        runs = list(own.encode_all(pa.array([None, *many], pa.string())[1:], 0))
        assert np.concatenate([c for c, _ in runs]).tolist() == [len(w) for w in want]
        assert np.concatenate([i for _, i in runs]).tolist() == [i for w in want for i in w]
        assert block > 1 or len(runs) > len(many) // 2
    assert list(own.encode_all(pa.array([], pa.string()), 0)) == []


def test_few_files_of_spark(docs, monkeypatch):
    # Spark forks the JVM for each of its files, and forks may count as memory
    df = docs([f"text {i}" for i in range(40)])
    manifest = token_files.write_shards(df, BYTE, shards=9)
    assert manifest.count() == 9 and len(manifest.inputFiles()) == 1
    rows = token_files.read_shards(manifest)
    assert rows.rdd.getNumPartitions() == 1
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    dealt = token_files.read_shards(manifest)
    assert dealt.rdd.getNumPartitions() == -(-manifest.agg({"n_tokens": "sum"}).first()[0] // 50) > 1
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))


def test_other_vocabularies_are_encoded_by_the_library():
    lib, own = Tokenizer.from_file(WORD), token_files.Encoder(WORD, 4)
    assert np.frombuffer(own.encode("The cat’s HAT"), "<u4").tolist() == lib.encode("The cat’s HAT", add_special_tokens=False).ids


def test_count_query(docs, odd):
    lib = Tokenizer.from_file(WORD)
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs(odd), WORD).collect()}
    for i, t in enumerate(odd):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_files_round_trip(docs, odd):
    lib = Tokenizer.from_file(BYTE)
    ids = [7, 3, 3, None, 100, 2, 50, 1, 0, 9]
    df = docs(odd, ids=ids)
    manifest = token_files.write_shards(df, BYTE, shards=3)
    rows = sorted(token_files.read_shards(manifest).collect(), key=lambda r: r["start"])
    order = sorted(range(len(odd)), key=lambda i: (ids[i] is not None, ids[i] or 0, odd[i] is not None, odd[i] or ""))
    at = 0
    assert len(rows) == len(odd)
    for r, i in zip(rows, order):
        want = np.array(lib.encode(odd[i] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids[i], at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    # many shards, whose places come from select
    many = sorted(token_files.read_shards(token_files.write_shards(df, BYTE, shards=7)).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in many] == [tuple(r) for r in rows]
    shard = token_files.open_shard(manifest.orderBy("part").first()["file"])
    assert shard.doc_id(0) is None and shard.ids(0)[-1] == 0
    assert token_files.encode_documents(docs([]), BYTE).count() == 0
