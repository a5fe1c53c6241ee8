"""Token ids as binary files with Elias-Fano document boundaries (operator 5).

A shard file holds the documents of one range of doc_id in ascending order:

    the ids of all documents, each followed by the end id,
    Elias-Fano code of the boundaries (documents + 1 values),
    Elias-Fano code of the doc_ids that are not null,
    id width in bytes (u8), the shard's documents (u64), documents with a null
    doc_id (u64), length of the ids and of both codes in bytes (u64 each),
    magic "EFTOK2\\0\\0".

Ids are made from the bytes of Arrow's batches, ``_BLOCK`` of them at once, and
written as they are made, so a task holds one block of them, and 16 bytes a
document until the codes are written. A document's place is the
boundary that ``select`` returns, one by one or for a range of documents; there
is no table of 64-bit offsets, and readers fetch the ids that they need. Shards
hold about ``SHARD_BYTES`` of text, however large the table is. A shard is written under a name of its own by each attempt
of its task and only the shards in the manifest count, so attempts that were
lost or repeated leave nothing that is read.

Spark's own files are few: the manifest is one, and a reading task takes about
``READ_IDS`` ids. For each file on a local disk the JVM is forked some times to
set permissions, and a fork that is seen before its program starts counts as a
second JVM.

Paths are opened through Arrow's file systems, from the URI of the shared
folder. Ids take two bytes where the vocabulary allows it, else four.

Defined results: a null text is an empty text, which is just the end id;
repeated doc_ids stand next to each other, ordered by their text; a null
doc_id comes first; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import elias_fano
from .common import materialize, scratch_path, ship
from .token_counts import byte_symbols

END_ID = 0
MAGIC = b"EFTOK2\0\0"
_FOOT = struct.Struct("<BQQQQQ8s")
#: Bytes of text in a shard, about.
SHARD_BYTES = 32 << 20
#: Ids in the shards of a reading task, about.
READ_IDS = 1 << 25
#: Documents that a reader decodes at once.
_READ = 1 << 10
#: Bytes of text that are encoded at once, whole documents.
_BLOCK = 1 << 23


def _marked(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


# Bytes of UTF-8, by what they say of white space (\t-\r, space, U+85, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000).
_VISIBLE = _marked((0x21, 0x7E))
#: First bytes of characters that are no white space.
_STARTS = _marked((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
#: First bytes of two-byte characters, none of them white space.
_PAIRS = _marked((0xC3, 0xDF))
#: Last bytes that no white space has.
_ENDS = _marked((0x8B, 0x9E), (0xA1, 0xA7), (0xAA, 0xAE), (0xB0, 0xBF))
# Fixed value: the pattern of byte-level pre-tokenization.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class _Numbered(dict):
    """Words by the order in which they came first."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _chain(values: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` is made of parts of these ``lengths``; the parts that ``which`` names one after the other, and where each of them ends."""
    chosen = lengths[which]
    ends = np.cumsum(chosen)
    places = np.repeat((np.cumsum(lengths) - lengths)[which] - ends + chosen, chosen)
    places += np.arange(len(places))
    return values[places], ends


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word of a block once.

    For a byte-level vocabulary without a normalizer, texts are cut before
    single spaces between visible characters, where the fixed pattern always
    cuts; the pattern cuts each distinct piece into words, and each distinct
    word is given to the library's model. Nothing is kept from block to block.
    Any other vocabulary, and any text that holds a special token, is encoded
    whole by the library's tokenizer.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        self.symbols = {i: c for i, c in enumerate(byte_symbols())}

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, ids in self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one run of ``texts`` after the other: each text's number of ids, and all their ids; ``end_id`` follows each text."""
        if not len(texts):
            return
        texts = pc.fill_null(texts, "")
        # a special token cuts the text before the pattern is applied, so its neighbours are not pieces of their own
        whole = np.full(len(texts), not self.plain)
        for token in self.special if self.plain else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        data = texts.cast(pa.large_binary())
        _, places, values = data.buffers()
        places = np.frombuffer(places, np.int64)[data.offset : data.offset + len(data) + 1]
        at = 0
        for turn in [*(np.flatnonzero(whole[1:] != whole[:-1]) + 1).tolist(), len(texts)]:
            while at < turn:
                last = min(turn, max(at + 1, int(np.searchsorted(places, places[at] + _BLOCK, side="right")) - 1))
                if whole[at]:
                    found = [np.array(e.ids, dtype=self.dtype) for e in map(self._library, texts[at:last].to_pylist())]
                    counts, ids = np.array([len(x) for x in found], dtype=np.int64), np.concatenate(found)
                else:
                    counts, ids = self._block(values, places[at : last + 1])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                yield counts, ids
                at = last

    def _library(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _block(self, values: pa.Buffer | None, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, size = int(places[0]), int(places[-1] - places[0])
        if not size:
            return np.zeros(len(places) - 1, dtype=np.int64), np.zeros(0, dtype=self.dtype)
        data, places = values.slice(first, size), places - first
        text = np.frombuffer(data, np.uint8)
        # the last space of a text is a word of its own, so the next text's first byte does no harm
        spaces = np.flatnonzero(text[1:-1] == 0x20) + 1
        before = text[spaces - 1]
        spaces = spaces[_STARTS[text[spaces + 1]] & (_VISIBLE[before] | _ENDS[before] | (before >= 0x80) & _PAIRS[text[spaces - 2]])]
        cuts = np.sort(np.concatenate([spaces, places]))
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        ids, lengths = self._pieces(pieces.dictionary.to_pylist())
        ids, ends = _chain(ids, lengths, pieces.indices.to_numpy())
        return np.diff(np.append(0, ends)[np.searchsorted(cuts, places)]), ids

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, and their number in each."""
        words, which, sizes = _Numbered(), array("q"), array("q")
        number = words.__getitem__
        for piece in pieces:
            body = piece[1:] if piece[0] == " " else piece
            # letters, and letters with one mark after them, need no pattern
            if body.isalpha():
                which.append(number(piece))
                sizes.append(1)
            elif body[-1:] in (",", ".") and body[:-1].isalpha():
                which.append(number(piece[:-1]))
                which.append(number(body[-1]))
                sizes.append(2)
            else:
                found = _PATTERN.findall(piece)
                which.extend(map(number, found))
                sizes.append(len(found))
        ids, lengths = array("I"), array("q")
        for word in words:
            found = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.symbols))]
            ids.extend(found)
            lengths.append(len(found))
        out, ends = _chain(np.frombuffer(ids, np.uint32).astype(self.dtype), np.frombuffer(lengths, np.int64), np.frombuffer(which, np.int64))
        return out, np.diff(ends[np.cumsum(np.frombuffer(sizes, np.int64)) - 1], prepend=0)


def encoder(path: str, width: int) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if (path, width) not in kept:
        kept[path, width] = Encoder(path, width)
    return kept[path, width]


def _open(uri: str, write: bool):
    """A stream on ``uri``, through the file system that its scheme names."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else uri)
    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


class ShardWriter:
    """Writes a shard to a stream: documents in ascending order of doc_id, nulls first, then ``close``."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.lengths, self.known, self.nulls = array("Q"), array("q"), 0

    def add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next documents."""
        self.out.write(ids.tobytes())
        self.lengths.frombytes(counts.astype(np.uint64).tobytes())

    def name(self, doc_ids: pa.Array) -> None:
        """The doc_ids of the next documents."""
        self.nulls += doc_ids.null_count
        self.known.frombytes(doc_ids.drop_null().to_numpy().astype(np.int64).tobytes())

    def close(self) -> tuple[int, int]:
        """Write what follows the ids; documents and ids of the shard."""
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(self.lengths, dtype=np.uint64).astype(np.int64))])
        codes = [elias_fano.encode(ends), elias_fano.encode(np.frombuffer(self.known, dtype=np.int64))]
        for code in codes:
            self.out.write(code)
        self.out.write(_FOOT.pack(self.width, len(self.lengths), self.nulls, int(ends[-1]) * self.width, *map(len, codes), MAGIC))
        return len(self.lengths), int(ends[-1])


class Shard:
    """Reader of one shard, a seekable file: ``doc_id(i)``, ``bounds(i)``, ``ids(i)`` by ``select``."""

    def __init__(self, file):
        self.file = file
        file.seek(-_FOOT.size, 2)
        end = file.tell()
        self.width, self.n, self.nulls, size, ends, known, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != MAGIC or size + ends + known != end:
            raise ValueError("not a token shard")
        file.seek(size)
        codes = file.read(ends + known)
        self.ends = elias_fano.EliasFano(codes)
        self.known = elias_fano.EliasFano(codes, ends)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.known.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i), self.ends.select(i + 1)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), "<u2" if self.width == 2 else "<u4")

    def ids(self, i: int) -> np.ndarray:
        return self.tokens(*self.bounds(i))


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the shards and return their manifest: part, file, n_docs, n_tokens, in the order of ``part``."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tokens")
    width = 2 if _vocabulary(tokenizer, end_id) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, width)
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
                name = f"{folder}/{part:08d}-{uuid.uuid4().hex}.eftok"
                out = _open(name, True)
                writer = ShardWriter(out, width)
            if batch.num_rows:
                writer.name(batch.column("doc_id"))
                for counts, ids in enc.encode_all(batch.column("text"), end_id):
                    writer.add(counts, ids)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        shards = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // SHARD_BYTES)
    dealt = own.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    dealt = dealt.select("doc_id", "text", F.col("part").cast("long").alias("part"))
    # a row for each shard, in one file
    return materialize(dealt.mapInArrow(write, "part long, file string, n_docs long, n_tokens long").repartition(1), "manifest")


def _vocabulary(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(manifest.sparkSession)
    # a row for each shard, so the order of shards is a small table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = -(-(manifest.agg(F.sum("n_tokens")).first()[0] or 1) // READ_IDS)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with _open(name, False) as f:
                    shard = Shard(f)
                    for at in range(0, shard.n, _READ):
                        last = min(shard.n, at + _READ)
                        ends = shard.ends.select_range(at, last + 1)
                        tokens = shard.tokens(int(ends[0]), int(ends[-1])).astype("<u4")
                        places = (ends - ends[0]).tolist()
                        sums = [zlib.crc32(tokens[a:b]) for a, b in zip(places, places[1:])]
                        known = shard.known.select_range(max(at - shard.nulls, 0), max(last - shard.nulls, 0))
                        names = pa.concat_arrays([pa.nulls(last - at - len(known), pa.int64()), pa.array(known, pa.int64())])
                        yield pa.RecordBatch.from_pydict({"doc_id": names, "start": start + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": pa.array(sums, pa.int64())})

    return placed.select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_shards(write_shards(docs, tokenizer, text=text, doc_id=doc_id))


def open_shard(uri: str) -> Shard:
    return Shard(_open(uri, False))
