"""Token-ID output: one zstandard frame for each document, all with one shared dictionary.

A shard is one byte string (little-endian throughout):

    magic        8 bytes  b"LMTOKEN1"
    dictionary   32 bytes SHA-256 of the shared dictionary
    start        u64      tokens of the same part before this shard
    n            u64      documents
    ids          n x i64  document ids
    known        n x u8   0 where the id is null
    tokens       n x u32  token counts
    offsets      (n + 1) x u64, of the frames from the end of this index
    frames       a zstandard frame for each document: its ids as u32

With the index a reader decompresses one short document alone (read_one). Executors can reach shared storage only
through Spark's writers, so a shard is a binary value of a Parquet table beside its first and last id, by which
readers skip shards; the dictionary is a table of one row.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_bpe
from .common import documents, pieces, shared_folder

MAGIC = b"LMTOKEN1"
MARKS = frozenset(".,;:!?|")
HEAD = struct.Struct("<8s32sQQ")
SHARD = "part int, seq int, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, data binary"


class Cache(dict):
    """Values computed when they are first asked for; what stays unused for a whole generation of entries is forgotten."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        self[key] = value = self.compute(key) if value is None else value
        return value

    def age(self) -> None:
        """To be called between pieces of input."""
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()


class CachedTokenizer:
    """The tokenizers library behind caches of runs without white space and of their pre-tokens, which it encodes independently.

    Texts for which that isn't certain (special tokens, odd controls, not in NFC) go to the library whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.parts = word_bpe.part_finder(json.load(f))
        self.symbols = word_bpe.byte_symbols()
        self.model = self.library.model
        self.of_part = Cache(self.part, most)
        self.of_word = Cache(self.word, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        """A pre-token needs the library's model only: it is normalised and split already."""
        symbols = self.symbols
        mapped = part if part.isascii() and part.isprintable() else "".join([symbols[b] for b in part.encode()])
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        word, part = word_bpe.WordBPE.lower(word), self.of_part
        if word.isalpha():  # letters alone are one pre-token, and so is a single mark after them
            return part[word]
        if word[-1] in MARKS and word[:-1].isalpha():
            return part[word[:-1]] + part[word[-1]]
        return b"".join([part[p] for p in self.parts(word)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        self.of_word.age()
        self.of_part.age()
        out, known = [], self.of_word.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif "<|" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(known, text.split())))
        return out


_LOADED: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where the samples are too few to train one, their own bytes serve as its content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def pack(ids: list, frames: list[bytes], counts: list[int], start: int, dictionary_hash: bytes) -> bytes:
    n = len(ids)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames], dtype=np.uint64)]).astype("<u8")
    index = [np.array([0 if i is None else i for i in ids], dtype="<i8"), np.array([i is not None for i in ids], dtype="u1"), np.array(counts, dtype="<u4"), offsets]
    return b"".join([HEAD.pack(MAGIC, dictionary_hash, start, n), *(a.tobytes() for a in index), *frames])


@dataclass
class Shard:
    start: int
    ids: list
    counts: np.ndarray
    offsets: np.ndarray
    data: bytes
    base: int

    def frame(self, k: int) -> bytes:
        return self.data[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]


def unpack(data: bytes, dictionary_hash: bytes) -> Shard:
    magic, named, start, n = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    if named != dictionary_hash:
        raise ValueError("the shard was written with another dictionary")
    at, parts = HEAD.size, []
    for kind, m in (("<i8", n), ("u1", n), ("<u4", n), ("<u8", n + 1)):
        parts.append(np.frombuffer(data, dtype=kind, count=m, offset=at))
        at += parts[-1].nbytes
    return Shard(start, [int(i) if ok else None for i, ok in zip(parts[0], parts[1], strict=True)], parts[2], parts[3], data, at)


class TokenStore:
    """A token table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.dictionary: bytes = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
        self.hash = hashlib.sha256(self.dictionary).digest()

    @classmethod
    def write(cls, docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, sample_bytes: int = 65_536, dictionary_bytes: int = 65_536, level: int = 3, shard_bytes: int = 2_000_000, part_bytes: int = 134_217_728) -> TokenStore:
        """Encodes, sorts by id and writes.

        The dictionary is trained on about sample_docs documents picked by a hash of the id, the first sample_bytes bytes of the
        ids of each; twice that product is the most that the driver holds. A task writes about part_bytes bytes of
        text. Ids are integers (another type raises TypeError); null ids sort first; a null text has the end id only;
        repeated rows stay, in no stated order among themselves; an empty table gives a store without shards; other columns are
        ignored.
        """
        spark = docs.sparkSession
        if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{id_col} has to be an integer column")
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        total, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        share = min(1_000_000, -(-sample_docs * 1_000_000 // max(1, total)))
        picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
        end = np.array([end_id], dtype="<u4").tobytes()

        def serialise(batches):
            for batch in pieces(batches):
                yield pa.RecordBatch.from_arrays([pa.array([(x + end)[:sample_bytes] for x in tokenizer(tokenizer_path).encode(batch.column(1).to_pylist())], pa.binary())], names=["ids"])

        samples = [bytes(r["ids"]) for r in picked.mapInArrow(serialise, "ids binary").take(2 * sample_docs)]
        dictionary = train_dictionary(samples, dictionary_bytes)
        spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
        dictionary_hash = hashlib.sha256(dictionary).digest()

        def shards(batches):
            press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
            part, seq, start = TaskContext.get().partitionId(), 0, 0
            ids, frames, counts, held = [], [], [], 0

            def flush():
                nonlocal seq, start, held
                data = pack(ids, frames, counts, start, dictionary_hash)
                known = [i for i in ids if i is not None]
                row = [part, seq, min(known, default=None), max(known, default=None), len(ids), sum(counts), data]
                seq, start, held = seq + 1, start + sum(counts), 0
                for x in (ids, frames, counts):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["part", "seq", "first_id", "last_id", "n_docs", "n_tokens", "data"])

            for batch in pieces(batches):
                for i, x in zip(batch.column(0).to_pylist(), tokenizer(tokenizer_path).encode(batch.column(1).to_pylist()), strict=True):
                    frame = press.compress(x + end)
                    ids.append(i)
                    frames.append(frame)
                    counts.append(len(x) // 4 + 1)
                    held += len(frame)
                    if held >= shard_bytes:
                        yield flush()
            if ids:
                yield flush()

        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // part_bytes))
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash parts rows of one id, or of none
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(shards, SHARD).write.parquet(f"{folder}/shards")
        return cls(spark, folder)

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(f"{self.folder}/shards")

    def read(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

        A part is what one writing task wrote: the broadcast table of their starts has a row of 12 bytes for each part_bytes of text
        (10 MB at 100 TB).
        """
        dictionary, dictionary_hash = self.dictionary, self.hash

        def documents_of(batches):
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    shard = unpack(data.as_py(), dictionary_hash)
                    starts = shard.start + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))])[:-1]
                    raw = [press.decompress(shard.frame(k)) for k in range(len(shard.ids))]
                    columns = [pa.array([part] * len(raw), pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in raw], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

        starts = self.shards().groupBy("part").agg(F.sum("n_tokens").alias("n"))
        starts = starts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")
        rows = self.shards().select("part", "data").mapInArrow(documents_of, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
        return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

    def read_one(self, doc_id: int) -> list[list[int]]:
        """The ids of one document (of each row with that id): one shard is fetched, one frame decompressed."""
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.dictionary))
        out = []
        for row in self.shards().where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("data").toLocalIterator():
            shard = unpack(bytes(row["data"]), self.hash)
            out += [np.frombuffer(press.decompress(shard.frame(k)), dtype="<u4").tolist() for k, i in enumerate(shard.ids) if i == doc_id]
        return out


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return TokenStore.write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2).read()
