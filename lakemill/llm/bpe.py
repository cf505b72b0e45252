"""BPE encoding and decoding (forced-boundary splitting, see word_bpe.py)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import word_bpe
from .common import documents, pieces


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes whole texts; one pass, no shuffle, rows keep their partition.

    Returns id_col, n_tokens and either ids (decimal, joined by spaces) and decoded, or with digests=True the
    SHA-256 of each (ids_sha256, decoded_sha256). A null or empty text has no token; repeated rows each give a row;
    null ids stay null; other columns of docs are ignored, whatever they are called; an empty table gives no row.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches):
        bpe = word_bpe.load(path)
        digest = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else str
        for batch in pieces(batches, 4_000_000):
            n, ids, decoded = [], [], []
            texts = batch.column(1).to_pylist()
            bpe.prepare([x for x in texts if x])
            for text in texts:
                i, t = bpe.encode_decode(text)
                n.append(i.count(" ") + 1 if i else 0)
                ids.append(digest(i))
                decoded.append(digest(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {names[0]} string, {names[1]} string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)
