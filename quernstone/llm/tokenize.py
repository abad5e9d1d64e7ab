"""BPE encoding and decoding of a text column (operator 2)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c
from .bpe import codec


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): packed little-endian 32-bit ids of every whole text.

    A null or empty text has no ids; repeated rows give repeated rows; other
    columns are ignored.  One pass without a shuffle.
    """
    c.ship(docs.sparkSession)

    def run(batches):
        k = codec(tokenizer)
        for b in c.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k.pack_many(b.column(1).to_pylist()), pa.binary())], ["id", "ids"])

    from pyspark.sql import functions as F

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(id, text) of rows with packed ids; null ids give an empty text, repeated rows repeated rows, an empty table an empty result."""
    c.ship(encoded.sparkSession)

    def run(batches):
        k = codec(tokenizer)
        for b in c.slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.unpack(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def roundtrip_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass and keep digests only, so that ids need not be written.

    A null or empty text has no ids and decodes to nothing; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    A text is worked on whole, in memory of some twenty times its size.
    """
    c.ship(docs.sparkSession)

    def run(batches):
        k = codec(tokenizer)
        for b in c.slices(batches):
            packed = k.pack_many(b.column(1).to_pylist())
            back = [k.unpack(x).decode("utf-8", "replace") for x in packed]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_digest(c.table(spark, sf_dir, "documents"), c.default_tokenizer())
