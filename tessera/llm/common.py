"""Helpers shared by the corpus operators: loading, text access, shards and packed number blobs."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a word breaks at: space, tab, line feed, vertical tab, form feed, carriage return. bytes.split() breaks at these same bytes.
SPACES = b" \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        return [b for chunk in column.chunks for b in texts(chunk)]
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def split_bucket(doc_id, modulus: int) -> int:
    """crc32 of the decimal text of an id, modulo `modulus`; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def split_column(doc_id, modulus: int):
    """The Column form of split_bucket."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """Runs fn(RecordBatch) -> dict of columns over every batch, with the types of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "smallint": pa.int16(), "tinyint": pa.int8(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def table_of(columns: dict, schema: str) -> pa.Table:
    """Arrow table with the columns and simple types of `schema`; needs no session, so it works on executors."""
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (f.strip().split(" ") for f in schema.split(","))]
    return pa.Table.from_arrays([c.combine_chunks().cast(f.type) if isinstance(c := columns[f.name], pa.ChunkedArray) else pa.array(c, type=f.type) for f in fields], schema=pa.schema(fields))


def shard_count(docs: DataFrame, shard_bytes: int, text: str = "text") -> int:
    """Number of hash shards so that one holds about shard_bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def with_shard(docs: DataFrame, n_shards: int, doc_id: str = "doc_id") -> DataFrame:
    """Adds the column `shard`; all rows of one id share a shard."""
    return docs.withColumn("shard", F.pmod(F.xxhash64(doc_id), F.lit(n_shards)))


def pack(array: np.ndarray) -> bytes:
    """Number array to a compressed blob."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def pack_sorted(array: np.ndarray) -> bytes:
    """Ascending unsigned numbers to a blob of byte-transposed differences."""
    a = np.ascontiguousarray(array, dtype=np.uint64)
    d = np.diff(a, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(d, dtype=np.uint64)
