"""Tables in the folder that the driver and all executors share, and the rows that tasks exchange."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that has none gets a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, from one column-pruned aggregation."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def hashed_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """The first `most` rows by a hash of key, of about `rows` rows in all.

    Only the share of hash space that holds half as many again is sorted, so no task gets `most` rows from every other task.
    """
    h = F.xxhash64(key)
    share = min(1.0, (1.5 * most + 50) / max(1, rows))
    few = df if share == 1.0 else df.filter(h < F.lit(int(-(1 << 63) + share * ((1 << 64) - 4096))))
    return few.orderBy(h, *df.columns).limit(most)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id, or for a null one a number below all usual ones that depends on the text: equal texts without an id are one document."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(-(1 << 63)))


def text_tag(text: str = "text") -> Column:
    """32 bits of the text's hash: with doc_key they tell rows apart that repeat a doc_id with another text."""
    return F.shiftrightunsigned(F.xxhash64(text), 32)


def bucket_bits(total_bytes: int, most: int = 16) -> int:
    """Log2 of the number of exchange buckets: about 4 MB of text each, so that a bucket fits in a task at any size."""
    return int(min(most, max(4, np.ceil(np.log2(max(1, total_bytes) / (4 << 20))))))


def deal(bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has rows: the bucket, then each column's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(bucket)]
    columns = [c[order] for c in columns]
    arrays = [pa.array(bucket[cut].astype(np.int32), pa.int32())]
    arrays += [pa.array([c[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def gather(table: pa.Table, name: str, kind) -> np.ndarray:
    """The values that deal() packed, of all rows of a bucket."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows of plain values as a batch of a flat schema."""
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
