"""Arrays of fixed length built from distributed rows: the only per-corpus statistics that are ever broadcast.

Their size is a parameter and does not depend on the data; a larger corpus makes the counts of a bucket larger, never the
array longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a chunk; a chunk is a row on its way to the driver.
CHUNK_BITS = 14


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def counts(df: DataFrame, bits: int) -> np.ndarray:
    """Sums of column ``n`` by column ``bucket`` (0 .. 2^bits - 1) as uint32, saturating. No rows give zeros."""
    low = (1 << CHUNK_BITS) - 1

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << CHUNK_BITS, dtype=np.uint32)
        out[pdf["bucket"].to_numpy() & low] = np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"chunk": [key[0]], "data": [out.tobytes()]})

    rows = (
        df.groupBy("bucket").agg(F.sum("n").alias("n"))
        .groupBy(F.shiftright("bucket", CHUNK_BITS).alias("chunk"))
        .applyInPandas(pack, "chunk int, data binary").collect()
    )
    out = np.zeros(max(1 << bits, 1 << CHUNK_BITS), dtype=np.uint32)
    for r in rows:
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["data"], dtype=np.uint32)
    return out[: 1 << bits]


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of settings (targets, capacities) that may be broadcast: at most ``most`` rows, more are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of settings")
    return df.sparkSession.createDataFrame(rows, df.schema)


def members(df: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """A bit set of 2^bits bits of the hashed values of ``column``: every value is in it, few others are."""
    bucket = F.shiftrightunsigned(F.xxhash64(column), 64 - bits).cast("int").alias("bucket")
    word = df.select(bucket).distinct().select(F.shiftright("bucket", 5).alias("bucket"), F.expr("shiftleft(1L, bucket & 31)").alias("n"))
    return counts(word, bits - 5)


def in_members(spark, bits_array: np.ndarray):
    """A filter column function for :func:`members`: True for every member and for few others."""
    shared = spark.sparkContext.broadcast(bits_array)
    width = int(np.log2(len(bits_array))) + 5

    @F.pandas_udf("boolean")
    def check(bucket: pd.Series) -> pd.Series:
        b = bucket.to_numpy()
        return pd.Series((shared.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1)

    return lambda column: check(F.shiftrightunsigned(F.xxhash64(column), 64 - width).cast("int"))


def rows_by_key(batches: Iterator, key: str):
    """Arrow batches sorted by ``key``, cut anew so that no key spans two of them. A run of one key is held whole: bound it."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch])
        got = got if held is None else pa.concat_tables([held, got])
        keys = got[key].to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield got.slice(0, last).combine_chunks()
        held = got.slice(last)
    if held is not None:
        yield held.combine_chunks()
