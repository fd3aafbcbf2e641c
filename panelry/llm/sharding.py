"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards alone decide the shard, without a ring table; with one more shard a row either
stays or moves to the new one, which receives its fair share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, gapless, hash_bits, plain_names

#: Hex digits of md5(key) that seed the jumps: 60 bits.
KEY_DIGITS = 15


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys jumping at once until each has landed."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    at = np.zeros(len(state), np.int64)
    while len(live):
        place[live] = at
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        at = np.floor((at + 1).astype(np.float64) * (2147483648.0 / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = at < shards
        live, state, at = live[on], state[on], at[on]
    return place


@plain_names
def with_shards(df: DataFrame, key: str, shards: dict[str, int]) -> DataFrame:
    """Adds one int column per entry of `shards` (name to number of shards); columns of those names are replaced.

    Equal keys share a shard. A null key counts as a key of its own. Empty tables and extra columns pass through.
    """
    df = df.select(*[c for c in df.columns if c.lower() not in {s.lower() for s in shards}])
    bits = free_name(df, "_bits")
    keyed = df.withColumn(bits, hash_bits(F.col(key), KEY_DIGITS))
    names = [c for c in keyed.columns if c != bits]
    schema = keyed.drop(bits).schema
    for name in shards:
        schema = schema.add(name, T.IntegerType())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(bits)).to_numpy(zero_copy_only=False)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols += [pa.array(jump(keys, n).astype(np.int32)) for n in shards.values()]
            yield pa.RecordBatch.from_arrays(cols, [*names, *shards])

    return keyed.mapInArrow(assign, schema)


def shard_table(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (a null text has none); slot numbers the rows of a shard from 0 by key,
    size and checksum; grown_shard is the place with one shard more. Repeated rows each get a slot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    placed = with_shards(narrow, "doc_id", {"shard": shards, "grown_shard": shards + 1})
    return gapless(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """The whole rows as Parquet, one folder per shard."""
    name = free_name(docs, "shard")
    with_shards(docs, key, {name: shards}).write.partitionBy(name).parquet(path)
