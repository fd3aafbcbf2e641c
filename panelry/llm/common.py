"""Shared pieces of the training-data operators: word arrays, stored tables, gapless numbering."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of numpy work holds at once.
STEP_BYTES = 2 << 20
#: Session settings of every pass over texts: bytes of an Arrow batch, rows that the Parquet reader decodes at once. The
#: defaults (64 MB, 4096 rows) suit narrow rows; with whole texts they cost hundreds of MB a task.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}

#: Spark's setting by which a job's shuffle files go when the job ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Ids that a Python worker may hold to leave rows out by: 8 bytes each.
HELD_IDS = 8_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, the one place that driver and executors share.

    Where the setting is absent a temporary folder stands in, on one machine only: elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="panelry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelry-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once and read back: lineage is cut, and a lost executor costs a re-read only.

    What the job shuffled is deleted as soon as it is written; else it stays until the driver collects garbage, which on
    large tables may be after the query.
    """
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN_SHUFFLES) if before is None else conf.set(CLEAN_SHUFFLES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once all that was made of it has been stored itself."""
    for df in tables:
        if getattr(df, "stored_at", None) is None:
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory: workers are reused, and so is what they hold on to."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def over_texts(df: DataFrame, run: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of a few MB whose memory is given back as soon as they are done."""
    for key, value in LEAN.items():
        df.sparkSession.conf.set(key, value)

    def lean(batches: Batches) -> Batches:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return df.mapInArrow(lean, schema)


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """A broadcast hint for a side whose counted rows stay below the limit; else the shuffle join stands."""
    return F.broadcast(df) if rows <= limit else df


def without(df: DataFrame, column: str, ids: DataFrame, n: int, limit: int) -> DataFrame:
    """The rows whose whole number in a column is not among the n ids; a null stays.

    Up to HELD_IDS the rows stay where they are: up to the limit the ids are broadcast to a join, beyond it as a sorted array.
    """
    if not limit < n <= HELD_IDS:
        key = free_name(df, "_without")
        return df.join(small(ids.toDF(key), n, limit), F.col(column) == F.col(key), "left_anti")
    held = df.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).cast(pa.int64()).to_numpy()))

    @F.arrow_udf("boolean")
    def among(asked: pa.Array) -> pa.Array:
        numbers = pc.fill_null(asked, 0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(held.value, numbers), len(held.value) - 1)
        return pc.and_(pa.array(held.value[at] == numbers), asked.is_valid())

    return df.where(~among(F.col(column).cast("long")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that keep all columns: names that would have to be quoted, as `a.b`, are others while it works."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        odd = {c: free_name(docs, f"_odd{i}") for i, c in enumerate(docs.columns) if not re.fullmatch(r"\w+", c)}
        out = operator(docs.withColumnsRenamed(odd), *args, **options)
        return out.withColumnsRenamed({v: c for c, v in odd.items()})

    return run


def string_type(batch_column: pa.ChunkedArray | pa.Array) -> pa.Array:
    col = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    return pc.fill_null(col, "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    col = string_type(column).cast(pa.large_string())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MUL2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several texts: byte ranges, 64-bit hashes, and the word range of each text.

    first[d]..first[d + 1] are the words of text d; starts and ends are bytes from the first text's start.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        base = int(offsets[0])
        a = data[base : int(offsets[-1])]
        if lower:
            a = lower_ascii(a)
        self.bounds = offsets - base
        self.data = a
        inside = ~((a == 32) | ((a - np.uint8(9)) <= 4))
        before = np.zeros(len(a), bool)
        before[1:] = inside[:-1]
        cut = self.bounds[:-1][self.bounds[:-1] < len(a)]
        before[cut] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(a), bool)
        after[:-1] = inside[1:]
        last = self.bounds[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.inside = inside
        self.h = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        length = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        u = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = length.astype(np.uint64) * _MUL
        live, at, left = np.arange(len(length)), self.starts, length
        while len(live):
            v = u[at] & _MASK[np.minimum(left, 8)]
            x = (h[live] ^ v) * _MUL
            h[live] = (x ^ (x >> np.uint64(29))) * _MUL2
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return mix(h)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all k-word windows inside one text, and their hashes."""
        n = len(self.h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            g = g * _MUL + self.h[j : n - k + 1 + j]
        start = np.arange(n - k + 1)
        ok = start + k <= np.repeat(self.first[1:], self.counts)[: n - k + 1]
        start = start[ok]
        return start, mix(g[start])

    def long_windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows(), by prefix sums: the cost does not depend on k."""
        n = len(self.h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _MUL, np.uint64)]))
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.h * power)])
        start = np.arange(n - k + 1)
        start = start[start + k <= np.repeat(self.first[1:], self.counts)[: n - k + 1]]
        return start, mix((total[start + k] - total[start]) * back[start])


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column out of flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of values[first[i]:first[i + 1]]."""
    raw = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
    size = values.dtype.itemsize
    return pa.array([bytes(raw[a * size : b * size]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())


def summed_chunks(chunks: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Adds up arrays that tasks have cut into (chunk, counts as int64 bytes); the driver gets each sum once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[c] = total.get(c, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])
        give_back()

    for row in chunks.select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        yield row["chunk"], np.frombuffer(row["counts"], np.int64)


def gapless(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers 0, 1, 2, ... inside each group by the order, without ever holding a group in one task.

    Rows are range-partitioned by group and order, sorted and numbered inside their partition and written once;
    counts per partition and group then give each partition its offset. The numbers depend on the rows alone, not on
    the partitions. Rows with equal group and order get adjacent numbers in an order of Spark's choice.
    """
    mark, part = free_name(df, "_mark"), free_name(df, "_part")
    base, ahead, n = (free_name(df, x) for x in ("_base", "_ahead", "_n"))
    df = stored(df)  # range partitioning looks at its input twice
    kept = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn(mark, F.monotonically_increasing_id()))
    kept = kept.withColumn(part, F.shiftright(mark, 33))
    runs = kept.groupBy(*group, part).agg(F.min(mark).alias(base), F.count(F.lit(1)).alias(n))
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    runs = stored(runs.withColumn(ahead, F.coalesce(F.sum(n).over(before), F.lit(0))))
    keys = {c: free_name(df, f"_key_{c}") for c in group}
    side = runs.select(*[F.col(c).alias(k) for c, k in keys.items()], F.col(part).alias(f"{part}r"), base, ahead)
    same = F.col(part) == F.col(f"{part}r")
    for c, k in keys.items():
        same &= F.col(c).eqNullSafe(F.col(k))
    joined = kept.join(small(side, runs.count()), same, "inner")
    return joined.select(*df.columns, (F.col(mark) - F.col(base) + F.col(ahead)).alias(name))


def hash_bits(key: Column, digits: int) -> Column:
    """The first hex digits of md5 as a long: the same number in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, digits), 16, 10).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest id of its connected component.

    Each round hooks every node to its smallest neighbour and contracts the edges. The first rounds order nodes by id,
    which settles stars at once; later ones order them by a fresh hash, so that long chains, too, shrink by a constant
    factor a round. Only narrow tables are shuffled, and each round is written and read again.
    """
    live = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    maps: list[DataFrame] = []
    spent = []
    for k in range(rounds):
        if live.isEmpty():
            break
        key = (lambda c: F.col(c)) if k < 4 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select(F.col("b"), F.col("a")))
        least = both.groupBy("v").agg(F.min(F.struct(key("u").alias("k"), F.col("u"))).alias("m"))
        own = F.struct(key("v").alias("k"), F.col("v").alias("u"))
        hook = stored(least.select("v", F.least(own, F.col("m"))["u"].alias("p")))
        maps.append(hook)
        left = live.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        spent.append(live)
        live = stored(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = maps[0].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for step in maps[1:]:
        nxt = step.select(F.col("v").alias("root"), F.col("p").alias("up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = stored(out)
    discard(live, *maps, *spent)
    if len(maps) <= 4:
        return out
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    final = stored(out.join(least, "root").select("node", F.col("least").alias("root")))
    discard(out)
    return final
