"""Best-fit packing of documents into sequences, with matching of the large ones.

Lengths are whole numbers up to the capacity, so how many pieces have each length is all that the plan needs: a table of
at most `capacity` rows, whatever the number of documents. Pieces longer than a third of the capacity, of which a bin
holds at most two, are matched greedily: the longest left with the longest that still fits beside it. Shorter ones, in
falling order, go where the least room is left over. The plan says which ranks of each length go into which run of bins;
pieces are numbered by length and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, gapless, over_texts, steps, stored, text_bytes
from .tokens import declared_encoder, default_vocabulary

CAPACITY, END = 1024, 2


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank_from, rank_to, bin_from, per_bin, offset) and the number of bins, from length -> pieces.

    Piece `r` of that length, rank_from <= r < rank_to, goes to bin bin_from + (r - rank_from) // per_bin at
    offset + (r - rank_from) % per_bin * length. Every step uses up a length or a run of bins, so the plan stays small.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    left = {s: n for s, n in counts.items() if n > 0}
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, n_bins: int, first: int, per_bin: int, offset: int) -> None:
        n = n_bins * per_bin
        rows.append((length, taken[length], taken[length] + n, first, per_bin, offset))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(gap: int, first: int, end: int) -> None:
        if gap > 0 and end > first:
            room.setdefault(gap, []).append((first, end))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while s in left:
            mate = next((m for m in large if m in left and m <= capacity - s and (m != s or left[s] > 1)), None)
            if mate is None:
                n = left[s]
                put(s, n, bins, 1, 0)
                leave(capacity - s, bins, bins + n)
            elif mate == s:
                n = left[s] // 2
                put(s, n, bins, 2, 0)
                leave(capacity - 2 * s, bins, bins + n)
            else:
                n = min(left[s], left[mate])
                put(s, n, bins, 1, 0)
                put(mate, n, bins, 1, s)
                leave(capacity - s - mate, bins, bins + n)
            bins += n
    gaps = sorted(room)
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while s in left:
            at = int(np.searchsorted(gaps, s))
            if at == len(gaps):
                per_bin = min(capacity // s, left[s])
                n = max(1, left[s] // per_bin)
                first, end, gap = bins, bins + n, capacity
                bins += n
            else:
                gap = gaps[at]
                first, end = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
                per_bin = min(gap // s, left[s])
                n = min(end - first, max(1, left[s] // per_bin))
                if first + n < end:
                    if gap not in room:
                        gaps.insert(int(np.searchsorted(gaps, gap)), gap)
                    leave(gap, first + n, end)
                    end = first + n
            put(s, n, first, per_bin, capacity - gap)
            rest = gap - per_bin * s
            if rest > 0:
                if rest not in room:
                    gaps.insert(int(np.searchsorted(gaps, rest)), rest)
                leave(rest, first, end)
    return rows, bins


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids themselves on demand).

    A document is its ids and an end id; a null or empty text is the end id alone. Only longer ones are cut, and their
    first piece takes what is left over, so that all others are full.
    """
    path = vocabulary or default_vocabulary()
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = declared_encoder(path).encode
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets):
                raw, base = data[offsets[i] : offsets[j]].tobytes(), int(offsets[i])
                ends = (offsets[i : j + 1] - base).tolist()
                rows, out = [], []
                for d, ids in enumerate(encode([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    at = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        rows.append(i + d)
                        out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int64) if keep_ids else None))
                cols = [batch.column(0).take(pa.array(rows, pa.int64()))]
                cols += [pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    cols.append(pa.array([x[4] for x in out], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return over_texts(docs.select("doc_id", "text"), cut, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. Only the counts by length, at most `capacity` rows, reach the driver."""
    rank = free_name(cut, "_rank")
    numbered = stored(gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], rank))
    counts = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}
    if not counts:
        return numbered.drop(rank).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows, _ = plan(counts, capacity)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for length, *rest in sorted(rows):
        by_length.setdefault(length, []).append(tuple(rest))
    names = [c for c in numbered.columns if c != rank]
    schema = T.StructType([numbered.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {s: np.array(x, np.int64) for s, x in by_length.items()}
        for batch in batches:
            at = batch.schema.get_field_index
            length = batch.column(at("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(at(rank)).to_numpy(zero_copy_only=False)
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                own = np.flatnonzero(length == s)
                lines = table[s]
                line = lines[np.searchsorted(lines[:, 0], ranks[own], "right") - 1]
                k = ranks[own] - line[:, 0]
                bins[own] = line[:, 2] + k // line[:, 3]
                offset[own] = line[:, 4] + k % line[:, 3] * s
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in names] + [pa.array(bins), pa.array(offset)], schema.names)

    return over_texts(numbered, look_up, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: the pieces with sequence_id and offset.

    A null or empty text is one piece, the end id alone. Rows with a null doc_id are packed too. Repeated rows are packed
    each for itself; an empty table gives no rows; other columns are ignored.
    """
    return place(pieces(docs, capacity, vocabulary, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the filled sequences of pieces that carry their ids; each group holds one capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
