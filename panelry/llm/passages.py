"""Substring dedup with repeated-phrase automata.

A passage is a window of WINDOW consecutive words that also starts in a document with a smaller doc_id.

1. Every window names one of its PHRASE-word phrases, the one with the smallest hash (winnowing): windows with equal words
   name equal phrases, so two documents can only share a window if they share a phrase they name.
2. Phrases named by two documents or more are looked at again: the windows that name them are counted by content. Those
   that recur are confirmed, with the smallest doc_id they start in.
3. Confirmed phrases are compiled into Aho-Corasick automata, one for each group of documents that share phrases. Each
   group streams its documents through its automaton; around every occurrence the windows are compared with the confirmed
   ones, and words under windows of earlier documents are marked.

Documents with equal words are decided without that: all but the first consist of repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, lists, mix, over_texts, small, steps, stored, text_bytes

WINDOW, PHRASE = 50, 8
#: Text bytes that one group of documents should hold, window records of one reduce task, ids worth a broadcast.
GROUP_BYTES, TASK_RECORDS, BROADCAST_IDS = 6 << 20, 1_500_000, 500_000

_RECORD = np.dtype([("phrase", "<u8"), ("window", "<u8"), ("doc", "<i8")])


def named_phrases(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, phrase): for every window the phrase it names; and the hashes of all phrases by start word."""
    n = len(words.h)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = np.zeros(n - PHRASE + 1, np.uint64)
    for j in range(PHRASE):
        g = g * np.uint64(0x9E3779B97F4A7C15) + words.h[j : n - PHRASE + 1 + j]
    g = mix(g)
    width, low, span = WINDOW - PHRASE + 1, g, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    start = np.arange(n - WINDOW + 1)
    start = start[start + WINDOW <= np.repeat(words.first[1:], words.counts)[: n - WINDOW + 1]]
    return start, low[start], g


def _fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over (place in the text, word): equal word sequences have equal ones."""
    place = (np.arange(len(words.h)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(words.h ^ np.uint64(salt)) + place * np.uint64(0x9E3779B97F4A7C15)))])
        out.append(np.diff(total[words.first]).view(np.int64))
    return out[0], out[1]


def text_fingerprints(column: pa.Array) -> np.ndarray:
    """The first fingerprint of each text's words."""
    data, offsets = text_bytes(column)
    f1 = np.zeros(len(column), np.int64)
    for i, j in steps(offsets):
        f1[i:j] = _fingerprints(Words(data, offsets[i : j + 1]))[0]
    return f1


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def profiles(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, f1, f2 (fingerprints of its words), sha (of all of them), the phrases it names."""
    names = ["doc_id", "n_words", "f1", "f2", "sha", "phrases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets):
                w = Words(data, offsets[i : j + 1])
                f1, f2 = _fingerprints(w)
                start, phrase, _ = named_phrases(w)
                row = w.row_of_word()[start] if len(start) else start
                new = np.ones(len(start), bool)
                new[1:] = (phrase[1:] != phrase[:-1]) | (row[1:] != row[:-1])
                first = np.searchsorted(row[new], np.arange(j - i + 1))
                raw, ends = w.data.tobytes(), w.bounds.tolist()
                sha = [_sha(raw[a:b].split()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cols = [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, lists(phrase[new].view(np.int64), first, pa.int64())], names)

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, n_words long, f1 long, f2 long, sha string, phrases array<long>")


def _windows_of(words: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that name one of the wanted phrases: (start, phrase, window hash); and all phrase hashes."""
    start, phrase, every = named_phrases(words)
    _, window = words.long_windows(WINDOW)
    at = np.searchsorted(wanted, phrase)
    at[at == len(wanted)] = 0
    hit = wanted[at] == phrase if len(wanted) else np.zeros(len(phrase), bool)
    return start[hit], phrase[hit], window[hit], every


def _extremes(r: np.ndarray) -> np.ndarray:
    """Of each phrase and window the records with the smallest and the largest doc."""
    r = r[np.lexsort((r["doc"], r["window"], r["phrase"]))]
    if not len(r):
        return r
    new = np.concatenate([[True], (r["window"][1:] != r["window"][:-1]) | (r["phrase"][1:] != r["phrase"][:-1])])
    keep = new.copy()
    keep[:-1] |= new[1:]
    keep[-1] = True
    return r[keep]


def confirmed(marked: DataFrame, parts: int) -> DataFrame:
    """(phrase, words, windows): phrases of confirmed windows with their text and, packed, window hashes and first docs.

    marked: (doc_id, text, phrases array<struct<phrase, own>>), own where doc_id is the first that names the phrase.
    Each step combines its records, so that a window common to many documents sends two records a step at most.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            listed = batch.column(2)
            values, at = listed.flatten(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
            phrases = values.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = values.field(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in steps(offsets):
                w = Words(data, offsets[i : j + 1])
                mine = phrases[at[i] : at[j]]
                start, phrase, window, every = _windows_of(w, np.unique(mine))
                r = np.zeros(len(start), _RECORD)
                r["phrase"], r["window"], r["doc"] = phrase, window, ids[i:j][w.row_of_word()[start]] if len(start) else 0
                r = _extremes(r)
                rows = []
                part = (mix(r["phrase"].copy()) % np.uint64(parts)).astype(np.int64)
                for p, cut in _cuts(part):
                    rows.append((p, b"".join(r[f][cut].tobytes() for f in r.dtype.names), b""))
                first = mine[own[at[i] : at[j]]]
                if len(first) and len(every):
                    first = np.unique(first)
                    # Only where all words of the phrase lie in one text.
                    inside = np.flatnonzero(np.arange(len(every)) + PHRASE <= np.repeat(w.first[1:], w.counts)[: len(every)])
                    order = inside[np.argsort(every[inside], kind="stable")]
                    place = order[np.minimum(np.searchsorted(every[order], first), len(order) - 1)]
                    raw = w.data.tobytes()
                    said = [b" ".join(raw[a:b].split()) for a, b in zip(w.starts[place].tolist(), w.ends[place + PHRASE - 1].tolist(), strict=True)]
                    part = (mix(first.copy()) % np.uint64(parts)).astype(np.int64)
                    for p, cut in _cuts(part):
                        rows.append((p, first[cut].tobytes(), b"\n".join(said[c] for c in cut.tolist())))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], ["part", "raw", "said"])

    def reduce(group: pa.Table) -> pa.Table:
        text: dict[int, bytes] = {}
        records = [np.zeros(0, _RECORD)]
        for raw, said in zip(group.column("raw").to_pylist(), group.column("said").to_pylist(), strict=True):
            if said:
                text.update(zip(np.frombuffer(raw, "<u8").tolist(), said.split(b"\n"), strict=True))
                continue
            n = len(raw) // _RECORD.itemsize
            r = np.zeros(n, _RECORD)
            for k, f in enumerate(_RECORD.names):
                r[f] = np.frombuffer(raw, _RECORD[f], n, 8 * n * k)
            records.append(r)
        r = _extremes(np.concatenate(records))
        twice = np.zeros(len(r), bool)
        if len(r):
            twice[:-1] = (r["phrase"][1:] == r["phrase"][:-1]) & (r["window"][1:] == r["window"][:-1]) & (r["doc"][1:] > r["doc"][:-1])
        r = r[twice]
        new = np.flatnonzero(np.concatenate([[True], r["phrase"][1:] != r["phrase"][:-1]])) if len(r) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(r))[: len(new)]
        phrases = r["phrase"][new]
        packed = [r["window"][a:b].tobytes() + r["doc"][a:b].tobytes() for a, b in zip(new, ends, strict=True)]
        return pa.table({"phrase": pa.array(phrases.view(np.int64)), "words": pa.array([text[p] for p in phrases.tolist()], pa.binary()), "windows": pa.array(packed, pa.binary())})

    dealt = over_texts(marked.select("doc_id", "text", "phrases"), deal, "part int, raw binary, said binary")
    return dealt.groupBy("part").applyInArrow(reduce, "phrase long, words binary, windows binary")


def _cuts(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(at, np.append(at[1:], len(part)), strict=True):
        yield int(sorted_[a]), order[a:b]


def automaton(phrases: list[bytes]):
    """Finds phrases between spaces in texts of single-spaced words; bytes are read as Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p.decode('latin-1')} ", len(p))
    if phrases:
        found.make_automaton()
    return found


def removed_words(bodies: list[bytes], ids: np.ndarray, phrases: list[bytes], windows: np.ndarray, firsts: np.ndarray) -> Iterator[np.ndarray]:
    """For each text which of its words lie under a confirmed window of an earlier document.

    windows (sorted) and firsts: hashes of confirmed windows and the smallest doc each starts in.
    """
    machine = automaton(phrases)
    for body, doc in zip(bodies, ids.tolist(), strict=True):
        w = Words(np.frombuffer(body, np.uint8), np.array([0, len(body)], np.int64))
        n = len(w.starts)
        gone = np.zeros(n, bool)
        if n >= WINDOW and phrases:
            even = b" " + b" ".join(body.split()) + b" "
            ends = np.array([(e, size) for e, size in machine.iter(even.decode("latin-1"))], np.int64).reshape(-1, 2)
            spaces = np.flatnonzero(np.frombuffer(even, np.uint8) == 32)
            at = np.searchsorted(spaces, ends[:, 0] - ends[:, 1] - 1)
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum(at - (WINDOW - PHRASE), 0), 1)
            np.add.at(near, np.minimum(at + 1, n), -1)
            start, h = w.long_windows(WINDOW)
            look = np.flatnonzero(np.cumsum(near)[start] > 0)
            place = np.searchsorted(windows, h[look])
            place[place == len(windows)] = 0
            earlier = look[(windows[place] == h[look]) & (firsts[place] < doc)] if len(windows) else look[:0]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start[earlier], 1)
            np.add.at(cover, np.minimum(start[earlier] + WINDOW, n), -1)
            gone = np.cumsum(cover)[:n] > 0
        yield gone


def _runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_CUT = "doc_id long, f1 long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def located(marked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, f1, n_removed, kept_sha256, spans): what each text loses, as ranges of words.

    Documents whose first phrases come from one place form a group; a group with much text is split, and each split gets
    the phrases of its own documents.
    """
    keyed = marked.withColumn("home", F.array_min(F.transform("phrases", lambda p: p["first"])))
    sizes = keyed.groupBy("home").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # Small homes share groups; a home beyond the size of a group is split by document.
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    groups = max(1, int(total / GROUP_BYTES))
    large = stored(sizes.where(F.col("bytes") > GROUP_BYTES).select(F.col("home").alias("h"), F.ceil(F.col("bytes") / GROUP_BYTES).alias("splits")))
    keyed = keyed.join(small(large, large.count()), F.col("home") == F.col("h"), "left")
    split = F.when(F.col("splits").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("splits")))
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("home", split), F.lit(groups)))
    needed = keyed.select((F.col("grp") + 0).alias("to"), F.explode(F.transform("phrases", lambda p: p["phrase"])).alias("phrase")).distinct()
    given = needed.join(patterns, "phrase").select("to", "words", "windows")

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        raw = found.column("windows").to_pylist()
        n = [len(r) // 16 for r in raw]
        windows = np.frombuffer(b"".join(r[: 8 * k] for r, k in zip(raw, n, strict=True)), "<u8")
        firsts = np.frombuffer(b"".join(r[8 * k :] for r, k in zip(raw, n, strict=True)), "<i8")
        order = np.argsort(windows)
        windows, firsts = windows[order], firsts[order]
        bodies = [b"" if t is None else t.encode() for t in docs.column("text").to_pylist()]
        ids = docs.column("doc_id").to_numpy()
        out: list[tuple] = []
        for body, gone in zip(bodies, removed_words(bodies, ids, found.column("words").to_pylist(), windows, firsts), strict=True):
            words = body.split()
            start, end = _runs(gone)
            out.append((int(gone.sum()), _sha([x for x, g in zip(words, gone.tolist(), strict=True) if not g]), [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]))
        give_back()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = {"doc_id": docs.column("doc_id"), "f1": docs.column("f1"), "n_removed": pa.array([x[0] for x in out], pa.int64()), "kept_sha256": pa.array([x[1] for x in out], pa.string()), "spans": pa.array([x[2] for x in out], spans)}
        return pa.table(cols)

    return keyed.select("grp", "doc_id", "f1", "text").groupBy("grp").cogroup(given.groupBy("to")).applyInArrow(run, _CUT)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, f1) of every row: the words under passages of earlier documents.

    Words are as they stand. Null and short texts lose nothing; nor do rows without doc_id, which are no source either.
    Rows that share a doc_id are judged each by its own text.
    """
    seen = stored(profiles(docs))
    long_ = seen.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    reps = stored(long_.groupBy("f1", "f2", "n_words").agg(F.min("doc_id").alias("rep")))
    own = long_.join(reps, ["f1", "f2", "n_words"]).where(F.col("doc_id") == F.col("rep"))
    named = stored(own.select("doc_id", "f1", F.explode("phrases").alias("phrase")).distinct())
    shared = named.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("phrase", "first")
    listed = named.join(shared, "phrase").groupBy("doc_id", "f1").agg(F.collect_list(F.struct("phrase", (F.col("first") == F.col("doc_id")).alias("own"), "first")).alias("phrases"))
    listed = stored(listed)
    ids = listed.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(small(ids, listed.count(), BROADCAST_IDS), "doc_id", "left_semi")
    marked = stored(_same_text(texts.join(listed, "doc_id")))
    records = marked.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    patterns = stored(confirmed(marked, max(1, int(records / 6 / TASK_RECORDS))))
    cut = stored(located(marked, patterns))
    rows = seen.join(reps, ["f1", "f2", "n_words"], "left").join(cut.dropDuplicates(["doc_id", "f1"]), ["doc_id", "f1"], "left")
    copy = F.col("rep").isNotNull() & (F.col("rep") < F.col("doc_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        "f1",
    )


def _same_text(joined: DataFrame) -> DataFrame:
    """Rows whose text has the fingerprint that the phrases were taken from (rows may share a doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            f1 = text_fingerprints(batch.column(at("text")))
            yield batch.filter(pa.array(f1 == batch.column(at("f1")).to_numpy(zero_copy_only=False)))

    return over_texts(joined, run, joined.schema)


def strip_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row: each text without its repeated words; the words kept are joined by one space.

    A null text becomes empty. Rows that share a doc_id lose each what is repeated in its own text.
    """
    found = repeated_passages(docs).where(F.size("spans") > 0).select("doc_id", "f1", "spans").dropDuplicates(["doc_id", "f1"])
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("f1", "spans")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            f1 = text_fingerprints(batch.column(1)).tolist()
            for text, mine, cuts in zip(batch.column(1).to_pylist(), f1, batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                for c in reversed(next((x["spans"] for x in cuts or [] if x["f1"] == mine), [])):
                    del words[c["start"] : c["end"]]
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return over_texts(docs.select("doc_id", "text").join(spans, "doc_id", "left"), run, "doc_id long, text string")
