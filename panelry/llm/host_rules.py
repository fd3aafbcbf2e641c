"""Quality rules by host: base rules per document, failure rates per host shrunk by an empirical beta prior.

The beta prior is fitted to all hosts by moments: its mean is the failure rate over all documents, its strength follows
from how much the hosts' rates differ beyond what chance explains. A host is rejected with all its documents where even
the lower end of its posterior rate (the shrunk rate less SURE standard deviations) exceeds both `limit` and the prior's
mean: small hosts are drawn to the mean and stay uncertain, and so never fall for a few bad pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, free_name, mix, over_texts, plain_names, small, steps, stored, text_bytes

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
#: A host is rejected where its shrunk failure rate, less so many posterior standard deviations, is above this share of its
#: documents and above the mean of all hosts. The prior's strength is held between the last two (documents).
HOST_LIMIT, SURE, STRENGTH = 0.5, 2.0, (1.0, 1e6)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def repeat_words(words: Words, k: int = WINDOW) -> np.ndarray:
    """Per text: words inside k-word windows that occur at least twice in that text."""
    start, h = words.windows(k)
    covered = np.zeros(len(words.starts) + 1, np.int32)
    if len(start):
        key = mix(h + words.row_of_word()[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, start[twice], 1)
        np.add.at(covered, start[twice] + k, -1)
    return _sums(np.cumsum(covered[:-1]) > 0, words.first)


def dup_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    raw = data.tobytes()
    out = np.zeros(len(bounds) - 1, np.int64)
    ends = bounds.tolist()
    for i in range(len(out)):
        lines = [x for x in raw[ends[i] : ends[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five measures of each text of a column; null and empty texts measure 0."""
    data, offsets = text_bytes(column)
    found = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for i, j in steps(offsets):
        words = Words(data, offsets[i : j + 1])
        found["n_words"][i:j] = words.counts
        found["word_chars"][i:j] = _sums(words.inside & ((words.data & 0xC0) != 0x80), words.bounds)
        found["n_symbols"][i:j] = _sums(_IS_SYMBOL[words.data], words.bounds)
        found["n_dup_lines"][i:j] = dup_lines(words.data, words.bounds)
        found["n_repeat_words"][i:j] = repeat_words(words)
    return found


@plain_names
def with_measures(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds the five measures (and drops the text unless told otherwise); columns of the same names are replaced.

    Null and empty texts measure 0 throughout; every row is measured, repeated ones too; an empty table stays empty.
    """
    df = df.select(*[c for c in df.columns if c.lower() not in MEASURES])
    names = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = measure_texts(batch.column(at(text)))
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in names] + [pa.array(found[m]) for m in MEASURES], [*names, *MEASURES])

    return over_texts(df, measure, schema)


def too_short() -> Column:
    return F.col("n_words") < MIN_WORDS


def repeats_itself() -> Column:
    return F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT


def base_failed() -> Column:
    return too_short() | repeats_itself()


def host_verdicts(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, failures, too_short, repeating, rate, low, rejected): one row per host, the prior fitted to all.

    failures counts documents, the next two how many fail each rule; rate is shrunk, low its lower end. Documents
    without a host get no verdict. One host alone, or hosts that never fail, are not rejected by the prior.
    """
    named = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = stored(named.agg(F.count(F.lit(1)).alias("docs"), F.count_if(base_failed()).alias("failures"), F.count_if(too_short()).alias("too_short"), F.count_if(repeats_itself()).alias("repeating")))
    whole = hosts.agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("h"), (F.sum("failures") / F.sum("docs")).alias("m"))
    spread = hosts.crossJoin(F.broadcast(whole)).agg(
        F.first("m").alias("m"),
        F.first(F.col("m") * (1 - F.col("m"))).alias("v"),
        (F.sum(F.col("docs") * F.pow(F.col("failures") / F.col("docs") - F.col("m"), 2)) / F.sum("docs")).alias("seen"),
        F.first((F.col("h") - 1) / F.col("n")).alias("by_chance"),
    )
    between = F.greatest(F.col("seen") - F.col("v") * F.col("by_chance"), F.lit(1e-9))
    prior = spread.select("m", F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.col("v") / between - 1)).alias("strength"))
    rate = (F.col("failures") + F.col("m") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    rated = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", rate)
    low = F.col("rate") - F.lit(SURE) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("docs") + F.col("strength") + 1))
    return rated.withColumn("low", low).select("host", "docs", "failures", "too_short", "repeating", "rate", "low", (F.col("low") > F.greatest(F.lit(limit), F.col("m"))).alias("rejected"))


def _rejected(measured: DataFrame, host: str, limit: float, name: str) -> tuple[DataFrame, int]:
    """The rejected hosts in a column of that name, and how many they are."""
    bad = stored(host_verdicts(measured, host, limit).where("rejected").select(F.col("host").alias(name)))
    return bad, bad.count()


@plain_names
def judge(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """Adds base_failed and kept to measured rows: kept unless a base rule or the host's verdict speaks against it.

    Columns of these two names are replaced, others may have any name. A null host has no verdict, null and empty texts
    fail the base rules, repeated rows are judged each, an empty table stays empty.
    """
    measured = measured.select(*[c for c in measured.columns if c.lower() not in ("base_failed", "kept")])
    name = free_name(measured, "_host")
    bad, n = _rejected(measured, host, limit, name)
    joined = measured.join(small(bad, n), F.col(host) == F.col(name), "left")
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & F.col(name).isNull()).alias("kept"))


@plain_names
def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, all columns unchanged, whatever their names. Texts are measured twice and never shuffled.

    Null, empty and very short texts go, as do all documents of a rejected host; documents without a host are judged by
    the base rules alone. Repeated rows share their fate.
    """
    measured = stored(with_measures(docs.select(host, "text")))
    named = {c: free_name(docs, f"_{i}") for i, c in enumerate(docs.columns) if c.lower() in MEASURES}
    fit = docs.withColumnsRenamed(named)
    name = free_name(fit, "_host")
    bad, n = _rejected(measured, host, limit, name)
    discard(measured)
    rows = with_measures(fit, keep_text=True).where(~base_failed())
    good = rows.join(small(bad, n), F.col(host) == F.col(name), "left_anti")
    return good.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])
