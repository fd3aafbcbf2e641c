"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. Every block
of documents gets an index (trigram to the block's documents) over the folded text; a rule's query intersects and unites
postings, and the rule's pattern runs over the candidates alone. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lower_ascii, over_texts, plain_names, steps, text_bytes

#: Most strings that one stretch of a pattern is expanded to.
EXPAND = 64


@dataclass(frozen=True)
class Rule:
    """pattern: as in re, ASCII classes; group and least: this group needs that many characters, else the match drops."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


#: The three base rules and what the scan adds to them. No rule looks at a stretch of text more often than a
#: bounded number of times: a token starts where no token character stands before it, and is not given back in parts.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)


@dataclass(frozen=True)
class Need:
    """A node of a trigram query: a leaf, or all/any of its parts. No parts at all: nothing is needed."""

    how: str = "all"
    parts: tuple = ()
    leaf: str = ""

    @property
    def free(self) -> bool:
        return not self.leaf and not self.parts

    def trigrams(self) -> set[str]:
        return {self.leaf} if self.leaf else set().union(*(p.trigrams() for p in self.parts))


def _all(parts: list[Need]) -> Need:
    real = list(dict.fromkeys(p for p in parts if not p.free))
    return real[0] if len(real) == 1 else Need("all", tuple(real))


def _any(parts: list[Need]) -> Need:
    parts = list(dict.fromkeys(parts))
    if not parts or any(p.free for p in parts):
        return Need()
    return parts[0] if len(parts) == 1 else Need("any", tuple(parts))


def _strings(found: set[str]) -> Need:
    """What holds if one of these strings occurs; bytes of UTF-8, three at a time."""
    out = []
    for s in sorted(found):
        raw = s.encode().decode("latin-1")
        out.append(_all([Need(leaf=raw[i : i + 3]) for i in range(len(raw) - 2)]))
    return _any(out)


@dataclass
class _Stretch:
    """What a part of a pattern can match: a small set of folded strings, or None and what it needs."""

    exact: set[str] | None
    need: Need = field(default_factory=Need)


def _walk(tree) -> _Stretch:
    run: set[str] | None = {""}
    whole, needs = True, []
    for op, arg in tree:
        part = _node(str(op), arg)
        if part.exact is not None and len(run) * len(part.exact) <= EXPAND:
            run = {a + b for a in run for b in part.exact}
            continue
        whole = False
        needs += [_strings(run), part.need]
        run = {""}
        if part.exact is not None:
            run = part.exact
    return _Stretch(run) if whole else _Stretch(None, _all([*needs, _strings(run)]))


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _node(op: str, arg) -> _Stretch:
    if op == "LITERAL":
        return _Stretch({_fold(arg)})
    if op == "IN":
        if all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 8:
            return _Stretch({_fold(v) for _, v in arg})
        return _Stretch(None)
    if op == "SUBPATTERN":
        return _walk(arg[-1])
    if op == "ATOMIC_GROUP":
        return _walk(arg)
    if op == "BRANCH":
        parts = [_walk(x) for x in arg[1]]
        if all(p.exact is not None for p in parts) and len(joined := set().union(*(p.exact for p in parts))) <= EXPAND:
            return _Stretch(joined)
        return _Stretch(None, _any([p.need if p.exact is None else _strings(p.exact) for p in parts]))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        part = _walk(inner)
        if low == 0:
            return _Stretch(part.exact | {""}) if high == 1 and part.exact is not None else _Stretch(None)
        if low == high == 1:
            return part
        return _Stretch(None, part.need if part.exact is None else _strings(part.exact))
    if op == "AT":
        return _Stretch({""})
    return _Stretch(None)


@lru_cache(maxsize=256)
def trigram_query(pattern: str) -> Need:
    """The trigrams, folded to lower case, that every match of the pattern contains; free if there are none."""
    found = _walk(re._parser.parse(pattern, re.A))
    return found.need if found.exact is None else _strings(found.exact)


class BlockIndex:
    """Trigram postings of one block of texts, for the trigrams that the queries ask for."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, trigrams: tuple[str, ...]):
        self.n = len(bounds) - 1
        self.ids = {t: i for i, t in enumerate(trigrams)}
        self.has = np.zeros((len(trigrams), self.n), bool)
        a = lower_ascii(data)
        if len(a) < 3 or not trigrams:
            return
        code = (a[:-2].astype(np.uint32) << 16) | (a[1:-1].astype(np.uint32) << 8) | a[2:]
        codes, front, back = _lookup(trigrams)
        at = np.flatnonzero(front[code >> 8] & back[code & 0xFFFF])
        place = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
        row = np.searchsorted(bounds, at, "right") - 1
        inside = (codes[place] == code[at]) & (at + 3 <= bounds[row + 1])
        self.has[place[inside], row[inside]] = True

    def rows(self, need: Need) -> np.ndarray:
        """Which texts satisfy the query."""
        if need.leaf:
            return self.has[self.ids[need.leaf]]
        if need.free:
            return np.ones(self.n, bool)
        sides = [self.rows(p) for p in need.parts]
        return np.logical_and.reduce(sides) if need.how == "all" else np.logical_or.reduce(sides)


@lru_cache(maxsize=4)
def _lookup(trigrams: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the sorted trigrams, and which pairs of bytes they start and end with."""
    codes = np.array([int.from_bytes(t.encode("latin-1"), "big") for t in trigrams], np.uint32)
    front, back = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    front[codes >> 8] = True
    back[codes & 0xFFFF] = True
    return codes, front, back


def find_spans(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, place of the rule, end) in code points, sorted; leftmost matches that do not overlap per rule."""
    needs = [trigram_query(r.pattern) for r in rules]
    trigrams = tuple(sorted(set().union(*(n.trigrams() for n in needs if not n.free))))
    patterns = [re.compile(r.pattern, re.A) for r in rules]
    data, offsets = text_bytes(column)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for i, j in steps(offsets):
        bounds = offsets[i : j + 1] - offsets[i]
        block = data[offsets[i] : offsets[j]]
        index = BlockIndex(block, bounds, trigrams)
        raw, ends = block.tobytes(), bounds.tolist()
        wanted = np.array([index.rows(n) for n in needs])
        for d in np.flatnonzero(wanted.any(axis=0)).tolist():
            text = raw[ends[d] : ends[d + 1]].decode()
            for k in np.flatnonzero(wanted[:, d]).tolist():
                rule = rules[k]
                found[i + d] += [(m.start(), k, m.end()) for m in patterns[k].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            found[i + d].sort()
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: key, spans array<struct<kind, start, end>>, in code points.

    Null and empty texts have none; repeated rows are scanned each; an empty table stays empty; other columns are ignored.
    """
    kinds = [r.kind for r in rules]
    schema = T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans] for spans in find_spans(batch.column(1), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], [key, "spans"])

    return over_texts(docs.select(key, text), run, schema)


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts of the base kinds, the hash of the base spans and all spans, in one pass.

    Null and empty texts count as without spans; repeated rows are scanned each; an empty table stays empty.
    """
    base = [k for k, r in enumerate(rules) if r.base]
    counts = [f"n_{rules[k].kind}" for k in base]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(batch.column(1), rules)
            said = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in spans] for spans in found]
            own = [",".join(s for s, (_, k, _) in zip(x, spans, strict=True) if rules[k].base) for x, spans in zip(said, found, strict=True)]
            cols = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in base]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own], pa.string()), pa.array([",".join(x) for x in said], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema.names)

    return over_texts(docs.select("doc_id", "text"), run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


@plain_names
def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every found span replaced by the mask, and their length brought up to date.

    Documents without spans, null texts and all other columns, whatever their names, stay as they are. Repeated rows are
    masked each; an empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = find_spans(batch.column(at), rules)
            hit = [i for i, spans in enumerate(found) if spans]
            if hit:
                new = batch.column(at).to_pylist()
                sizes = batch.column(batch.schema.get_field_index(length)).to_pylist() if length in names else None
                for i in hit:
                    new[i] = masked(new[i], found[i], mask)
                    if sizes:
                        sizes[i] = len(new[i])
                cols = list(batch.columns)
                cols[at] = pa.array(new, batch.schema.field(at).type)
                if sizes:
                    k = batch.schema.get_field_index(length)
                    cols[k] = pa.array(sizes, batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return over_texts(docs, run, docs.schema)
