"""Periodic runs of words: stretches that repeat with some period at least three times over.

The words of a stretch are appended one by one to a suffix automaton. Its suffix links form a tree in which the path from
the root to a prefix's state holds all suffixes of that prefix; each node is coloured with the end at which its suffixes
occurred last. Appending word i accesses the path of prefix i in a link-cut tree, whose preferred paths are exactly the
segments of one colour, and recolours it with i. A segment with colour e and longest suffix L says that the L words that
end at i also ended at e and no more than these, so that the words i-L-d+1..i have period d = i-e. Where L >= 2d they are a
run with d its smallest period (an occurrence nearer than d would have been the colour), it cannot be extended to the left,
and it is whole if the next word breaks the period.

Only stretches in which a run can lie are given to the automaton: each window of a few words inside a run occurs again one
period before or after it in that run. Windows of a text without such a neighbour are ruled out by one sort of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, mix, over_texts, steps, text_bytes

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 24, 3
#: How often the sieve looks again with what is left; it only has to rule out, so stopping early is safe.
SIEVES = 8

RUN = "struct<start: long, length: long, period: long>"


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string, state of each prefix); state 0 is the root."""
    link, length, ends = [-1], [0], []
    step: list[dict[int, int]] = [{}]
    last = 0
    for n, word in enumerate(words, 1):
        new = len(link)
        link.append(0)
        length.append(n)
        step.append({})
        ends.append(new)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if length[q] != length[p] + 1:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link[q] = clone
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = q
        last = new
    return link, length, ends


def recoloured(link: list[int], length: list[int], ends: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, e, L) for each segment of one colour that the access of prefix i meets: L words that end at i ended at e last.

    A splay tree stands for each preferred path, shallow nodes left; its root holds the colour of the whole path. `up` is
    the parent in the splay tree, or the node above the path for its root. Node 0 means none: the automaton's root, whose
    empty suffix says nothing, is left out of the trees.
    """
    n = len(link)
    left, right, colour = [0] * n, [0] * n, [-1] * n
    up = [max(p, 0) for p in link]
    for i, state in enumerate(ends):
        below, x = 0, state
        while x:
            # Splay x to the root of its path's tree.
            p = up[x]
            if p and (left[p] == x or right[p] == x):
                while p and (left[p] == x or right[p] == x):
                    g = up[p]
                    x_left, p_left = left[p] == x, False
                    if g and ((p_left := left[g] == p) or right[g] == p):
                        top = up[g]
                        root = not top or (left[top] != g and right[top] != g)
                        if x_left == p_left:  # in line: first the parent, then the node goes above
                            if x_left:
                                a, b = right[p], right[x]
                                left[g], right[p], left[p], right[x] = a, g, b, p
                            else:
                                a, b = left[p], left[x]
                                right[g], left[p], right[p], left[x] = a, g, b, p
                            if a:
                                up[a] = g
                            if b:
                                up[b] = p
                            up[g], up[p] = p, x
                        else:
                            if x_left:
                                a, b = left[x], right[x]
                                right[g], left[p], left[x], right[x] = a, b, g, p
                                if a:
                                    up[a] = g
                                if b:
                                    up[b] = p
                            else:
                                a, b = left[x], right[x]
                                right[p], left[g], left[x], right[x] = a, b, p, g
                                if a:
                                    up[a] = p
                                if b:
                                    up[b] = g
                            up[g], up[p] = x, x
                        old = g
                        up[x] = top
                        if not root:
                            if left[top] == g:
                                left[top] = x
                            else:
                                right[top] = x
                    else:
                        root, old = True, p
                        if x_left:
                            b = right[x]
                            left[p], right[x] = b, p
                        else:
                            b = left[x]
                            right[p], left[x] = b, p
                        if b:
                            up[b] = p
                        up[p], up[x] = x, g
                    if root:
                        colour[x] = colour[old]
                        break
                    p = up[x]
            e = colour[x]
            if e >= 0:
                yield i, e, length[x]
                if right[x]:
                    colour[right[x]] = e
            right[x] = below
            below, x = x, up[x]
        colour[below] = i


def find_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. Words are compared by number.

    A run is a stretch with smallest period q and max(least, times * q) words or more, times >= 3, that no neighbouring
    word extends with the same period.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not settled by the last occurrence alone")
    n, found = len(words), []
    for i, e, size in recoloured(*suffix_automaton(words)):
        d = i - e
        if size + d >= least and size >= (times - 1) * d and (i + 1 == n or words[i + 1] != words[e + 1]):
            found.append((e - size + 1, size + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: Words, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Word ranges [a, b), each inside one text, outside of which no run can lie.

    With k words in a window, 3 (k - 1) <= least, a window of a run occurs again in it a period before or after. So windows
    without a twin in their text are out, and so are those whose nearest twin is farther away than the stretch of windows
    around them could hold `times` times.
    """
    k = min(8, least // 3 + 1)
    start, h = words.windows(k)
    if not len(start):
        return []
    row = words.row_of_word()[start]
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    far = np.int64(len(words.starts) + 1)
    gap = np.where(key[order[1:]] == key[order[:-1]], start[order[1:]] - start[order[:-1]], far)
    near = np.full(len(start), far)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    live = near < far
    for _ in range(SIEVES):
        at = np.flatnonzero(live)
        if not len(at):
            return []
        new = np.flatnonzero((np.diff(start[at]) > 1) | (np.diff(row[at]) > 0)) + 1
        first = np.concatenate([[0], new])
        size = np.diff(np.append(first, len(at)))
        room = np.repeat(size, size) + k - 1
        ok = (room >= least) & (times * near[at] <= room)
        if ok.all():
            break
        live[at[~ok]] = False
    at = np.flatnonzero(live)
    new = np.flatnonzero((np.diff(start[at]) > 1) | (np.diff(row[at]) > 0)) + 1
    cuts = np.split(start[at], new) if len(at) else []
    return [(int(c[0]), int(c[-1]) + k) for c in cuts if len(c) + k - 1 >= least]


def runs_of_texts(words: Words, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, with word numbers from 0 in that text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    for a, b in stretches(words, least, times):
        text = int(np.searchsorted(words.first, a, "right")) - 1
        base = a - int(words.first[text])
        numbers = np.unique(words.h[a:b], return_inverse=True)[1].tolist()
        out[text] += [(s + base, size, q) for s, size, q in find_runs(numbers, least, times)]
    return out


def kept_words(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's remaining words joined by one space, and where each text begins in them."""
    kept = np.flatnonzero(~gone)
    body = words.data.copy()
    edge = np.zeros(len(body) + 1, np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8) > 0
    row = words.row_of_word()[kept]
    inner = words.ends[kept[:-1]][row[1:] == row[:-1]] if len(kept) else kept
    body[inner] = 32  # a word follows in the same text, so this byte is white space of that text
    take[inner] = True
    size = np.concatenate([[0], np.cumsum(take)])
    return body[take], size[words.bounds]


def _dropped(words: Words, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    cover = np.zeros(len(words.starts) + 1, np.int64)
    for text, found in enumerate(runs):
        base = int(words.first[text])
        for start, size, period in found:
            cover[base + start + period] += 1
            cover[base + start + size] -= 1
    return np.cumsum(cover[:-1]) > 0


def _passes(column: pa.Array, least: int, times: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for i, j in steps(offsets):
        words = Words(data, offsets[i : j + 1])
        runs = runs_of_texts(words, least, times)
        yield runs, words.counts, *kept_words(words, _dropped(words, runs))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256) of every row, in place: nothing is shuffled.

    runs are structs (start, length, period) by start, then period. collapsed_sha256 is of the text that collapse() gives.
    A null or empty text has no words and no runs; rows with equal doc_id or equal text are judged each by itself, and an
    empty table gives an empty one. Other columns are not read, whatever their names. A text is worked on whole, in one
    task, with some 600 bytes a word of its periodic stretches at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, shas, counts = [], [], []
            for found, n, body, bounds in _passes(batch.column(1), least, times):
                counts.append(n)
                runs += [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                shas += [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64()), pa.array(runs, kind), pa.array(shas, pa.string())], ["doc_id", "n_words", "runs", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed_sha256 string")


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, text) of every row: of each run only its first period stays; the words kept are joined by one space.

    A word goes if any run contains it after that run's first period. A null text becomes empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for _, _, body, bounds in _passes(batch.column(1), least, times):
                raw = body.tobytes()
                texts += [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return over_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
