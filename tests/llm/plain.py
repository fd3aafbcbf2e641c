"""Plain versions of operators, written from their contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction


def crc(x):
    return zlib.crc32(str(x).encode())


def plain_runs(words, least=24, times=3):
    """(start, length, period) of all runs, by looking at every period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_op11(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), crc(doc)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    three = best or (None, None, None)
    return (doc, len(runs), *three, best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def plain_trie(convs):
    """Nodes of a dict conv_id -> list of (role, text), as sorted tuples in the order of the contract's columns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    rows = [(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], sha(node)) for node, m in members.items()]
    return sorted(rows, key=repr)


def plain_rebuilt(rows):
    """rows (conv_id, turn, role, text) to the contract's rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc(c) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_licenses(text, names, notices, base):
    """The contract's columns for one text, with notices found by votes, merged diagonals and cover."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels, base_labels, score = [], set(), set(), 0.0
    for i, (name, label) in enumerate(names):
        want = name.split()
        at = [w for w in range(len(words) - len(want) + 1) if words[w : w + len(want)] == want]
        if at:
            labels.add(label)
            score = 1.0
        if at and i < base:
            starts += at
            base_labels.add(label)
    for label, notice in notices:
        want = re.findall(r"[a-z0-9]+", notice.lower())
        votes = defaultdict(set)
        for w in range(len(words) - 3):
            for t in range(len(want) - 3):
                if words[w : w + 4] == want[t : t + 4]:
                    votes[w - t].add(t)
        islands = []
        for d in sorted(votes):
            if not islands or d - islands[-1][-1] > 8:
                islands.append([])
            islands[-1].append(d)
        for island in islands:
            said = {t + j for d in island for t in votes[d] for j in range(4)}
            first, last = min(d + min(votes[d]) for d in island), max(d + max(votes[d]) + 4 for d in island)
            if len(said) / len(want) >= 0.5 and last - first <= math.ceil(1.5 * len(want)):
                labels.add(label)
                score = max(score, len(said) / len(want))
    ends = (min(starts), max(starts)) if starts else (None, None)
    return (len(words), len(starts), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)
