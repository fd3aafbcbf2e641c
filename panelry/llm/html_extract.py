"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements are binary nodes (content or not). Their own features give unary potentials, each parent-child edge a
potential over both labels. One upward and one downward pass of sum-product messages yield exact marginals; training
climbs the likelihood of labelled pages with the same passes. Blocks whose marginal exceeds one half are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import over_texts, plain_names
from .html_pages import labelled_pages

#: Elements that start a block, and those whose text is never shown.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style template noscript head title iframe object svg canvas textarea select datalist option".split())
#: What may stand in a head; anything else ends one whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Hidden elements that may lack an end tag and still hide what they hold: it is implied, or the page ends in raw text.
MAY_STAY_OPEN = frozenset("head option script style".split())
#: Opening one of these ends the open ones named beside it, up to the nearest of the last column.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: An open paragraph outside of these is not ended by a block inside them.
AROUND = ("td", "th", "li", "blockquote", "div", "article", "section")
EDGE_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "li": 3, "ul": 3, "ol": 3, "div": 4, "section": 4, "article": 5, "main": 5}
N_EDGES, EPOCHS, RATE, RIDGE = 6, 160, 0.4, 2e-3
#: What a sentence ends with.
END = tuple(".!?…")
#: Pages whose nodes are worked on at once.
TOGETHER = 256


@dataclass
class Tree:
    """Block nodes of one page in document order, and its text units (node, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    units: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self, shown: frozenset[tuple[int, int]] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.open: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.hidden: list[tuple[str, tuple[int, int]]] = []
        self.shown = shown
        self.links = 0
        self.places: dict[str, list[int]] = defaultdict(list)
        self.hiding: Counter[str] = Counter()
        self._node("", ())

    def _node(self, tag: str, names: tuple[str, ...], label: int | None = None) -> None:
        t = self.tree
        up = self.open[-1][1] if self.open else -1
        t.parent.append(up)
        t.tag.append(tag)
        t.names.append(names)
        t.label.append(label if label is not None else (t.label[up] if up >= 0 else 0))
        t.chars.append(0)
        t.linked.append(0)
        self.places[tag].append(len(self.open))
        self.open.append((tag, len(t.tag) - 1))

    def flush(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            self.text = []
            if said:
                self.tree.units.append((self.open[-1][1], said))

    def _close(self, upto: int) -> None:
        self.flush()
        for tag, _ in reversed(self.open[upto:]):
            self.places[tag].pop()
        del self.open[upto:]

    def _last(self, tags) -> int:
        """Where in the open elements the innermost of these tags stands; -1 for none."""
        return max((at[-1] for x in tags if (at := self.places.get(x))), default=-1)

    def _reveal(self, upto: int) -> None:
        """Hidden elements from this one on end."""
        for tag, _ in self.hidden[upto:]:
            self.hiding[tag] -= 1
        del self.hidden[upto:]

    def _imply_end(self, tag: str) -> None:
        """End tags that a start tag implies: of an open option, and of an open head."""
        if self.hidden[-1][0] == "option" and (tag in BLOCKS or tag in ("option", "optgroup", "select")):
            self._reveal(len(self.hidden) - 1)
        elif self.hidden[-1][0] == "head" and tag not in IN_HEAD:
            self._reveal(len(self.hidden) - 1)
        elif tag == "body" and self.hiding["head"] and not self.hiding["template"]:
            self._reveal([x for x, _ in self.hidden].index("head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            self._imply_end(tag)
        if tag in HIDDEN and self.getpos() not in self.shown:
            self.hidden.append((tag, self.getpos()))
            self.hiding[tag] += 1
        if self.hidden:
            return
        if tag == "a":
            self.links = 1
        if tag in ("br", "img"):
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        paragraph = self._last(("p",))
        if paragraph > self._last(AROUND):
            self._close(paragraph)
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            inside = self._last(scope)
            first = [at[i] for x in ends if (at := self.places.get(x)) and (i := bisect_right(at, inside)) < len(at)]
            if first:
                self._close(min(first))
        self.flush()
        if tag == "hr":
            return
        found = dict(attrs)
        names = tuple(dict.fromkeys(x for k in ("class", "id", "role") for x in re.findall(r"[a-z]+", (found.get(k) or "").lower())))
        mark = found.get("data-y")
        self._node(tag, names, int(mark) if mark else None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS or tag in HIDDEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1][0] == "option" and tag in BLOCKS:
            self._reveal(len(self.hidden) - 1)
        if self.hidden:
            if self.hiding[tag]:
                at = len(self.hidden) - 1
                while self.hidden[at][0] != tag:
                    at -= 1
                self._reveal(at)
            return
        if tag == "a":
            self.links = 0
        if tag in BLOCKS and self._last((tag,)) > 0:
            self._close(self._last((tag,)))

    def handle_data(self, data: str) -> None:
        if self.hidden and self.hidden[-1][0] == "head" and data.strip():
            self._reveal(len(self.hidden) - 1)
        if self.hidden:
            return
        self.text.append(data)
        n, at = len(data), self.open[-1][1]
        self.tree.chars[at] += n
        if self.links:
            self.tree.linked[at] += n


def parse(html: str) -> Tree:
    """The page's tree. Hidden elements that are never closed (say, an iframe) hide nothing: the page is read again so."""
    shown: frozenset[tuple[int, int]] = frozenset()
    while True:
        builder = _Builder(shown)
        builder.feed(html)
        builder.close()
        left = {at for tag, at in builder.hidden if tag not in MAY_STAY_OPEN}
        if not left:
            break
        shown |= left
    builder.flush()
    tree = builder.tree
    if "body" not in tree.tag:  # its tags may be left out
        tree.tag[0] = "body"
    return tree


def node_features(t: Tree) -> list[list[str]]:
    """What each node shows of itself: tag, names, text length, share of links, sentence marks, paragraphs, its parent."""
    parts: list[list[str]] = [[] for _ in t.tag]
    for i, said in t.units:
        parts[i].append(said + " ")
    own = ["".join(x) for x in parts]
    holds = [0] * len(t.tag)
    for i, tag in enumerate(t.tag):
        if tag == "p" and t.parent[i] >= 0 and own[i].rstrip()[-1:] in END and own[i].count(" ") > 3:
            holds[t.parent[i]] += 1
    said_below = [tag in ("p", "h1", "h2") or own[i].count(" ") > 8 and own[i].rstrip()[-1:] in END for i, tag in enumerate(t.tag)]
    below = [0] * len(t.tag)
    for i in range(len(t.tag) - 1, 0, -1):
        if t.parent[i] >= 0:
            below[t.parent[i]] += below[i] + said_below[i]
    out = []
    for i, tag in enumerate(t.tag):
        n = own[i].count(" ")
        share = min(3, 4 * t.linked[i] // max(1, t.chars[i]))
        size = 0 if n == 0 else 1 if n < 4 else 2 if n < 12 else 3 if n < 40 else 4
        up = t.tag[t.parent[i]] if t.parent[i] >= 0 else ""
        f = ["1", f"tag {tag}", f"size {size}", f"link {share} {size}", f"up {up} {tag}"]
        if size:
            ends = own[i].rstrip()[-1:] in END
            f += [f"ends {ends}", f"link {share} ends {ends}"]
            f.append(f"in {up} {tag} {size}")
        if tag in ("table", "tbody", "tr"):
            f.append(f"below {min(below[i], 2)} {tag}")
        if holds[i]:
            f.append(f"holds {min(holds[i], 3)}")
            f.append(f"holds {min(holds[i], 3)} {tag}")
        if "©" in own[i]:
            f.append("copy")
        out.append(f + [f"name {x}" for x in t.names[i]])
    return out


@dataclass
class Forest:
    """Nodes of several pages: parents come before children, levels hold the nodes of one depth."""

    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray


def forest(trees: list[Tree], known: dict[str, int], learn: bool = False) -> Forest:
    parent, edge, node, feature, base = [], [], [], [], 0
    for t in trees:
        for i, found in enumerate(node_features(t)):
            for f in found:
                k = known.setdefault(f, len(known)) if learn else known.get(f)
                if k is not None:
                    node.append(base + i)
                    feature.append(k)
        parent += [p + base if p >= 0 else -1 for p in t.parent]
        edge += [EDGE_KINDS.get(x, 0) for x in t.tag]
        base += len(t.tag)
    up = np.array(parent, np.int64)
    depth = np.zeros(base, np.int64)
    levels, live = [], np.flatnonzero(up < 0)
    depth[:] = -1
    depth[live] = 0
    for i in np.flatnonzero(up >= 0).tolist():
        depth[i] = depth[up[i]] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if base else []
    return Forest(up, np.array(edge, np.int64), levels, np.array(node, np.int64), np.array(feature, np.int64))


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


@dataclass
class Model:
    known: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, g: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and P(parent's label, own label) of every edge (zeros at roots)."""
        n = len(g.parent)
        score = np.zeros((n, 2))
        score[:, 1] = np.bincount(g.node, self.unary[g.feature], minlength=n) if len(g.node) else 0
        inner = score.copy()
        message = np.zeros((n, 2))
        for nodes in reversed(g.levels[1:]):
            message[nodes] = _log_sum(inner[nodes][:, None, :] + self.pair[g.edge[nodes]], 2)
            np.add.at(inner, g.parent[nodes], message[nodes])
        belief = inner.copy()
        both = np.zeros((n, 2, 2))
        for nodes in g.levels[1:]:
            above = belief[g.parent[nodes]] - message[nodes]
            joint = above[:, :, None] + self.pair[g.edge[nodes]] + inner[nodes][:, None, :]
            belief[nodes] = _log_sum(joint, 1)
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[nodes] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), both


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Maximum likelihood (with a ridge) on pages whose elements carry data-y, by Adagrad over all of them."""
    trees = [parse(p) for p in pages]
    known: dict[str, int] = {}
    g = forest(trees, known, learn=True)
    y = np.concatenate([np.array(t.label) for t in trees])
    m = Model(known, np.zeros(len(known)), np.zeros((N_EDGES, 2, 2)))
    child = np.flatnonzero(g.parent >= 0)
    seen = np.zeros_like(m.pair)
    np.add.at(seen, (g.edge[child], y[g.parent[child]], y[child]), 1)
    su, sp = np.full(len(known), 1e-3), np.full(m.pair.shape, 1e-3)
    for _ in range(epochs):
        p, both = m.marginals(g)
        gu = np.bincount(g.feature, (y - p)[g.node], minlength=len(known)) / len(trees) - RIDGE * m.unary
        expected = np.zeros_like(m.pair)
        np.add.at(expected, g.edge[child], both[child])
        gp = (seen - expected) / len(trees) - RIDGE * m.pair
        su += gu * gu
        sp += gp * gp
        m.unary += RATE * gu / np.sqrt(su)
        m.pair += RATE * gp / np.sqrt(sp)
    return m


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    """The content blocks of each page, one a line; a null or empty page has none."""
    trees = [parse(p) if p else Tree() for p in pages]
    p, _ = model.marginals(forest(trees, model.known))
    out, base = [], 0
    for t in trees:
        out.append("\n".join(said for i, said in t.units if p[base + i] > 0.5))
        base += len(t.tag)
    return out


@plain_names
def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """Adds text and n_chars to the pages and drops the html; columns of those names are replaced.

    Without a model, one is trained on the labelled pages of this package. A null or empty html has an empty text. Repeated
    rows are extracted each; an empty table stays empty. Depth is no limit: nesting is kept on a list, not on the stack.
    """
    model = model or fit(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                at = part.schema.get_field_index
                texts = main_texts(part.column(at(html)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return over_texts(pages.select(*names, html), run, schema)
