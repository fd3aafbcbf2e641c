"""Small parts against plain versions, without Spark."""

import itertools
import random
import re
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelry.llm import bm25, common, factorization, host_rules, html_extract, ngram_join, packing, passages, secret_scan, sharding, tokens
from panelry.llm.html_pages import labelled_pages

TEXTS = st.lists(st.text(alphabet="ab \n\tÉ\x0b#x", max_size=40), min_size=1, max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_split(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    w = common.Words(data, offsets)
    said = [[bytes(w.data[a:b]) for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert said == [t.encode().split() for t in texts]
    by_hash = {}
    for word, h in zip(itertools.chain(*said), w.h.tolist(), strict=True):
        assert by_hash.setdefault(h, word) == word


@given(TEXTS)
@settings(max_examples=80, deadline=None)
def test_windows_agree(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    w = common.Words(data, offsets)
    a, ha = w.windows(3)
    b, hb = w.long_windows(3)
    assert a.tolist() == b.tolist()
    gram = lambda i: tuple(bytes(w.data[w.starts[j] : w.ends[j]]) for j in range(i, i + 3))
    for h in (ha, hb):
        assert len({gram(i) for i in a.tolist()}) == len(set(h.tolist()))


def jump_slow(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_one_and_moves_only_to_the_new_shard():
    r = random.Random(1)
    keys = np.array([r.getrandbits(60) for _ in range(4000)], np.int64)
    for n in (1, 2, 8, 9):
        assert sharding.jump(keys, n).tolist() == [jump_slow(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.03
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_base_rules_against_counting():
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "bb", "é#", "|c"]) + r.choice(["", "", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "\n\n", "a\na\n a"]
    got = host_rules.measure_texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        words = t.split()
        lines = [x for x in t.split("\n") if x.strip()]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        marked = {k + d for k, x in enumerate(grams) if grams.count(x) > 1 for d in range(5)}
        want = [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)]
        assert [int(got[m][i]) for m in host_rules.MEASURES] == want


def plain_spans(text):
    found = []
    for k, (pattern, least, group) in enumerate([(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), (r"AKIA[A-Z0-9]+", 16, 0), (r"[0-9a-f]+", 32, 0)]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(found)


def test_spans_equal_a_plain_scan():
    r = random.Random(3)
    parts = ["password=abcdefgh1", 'PassWD : "short"', "api_key= x.y_z-12345", "APIKEY:abcdefghij", "AKIA" + "Z9" * 8, "AKIAshort", "0123456789abcdef" * 2, "deadbeef" * 5, "Token = 'aaaaaaaaaa'", "é", "secret", " ", "\n", "ſecret=abcdefgh9", "tok", "en=abcdefgh"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, ""]
    got = secret_scan.find_spans(pa.array(texts, pa.string()))
    assert [[s for s in x if s[1] < 3] for x in got] == [plain_spans(t or "") for t in texts]


def test_trigram_queries_never_miss():
    for pattern, matches in ((r"ab(c|de)f+", ["abcf", "abdeff"]), (r"x?yz[0-9]{2,}key", ["yz12key", "xyz345key"]), (r"(foo|bar)?baz", ["baz", "foobaz"]), (r"(abc){2,3}", ["abcabc"])):
        need = secret_scan.trigram_query(pattern)
        for text in matches:
            data = np.frombuffer(text.encode(), np.uint8)
            index = secret_scan.BlockIndex(data, np.array([0, len(text)]), tuple(sorted(need.trigrams())))
            assert index.rows(need)[0]
    assert secret_scan.trigram_query(r"[0-9a-f]{32,}").free


def test_mask():
    assert secret_scan.masked("a password=12345678 b", [(2, 0, 19), (11, 2, 19)], "[S]") == "a [S] b"


@pytest.mark.parametrize("seed", range(25))
def test_plan_places_everything_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 30, 100, 1024])
    counts = {}
    for _ in range(r.randint(1, 300)):
        s = r.randint(1, cap) if r.random() < 0.5 else max(1, int(cap * r.random() ** 2))
        counts[s] = counts.get(s, 0) + r.choice([1, 1, 2, 50])
    rows, bins = packing.plan(counts, cap)
    used, ranks = {}, {}
    for s, a, z, first, per, at in rows:
        ranks.setdefault(s, []).extend(range(a, z))
        for k in range(z - a):
            used.setdefault(first + k // per, []).append((at + k % per * s, s))
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items())
    assert set(used) == set(range(bins))
    for v in used.values():
        v.sort()
        assert [x[0] for x in v] == [sum(y[1] for y in v[:i]) for i in range(len(v))] and sum(x[1] for x in v) <= cap
    free = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        for i, room in enumerate(free):
            if room >= s:
                free[i] -= s
                break
        else:
            free.append(cap - s)
    assert ceil(sum(s * n for s, n in counts.items()) / cap) <= bins <= len(free) * 1.02 + 1
    large = [s for s, n in counts.items() for _ in range(n) if 3 * s > cap]
    assert all(sum(3 * x[1] > cap for x in v) <= 2 for v in used.values()) or not large


def test_ids_equal_the_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "a  b", " lead", "x\n\ny z", "naïve – “q” 中文 字 1234 56", "don't we'll I'm 's", "\x1c a", "<|endoftext|> a", "a 　b", "é" * 3000]
    got = tokens.encoder(tokens.default_vocabulary()).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def unmodified_ids(texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_unmodified_tokenizers():
    end = "<|endoftext|>"
    texts = ["", f"a {end} b", f"{end}{end}", f"  {end}  \n x", f"a  {end}\n", "<|endoftext|", f"<{end}>", "<|ENDOFTEXT|> don't 中文", f"é{end}é" * 300]
    want = unmodified_ids(texts)
    assert want[1] == [64, 220, 50256, 275]
    got = tokens.declared_encoder(tokens.default_vocabulary()).encode(texts)
    assert [x.tolist() for x in got] == want


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t"])
def test_ids_of_long_blanks_equal_the_tokenizers(blank):
    texts = [f"a {blank * (1_200_000 // len(blank))}word <|endoftext|>", blank * 99_999 + "x", blank * 100_000]
    got = tokens.declared_encoder(tokens.default_vocabulary()).encode(texts)
    assert [x.tolist() for x in got] == unmodified_ids(texts)


def test_overlap_thresholds_and_subsets():
    for n, m in itertools.product(range(1, 40), repeat=2):
        least = next(i for i in range(n + m + 1) if 100 * i >= 80 * (n + m - i))
        assert ngram_join.need(n, m) == least
        if m >= n:
            assert (ngram_join.shortest(m) <= n) == (100 * n >= 80 * m)
    for n in range(1, 9):
        for t in ngram_join.subset_sizes(n, 9):
            assert 0 < t <= n


def test_factor_scores_equal_all_pairs():
    r = np.random.default_rng(1)
    x = factorization.Rows(np.array([0, 3, 7]), r.integers(0, 9, 7), r.normal(size=7))
    m = factorization.Machine(0.3, r.normal(size=9), r.normal(size=(9, 4)))
    for i, (a, b) in enumerate(((0, 3), (3, 7))):
        f, v = x.features[a:b], x.values[a:b]
        pairs = sum(m.factors[f[p]] @ m.factors[f[q]] * v[p] * v[q] for p, q in itertools.combinations(range(b - a), 2))
        assert m.logits(x)[i] == pytest.approx(0.3 + m.linear[f] @ v + pairs)


@pytest.fixture(scope="module")
def page_model():
    return html_extract.fit(labelled_pages(250, 5), 120)


def test_marginals_equal_brute_force(page_model):
    tree = html_extract.parse('<body><nav><a href=x>one</a></nav><div class="content"><p>Some words here.</p><div class="ad">buy</div></div></body>')
    g = html_extract.forest([tree], page_model.known)
    got, _ = page_model.marginals(g)
    n = len(tree.tag)
    unary = np.bincount(g.node, page_model.unary[g.feature], minlength=n)
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        e = sum(unary[i] * y[i] for i in range(n)) + sum(page_model.pair[g.edge[i], y[tree.parent[i]], y[i]] for i in range(n) if tree.parent[i] >= 0)
        p = np.exp(e)
        total += p
        mass += p * np.array(y)
    assert np.allclose(got, mass / total)


def test_pages_of_unseen_layouts(page_model):
    wrong = units = 0
    for page in labelled_pages(120, 77):
        tree = html_extract.parse(page)
        p, _ = page_model.marginals(html_extract.forest([tree], page_model.known))
        for i, _ in tree.units:
            units += 1
            wrong += (p[i] > 0.5) != (tree.label[i] == 1)
    assert wrong < 0.03 * units


def test_page_text(page_model):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><article><h1>A &amp; B title</h1><p><b>First&nbsp;line is a\n sentence.<br><p>Second one, with words.</p></article><footer>&copy; site</footer>'
    assert html_extract.main_texts([page, None, ""], page_model) == ["A & B title\nFirst line is a sentence.\nSecond one, with words.", "", ""]


def said(page):
    return [text for _, text in html_extract.parse(page).units]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><meta charset=x><body><p>One.</p></body></html>", ["One."]),
        ("<html><head><title>t</title><p>One.<p>Two.", ["One.", "Two."]),
        ("<head><title>t</title>One.", ["One."]),
        ("<head><noscript><img src=x></noscript><title>t</title></head><p>One.", ["One."]),
        ("<head><noscript><link><body><p>One.<noscript>x</noscript>", ["One."]),
        ("<article><p>One.</p><select><option>a<option>b</select><p>Two.</p></article>", ["One.", "Two."]),
        ("<select><optgroup><option>a<optgroup><option>b</optgroup></select><p>One.", ["One."]),
        ("<p>One.<datalist><option>a<option>b</datalist><p>Two.", ["One.", "Two."]),
        ("<div><option>a</div>One.", ["One."]),
        ("<p>One.</p><select><option>a<option>b<p>Two.</p>", ["One.", "Two."]),
        ("<p>One.</p><svg><object>x</svg><p>Two.</p>", ["One.", "Two."]),
        ("<p>One.</p><iframe src=x><p>Two.</p><iframe>x</iframe><p>Three.", ["One.", "Two.", "Three."]),
        ("<p>One.</p><template><p>x</template></svg></option><p>Two.<script>var a", ["One.", "Two."]),
        *((f"<p>One.</p><{x}><p>Two.</p>", ["One.", "Two."]) for x in ("noscript", "iframe", "svg", "object", "canvas")),
    ],
)
def test_omitted_end_tags_of_hidden_elements(page, texts):
    assert said(page) == texts


def test_many_unclosed_hidden_elements_take_two_readings(monkeypatch):
    made = []
    monkeypatch.setattr(html_extract, "_Builder", type("Counted", (html_extract._Builder,), {"__init__": lambda self, *a: (made.append(1), super(type(self), self).__init__(*a))[1]}))
    assert said("<p>One.</p>" + "<iframe><object><svg></svg><p>Two.</p>" * 300) == ["One."] + ["Two."] * 300
    assert len(made) == 2


def test_windows_name_equal_phrases():
    words = [f"w{i % 97}" for i in range(300)]
    a = " ".join(words[50:200])
    data, offsets = common.text_bytes(pa.array([" ".join(words), "zz " + a + " qq", "few words"], pa.string()))
    w = common.Words(data, offsets)
    start, phrase, _ = passages.named_phrases(w)
    row = w.row_of_word()[start]
    one = {tuple(words[i : i + 50]): p for i, p in zip(start[row == 0].tolist(), phrase[row == 0].tolist(), strict=True)}
    for i, p in zip((start[row == 1] - w.first[1]).tolist(), phrase[row == 1].tolist(), strict=True):
        own = tuple(("zz " + a + " qq").split()[i : i + 50])
        assert one.get(own, p) == p
    assert not (row == 2).any()


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")


def shard_and_queries(n_docs, lengths, seed, words=3000):
    """A shard of Zipf-distributed words and queries made the same way, with the counts of the shard as the global ones."""
    r = np.random.default_rng(seed)
    weight = 1 / np.arange(1, words + 1)
    make = lambda n, low, high: [r.choice(words, r.integers(low, high), p=weight / weight.sum()) for _ in range(n)]
    docs, asked = make(n_docs, 20, 120), [np.unique(x) for x in make(40, *lengths)]
    pair, tf = np.unique(np.repeat(np.arange(n_docs), [len(d) for d in docs]) * words + np.concatenate(docs), return_counts=True)
    sizes = np.array([len(d) for d in docs], float)
    q = bm25.QueryBlock(np.arange(40), [x.astype(np.uint64) for x in asked], bm25.Vocabulary(np.arange(words, dtype=np.uint64)))
    q.count(n_docs, int(sizes.sum()), np.bincount(pair % words, minlength=words))
    ids = r.permutation(n_docs) * 3
    shard = bm25.Shard(ids, sizes, pair // words, pair % words, tf.astype(float), q)
    grid = np.zeros((n_docs, words))
    grid[pair // words, pair % words] = q.idf[pair % words] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[pair // words] / q.average))
    return shard, q, asked, ids, grid


@pytest.mark.parametrize(("n_docs", "lengths"), [(3000, (1, 6)), (3000, (60, 200)), (5, (1, 40)), (33, (1, 6)), (700, (5, 30))])
def test_pivots_lose_no_result(n_docs, lengths):
    shard, q, asked, ids, grid = shard_and_queries(n_docs, lengths, n_docs + lengths[1])
    exact = []
    for t in asked:
        score = np.round(grid[:, t].sum(axis=1), 6)
        order = np.lexsort((ids, -score))[:10]
        order = order[score[order] > 0]
        exact.append((ids[order], score[order]))
    tenth = np.array([s[-1] if len(s) == 10 else 0.0 for _, s in exact])
    for floor in (np.zeros(40), np.maximum(tenth - 1e-5, 0), tenth * 0.7):
        got = {query: (d, s) for query, d, s in shard.search(q, floor, 10)}
        for query, (d, s) in enumerate(exact):
            d2, s2 = got.get(query, (d[:0], s[:0]))
            assert len(d) == len(d2) and s2 == pytest.approx(s, abs=2e-6)
            clear = np.abs(np.diff(s, prepend=np.inf, append=-np.inf)) > 4e-6
            clear = clear[:-1] & clear[1:]
            assert (d[clear] == d2[clear]).all()


def test_pivots_skip_most_postings():
    """Queries of a few words, and long ones of unrelated words, against Zipf-distributed words; other shards gave the floor."""
    for lengths, share in (((2, 8), 0.5), ((60, 200), 0.6)):
        shard, q, asked, _, grid = shard_and_queries(6000, lengths, 5)
        floor = np.array([np.sort(grid[:, t].sum(axis=1))[-10] for t in asked]) - bm25.MARGIN
        list(shard.search(q, floor, 10))
        assert 0 < shard.read < share * shard.all, (lengths, shard.read / shard.all)
