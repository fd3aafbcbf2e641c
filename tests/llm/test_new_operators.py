"""Periodic runs, the prefix trie and the license scan against plain versions, and on odd tables."""

import random

import numpy as np
import pytest
from oracle import connect, plain
from plain import crc, plain_licenses, plain_op11, plain_rebuilt, plain_runs, plain_trie
from pyspark.sql import functions as F

from panelry.llm import common, license_scan, periodic_runs, prefix_trie, q_prefix_trie, queries

RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "doc_id long, text string"


def order(rows):
    return sorted(map(tuple, rows), key=repr)


# Periodic runs


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_random_words(letters):
    rnd = random.Random(letters)
    for _ in range(300):
        s = [rnd.randrange(letters) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 12))]
            at = rnd.randint(0, len(s))
            s[at:at] = (part * 7)[: rnd.randint(len(part), 6 * len(part))]
        for least in (24, 6, 3):
            assert periodic_runs.find_runs(s, least) == plain_runs(s, least)
        text = " ".join(map(str, s)).encode()
        words = common.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert periodic_runs.runs_of_texts(words)[0] == plain_runs(s)
        assert periodic_runs.runs_of_texts(words, 6)[0] == plain_runs(s, 6)


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        periodic_runs.find_runs([1, 2], 2, 2)


def test_sieve_keeps_texts_apart():
    """Neighbouring texts of one step share no run, though their words would continue it."""
    parts = [b"a b " * 20, b"a b " * 20, b"a b", b" a b " * 11 + b"c"]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    runs = periodic_runs.runs_of_texts(common.Words(data, offsets))
    assert runs == [[(0, 40, 2)], [(0, 40, 2)], [], []]


def test_long_periodic_text_is_linear(spark):
    """A million words of one period and half a million of another, in one text."""
    text = "x y z " * 330_000 + "q " * 500_000
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], KIND)).first()
    assert r.n_words == 1_490_000 and [tuple(x) for x in r.runs] == [(0, 990_000, 3), (990_000, 500_000, 1)]
    assert periodic_runs.collapse(spark.createDataFrame([(1, text)], KIND)).first().text == "x y z q"


def test_query_of_runs(spark, sf_dir):
    got = queries.QUERIES["op11_periodic_runs"](spark, sf_dir).select(*RUN_COLUMNS).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert order(got) == order(plain_op11(d.doc_id, d.text) for d in docs)
    assert sum(r.n_runs for r in got) > 10


def test_runs_of_odd_texts(spark):
    planted = [i for i in range(1000) if crc(i) % 10 == 0][:4]
    texts = [None, "", " \n ", "one", "a " * 30, "a " * 30, "é ß  " * 40, "a b c d e f g h i j k l"]
    rows = [(i, t) for i, t in zip([*planted, 1, 2, 3, 4], texts, strict=True)] + [(4, texts[-1]), (4, "b " * 50), (planted[0], "p q r s")]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("mine") for c in ("runs", "n_words", "a.b", "start")})
    from panelry.llm.q_periodic_runs import echoed, strongest

    found = periodic_runs.periodic_runs(echoed(df)).withColumn("best", strongest(F.col("runs"))).collect()
    want = [plain_op11(d, t) for d, t in rows]
    mine = [(r.doc_id, len(r.runs), *(tuple(r.best) if r.best else (None,) * 3), r.collapsed_sha256, r.n_words) for r in found]
    assert order(mine) == order((w[0], w[1], *w[2:5], w[7], w[8]) for w in want)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0 and periodic_runs.collapse(df.limit(0)).count() == 0
    assert periodic_runs.periodic_runs(spark.createDataFrame([(None, "a " * 30)], KIND)).first().runs[0].length == 30


# The prefix trie


def trie(spark, convs):
    """prefix_trie() of a dict conv_id -> list of (role, text)."""
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    turns = prefix_trie.turns_in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    return order(prefix_trie.prefix_trie(common.stored(turns), ids).select(*NODE_COLUMNS).collect())


def test_query_of_the_trie(spark, sf_dir):
    got = queries.QUERIES["op12_prefix_trie"](spark, sf_dir).select(*NODE_COLUMNS).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert order(got) == plain_trie(plain_rebuilt(rows))


def test_trie_of_random_conversations(spark):
    """Long chains, a hot conversation, a hot first turn, turnless ones."""
    rnd = random.Random(5)
    turn = lambda: (rnd.choice("ua"), rnd.choice(["", "x", "yy", "zé"]))
    convs = {i: [turn() for _ in range(rnd.randint(0, 5))] for i in range(60)}
    chain = [turn() for _ in range(90)]
    convs |= {100 + i: chain[: rnd.randint(1, 90)] for i in range(8)}
    convs |= {200 + i: chain[:3] for i in range(40)} | {300 + i: [("s", "hot"), ("u", str(i))] for i in range(40)}
    assert trie(spark, convs) == plain_trie(convs)


def test_conversations_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 8)
    convs = {i: [("u", str(j)) for j in range(i % 11)] for i in range(60)}
    assert trie(spark, convs) == plain_trie(convs)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_contraction_of_any_shape(spark, shape):
    rnd = random.Random(shape)
    n = 300
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i), "forest": lambda i: rnd.randrange(i) if i % 7 else None}[shape]
    up = {i: parent(i) if i else None for i in range(n)}
    kids = {p: sum(q == p for q in up.values()) for p in up}
    own = {i: i % 5 for i in up}
    total = dict(own)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            total[up[i]] += total[i]
    tree = spark.createDataFrame([(i, up[i], kids[i] or None, own[i]) for i in up], "id long, parent long, n_children long, v long")
    assert {r.id: r.v for r in prefix_trie.contract(tree, ["v"]).collect()} == total


def test_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(100, None, "u", "first"), (100, 0, None, None), (100, 0, "", ""), (101, 5, "u", None), (101, 2, "a", "x"), (101, 2, "a", "x"), (None, 0, "u", "lost"), (7, 1, "u", "z" * 5000), (307, 0, "u", "own")]
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("mine") for c in ("pos", "depth", "a.b", "id")})
    got = prefix_trie.prefix_trie(*q_prefix_trie.rebuilt(common.stored(prefix_trie.turns_in_order(df)))).select(*NODE_COLUMNS)
    assert order(got.collect()) == plain_trie(plain_rebuilt(rows))
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    ids = [r.conv_id for r in prefix_trie.conversation_trie(df).where("depth = 0").collect()]
    assert ids == [7]


# The license scan

NOTICE = license_scan.NOTICES[0][1]
TEXTS = [
    None,
    "",
    "MIT License",
    "the MIT-License, the Apache\nLICENSE and the GNU General Public License; mit license mit license",
    "Mit licensé mit licence mİt license General Public License Kelvin",
    "permit license mit_license mit--license",
    NOTICE,
    "say: " + NOTICE.replace("free of charge", "entirely free of any charge").upper() + " end",
    NOTICE[: len(NOTICE) // 3],
    NOTICE[: int(len(NOTICE) * 0.7)] + " " + "other words " * 20 + NOTICE[-80:],
    "copyright, all rights reserved. Licensed under CC BY-NC 4.0.",
    " ".join(x for _, x in license_scan.NOTICES),
    ("filler " * 5000 + "apache license ") * 3,
]
LICENSE_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_licenses_equal_plain(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (2, "apache license"), (None, TEXTS[3])]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("mine") for c in ("key", "doc", "words", "labels", "a.b", "n_words")})
    got = license_scan.scan_licenses(df).select("doc_id", *LICENSE_COLUMNS).collect()
    want = [(d, *plain_licenses(t, license_scan.NAMES, license_scan.NOTICES, license_scan.BASE)) for d, t in rows]
    clean = lambda rows: order((*r[:7], round(r[7], 9)) for r in rows)
    assert clean(got) == clean(want)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    found = {r.doc_id: r.labels for r in got if r.doc_id in (6, 7, 8, 9, 11)}
    assert found[6] == found[7] == found[9] == "mit-notice" and found[8] == ""
    assert {x for x in found[11].split(",") if "notice" in x} == {label for label, _ in license_scan.NOTICES}


BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
h AS (SELECT doc_id, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache' WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label FROM p)
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(label)::BIGINT AS n_base, (min(i) FILTER (label IS NOT NULL))::BIGINT AS first_word, (max(i) FILTER (label IS NOT NULL))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id
"""


def test_base_of_the_license_query_equals_sql(spark, sf_dir):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = queries.QUERIES["op13_license_scan"](spark, sf_dir)
    assert plain(got.select(columns).toPandas(), columns) == plain(connect(sf_dir).sql(BASE_SQL).df(), columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, *plain_licenses(d.text, license_scan.NAMES, [], license_scan.BASE)) for d in docs]
    assert order(got.select("doc_id", *LICENSE_COLUMNS).collect()) == order(want)


def test_license_scan_is_native(spark, sf_dir):
    plan = queries.QUERIES["op13_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
