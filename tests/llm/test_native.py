import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from balancebeam.llm import chat, embdedup, licenses, topk, urls
from balancebeam.llm.common import components
from tests.llm.conftest import ODD

NO_PYTHON = ("Python", "Pandas", "Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- chat

NASTY = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end\\|>", "<\\\\|", "a<|b", "<", "<\\", "|>", "tail<", "\n", "<|nl|>", None, "x" * 50000]


def test_chat_round_trip(spark):
    rows = [(k % 7 if k else None, None if k == 3 else k, r, t, "clash") for k, (r, t) in enumerate([(r, t) for r in ("user", "assistant", "sys\ntem", "<|nl|>", "<|im_start|>", None, "") for t in NASTY])]
    df = spark.createDataFrame([*rows, rows[5]], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    assert not any(x in plan(out) for x in NO_PYTHON)
    want = {}
    for c, n, r, t, _ in [*rows, rows[5]]:
        want.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in turns]
        assert got[c].loss == "".join(t for _, r, t in turns if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c <| d"), (1, 1, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|im_start|>user\na < b | c <| d<|im_end|>\n<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"


# ---- URLs


def test_urls(spark):
    cases = [("http://a.b.org/x", "org/", "allow"), ("http://x.org", None, "allow"), ("https://EXAMPLE.org/es/1?q", "example.org/es/", "block"), ("http://www.example.org/en/12", "example.org/en/1", "block"),
             ("http://notexample.org/en/1", "org/", "allow"), ("http://shop.com/de/#x", "com/de/", "block"), ("http://shop.com/DE/", None, "allow"), ("x://casino.com/fr/", "com/fr/", "allow"),
             ("http://my-casino.net/a", "*casino*", "block"), ("http://casinova.net/", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("http://", None, "allow"), ("http://" + "a." * 5000 + "org/", "org/", "allow")]
    df = spark.createDataFrame([(k if k else None, u, "clash") for k, (u, _, _) in enumerate(cases)] * 2, "page_id long, url string, rule string")
    out = urls.judge(df)
    assert not any(x in plan(out) for x in NO_PYTHON)
    got = out.collect()
    assert len(got) == 2 * len(cases) and all((r.rule, r.verdict) == cases[r.page_id or 0][1:] for r in got)
    assert urls.judge(df.limit(0)).count() == 0 and {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_a_rule_without_tokens_is_always_a_candidate(spark):
    df = spark.createDataFrame([(1, "http://é.x/")], "page_id long, url string")
    assert urls.judge(df, [urls.Rule("e", "^é", (), "block", 1)]).first().verdict == "block"


# ---- licences


def slow_dice(line, template):
    import regex

    def pairs(t):
        w = regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip().split(" ")
        return set(zip(w, w[1:]))

    a, b = pairs(line), pairs(template)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses_match_brute_force(docs):
    r, lines = random.Random(9), ["", "licensed", "Released!! under THE mit-license.", "released under the mit license " * 2000]
    for _, t in licenses.TEMPLATES:
        w = t.split()
        lines += [t, " ".join(w[:-1]), " ".join(w[1:]), " ".join(x for x in w if r.random() > 0.15), t + " and more", " ".join(reversed(w))]
    rows = [(k, "\n".join(("some prose here", x)), "en") for k, x in enumerate(lines)]
    out = licenses.scan(docs(rows + [(i and i + 1000, t, l) for i, t, l in ODD]))
    assert not any(x in plan(out) for x in NO_PYTHON)
    want = {}
    for k, x in enumerate(lines):
        best = min((-slow_dice(x, t), n) for n, t in licenses.TEMPLATES)
        if -best[0] >= 0.8:
            want[k] = (2, best[1], round(-best[0], 9))
    assert {m.doc_id: (m.line, m.license, round(m.dice, 9)) for m in out.collect()} == want
    assert licenses.scan(docs([])).count() == 0


# ---- exact search


@pytest.mark.parametrize("dims", [1, 7, 40])
def test_top_k_matches_brute_force(spark, dims):
    g = np.random.default_rng(dims)
    v = g.integers(-3, 4, (300, dims)) / 4 + 0.1
    v[200:] = v[:100]
    rows = [(int(k), v[k].tolist(), 0) for k in range(300)] + [(0, v[0].tolist(), 0)]
    odd = [(900, None, 0), (950, [float("nan")] * dims, 0), (1000, [None] * dims, 0), (1050, [float("inf")] * dims, 0), (1100, [], 0), (None, v[0].tolist(), 0), (1150, [0.5] * (dims + 1), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    clean = topk.clean_integers(df, "vec_id", "embedding", 256.0)
    got = {}
    for r in topk.top_k(clean, clean.where("id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    whole = np.floor(256 * v).astype(int)
    for q in range(0, 300, 50):
        want = sorted((-int(whole[q] @ whole[k]), k) for k in range(300) if k != q)[:5]
        assert sorted(got.pop(q)) == [(n, k, -s) for n, (s, k) in enumerate(want, 1)]
    assert not got  # 1150 has no other vector of its length
    assert topk.top_k(clean.limit(0), clean.limit(0)).count() == 0


def test_search_block_prunes_nothing_that_counts():
    g = np.random.default_rng(3)
    q, c = g.integers(-200, 200, (20, 64)), g.integers(-200, 200, (1500, 64))
    c[700:] = c[:800] // 3
    ids, got, score = topk.search_block(np.arange(20) + 5000, q, np.arange(1500), c, 5)
    for r in range(20):
        s = c @ q[r]
        want = np.lexsort((np.arange(1500), -s))[:5]
        assert got[ids == 5000 + r].tolist() == want.tolist() and score[ids == 5000 + r].astype(int).tolist() == s[want].tolist()
    huge = np.full((1, 2), 1 << 40)
    assert topk.search_block(np.array([1]), huge, np.array([2]), huge, 5)[2].tolist() == [2 << 80]


# ---- embeddings


@pytest.mark.parametrize("chunk", [16, 16384])
def test_embeddings_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embdedup, "CHUNK", chunk)
    g = np.random.default_rng(4)
    base = g.normal(size=(60, 40))
    v = np.concatenate([base, base[:30] + g.normal(0, 0.12, (30, 40)), base[:20] * 3, base[:1] + g.normal(0, 0.05, (60, 40)), base[5:6].repeat(20, 0)])
    rows = [(int(k), v[k].tolist(), 0) for k in range(len(v))]
    odd = [(900, None, 0), (901, [float("nan")] * 40, 0), (902, [None] * 40, 0), (903, [0.0] * 40, 0), (904, [], 0), (None, v[0].tolist(), 0), (905, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept int")
    got = {r.id: r for r in embdedup.near_duplicates(df).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(links, root[None], len(v)).min(1))
    assert [got[k].n_links for k in range(len(v))] == links.sum(1).tolist() and [got[k].component_id for k in range(len(v))] == root.tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903, 904, 905, None))
    assert [got[k].kept for k in range(len(v))] == (root == np.arange(len(v))).tolist()
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_an_id_with_two_vectors_is_one_node(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.id, r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()) == [(1, 1, 1), (5, 1, 1), (5, 1, 1), (7, 1, 1), (8, 0, 8)]


def test_rotation_keeps_distances():
    x = embdedup.unit(np.random.default_rng(5).normal(size=(50, 23)))
    assert np.allclose(embdedup.rotate(x) @ embdedup.rotate(x).T, x @ x.T)


# ---- components


def test_components_of_a_long_chain_and_a_star(spark):
    chain, star = [(k, k + 1) for k in range(100, 160)], [(500, 500 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 700)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
