import hashlib
import random
import re
import zlib
from math import floor, log

import numpy as np
import pytest

from balancebeam.llm import convtrie, lexical, lshsearch
from tests.llm.conftest import ODD

# ---- approximate nearest neighbours


def best_by_hand(rows, k, every):
    """query id -> [(score, id)]: the best pair of each other id, over vectors of one length."""
    want = {}
    for i, a in rows:
        if i % every:
            continue
        best = want.setdefault(i, {})
        for j, b in rows:
            if j != i and len(a) == len(b):
                best[j] = max(best.get(j, -np.inf), float(np.dot(a, b)))
    return {i: sorted((-s, j) for j, s in best.items())[:k] for i, best in want.items()}


@pytest.mark.parametrize("cells", [1 << 21, 600])
def test_neighbours_recall_and_exact_scores(spark, monkeypatch, cells):
    monkeypatch.setattr(lshsearch, "CELLS", cells)
    monkeypatch.setattr(lshsearch, "shard_rows", lambda d: max(40, cells // max(1, d)))
    g = np.random.default_rng(8)
    v = np.concatenate([g.normal(size=(700, 12)), g.normal(size=(60, 12)) * 40, g.normal(size=(400, 12)) * 0.01 + 1, np.ones((40, 12))])
    rows = [(int(k), x.tolist()) for k, x in enumerate(v)] + [(3000 + k, g.normal(size=3).tolist()) for k in range(45)]
    rows += [(5, v[5].tolist()), (20, (v[20] * -1).tolist()), (20, v[20].tolist())]  # a repeated row, an id with two vectors
    odd = [(900000, None), (900020, [float("nan")] * 12), (900040, [None] * 12), (900060, [0.0] * 12), (900080, []), (None, v[0].tolist()), (900100, [float("inf")] * 12), (900120, [1.0] * 5)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows + odd], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in lshsearch.nearest(df, 7, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    want = best_by_hand(rows, 7, 20)
    assert set(got) == {i for i, best in want.items() if best}  # 900120 is alone with its length
    vectors = {}
    for i, x in rows:
        vectors.setdefault(i, []).append(x)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and len({i for _, i, _ in found}) == len(found) <= 7 and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(max(float(np.dot(a, b)) for a in vectors[q] for b in vectors[i] if len(a) == len(b)), rel=1e-12, abs=1e-12)
        floor_score = -want[q][-1][0]
        hits += sum(s >= floor_score - 1e-9 for _, _, s in found)  # ties are as near
        total += len(want[q])
    assert hits >= 0.9 * total
    assert lshsearch.nearest(df.limit(0)).count() == 0


def test_a_bucket_beyond_a_shard_is_dealt_as_chunks(spark, monkeypatch):
    monkeypatch.setattr(lshsearch, "shard_rows", lambda d: 16)
    g = np.random.default_rng(2)
    rows = [(k, ([1.0, 0.0, 0.0, 0.0] if k % 3 == 0 else g.normal(size=4)).tolist() if k % 3 else [1.0, 0.0, 0.0, 0.0]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in lshsearch.nearest(df, 5, 60).collect()}
    for q in (0, 60, 120):  # copies of one vector: the smallest ids among those that tie
        assert all(s >= 1 for (x, _), (_, s) in got.items() if x == q)
    assert {q for q, _ in got} == {0, 60, 120, 180, 240} and len(got) == 25


def test_buckets_are_visited_by_estimated_success():
    g = np.random.default_rng(0)
    unit = lshsearch.norms(g.normal(size=(3000, 16)))[0]
    space = lshsearch.new_space(16, 3000, 1.0, unit, np.ones(3000))
    near = unit[:50] + g.normal(size=(50, 16)) * 0.05
    u, n, _ = lshsearch.norms(near)
    lshsearch.calibrate(space, unit[:50], np.arange(50), u, np.minimum(n, 1) * 0 + 1, 0.95)
    few, many = space.order(unit[:50], 4), space.order(unit[:50], 64)
    assert (few == many[:, :, :4]).all()
    assert all(len(set(row)) >= 60 for row in many[:, 0])  # clipped slots may repeat a code, nothing else
    codes = space.codes(u, np.ones(50))
    assert (space.order(unit[:50], space.probes) == codes[..., None]).any(2).any(1).mean() >= 0.95
    assert np.abs(lshsearch.below(np.array([0.0, 1.0, -2.0])) - [0.5, 0.8413447, 0.0227501]).max() < 1e-6


# ---- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, n_words = sum(bool(w) for w in words), sum(map(len, words))
    out = []
    for item, text in items:
        want, scores = terms(text), []
        weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * sum(t in w for w in map(set, words)) + 1))) for t in set(want)}
        for (doc, _), w in zip(docs, words):
            m = 75 + 25 * len(w) * n_docs // n_words if w else 0
            score = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in want if t in w)
            if score:
                scores.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_is_brute_force(spark, docs, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ODD) + [(100 + k, " ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=r.randint(0, 60))), "en") for k in range(500)]
    rows += [(1000 + k, "The SAME text, Ünicode wörter-w7 w399 w399", "en") for k in range(90)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for k in range(60)]
    items += [(70, None), (71, ""), (72, "!!"), (None, "w1 w399"), (73, "the the THE same ünicode Ünicode"), (0, "w5 w6"), (74, rows[30][1]), (75, "absent"), (76, "wort " * 2000)]
    table = docs([(i, t, "x") for i, t, _ in rows])
    asked = spark.createDataFrame([*((i, t, 1) for i, t in items), (0, "w5 w6", 1)], "item_id long, text string, rank int")
    want = ranked_by_hand([(i, t) for i, t, _ in rows], items, 20)
    got = lambda: sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in lexical.search(table, asked).collect()), key=repr)
    assert got() == want
    monkeypatch.setattr(lexical, "ITEMS", 20)  # several blocks of items
    assert got() == want
    assert lexical.search(docs([]), asked).count() == 0 and lexical.search(table, asked.limit(0)).count() == 0


@pytest.mark.parametrize("greedy", [False, True])
def test_a_tree_finds_the_best_and_prunes(monkeypatch, greedy):
    g = np.random.default_rng(1)
    for name, size in (("LEAF", 4), ("FAN", 3), ("ITEM_LEAF", 2)):
        monkeypatch.setattr(lexical, name, size)
    weight = g.integers(1, 9000, 50)
    counts = [{int(t): int(g.integers(1, 4)) for t in g.choice(50, 5, replace=False)} for _ in range(17)]
    lists = [np.sort(g.choice(50, g.integers(1, 6), replace=False)) for _ in range(200)]
    lists.sort(key=lambda t: sorted(-weight[t])[:2])
    impact = [g.integers(1, 10**6, len(t)) for t in lists]
    best, items = lexical.Best(np.zeros(17, np.int64), 5), lexical.Items(counts, weight)
    lexical.search_tree(items, best, np.arange(200), np.concatenate(lists), np.concatenate(impact), np.array(list(map(len, lists))), greedy)
    for k, c in enumerate(counts):
        scores = sorted((-sum(c.get(int(t), 0) * int(weight[t]) * int(x) for t, x in zip(ts, xs)), d) for d, (ts, xs) in enumerate(zip(lists, impact)))
        want = [(-s, d) for s, d in scores[:5] if s]
        have = list(zip(best.score[best.item == k].tolist(), best.id[best.item == k].tolist()))
        if greedy:  # true scores, so the weakest of them is a lower bound
            assert set(have) <= {(-s, d) for s, d in scores}
        else:
            assert have == want


def test_large_counts_stay_exact():
    items = lexical.Items([{0: 1 << 40}], np.array([9000]))
    assert items.kind is np.int64
    assert lexical.impacts(np.array([3]), np.array([1 << 40]), 1 << 40, 1 << 41).tolist() == [3_000_000_000 // (3000 + 12 * (75 + (25 << 80) // (1 << 41)))]


# ---- conversation trie


def trie_by_hand(rows):
    seqs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            seqs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(s)] for c, s in seqs.items()}
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + s[h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below),
                    sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_is_brute_force(spark):
    r = random.Random(6)
    rows = []
    for c in [*range(0, 66), -1, -20, -41, 400, 403, 1007]:
        for n in range(r.choice((1, 2, 3, 3, 4, 5, 9))):
            rows.append((c, n, r.choice(("user", "assistant")), r.choice(("a b", "a  b\tc", "x", ""))))
    rows += [(2000, n, "user", f"t{n // 40}") for n in range(70)] + [(2020, n, "user", f"t{n // 40}") for n in range(70)] + [(2040, n, "user", f"t{n // 41}") for n in range(37)]
    rows += [(3000, None, None, None), (3000, None, "b", "tie"), (3000, 0, "", "a b"), (3000, 0, "a", "tie"), (None, 0, "user", "no id"), (3001, 5, "user", "only"), (3001, 5, "user", "only"), (5000, 1, "1:u", "s"), (5020, 1, "1", ":us")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, depth int")
    got = convtrie.conversation_trie(df)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == trie_by_hand(rows)
    assert convtrie.conversation_trie(df.limit(0)).count() == 0
    assert convtrie.conversation_trie(df.where("conv_id is null")).count() == 0


def test_members_without_turns_and_a_single_path(spark):
    turns = spark.createDataFrame([(7, k + 1, bytes([k]), 2) for k in range(8)], "conv long, pos long, digest binary, words long")
    members = spark.createDataFrame([(7, 8), (3, 0), (9, 0)], "conv long, len long")
    got = {(x.depth, x.conv_id): x for x in convtrie.prefix_trie(turns, members).collect()}
    assert len(got) == 9 and got[0, 3].n_convs == 3 and got[0, 3].n_leaves == 1 and got[0, 3].n_children == 1 and got[8, 7].n_children == 0 and got[1, 7].parent_conv_id == 3
    assert got[0, 3].ends_sha256 == hashlib.sha256(b"3,9").hexdigest() and got[8, 7].ends_sha256 == hashlib.sha256(b"7").hexdigest()
