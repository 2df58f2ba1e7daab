import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from balancebeam.llm import langid, quality, shingles
from balancebeam.llm.queries import ORACLES
from check import TABLES, canon
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables not present")


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    rel = con.sql(ORACLES[name])
    at = [list(rel.columns).index(c) for c in df.columns]
    want = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(canon(x) for x in r) for r in df.collect()), key=repr) == want


def sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_groups(texts):
    """The root of each text by pairs of similarity 0.8 or more, by brute force."""
    root, have = list(range(len(texts))), [sets(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (not have[a] and not have[b]) or len(have[a] & have[b]) >= 0.8 * len(have[a] | have[b]) > 0:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(texts))]


def jaccard_kept(rows):
    groups = {}
    for (i, t), root in zip(rows, jaccard_groups([t for _, t in rows])):
        groups.setdefault(root, []).append(i)
    return sorted(min((i for i in g if i is not None), default=0) for g in groups.values())


@here
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        if name == "language ID":  # each text by itself with the model that the stage fits
            model = langid.fit(docs)
            want = sorted(r.doc_id for r in before if not model.predict(r.text)[2])
        elif name == "quality classifier":
            model = quality.fit(docs, labels)
            want = sorted(r.doc_id for r in before if model.score(r.text) >= quality.THRESHOLD)
        else:
            want = jaccard_kept([(r.doc_id, r.text) for r in before])
        out = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert out.columns == corpus_pipeline.COLUMNS
        assert sorted(r.doc_id for r in out.collect()) == want and want
        docs = out
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    assert all(sum(p.length for p in pieces if p.doc_id == d) == n for d, n in {(p.doc_id, p.doc_tokens) for p in pieces})


def test_stages_take_odd_and_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(5, 1, 0), (7, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs(rows), str(tmp_path))
            assert out.count() <= (len(rows) if out.columns == corpus_pipeline.COLUMNS else 10**6)


def test_near_duplicate_stage_is_brute_force_jaccard(spark, docs):
    r = random.Random(11)
    rows = list(ODD)
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((4, 9, 60, 200)))]
        for j in range(5):  # near copies that differ in a few words; a copy of a copy drifts away
            rows.append((100 + 10 * k + j, " ".join(base), "en"))
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = f"x{r.randrange(10**6)}"
    notice = " ".join(f"n{i}" for i in range(40))
    rows += [(900 + k, f"{notice} {' '.join(f'y{k}.{i}' for i in range(k % 20))}", "en") for k in range(60)]

    want = jaccard_kept([(i, t) for i, t, _ in rows])
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(x.doc_id or 0 for x in stage(spark, docs(rows), "").collect()) == want


def test_texts_that_share_an_id_are_rows_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "k1"), (1, b, "k2"), (2, a, "k3"), (3, a + " more", "k4"), (1, a, "k5"), (None, b, "k6"), (None, "c d", "k7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = shingles.dedup(df)
    assert got.columns == ["doc_id", "text", "key"]  # a column of that name stays
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (1, b), (None, "c d")], key=repr)


def test_stars_over_batch_ends():
    r = random.Random(4)
    rows = sorted((r.randrange(12), r.randrange(6)) for _ in range(60)) + [(20, 5)] * 4 + [(21, 3), (21, 4), (21, 4), (22, 1)]
    want = set()
    for t in {t for t, _ in rows}:
        hs = {h for u, h in rows if u == t}
        want |= {(t, h, min(hs)) for h in hs} if len(hs) > 1 else set()
    for size in (1, 2, 3, 7, 100):
        batches = [pa.record_batch({"token": pa.array([t for t, _ in rows[k : k + size]], pa.int64()), "h": pa.array([h for _, h in rows[k : k + size]], pa.int64())}) for k in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in shingles._stars(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_bands_and_sketches_lose_no_similar_pair():
    g = np.random.default_rng(9)
    lost = 0
    for _ in range(400):
        n = int(g.integers(20, 400))
        both = g.integers(0, 1 << 63, n).astype(np.uint64)
        extra = g.integers(0, 1 << 63, int(n / 0.8 - n)).astype(np.uint64)
        cut = int(g.integers(0, len(extra) + 1))
        low = [shingles.minima(np.unique(np.concatenate((both, x)))) for x in (extra[:cut], extra[cut:])]
        shared = (shingles.bands(low[0]) == shingles.bands(low[1])).any()
        lost += not (shared and (shingles.sketch(low[0]) == shingles.sketch(low[1])).mean() >= shingles.least_agreement(0.8))
    assert not lost


def test_groups_that_share_bands_but_not_links(spark, docs, monkeypatch):
    """Many variants of one text, most of them less similar than asked for: blocks meet in tasks, whatever the size of the chunks."""
    r = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"g{g}.{k}" for k in range(120)]
        for k in range(40):
            w = list(base)
            for _ in range(r.choice((1, 2, 4))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(w), "en"))
    want = jaccard_kept([(i, t) for i, t, _ in rows])
    assert 4 < len(want) < len(rows)
    for chunk, weight, columns in ((shingles.CHUNK, shingles.WEIGHT, shingles.COLUMNS), (5, 900, 64)):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        monkeypatch.setattr(shingles, "WEIGHT", weight)
        monkeypatch.setattr(shingles, "COLUMNS", columns)
        assert sorted(x.doc_id for x in shingles.dedup(docs(rows)).collect()) == want


def test_simhash_trie_gives_candidates_of_its_own(spark, docs, monkeypatch):
    """Without a band in common, near copies within two bits still meet, and whole sets decide on them."""
    r = random.Random(8)
    texts = []
    for g in range(30):
        base = [f"g{g}.{r.randrange(500)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    prints = [shingles._print(shingles.shingle_set(t)) for t in texts]
    close = [((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in zip(prints[::2], prints[1::2])]
    assert any(close) and not all(close)
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(100, texts[0].upper(), "en"), (101, " ", "en"), (102, None, "en")]
    monkeypatch.setattr(shingles, "bands", lambda low: np.frombuffer(os.urandom(8 * shingles.BANDS), np.uint64))
    want = sorted(set(range(60)) - {2 * k + 1 for k in range(30) if close[k]}) + [101]
    assert sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs(rows), "").collect()) == want


def test_runs_over_batch_ends_and_shared_counts():
    r = random.Random(6)
    rows = sorted((r.randrange(3), r.randrange(4), k) for k in range(50))
    want = {}
    for a, b, k in rows:
        want.setdefault((a, b), []).append(k)
    for size in (1, 2, 7, 100):
        batches = [pa.record_batch({n: pa.array([x[i] for x in rows[k : k + size]], pa.int64()) for i, n in enumerate("abk")}) for k in range(0, len(rows), size)]
        assert [t.column(0).to_pylist() for t in shingles._runs(iter(batches), 2)] == list(want.values())
    some = [np.unique(np.array([r.randrange(300) for _ in range(r.randrange(1, 200))], np.uint64)) for _ in range(9)]
    got = shingles.shared_counts(some)
    assert all(got[i, j] == len(np.intersect1d(some[i], some[j])) for i in range(9) for j in range(9) if i != j)
