import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from balancebeam.llm import bpe, langid, packing, quality, simhash
from balancebeam.llm.wordids import file_encoder
from tests.llm.conftest import ODD

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = "ab é\n\n  \t'sß漢😀1٣²!?.,;\x1c\x85\xa0 \u200b\r"


def scraps(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def multi():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- byte-level BPE


def test_transducer_is_the_encoding(multi):
    enc = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for t in scraps(1500) + [x for _, x, _ in ODD if x] + ["antidisestablishmentarianism's Übergrößenträger", "ab" * 2000, "\n" * 500]:
        assert list(memoryview(enc.encode(t)).cast("I")) == multi.encode_ordinary(t)
    t = enc.transducer
    for (a, b), ok in list(t.memo_pair.items())[:3000]:
        assert ok == (t.merge(a + b) == [a, b])


def test_utf8_machine_streams_any_bytes():
    machine, r = bpe.Utf8({i: bytes((i,)) for i in range(256)}), random.Random(2)
    for data in ("é漢😀x".encode(), "é漢😀".encode()[:-1], bytes(r.randrange(256) for _ in range(5000)), b""):
        assert "".join(machine.stream(data)) == data.decode("utf-8", "replace")


def test_bpe_round_trip(docs, multi):
    coded = bpe.encode(docs(ODD), RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.id or 0, r.text) for r in rows) == sorted((i or 0, t or "") for i, t, _ in ODD)
    assert all(list(memoryview(bytes(r.ids)).cast("I")) == multi.encode_ordinary(r.text) for r in rows)
    assert bpe.decode(bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


# ---- packing


def test_encoder_gives_the_files_ids():
    enc, tok = file_encoder(JSON), Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    texts = scraps(1500, 3) + ["it's, don't. <|endoftext|>, x.", "a. ", "\n a", "é., b", "a\n\ns", "a" * 200_000, "a" + " " * 1_200_000 + "b", "\n" * 150_000]
    assert [list(enc(t)) for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_id_once(docs):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "riverbank", "quartz", "nimbus"]
    rows = ODD + [(100 + k, " ".join(r.choice(words) for _ in range(r.randint(1, 400))), "en") for k in range(150)]
    tok, whole = Tokenizer.from_file(JSON), {}
    for i, t, _ in rows:
        whole.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    got = packing.pack(docs(rows), JSON, window=128, shard=16).collect()
    seen, sequences = {}, {}
    for p in got:
        ids = list(memoryview(bytes(p.ids)).cast("I"))
        assert len(ids) == p.length and any(len(w) == p.doc_tokens and w[p.start : p.start + p.length] == ids for w in whole[p.doc_id])
        seen.setdefault(p.doc_id, []).extend(ids)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {i: sorted(x for w in v for x in w) for i, v in whole.items()} == {i: sorted(v) for i, v in seen.items()}
    short = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        short += sum(n for _, n in parts) < 128
    assert short <= 4  # the last of each task
    assert packing.pack(docs([]), JSON).count() == 0


def test_index_returns_bm25_neighbours():
    tails = [np.array(x) for x in ([1, 2, 3], [7, 8], [1, 2, 9], [1, 5, 5], [7, 7, 8, 3])]
    idf = packing.bm25_idf(np.array([0, 3, 2, 2, 0, 1, 0, 2, 2, 1]), 5)
    index = packing.Shard(tails, idf, np.mean([len(t) for t in tails]))

    def plain(seed, d):
        t, c = np.unique(tails[d], return_counts=True)
        mean = np.mean([len(x) for x in tails])
        return sum(idf[a] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tails[d]) / mean)) for a, n in zip(t, c) if a in set(tails[seed]))

    for seed in range(5):
        assert np.allclose(index.scores(seed), [plain(seed, d) for d in range(5)])
    assert list(index.neighbours(0, np.array([True, True, True, False, True])))[0] == 2


def test_index_scores_every_term_of_a_seed():
    g = np.random.default_rng(12)
    tails = [np.unique(g.integers(0, 300, 120)) for _ in range(12)]
    df = np.bincount(np.concatenate(tails), minlength=300)
    idf, mean = packing.bm25_idf(df, 12), np.mean([len(t) for t in tails])
    index = packing.Shard(tails, idf, mean)
    for seed in range(12):
        want = [sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(x.tolist()) & set(tails[seed].tolist())) for x in tails]
        assert np.allclose(index.scores(seed), want)


def test_related_tails_meet_in_a_shard(docs):
    r = random.Random(13)
    vocab = sorted((i, t[1:]) for t, i in Tokenizer.from_file(JSON).get_vocab().items() if len(t) > 4 and t[0] == "Ġ" and t[1:].isascii() and t[1:].islower() and t[1:].isalpha())
    plain, late = [t for _, t in vocab[:40]], [t for _, t in vocab[-200:]]  # two of the highest ids in each document, whatever its topic
    rows = [(k, " " + " ".join([*r.sample(late, 2), *r.choices(plain[k % 8 :: 8], k=20)]), "en") for k in range(640)]
    r.shuffle(rows)
    windows = {}
    for p in packing.pack(docs(rows).repartition(1), JSON, window=128, shard=32).collect():
        windows.setdefault(p.sequence_id, []).append(p.doc_id % 8)
    pieces = sum(len(v) for v in windows.values())
    assert sum(max(v.count(t) for t in range(8)) for v in windows.values()) > 0.85 * pieces


# ---- SimHash


def slow_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(fps, budget):
    ids = sorted({i for i, _ in fps if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, f in fps:
        for b, g in fps:
            if a is not None and b is not None and (f ^ g).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("node_rows", [1, 16, 4096])
def test_simhash_matches_brute_force(docs, node_rows):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = ODD + [(100 + k, r.choice(base).upper() if k % 3 else r.choice(base) + " k", "en") for k in range(150)]
    out = simhash.near_duplicates(docs(rows), budget=2, node_rows=node_rows).collect()
    fps = [(r.id, r.fp % (1 << 64)) for r in out]
    assert sorted(f for _, f in fps) == sorted(slow_fingerprint(t) for _, t, _ in rows)
    want = slow_components(fps, 2)
    assert {r.id: r.component_id for r in out if r.id is not None} == want and len(out) == len(rows)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_links_are_all_links(budget):
    g = np.random.default_rng(6)
    near = g.integers(0, 1 << 63, 40, dtype=np.uint64)
    a = np.unique(np.concatenate([near] + [near ^ (np.uint64(1) << g.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]))
    got = set()
    for home in range(4):
        for i, j in simhash.trie_links(a, 2, budget, home):
            got |= {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= budget}
    assert got == want


def test_dedup_keeps_one_of_each(docs):
    kept = simhash.dedup(docs([*ODD, (20, "TWICE", "en"), (21, "three words here now", "en")]))
    rows = kept.collect()
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 4, 5, 6, 7, 8, 9, 21]  # 1, 2 and 3 hold no word; 5 and 20 are copies
    assert simhash.dedup(docs([])).count() == 0


# ---- language and quality


def test_language_held_out_and_odd_rows(docs):
    r = random.Random(7)
    words = {"aa": ["kala", "maki", "tora", "nuki", "sato"], "bb": ["schnur", "brecht", "ungst", "keit", "floss"], "cc": ["thing", "wherry", "oughts", "stead", "lythe"]}
    rows = [(k, " ".join(r.choice(words[l]) for _ in range(r.randint(3, 60))), l) for k, l in enumerate(r.choices("aa bb cc".split(), k=400))]
    frame = docs(rows)
    model = langid.fit(frame.where("doc_id < 300"), epochs=6)
    out = langid.predict(docs([*rows[300:], *[(i and i + 1000, t, l) for i, t, l in ODD]]), model)
    assert out.columns == [c for c in frame.columns if c not in ("score", "rejected")] + ["lang_pred", "score", "rejected"]
    got = out.collect()
    tested = [x for x in got if x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.lang_pred == x.lang for x in tested) >= 0.97 * len(tested) and sum(x.rejected for x in tested) <= 2
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert und == {1001, 1002, 1003, 1004} and all(0 <= x.score <= 1 for x in got)
    again = langid.predict(docs(rows[300:310]), langid.fit(frame.where("doc_id < 300"), epochs=6)).collect()
    assert {x.doc_id: x.score for x in again} == {x.doc_id: x.score for x in tested if x.doc_id < 310}
    blank = langid.fit(docs([]))
    assert [x.lang_pred for x in langid.predict(docs(ODD), blank).collect()] == ["und"] * len(ODD)


def test_texts_of_an_unlearned_language_are_rejected(docs):
    r = random.Random(12)
    tongues = {"en": "the of and ing that with which ould ight".split(), "de": "der und sch ein nicht ung lich keit ß".split(), "fr": "le que eau ette tion ç eux ment est".split()}
    say = lambda l: " ".join("".join(r.choice(tongues[l]) for _ in range(r.randint(1, 3))) for _ in range(r.choice((12, 60, 400))))
    rows = [(k, say(l), l) for k, l in ((k, r.choice(list(tongues))) for k in range(600))]
    model = langid.fit(docs([x for x in rows[:400] if x[2] != "fr"]))
    out = langid.predict(docs(rows[400:]), model).collect()
    foreign, own = [x.rejected for x in out if x.lang == "fr"], [x.rejected for x in out if x.lang != "fr"]
    assert sum(foreign) >= 0.9 * len(foreign) > 0 and sum(own) <= 0.02 * len(own)
    k, counts = 0, langid.subword_counts(rows[0][1])  # familiarity from the model's arrays, plainly
    mean = sum(int(c) * float(model.frequencies[k, i]) for i, c in enumerate(counts)) / int(counts.sum())
    want = (mean - model.centre[k]) / (model.spread[k, 0] + model.spread[k, 1] / int(counts.sum())) ** 0.5
    assert abs(model.familiarity(counts, k) - want) < 1e-9


def test_quality_held_out_and_odd_rows(docs, spark):
    r = random.Random(8)
    say = lambda: [r.choice("lorem ipsum dolor sit amet elit sed".split()) for _ in range(r.randint(5, 40))]
    rows, marks = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, " ".join(w.upper() + "!!" for w in say()) if bad else " ".join(say()) + ".", "en"))
        marks.append((k, 0 if bad else 1))
    labels = spark.createDataFrame([*marks, (1, 1), (None, 0), (9999, None)], "doc_id long, quality int")
    model = quality.fit(docs(rows), labels.where("doc_id < 300 or doc_id is null"))
    got = {x.doc_id: x for x in quality.score(docs([*rows[300:], *[(i and i + 1000, t, l) for i, t, l in ODD]]), model).collect()}
    assert all(got[k].predicted == m for k, m in marks[300:]) and all(0 <= x.score <= 1 for x in got.values())
    assert got[1001].score == got[1002].score == got[1003].score
    f, n = quality.features(rows[301][1])
    z = model.bias + quality.SCALE / n * sum(float(model.weights[k]) for k in f)
    assert abs(got[301].score - 1 / (1 + np.exp(-z))) < 1e-4
    empty = quality.fit(docs([]), labels.limit(0))
    assert {x.score for x in quality.score(docs(ODD), empty).collect()} == {0.5}


def test_ftrl_updates_follow_the_rule():
    leader, plain, z, n = quality.Ftrl(3, 0.5, 1.0, 0.0, 0.1), [0.0] * 4, [0.0] * 4, [0.0] * 4
    for at, x, y in (([0, 2], [1.0, 2.0], 1.0), ([2], [1.5], 0.0), ([0, 1], [0.5, 1.0], 1.0)):
        leader.update(np.array(at), np.array(x), y)
        at, x = [*at, 3], [*x, 1.0]
        p = 1 / (1 + np.exp(-sum(plain[k] * v for k, v in zip(at, x))))
        for k, v in zip(at, x):
            g = (p - y) * v
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.5 * plain[k]
            n[k] += g * g
            plain[k] = -z[k] / ((1 + n[k] ** 0.5) / 0.5 + 0.1)
    assert np.allclose(leader.weights(np.arange(4)), plain)


def test_held_out_rule_is_crc32(spark):
    from balancebeam.llm.queries import remainder

    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 5 for r in spark.range(50).withColumnRenamed("id", "doc_id").withColumn("m", remainder(5)).collect())
