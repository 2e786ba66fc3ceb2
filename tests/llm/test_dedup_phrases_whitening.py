"""MinHash near-dedup, phrase collocations and embedding whitening against brute force and hard inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from test_training_data import hard, shingles

from lectern.llm import common, jaccard_join, minhash, phrases, whitening


def test_signatures_agree_as_sets_do():
    """Places agree with the sets' similarity, short sets too, whose ranges are nearly all borrowed."""
    rng = np.random.default_rng(1)
    for n, differ in ((8, 1), (60, 9), (3000, 300)):
        agree, true = [], []
        for _ in range(60):
            pool = rng.integers(0, 2**63, n + differ, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(pool[differ:])
            agree.append(np.mean(minhash.signature(a) == minhash.signature(b)))
            true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.05)
    one = np.array([5], dtype=np.uint64)
    assert (minhash.signature(one) == 5).all() and (minhash.bands(one) == minhash.bands(one)).all()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    """Families whose members are near their base and not near each other, short texts, copies and hard rows."""
    rng = random.Random(k)
    texts = []
    for n in (6, 9, 14, 40, 80, 80, 300):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 2 + n // 60)):
                t[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts += [" ".join(t)] * rng.choice([1, 1, 2])
    # a chain: each text loses words at one end, so that neighbours link and the ends do not
    line = [f"c{i}" for i in range(160)]
    texts += [" ".join(line[i : i + 100]) for i in range(0, 60, 4)]
    docs = hard(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    rows = [(r["doc_id"], shingles(r["text"], k)) for r in docs.collect() if r["doc_id"] is not None]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = minhash.near_duplicates(docs.withColumn("key", F.lit(1)).withColumn("mark", F.lit(2)), k, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == sorted((d, len(s), root(d), root(d) == d) for d, s in rows)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert len({root(d) for d, _ in rows}) > 20


def test_no_near_duplicates(spark):
    assert minhash.near_duplicates(hard(spark).limit(0)).count() == 0


def collocations(rows, least, top):
    """What the operator returns, by plain loops; rows: text, lang."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for q in (p[:2], p[1:]) if len(p) == 3 else ():
                longer[q] = max(longer[q], a)
        own = []
        for p, a in found.items():
            if not (longer[p] and 100 * longer[p] >= 50 * a):
                score, cut = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def some_texts(rng, n):
    words = ["New", "york", "the", "of", "é😀", "a\x1cb", "x" * 60, "\x00", "city", "Émile"]
    return [" ".join(rng.choice(words[: rng.choice([3, 6, 10])]) + rng.choice(["", "", "", ".", ",\n", "\t", " z"]) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


def test_collocations_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(t, rng.choice(["en", "fr", None])) for t in some_texts(rng, 60)] + [(None, "en"), ("", "de"), ("one two", "es"), ("a b " * 30_000, "it")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).repartition(5)
    for top in (2000, 4):
        got = phrases.collocations(docs, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == collocations(rows, 10, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_trie_bursts_and_spills(monkeypatch, k):
    """Containers that burst, tries that spill and prefixes that are hot change no count."""
    monkeypatch.setattr(phrases, "BURST", 20)
    rng = random.Random(k)
    texts = some_texts(rng, 40)
    everything, nothing = np.full(1 << 17, 255, np.uint8), np.zeros(1 << 17, np.uint8)
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.lower().replace("é", "é")):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(w[i : i + k]).encode() for i in range(len(w) - k + 1))
    for hot in (everything, nothing):
        c, got, parts, widest = phrases._Counter("en", k, everything, hot, 7), Counter(), {}, 0
        spills = 0
        for i, t in enumerate(texts):
            c.held += [*phrases.tokens(t.lower().encode()), b"."]
            if i % 3 == 0:
                c.count()
            widest = max(widest, len(c.trie.containers))
            if i % 11 == 0 or i == len(texts) - 1:
                spills += 1
                for batch in c.spilled():
                    for _, part, run, n in zip(*(x.to_pylist() for x in batch.columns)):
                        assert run == sorted(run)
                        for p, x in zip(run, n):
                            got[p] += x
                            prefix = p if hot is everything else p.split(b" ")[0]
                            assert parts.setdefault(prefix, part) == part  # one part for a prefix, whatever the task
        total = got.pop(b"", None)
        assert got == want and spills > 3 and (widest > 1 or k == 1)
        assert total == (sum(want.values()) if k == 1 else None)


def test_containers_keep_branches():
    """A trie's directory parts the codes in order, at borders of whole branches."""
    rng = np.random.default_rng(4)
    trie = phrases.HatTrie(2)
    codes = rng.integers(1, 400, 300_000) << phrases.BITS | rng.integers(1, 3000, 300_000)
    for part in np.array_split(codes, 7):
        trie.add(part)
    found = [run for run, _ in trie.runs()]
    assert len(found) > 2 and (np.concatenate(found) == np.unique(codes)).all()
    assert sum(int(n.sum()) for _, n in trie.runs()) == len(codes)
    assert all(int(b) % (1 << phrases.BITS) == 0 for b in trie.borders)
    assert pc.sum(trie.containers[0].table["n"]).as_py() > 0


def whitened(rows, components=32):
    x = np.floor(64 * np.array(rows, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return x, ((n * x - s) ** 2).sum(axis=1), c @ v[:, :components] / np.sqrt(e[:components]), e / e.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist()), (None, [0.5] * 5)]
    dropped = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("-inf")] + [0.0] * 4), (905, [1.0, 2.0])]
    table = spark.createDataFrame(rows + dropped, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")).repartition(4)
    got = whitening.whiten(table).collect()
    _, deviation, want, share = whitened([v for _, v in rows])
    assert len(got) == len(rows) * 5 and {r["n"] for r in got} == {len(rows)}
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in rows for _ in range(5))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    of = {r[0]: k for k, r in enumerate(rows)}
    sign = {}
    for r in sorted(got, key=lambda r: (r["component"], r["vec_id"] or 0)):
        k, c = of[r["vec_id"]], r["component"] - 1
        k = 7 if r["vec_id"] == 7 else k
        assert r["deviation"] == deviation[k] and r["explained"] == pytest.approx(share[c], rel=1e-9)
        flip = sign.setdefault(c, np.sign(r["whitened"] * want[k, c]))
        assert r["whitened"] * flip == pytest.approx(want[k, c], abs=1e-7)


def test_whitening_in_blocks(spark, monkeypatch):
    """Several row and column blocks, dealt to several tasks, give the same products."""
    for name, value in (("ROWS", 16), ("COLS", 4), ("TASK_ROWS", 20)):
        monkeypatch.setattr(whitening, name, value)
    vectors = np.random.default_rng(7).normal(size=(70, 10))
    out = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), components=6)
    got = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in out.collect()}
    want = whitened(vectors, 6)[2]
    assert len(got) == 420 and all(v == pytest.approx(abs(want[i, c - 1]), abs=1e-8) for (i, c), v in got.items())


def test_whitening_without_spread(spark):
    schema = "vec_id string, embedding array<double>"
    for rows in ([("a", [1.0, 2.0])], [("a", [1.0, 2.0])] * 3):
        got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, 0.0, 0.0)} and len(got) == 2 * len(rows)
    line = whitening.whiten(spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], schema)).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: r["component"])] == [False, False, True, True]
    none = whitening.whiten(spark.createDataFrame([("a", None)], schema))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_scratch_deletes(spark):
    import os

    with common.scratch():
        kept = common.settle(spark.range(3), "kept", keep=True)
        gone = common.settle(spark.range(3), "gone")
        assert gone.count() == 3
    at = lambda t: t.settled_at.removeprefix("file:")
    assert os.path.exists(at(kept)) and not os.path.exists(at(gone))
    common.discard(kept)
    assert not os.path.exists(at(kept))


def test_one_of_each_keeps_columns(spark):
    names = ["_mark", "mark", "kept", "row", "hashed", "component", "key", "n", "rep"]
    docs = hard(spark)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    out = jaccard_join.one_of_each(docs, 3, 85)
    assert out.columns == docs.columns and out.count() == 8
    assert {tuple(r) for r in out.select(names).collect()} == {tuple(range(len(names)))}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        jaccard_join.jaccard_components(spark.createDataFrame([("a", "x y")], "doc_id string, text string")).collect()
