"""Near copies: signatures against exact similarities, and texts that share a template but are no copies."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tripforge.llm import near_copies as N

SCHEMA = "key long, text string"


def test_agreeing_counts_equal_nibbles(spark):
    draw = np.random.default_rng(1)
    a = draw.integers(0, 16, (50, N.BANDS * N.ROWS))
    b = np.where(draw.random(a.shape) < 0.7, a, draw.integers(0, 16, a.shape))

    def packed(row):
        out = [0] * N._LONGS
        for k, v in enumerate(row):
            out[k // 16] |= int(v) << (4 * (k % 16))
        return np.array(out, np.uint64).view(np.int64).tolist()

    rows = spark.createDataFrame([(i, packed(x), packed(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<long>, b array<long>")
    got = {r.i: r.n for r in rows.select("i", N.agreeing(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == dict(enumerate((a == b).sum(1).tolist()))


def test_signatures_keep_pairs_at_the_threshold_and_drop_those_of_a_template():
    draw, kept = random.Random(3), {0.8: 0, 0.55: 0}
    for similar in kept:
        for _ in range(300):
            both, own = int(900 * similar), (900 - int(900 * similar)) // 2
            ids = np.array([draw.getrandbits(64) for _ in range(both + 2 * own)], np.uint64)
            left, right = ids[: both + own], np.concatenate([ids[:both], ids[both + own :]])
            _, marks = N.band_keys(np.concatenate([left, right]), np.array([0, len(left)]))
            nibbles = [[int(v >> np.uint64(4 * (k % 16))) & 15 for k, v in ((k, m[k // 16]) for k in range(N.BANDS * N.ROWS))] for m in marks]
            kept[similar] += sum(x == y for x, y in zip(*nibbles, strict=True)) >= N.AGREE
    assert kept[0.8] >= 299 and kept[0.55] <= 20


def test_templated_texts_are_told_apart_by_their_signatures(spark, monkeypatch):
    draw, n = random.Random(7), 1200
    template = [f"t{draw.randint(0, 10**6)}" for _ in range(300)]
    texts = [" ".join(template + [f"o{draw.randint(0, 10**6)}" for _ in range(120)]) for _ in range(n)]
    copies = [" ".join([*texts[k].split()[:-5], "new", "end"]) for k in range(0, 60, 3)]
    rows = spark.createDataFrame(list(enumerate(texts + copies)), SCHEMA).repartition(8)
    tested, verify = [], N._verified

    def counted(pairs, texts):
        tested.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(N, "_verified", counted)
    began = time.time()
    merged = {r.root: r.merged for r in N.near_copy_roots(rows, rows.select("key", F.col("key").alias("root"))).collect()}
    print(f"{n} texts: {time.time() - began:.0f} s, {sum(tested)} of {n * (n - 1) // 2} pairs verified")
    groups = {}
    for root, to in merged.items():
        groups.setdefault(to, set()).add(root)
    assert sorted(map(sorted, groups.values())) == [[k, n + i] for i, k in enumerate(range(0, 60, 3))]
    assert sum(tested) <= 0.06 * n * (n - 1) / 2


def test_copies_of_one_text_are_joined_by_it_and_not_by_their_pairs(spark, monkeypatch):
    draw, n = random.Random(11), 300
    words = [f"t{k}" for k in range(150)]
    texts = []
    for k in range(n):
        text = list(words)
        for i in draw.sample(range(len(text)), 2 + k % 3):
            text[i] = f"o{draw.randint(0, 10**6)}"
        texts.append(" ".join(text))
    texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(8)
    tested, verify = [], N._verified

    def counted(pairs, texts):
        tested.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(N, "_verified", counted)
    merged = {r.root: r.merged for r in N.near_copy_roots(rows, rows.select("key", F.col("key").alias("root"))).collect()}
    sets = [set(N.shingles([t.encode()])[0].tolist()) for t in texts]
    want = list(range(n + 1))
    for a in range(n + 1):
        for b in range(a):
            if len(sets[a] & sets[b]) >= N.SIMILAR * len(sets[a] | sets[b]) - 1e-9:
                want = [want[b] if w == want[a] else w for w in want]
    got = [merged.get(k, k) for k in range(n + 1)]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    assert tested[-1] <= n, tested


def test_parities_never_differ_more_than_the_shingles(spark):
    draw, rows = random.Random(5), []
    for i in range(300):
        n = draw.choice([1, 10, 150, 3000])
        both = [draw.getrandbits(64) for _ in range(n)]
        own = [[draw.getrandbits(64) for _ in range(int(n * draw.choice([0, 0.11, 0.12, 0.2])))] for _ in "ab"]
        a, b = (np.unique(np.array(both + o, np.uint64)) for o in own)
        similar = n / (n + len(own[0]) + len(own[1])) >= N.SIMILAR
        rows.append((i, N.parities(a).tolist(), N.parities(b).tolist(), len(a), len(b), similar))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, na int, nb int, similar boolean")
    kept = df.select("similar", "na", N.may_be_similar(F.col("a"), F.col("b"), F.col("na"), F.col("nb")).alias("kept")).collect()
    assert all(r.kept for r in kept if r.similar) and sum(r.similar for r in kept) >= 100
    assert not all(r.kept for r in kept if not r.similar and r.na < 1000)
