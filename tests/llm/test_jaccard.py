import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawgraph.llm import jaccard
from drawgraph.llm.components import connected
from drawgraph.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [set_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 8)):
            out.append(edited(rng, base, rng.randint(0, max(1, len(base) // 40)), vocabulary))
    near = [rng.choice(vocabulary) for _ in range(120)]
    out += [edited(rng, near, rng.randint(1, 6), vocabulary) for _ in range(60)]
    out += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    texts = [" ".join(w).lower() if rng.random() < 0.5 else "\n ".join(w) for w in out]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (9003, "É a"), (9004, "é a"), (9005, "one"), (9006, "ONE"), rows[0], (None, rows[1][1])]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_components_match_brute_force(spark, monkeypatch, seed, size, percent):
    monkeypatch.setattr(jaccard, "REPORTED", 2)
    rows = corpus(seed)
    got = jaccard.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, percent)


def test_no_partner_is_lost_by_any_allowance():
    """Any two sets of the similarity share a key in roles that meet, whatever the table of frequent shingles says."""
    rng = np.random.default_rng(5)
    np.seterr(over="ignore")
    for trial in range(400):
        n = int(rng.integers(7, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop, add = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        b = np.union1d(rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        sketch = None if trial % 2 else (rng.random(256) < rng.random()).astype(np.int64) * 50
        maker = jaccard.Signatures(85, sketch)
        small, large = sorted((a, b), key=len)
        p, q = maker.rows(small), maker.rows(large)
        index = {}
        for k, r in zip(q[0].tolist(), q[1].tolist(), strict=True):
            index[k] = index.get(k, 0) | r
        meet = lambda x, y: (y & 1 and x & 20) or (y & 2 and x & 8)
        assert any(meet(r, index.get(k, 0)) for k, r in zip(p[0].tolist(), p[1].tolist(), strict=True))


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    with np.errstate(over="ignore"):
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 2000)), dtype=np.uint64))
            b = np.union1d(a[int(rng.integers(0, len(a))) :], rng.integers(0, 1 << 63, int(rng.integers(0, 900)), dtype=np.uint64))
            assert jaccard.parity_gap(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))
        far = jaccard.parity_gap(jaccard.parity(a), jaccard.parity(rng.integers(0, 1 << 63, len(a), dtype=np.uint64)))
        assert far > 2 * len(a) * 15 // 115


def test_signature_rows_are_small(spark):
    """They are most of what the join writes: keys of 48 bits, and no sizes, which the table of sets holds."""
    docs = spark.createDataFrame(corpus(7), "doc_id long, text string")
    rows = jaccard.signatures(docs, "text", 5, 80, None)
    assert rows.columns == ["key", "node", "role"]
    ends = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    assert 0 <= ends[0] and 1 << 40 < ends[1] < 1 << 48 and ends[2] > 1000


def test_shingles_match_words():
    rows = corpus(4)
    texts = [(t or "").encode() for _, t in rows]
    with np.errstate(over="ignore"):
        for size in (1, 4, 5):
            got = shingle_sets(texts, size)
            assert [len(s) for s in got] == [len(set_of(t, size)) for _, t in rows]


def test_connected(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(50)] + [(200 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(60)] + [(7, 7)]
    got = {r.x: r.label for r in connected(spark.createDataFrame(links, "x long, y long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for i in list(parent):
        groups.setdefault(root(i), []).append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}
    assert connected(spark.createDataFrame([], "x long, y long")).collect() == []


def test_representatives_keep_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (3, "z y x w v u", 3), (4, None, 4), (5, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.doc_id for r in jaccard.representatives(df).collect()) == [1, 3, 4, 5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.report(empty).collect() == [] and jaccard.representatives(empty.select("*", F.lit(1).alias("key"))).collect() == []


def test_representatives_of_repeated_and_null_ids(spark):
    copy, other = "a b c d e f g", "z y x w v u t"
    rows = [(1, copy, 1), (1, copy, 1), (1, other, 2), (7, other, 3), (None, "k l m n o p q", 4), (None, "k l m n o p q", 5), (8, copy, 6)]
    rows += [(None, None, 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = jaccard.representatives(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(1, copy), (1, other), (None, "k l m n o p q"), (None, None), (None, None)], key=str
    )


def test_a_key_of_many_unlike_sets_and_a_family_below_the_similarity(spark):
    """Thousands of sets that share words but not enough, and a family of copies around the threshold."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    texts = [common + [rng.choice(vocabulary) for _ in range(20)] for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(150):  # each with its own edits: two of them are about 75 to 85 % alike
        words = list(base)
        for i in rng.sample(range(300), rng.randint(3, 9)):
            words[i] = rng.choice(vocabulary)
        texts.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80).collect()}
    sets = [set_of(t, 5) for _, t in rows]
    index, near = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in index.get(x, ())[-400:] if i < 3000 else index.get(x, ()):
                near[i, j] = near.get((i, j), 0) + 1
            index.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), both in near.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert got == {i: root(i) for i in range(len(rows))}
    assert 1 < len({got[i] for i in range(3000, len(rows))}) < 150
