import random
import re

import numpy as np
import pytest

from parvis.llm import ngram_join
from parvis.llm.components import connected_components


def brute(rows, n, percent):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same_id or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                up[root(i)] = root(j)
    least = {}
    for i in sets:
        if rows[i][0] is not None:
            least[root(i)] = min(rows[i][0], least.get(root(i), 1 << 60))
    return [(rows[i][0], len(sets[i]), least.get(root(i)) if sets[i] else rows[i][0]) for i in sets]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "x"]) if rng.random() < 0.5 else "".join(rng.choice("abcde") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 60, 150]))] + passage * rng.randint(0, 1)
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w[rng.randint(0, 1):]).upper() if rng.random() < 0.2 else " ".join(w))
    rows += [None, "", " \n ", "one", "ONE", "one two", "one  two", "é É", "zz " * 3000]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, t) for i, t in zip(ids, rows)] + [(None, rows[0]), (None, "nobody else"), (5000, rows[1]), (5000, rows[1]), (5001, rows[2]), (5001, rows[-1])]


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, False), (5, 80, True), (3, 60, True)])
def test_against_all_pairs(spark, monkeypatch, n, percent, small):
    if small:  # many blocks, few counters
        monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 300)
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 3)
        monkeypatch.setattr(ngram_join, "COUNTERS", 64)
    rows = corpus(n * percent)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h1 int, component string")
    got = [tuple(r) for r in ngram_join.linked(docs, n=n, percent=percent).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, n, percent), key=repr)


def test_very_long_texts(spark, monkeypatch):
    """Far more n-grams than bits in a bitmap; the texts of candidates are joined, not broadcast."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    base = [f"w{i * 7919 % 200_003}" for i in range(200_000)]
    rows = [(1, base), (2, base[:190_000]), (3, base[:150_000]), (4, [*base[:199_000], *(f"x{i}" for i in range(900))]), (5, [f"y{i}" for i in range(200_000)])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs).collect()}
    assert got == {1: (199_998, 1), 2: (189_998, 1), 3: (149_998, 3), 4: (199_898, 1), 5: (199_998, 5)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.linked(docs).collect() == []
    with pytest.raises(ValueError):
        ngram_join.linked(docs, percent=0)


def test_tree_walk_finds_all_links():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(3, 25)))) for _ in range(120)]
    tree = ngram_join.Tree(np.zeros(0, np.int64), 1 << 60, 0)
    for i, s in enumerate(sets):
        tree.add(s, i)
    for percent in (30, 60, 90):
        for s in sets:
            member = np.zeros(40, bool)
            member[s] = True
            found = sorted(tree.similar(s, member, percent, lambda: False))
            a = set(s.tolist())
            assert found == [j for j, o in enumerate(sets) if 100 * len(a & set(o.tolist())) >= percent * len(a | set(o.tolist()))]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in nodes)
