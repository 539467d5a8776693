import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parvis.llm import pitman_yor


def corpus(n):
    rng = random.Random(9)
    sets = [[f"{a}{k}" for k in range(40)] for a in ("ka", "mi", "to")]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) if rng.random() < 0.9 else f"q{rng.randrange(3000)}" for _ in range(rng.randint(5, 60))), i % 10 != 0) for i in range(n)]
    return [*rows, (n, None, True), (n + 1, "", False), (n + 2, " \n\x0b", True), (None, "ka1 KA1 ÉÉ\xa0x", False), (3, rows[3][1], True), (n + 3, "ka2 " * 5000, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def test_base_and_totals(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 4000)
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t, x, "extra") for d, t, x in rows], "doc_id long, text string, learn boolean, word string")
    got = pitman_yor.scored(docs, sweeps=3, burn_in=1).collect()
    counts = Counter(w for _, t, x in rows if x for w in words(t))
    tokens, types = sum(counts.values()), len(counts)
    want = []
    for d, t, _ in rows:
        ws = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (tokens + 0.1 * (types + 1))) for w in ws)
        want.append((repr(d), len(ws), sum(counts[w] > 0 for w in ws), tokens, round(base, 5)))
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_merging_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame([(d, t, x) for d, t, x in corpus(100)], "doc_id long, text string, learn boolean")
    one = sorted((r.doc_id or -1, round(r.score, 4)) for r in pitman_yor.scored(docs, sweeps=2, burn_in=0).collect())
    monkeypatch.setattr(pitman_yor, "MERGED_BLOCKS", 2)
    assert one == sorted((r.doc_id or -1, round(r.score, 4)) for r in pitman_yor.scored(docs, sweeps=2, burn_in=0).collect())


def test_probabilities_sum_to_one():
    """Over all words and the unknown one, in every context, after sweeps with totals of the same seats."""
    rng = np.random.default_rng(5)
    cells = {(w, int(c)): int(n) for w in range(50) for c, n in zip(rng.choice(6, 3, replace=False) * 37 + 11, rng.integers(1, 200, 3))}
    asked = sorted({(w, c) for w in range(51) for c in {c for _, c in cells}})
    rows, contexts = (np.array(x) for x in zip(*asked))
    counts = np.array([cells.get(p, 0) for p in asked])
    model = pitman_yor.Model([], (0.6, 0.7, 0.8), 1.0, int(counts.sum()), 50, 0)
    seats = pitman_yor.Seats(rng.integers(0, 1 << 62, 51).astype(np.uint64), contexts, counts, rows, model)

    def totals():
        t = pitman_yor.Totals()
        for k, (c, n, at) in enumerate(((seats.c0, seats.t0, np.zeros(51, int)), (seats.c1, seats.t1, seats.at1), (seats.c2, seats.t2, seats.at2))):
            np.add.at(t.customers[k], at, c)
            np.add.at(t.tables[k], at, n)
        return t

    for number in range(4):
        seats.sweep(totals(), number)
        for c, t in ((seats.c0, seats.t0), (seats.c1, seats.t1), (seats.c2, seats.t2)):
            assert (t <= c).all() and ((t > 0) == (c > 0)).all()
        p = seats.predictive(totals(), 2)
        for c in set(contexts):
            assert math.isclose(p[contexts == c].sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize(("customers", "discount", "others", "below"), [(5, 0.5, 0, 0.3), (60, 0.5, 3, 0.8), (20, 0.7, 0, 0.5), (60, 0.8, 0, 0.3), (2000, 0.8, 0, 0.3), (3000, 0.5, 40, 0.1)])
def test_seating_matches_the_process(customers, discount, others, below):
    """Against customers that choose one after the other among the tables of their dish and a new one."""
    rng = random.Random(1)
    key = np.arange(600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fast = pitman_yor.seated(np.full(600, float(customers)), 1.0, np.full(600, float(others)), np.full(600, below), discount, key, 0).mean()
    slow = 0
    for _ in range(600):
        tables = 1
        for sat in range(1, customers):
            new = (1.0 + discount * (others + tables)) * below
            tables += rng.random() < new / (new + sat - discount * tables)
        slow += tables / 600
    assert abs(fast - slow) < 0.06 * slow + 0.15


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in pitman_yor.scored(docs).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)
    assert pitman_yor.scored(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pitman_yor.scored(docs, sweeps=2, burn_in=2)


def test_context_hash():
    assert pitman_yor.context_of(b"") == 0
    assert pitman_yor.context_of("né".encode()) // pitman_yor.CHILDREN == zlib.crc32("é".encode()) % pitman_yor.PARENTS


def test_word_bigrams_count(spark, monkeypatch):
    """Words with the same ending are different contexts: what follows each of them is learnt."""
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(pitman_yor, "SHARD_BLOCKS", 3)
    rng = random.Random(4)
    pairs = {f"{a}xyz": f"n{a}" for a in "abcdefghijklmnop"}
    line = lambda: " ".join(f"{a} {pairs[a]}" for a in rng.choices(sorted(pairs), k=40))
    rows = [(i, line(), True) for i in range(150)] + [(1000, "axyz na", False), (1001, "axyz nb", False)]
    got = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()}
    assert got[1000] - got[1001] > 2


def test_tables_go_when_read(spark, monkeypatch):
    """What only the table of contexts' customers is made from is gone before the first sweep."""
    events, forget, gathered = [], pitman_yor.forget, pitman_yor._gathered
    monkeypatch.setattr(pitman_yor, "forget", lambda rows: (events.append(tuple(rows.columns)), forget(rows))[1])
    monkeypatch.setattr(pitman_yor, "_gathered", lambda *a: (events.append("sweep"), gathered(*a))[1])
    docs = spark.createDataFrame([(i, f"a b{i % 3} c", True) for i in range(12)], "doc_id long, text string, learn boolean")
    assert pitman_yor.scored(docs, sweeps=1, burn_in=0).count() == 12
    assert events[:2] == [("bucket", "context", "n"), "sweep"]


def test_contexts_travel_packed(spark, monkeypatch):
    """Contexts and their customers are one row per bucket and range, not one per context."""
    found, forget = {}, pitman_yor.forget
    monkeypatch.setattr(pitman_yor, "forget", lambda rows: (found.update({tuple(rows.columns): rows.count()}), forget(rows))[1])
    docs = spark.createDataFrame([(i, " ".join(f"a{i} b{k}" for k in range(20)), True) for i in range(30)], "doc_id long, text string, learn boolean")
    assert pitman_yor.scored(docs, sweeps=1, burn_in=0).count() == 30
    assert found["bucket", "context", "n"] == 1


def test_dealt_tables_stay_where_they_are(spark):
    """Joins and groups by the column that a table is dealt by need no shuffle, and its name is not kept."""
    from parvis.llm.common import forget, stage_by

    one, two = (stage_by(spark.range(100).selectExpr("id % 7 AS k", f"id AS {c}"), "k", 3) for c in "ab")
    rows = one.join(two.hint("merge"), "k").groupBy("k").count()
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r["count"] for r in rows.collect()} == {k: (15 if k < 2 else 14) ** 2 for k in range(7)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]
    forget(one)
    forget(two)


def test_packing_and_back():
    rng = np.random.default_rng(3)
    contexts = rng.integers(-(1 << 63), 1 << 63, 500)
    assert (pitman_yor._loose(pitman_yor._tight(contexts), 500) == contexts).all()
    places = np.sort(rng.integers(0, 1 << 20, 500))
    assert (pitman_yor._walked(pitman_yor._steps(places)) == places).all()
    assert len(pitman_yor._loose(pitman_yor._tight(contexts[:0]), 0)) == 0


def test_tokens_and_falling_order():
    import pyarrow as pa

    texts = ["".join(map(chr, range(300))) + " a\x85b\xa0c   D", "", None, "  x\n\n Y ", " \n\x0b", "é\x1c\x1d q"] * 400
    numbers, lengths, names = pitman_yor._tokens(pa.array(texts))
    assert [names[i].decode() for i in numbers] == [w for t in texts for w in words(t)] and lengths.tolist() == [len(words(t)) for t in texts]
    values = np.random.default_rng(1).zipf(1.2, 50_000).clip(0, 10**9).astype(float)
    assert (pitman_yor._falling(values) == np.argsort(-values, kind="stable")).all() and not len(pitman_yor._falling(values[:0]))
