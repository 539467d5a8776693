import math
import random

import numpy as np

from parvis.llm import queries, top_k

SCHEMA = "vec_id long, vector array<long>, score string"


def by_hand(queries, candidates, k):
    """Per query row its best k of all candidates, found by sorting."""
    out = []
    for q, v in queries:
        if v is None or None in v:
            continue
        hits = [(-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in candidates if w is not None and None not in w and (i is None or i != q)]
        hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(hits[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(top_k, "STRIPE", 300)
    monkeypatch.setattr(top_k, "GROUP", 60)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0, 0, 0, 1, 2, -3, 40]) for _ in range(8)]) for i in range(400)]  # short lists, many ties
    rows += [(400 + i, [rng.randint(-300, 300) for _ in range(rng.randint(0, 12))]) for i in range(60)]  # of all lengths
    rows += rows[:5] + [(7, [9] * 8)] * 3  # repeated rows and ids
    rows += [(None, [1] * 8), (None, [50] * 8), (900, None), (901, [1, None]), (902, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    asked = [r for r in rows if r[0] is None or r[0] % 9 == 0]
    got = top_k.top_k(spark.createDataFrame([(*r, "x") for r in asked], SCHEMA), table, 7)
    assert found(got) == by_hand(asked, rows, 7)


def test_few_candidates_large_numbers_and_empty_tables(spark):
    rows = [(1, [2**40, -(2**20)]), (2, [3, 2**41]), (3, [2**21, 0]), (4, [0, 0])]
    table, none = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert found(top_k.top_k(table, table, 20)) == by_hand(rows, rows, 20)
    assert found(top_k.top_k(none, table)) == [] and found(top_k.top_k(table, none)) == []


def test_registered_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], 1) for i in range(300)]
    rows[40] = (40, [float("nan")] * 16, 1)
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [float("inf")] * 16, 1), (303, rows[0][1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v and None not in v and all(map(math.isfinite, v))]
    df = queries.op12_top_k(spark, str(tmp_path))
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert found(df) == by_hand([r for r in whole if r[0] % 20 == 0], whole, 20)
