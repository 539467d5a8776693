"""Exact top-k search by inner product: term-at-a-time accumulation over every vector.

Candidates are dealt into stripes, queries into groups. In each cell of the grid a
stripe becomes posting lists (component, positions, weights); every component of a
query that is not zero scatters its weighted list into a dense array of scores, one
per candidate of the stripe, and a partition selects the best k of the array. The
lists of all stripes are then merged by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parvis.llm.common import stage

STRIPE = 1 << 20  # components of the candidates of a cell
GROUP = 1 << 18  # components of the queries of a cell
FOUND = "query bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as longs; null if the vector is null or holds a null or non-finite one."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def postings(vectors, dtype):
    """The lists of one stripe: component -> (positions, weights), positions None where most candidates have it."""
    import numpy as np

    lengths = np.diff(vectors.offsets.to_numpy())
    weights = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    positions = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = weights != 0
    positions, terms, weights = positions[used], terms[used], weights[used]
    order = np.argsort(terms, kind="stable")
    positions, terms, weights = positions[order], terms[order], weights[order]
    names, starts = np.unique(terms, return_index=True)
    lists = {}
    for name, low, high in zip(names.tolist(), starts, [*starts[1:], len(terms)]):
        if 4 * (high - low) < len(lengths):
            lists[name] = positions[low:high], weights[low:high]
        else:  # a long list is kept by position, so that scattering it is one addition
            row = np.zeros(len(lengths), dtype)
            row[positions[low:high]] = weights[low:high]
            lists[name] = None, row
    return lists


def accumulate(query, lists, scores, scratch) -> None:
    """Scores of one query against a stripe, term after term, into the dense array ``scores``."""
    import numpy as np

    scores[:] = 0
    for term in np.flatnonzero(query).tolist():
        positions, weights = lists.get(term, (None, None))
        if weights is None:
            continue
        if positions is None:
            np.multiply(weights, query[term], out=scratch)
            np.add(scores, scratch, out=scores)
        else:
            scores[positions] += weights * query[term]


def best(scores, k: int):
    """Positions of the k highest scores (all, if fewer), ties to the smaller position, in no order."""
    import numpy as np

    if len(scores) <= k:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > limit)
    return np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]])


def search(queries, stripe, k: int, dtype):
    """(query, vec_id, score) of the best k of a stripe for each query of a group, as an Arrow table."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    stripe = stripe.take(pc.sort_indices(stripe, [("vec_id", "ascending")]))  # nulls last
    ids = stripe["vec_id"].combine_chunks()
    known = ids.drop_null().to_numpy(zero_copy_only=False)
    lists = postings(stripe["vector"].combine_chunks(), dtype)
    scores, scratch = np.empty(len(ids), dtype), np.empty(len(ids), dtype)
    vectors = queries["vector"].combine_chunks()
    offsets, flat = vectors.offsets.to_numpy(), vectors.flatten()
    flat, base = flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False), offsets[0]
    rows, taken, totals = [], [], []
    for i, (row, own) in enumerate(zip(queries["query"].to_pylist(), queries["vec_id"].to_pylist())):
        accumulate(flat[offsets[i] - base : offsets[i + 1] - base], lists, scores, scratch)
        low, high = (0, 0) if own is None else np.searchsorted(known, [own, own + 1])
        scores[low:high] = np.iinfo(dtype).min
        kept = best(scores, k)
        kept = kept[(kept < low) | (kept >= high)]
        rows.append(np.full(len(kept), row))
        taken.append(kept)
        totals.append(scores[kept].astype(np.int64))
    joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.table({"query": joined(rows), "vec_id": ids.take(pa.array(joined(taken))), "score": joined(totals)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for every query.

    Both tables hold ``vec_id`` (long) and ``vector`` (array of long, as ``quantised``
    makes it); other columns are ignored. Rows whose vector is null or holds nulls take
    no part. Candidates with the query's vec_id are its own rows and left out; a null
    vec_id is nobody's own. Each row of ``queries`` is answered, repeated ones each; each
    row of ``candidates`` counts, repeated ones too. Ties go to the smaller vec_id, null
    last. Vectors of different lengths are multiplied over the components both have; an
    empty one scores 0. A sum beyond a long wraps as long arithmetic does. Without
    queries or candidates there are no rows.

    Cells of the grid have a bounded number of components on average (``STRIPE``,
    ``GROUP``); rows are dealt by their place in the table, so no vec_id makes a stripe
    larger. A cell sends k rows per query on.
    """
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    ours = lambda df: df.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<bigint>").alias("vector"))
    place = F.monotonically_increasing_id()
    queries = stage(ours(queries).select(place.alias("query"), "vec_id", "vector"))
    candidates = ours(candidates).select(place.alias("row"), "vec_id", "vector")

    largest = F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))
    shape = lambda df: df.agg(F.sum(F.size("vector")), F.max(F.size("vector")), largest).first()
    (q_parts, q_width, q_largest), (c_parts, c_width, c_largest) = shape(queries), shape(candidates)
    groups, stripes = 1 + (q_parts or 0) // GROUP, 1 + (c_parts or 0) // STRIPE
    reach = min(q_width or 0, c_width or 0) * (q_largest or 0) * (c_largest or 0)
    dtype = "int32" if reach < 2**31 else "int64"
    packed = next(t for t, top in (("tinyint", 127), ("smallint", 32767), ("int", 2**31 - 1), ("bigint", None)) if top is None or max(q_largest or 0, c_largest or 0) <= top)

    vector = F.col("vector").cast(f"array<{packed}>").alias("vector")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(dealt("query", groups).alias("group"), every(stripes).alias("stripe"), "query", "vec_id", vector)
    right = candidates.select(every(groups).alias("group"), dealt("row", stripes).alias("stripe"), "vec_id", vector)

    def cell(some, stripe):
        import numpy as np

        return search(some, stripe, k, np.dtype(dtype).type)

    found = left.groupBy("group", "stripe").cogroup(right.groupBy("group", "stripe")).applyInArrow(cell, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select("query", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: the contract of op12 in SQL
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
