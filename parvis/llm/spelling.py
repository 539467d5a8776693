"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are put in one order for all words, rare ones first. Of words
that differ by one edit, at least one of any two disjoint bigrams of the one is left
whole in the other, and it lies in the other's prefix of three bigrams if that prefix
reaches at least as far in the order. So each word looks up its two pivots, disjoint
bigrams of its own prefix with the least frequency (chosen by dynamic programming),
in an index of the prefixes, at the lengths and positions one edit can lead to: the
edit lies wholly before or wholly behind a bigram it leaves whole, so what is on the
other side is the same too and belongs to the place looked up. What is found is verified.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis.llm.common import ascii_lower, stage

RUN = "[A-Za-zÀ-ÿ]+"
GRAM, EDITS = 2, 1
PREFIX, PIVOTS = GRAM * EDITS + 1, EDITS + 1
BROADCAST_GRAMS = 1 << 20  # so many distinct bigrams are sent to all tasks


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5) -> DataFrame:
    """(doc_id, run): all maximal letter runs of so many code points in the texts, A-Z in lower case; a null text has none."""
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.col(doc_id).alias("doc_id"), found.alias("run")).where(F.char_length("run") >= least_chars)
    return runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int = 97) -> Column:
    """``run`` less one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def frequent(words: DataFrame, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words with so many code points and occurrences; null words do not count."""
    long_enough = words.where(F.char_length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def disjoint_rare(frequencies: list[int], positions: list[int], pivots: int = PIVOTS, width: int = GRAM) -> list[int]:
    """Positions of ``pivots`` disjoint grams with the least frequencies in all, None if there are not so many.

    ``best[i]`` is the cheapest choice of j grams among the first i, by position; the
    i-th gram either stays out or follows the choice of j - 1 that ends before it.
    """
    grams = sorted(zip(positions, frequencies))
    at = [p for p, _ in grams]
    before = [bisect_right(at, p - width) for p in at]  # grams that end where this one starts, or earlier
    best: list = [(0, ())] * (len(grams) + 1)
    for _ in range(pivots):
        after: list = [None]
        for i, (p, f) in enumerate(grams):
            rest = best[before[i]]
            taken = None if rest is None else (rest[0] + f, (*rest[1], p))
            after.append(min(filter(None, (after[i], taken)), default=None))
        best = after
    return None if best[-1] is None else list(best[-1][1])


def pivot_positions(frequencies: Column, positions: Column) -> Column:
    import pyarrow as pa

    def apply(f, p):
        return pa.array([disjoint_rare(*both) for both in zip(f.to_pylist(), p.to_pylist())], pa.list_(pa.int32()))

    apply.__annotations__ = {"f": pa.Array, "p": pa.Array, "return": pa.Array}

    return F.arrow_udf(apply, "array<int>")(frequencies, positions)


def signatures(vocabulary: DataFrame) -> DataFrame:
    """(word, n, chars, last, prefix, pivots) for words with enough bigrams.

    ``last`` is the place in the order of the prefix's last bigram, (frequency, gram);
    ``prefix`` holds every occurrence up to it, also of bigrams that occur more than once.
    """
    grams = vocabulary.select(
        "word", "n", F.char_length("word").alias("chars"), F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("pos")
    ).withColumn("gram", F.substring("word", F.col("pos"), F.lit(GRAM)))
    frequencies = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")))
    if frequencies.count() <= BROADCAST_GRAMS:
        frequencies = F.broadcast(frequencies)
    known = grams.join(frequencies, "gram")
    ordered = known.groupBy("word").agg(
        F.first("n").alias("n"), F.first("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("freq", "gram", "pos"))).alias("grams")
    ).where(F.size("grams") >= PREFIX)
    place = lambda g: F.struct(g["freq"].alias("freq"), g["gram"].alias("gram"))
    cut = ordered.withColumn("last", place(F.element_at("grams", PREFIX)))
    cut = cut.withColumn("prefix", F.filter("grams", lambda g: place(g) <= F.col("last"))).drop("grams")
    chosen = pivot_positions(F.col("prefix.freq"), F.col("prefix.pos"))
    return cut.withColumn("chosen", chosen).select(
        "word", "n", "chars", "last", "prefix", F.filter("prefix", lambda g: F.array_contains(F.col("chosen"), g["pos"])).alias("pivots")
    )


def _places(word: Column, pos: Column, chars: Column, changes: tuple[int, ...]) -> Column:
    """Where a bigram may stand in a word ``changes`` longer: its distance to one end, and all that lies between, as hashes."""
    behind = F.substring(word, F.lit(1), pos + GRAM - 1)  # the edit lies behind: start and bigram are kept
    before = F.substring(word, pos, chars)  # the edit lies before: bigram and end are kept
    return F.array(*[F.xxhash64(chars + c, F.lit(side), kept) for c in changes for side, kept in (("behind", behind), ("before", before))])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways, for the words of (word, n) that differ by exactly one code point.

    Words must be distinct; those with fewer than four code points have too few bigrams
    and are compared with none. Nothing is capped: what a place of a bigram holds is
    narrowed by all the text on its kept side, and an equal hash is verified like the rest.
    """
    rows = stage(signatures(vocabulary))
    g, word, chars = F.col("g"), F.col("word"), F.col("chars")
    asked = rows.withColumn("g", F.explode("pivots")).select(
        F.explode(_places(word, g["pos"], chars, (0, 1, -1))).alias("place"), g["gram"].alias("gram"), "word", "n", "last"
    )
    index = rows.withColumn("g", F.explode("prefix")).select(
        F.explode(_places(word, g["pos"], chars, (0,))).alias("place"), g["gram"].alias("gram"),
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"),
    )
    found = asked.join(index, ["place", "gram"]).where("last <= other_last AND word <> other")
    pairs = found.where(F.levenshtein("word", "other", EDITS) == EDITS)
    both = F.array(
        F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    return pairs.select(F.inline(both)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form), each form followed to the last; forms must not lead in a circle.

    Every round doubles the length of the steps taken, so a chain of d forms takes log2(d) rounds.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = after.select("word", "root")
        if after.where("moved").isEmpty():
            return reached


def variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if
    that n is at least ``ratio`` (2 or more) times the word's; else null, and the word is its own root.
    Rows without a word are left out; the n of repeated rows of a word add up, null as 0.
    """
    counted = vocabulary.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    words = stage(counted)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left")
    found = F.col("best.less").isNotNull() & (-F.col("best.less") >= ratio * F.col("n")) & (-F.col("best.less") > F.col("n"))
    rows = stage(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(found, F.col("best.word")).alias("form"), F.when(found, -F.col("best.less")).alias("form_n"),
    ))
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: the contract of op11 in SQL: crc32 byte by byte, near words by what is left after one deletion
SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc
), vocabulary AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)
), near AS MATERIALIZED (
  SELECT l.word, v.word AS other, v.n AS other_n FROM less l JOIN vocabulary v ON v.word = l.rest
  UNION SELECT v.word, l.word, l.n FROM less l JOIN vocabulary v ON v.word = l.rest
  UNION SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word AND place = 1
), chains AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM chains c JOIN formed f ON f.form = c.word
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN chains USING (word)
"""
