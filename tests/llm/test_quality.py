import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from parvis.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i:i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "a", "x " * 7, "x " * 8, "x " * 9, "# * $", "l1 x\nl1 x\n\nl1 x\n \n \n", "a\x0bb\x0cc\rd é😀 é😀", "w" * 5000]
    for _ in range(60):
        base = [rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(10, 80))]
        at = rng.randrange(len(base))
        out.append(" ".join(base + base[at:at + rng.randint(3, 15)] * rng.randint(0, 3)) + rng.choice(["", "\nx\nx", "|<>"]))
    return out + ["same words"] * 3


def test_measures(spark):
    rows = list(enumerate(texts())) + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, None, 7, "z") for i, t in rows], "doc_id long, text string, lang string, n_words int, key string")
    got = quality.measured(docs).select(
        "row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == brute(r.text), r.text


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 10), (0, 2000), (3, 2000), (9, 2000), (0, 500_000), (2300, 500_000), (10, 1000), (0, 0)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    for k, n, p in got:
        if k >= n * 0.005:
            assert p == 1.0
            continue
        pmf = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.005) + (n - i) * math.log1p(-0.005) for i in range(k + 1)]
        assert math.isclose(p, math.fsum(map(math.exp, pmf)), rel_tol=1e-6, abs_tol=1e-300)


def corpus(spark, copies):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(2600):
        words = [word() for _ in range(30)]
        bad = i % 13 == 0
        rows.append((i, " ".join(w + "###" * bad for w in words), "en" if i % 20 else "de", i))
        labels.append((i, int(not bad)))
    for c in range(copies):  # one good text with symbols, many times: it counts once
        rows.append((10_000 + c, " ".join(f"{k}$$$" for k in range(30)), "en", 0))
        labels.append((10_000 + c, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra int")
    return docs, spark.createDataFrame([*labels, (None, 1), (99_999, None), (77_777, 0)], "doc_id long, quality int")


def test_verdicts(spark):
    docs, labels = corpus(spark, copies=50)
    kept = {r.doc_id: r for r in quality.kept_documents(docs, labels).collect()}
    assert set(kept[1].asDict()) == {"doc_id", "text", "lang", "extra"}
    for i in range(2600):
        if i % 13:
            assert i in kept  # clean documents stay
        elif i % 20:
            assert i not in kept  # junk goes where cutoffs could be certified
        else:
            assert i in kept  # 130 labels in this stratum certify nothing


def test_certified_bound_and_order(spark):
    docs, labels = corpus(spark, copies=0)
    tested = quality.tested_cutoffs(quality.measured(docs), labels).collect()
    by = defaultdict(list)
    for r in sorted(tested, key=lambda r: r.step):
        by[r.stratum, r.rule].append(r)
    assert Counter(len(v) for v in by.values()) and set(s for s, _ in by) == {"en", "de"}
    for rows in by.values():
        flags = [r.certified for r in rows]
        assert flags == sorted(flags, reverse=True)
        for r in rows:
            assert not r.certified or r.p_value <= 0.05 / 4 / 2
    assert not any(r.certified for r in tested if r.stratum == "de")


def test_empty_tables(spark):
    docs, labels = corpus(spark, copies=0)
    none = docs.limit(0)
    assert quality.kept_documents(none, labels).collect() == []
    assert quality.kept_documents(docs.limit(30), labels.limit(0)).count() == 30
