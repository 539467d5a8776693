import collections
import random
import zlib

from parvis.llm import queries, spelling


def edit_one(a, b):
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts, ratio=2):
    near = {w: [o for o in counts if edit_one(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return rows


def collected(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_variants_by_brute_force(spark):
    rng = random.Random(5)
    words = set()
    for _ in range(60):  # families around a stem, few letters, so bigrams repeat and edits meet pivots
        stem = "".join(rng.choice("aabcé") for _ in range(rng.randint(5, 9)))
        words.add(stem)
        for _ in range(6):
            i = rng.randrange(len(stem) + 1)
            words.add(stem[:i] + rng.choice(["", "a", "ß"]) + stem[i + rng.randint(0, 1) :])
    words |= {"a" * n for n in (5, 6, 7, 30, 31)} | {"ababab", "abababa", "bababab", "x" * 3000, "x" * 2999 + "y"}
    counts = {w: rng.choice([3, 4, 6, 12, 24, 48]) for w in sorted(words) if len(w) >= 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.variants(table)) == by_hand(counts)


def test_chains_of_forms(spark):
    counts = {"maison" + "s" * i: 3 * 2**i for i in range(9)}
    rows = collected(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows == by_hand(counts) and rows["maison"][1] == "maison" + "s" * 8


def test_odd_vocabularies(spark):
    schema = "word string, n long, other string"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, 9, "x"), ("abc", 4, "x"), ("abd", 9, "x"), ("house", 2, "x"), ("house", 3, "y"), ("houses", 10, "x"), ("hause", None, "x")]
    got = collected(spelling.variants(spark.createDataFrame(rows, schema)))
    assert got == {
        "abc": (None, "abc", 4, 0, None), "abd": (None, "abd", 9, 0, None),  # too short to be compared
        "house": ("houses", "houses", 5, 2, 10), "houses": (None, "houses", 10, 1, None), "hause": ("house", "houses", 0, 1, 5),
    }


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(500):
        at = sorted(rng.sample(range(1, 12), rng.randint(3, 6)))
        f = [rng.randint(1, 9) for _ in at]
        chosen = spelling.disjoint_rare(f, at)
        cost = dict(zip(at, f))
        assert chosen[1] - chosen[0] >= 2
        assert cost[chosen[0]] + cost[chosen[1]] == min(cost[p] + cost[q] for p in at for q in at if q - p >= 2)
    assert spelling.disjoint_rare([1, 1], [4, 5]) is None


def test_words_of_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["École", "ecole", "straße", "STRASSE", "naïve", "a1bcdef", "x-rated", "Université"]) for _ in range(rng.randint(0, 120))) for i in range(60)}
    texts |= {900: None, 901: "", 902: "UniversitÉ " * 5000, 903: "don't été÷été×"}
    rows = [(i, t, "en") for i, t in texts.items()] + [(None, "null words anew anew anewer", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text, _ in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert collected(queries.op11_spelling_variants(spark, str(tmp_path))) == by_hand(counts)
