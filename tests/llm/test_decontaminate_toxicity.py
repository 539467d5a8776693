import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from parvis.llm import decontaminate, toxicity


def items(rng, n):
    word = lambda: rng.choice("the of and to a in".split()) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(4))
    return [(i, " ".join(word() for _ in range(rng.randint(8, 40))) + ".") for i in range(n)], word


def score(text, passage, every):
    lists = [Counter(decontaminate.WORDS(t.lower())) for _, t in every]
    mean = sum(sum(x.values()) for x in lists) / len(lists)
    tf = Counter(decontaminate.WORDS(text.lower()))
    size = sum(tf.values())
    weight = lambda t: math.log(1 + (len(lists) - (df := sum(t in x for x in lists)) + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * size / mean))
    return sum(weight(t) for t in tf if t in set(passage)) / sum(map(weight, tf))


@pytest.mark.parametrize("block", [1, 3, 32])
def test_retrieval_finds_all_above_threshold(monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(block)
    every, word = items(rng, 60)
    lists = [decontaminate.WORDS(t.lower()) for _, t in every]
    frequency = Counter(w for ws in lists for w in set(ws))
    for threshold in (0.1, 0.3, 0.6):
        index = decontaminate.Index(every, frequency, len(every), sum(map(len, lists)) / len(lists), decontaminate.Settings(threshold=threshold))
        for _ in range(40):
            words = [word() for _ in range(rng.randint(0, 150))]
            for _ in range(rng.randint(0, 3)):
                part = rng.choice(lists)
                at = rng.randint(0, len(words))
                words[at:at] = part[: rng.randint(1, len(part))]
            step = index.length
            promising = set(index.promising(words, step)) if words else set()
            for start in range(0, max(len(words) - step, 1), step):
                passage = words[start:start + 2 * step]
                want = sorted(i for i, (_, t) in enumerate(every) if score(t, passage, every) >= threshold)
                assert sorted(i for i, _ in index.retrieve(passage)) == want
                assert not want or start in promising


def test_leaks(spark):
    rng = random.Random(11)
    every, word = items(rng, 30)
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{filler(300)}\n{every[i][1].upper()} {filler(200)}") for i in range(10)] + [(i, filler(400)) for i in range(10, 20)]
    rows += [(20, None), (21, ""), (22, every[3][1]), (None, every[4][1]), (0, rows[0][1]), (23, " ".join(every[5][1].split()[: len(every[5][1].split()) // 3]))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*every, (None, "no id"), (98, None), (99, "..."), every[0]], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect() if r.doc_id is not None)
    assert got == sorted([(0, 0)] + [(i, i) for i in range(10)] + [(22, 3)])
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(10, 22), 23]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == [] and decontaminate.contaminated(docs.limit(0), bench).collect() == []


def test_shards_agree(spark, monkeypatch):
    rng = random.Random(12)
    every, word = items(rng, 30)
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in every], "doc_id long, text string")
    bench = spark.createDataFrame(every, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "score").collect()))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    many = sorted(map(tuple, decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "score").collect()))
    assert [x[:2] for x in one] == [x[:2] for x in many] and np.allclose([x[2] for x in one], [x[2] for x in many])


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    field = toxicity.Field(None, 0.3, rng.normal(size=(2, 2)))
    lengths = np.array([6, 4, 1])
    starts = np.array([0, 6, 10])
    u = rng.normal(size=11)
    forward, backward = toxicity.forward_backward(u, starts, lengths, field)
    odds = forward + backward
    steps = np.zeros((2, 2))
    for a, n in zip(starts, lengths):
        total, on = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(field.start * y[0] + sum(u[a + k] * y[k] for k in range(n)) + sum(field.steps[y[k]][y[k + 1]] for k in range(n - 1)))
            total += w
            on += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        assert np.allclose(1 / (1 + np.exp(-odds[a:a + n])), on / total)
        steps += pairs / total
    inner = np.array([1, 2, 3, 4, 5, 7, 8, 9])
    assert np.allclose(toxicity._expected_steps(forward[inner - 1], u[inner] + backward[inner], field.steps), steps)


def toxic_corpus(n):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "to", "re", "shi", "ou"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(6, 120))]
        bad = i % 5 == 0
        for _ in range(bad * rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["Badword!", "xquick" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = toxic_corpus(1200)
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    field = toxicity.train(docs.where("doc_id < 800"), marks)
    got = docs.where("doc_id >= 800").select("doc_id", "text", toxicity.toxicity(docs["text"], spark, field).alias("t")).collect()
    right = sum((r.t.score >= 0.5) == (r.doc_id % 5 == 0) for r in got)
    assert right >= 0.97 * len(got)
    spans = [r.text[s.start:s.stop] for r in got for s in r.t.spans]
    assert spans and sum("Badword!" in s or "xquick" in s for s in spans) >= 0.95 * len(spans)
    kept = toxicity.clean_documents(docs, marks)
    assert kept.columns == docs.columns and abs(kept.count() - 960) < 30


def test_workers_hand_over_small_frames():
    """However many texts a batch has, a frame holds little more than the marks, or pieces, of one text."""
    texts = [" ".join(f"w{i}x{(i * k) % 97}abc" for k in range(300)) for i in range(400)] + ["", "one", "A " * 90]
    batch = pd.DataFrame({"text": texts, "toxic": [i % 3 == 0 for i in range(len(texts))]})
    want = set()
    for text, toxic in zip(batch["text"], batch["toxic"]):
        words = [toxicity.core(w) for w in text.split()]
        want |= {(m, toxic, zlib.crc32(text.encode()), zlib.crc32(b.encode())) for b, w in zip(["", *words], words) for m in toxicity.marks(w)}
    frames = list(toxicity._seen(iter([batch, batch[:0]])))
    rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
    assert len(rows) == len(want) > 3 * toxicity.FRAME and set(rows) == want
    assert max(map(len, frames)) <= toxicity.FRAME + 900
    known = {f"w:w{i}x5abc" for i in range(0, 400, 2)}
    frames = list(toxicity._cut(iter([batch]), known))
    assert [" ".join(w for p in f["words"] for w in p) for f in [pd.concat(frames)]] == [" ".join(" ".join(texts).split())]
    assert max(sum(map(len, f["words"])) for f in frames) <= toxicity.FRAME + 300
    assert any("1" in t for f in frames for t in f["tags"])


def test_odd_texts(spark):
    rows, labels = toxic_corpus(200)
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, " \n"), (None, "no id"), (5003, "to re " * 40_000), rows[0]], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    for field in (toxicity.train(docs, marks), toxicity.train(docs, marks.limit(0)), toxicity.train(docs.limit(0), marks)):
        got = docs.select("doc_id", toxicity.toxicity(docs["text"], spark, field).alias("t")).collect()
        assert len(got) == len(rows) + 6 and all(0 <= r.t.score <= 1 for r in got)
        assert [r.t.score for r in got if r.doc_id in (5000, 5001, 5002)] == [0.0] * 3
    assert docs.limit(0).select(toxicity.toxicity(docs["text"], spark, field)).collect() == []


def test_edited_items_are_found(spark):
    """A changed word in a short answer, in each place of it, hides no item; half a question is none."""
    rng = random.Random(21)
    new = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    parts = [([new() for _ in range(rng.randint(14, 40))], [new() for _ in range(n)]) for n in (3, 4, 5, 6, 7, 8, 9, 12) for _ in range(3)]
    bench = spark.createDataFrame([(i, f"{' '.join(q)}. {' '.join(a)}.") for i, (q, a) in enumerate(parts)], "item_id long, text string")
    rows = []
    for i, (q, a) in enumerate(parts):
        around = lambda words: " ".join([*(new() for _ in range(60)), *words, *(new() for _ in range(60))])
        for k in range(len(a)):
            rows.append((i, around([*q, *a[:k], "changed", *a[k + 1:]])))
        for _ in range(4):
            words = [*q, *a]
            for k in rng.sample(range(len(words)), 2):
                words[k] = "changed"
            rows.append((i, around(words)))
        rows.append((1000 + i, around(q[: len(q) // 2])))
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "doc_id long, want long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(n, i) for n, (i, _) in enumerate(rows) if i < 1000}
    assert {r.want for r in decontaminate.clean_documents(docs, bench).collect()} == {1000 + i for i in range(len(parts))}
