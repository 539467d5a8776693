"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so tokens are labelled first, on a bounded sample of labelled
texts: a word or a word beginning is toxic if it stands in toxic texts far more often
than in others and next to many different words there; copies of one text add no
neighbours. The field has two states, weights for hashed features of a word and
weights for the step from one state to the next; it is fitted on pieces of labelled
tokens. Every whole text is then tagged: forward-backward marginals give each token's
probability, the highest one is the document's score, and runs of tokens at 0.5 or
more are its toxic spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis.llm.common import stage

SLOTS = 1 << 18  # hashed features
PIECE = 40  # tokens in a training piece
FRAME = 1 << 15  # rows of marks, or tokens of pieces, from which on a worker hands them over
SCHEMA = "struct<score: double, spans: array<struct<start: int, stop: int, probability: double>>>"


@dataclass(frozen=True)
class Sample:
    """Bounds of what the field is fitted on: distinct labelled texts of either kind, and pieces of either kind."""

    toxic_texts: int = 2_000
    clean_texts: int = 4_000
    pieces: int = 6_000


@dataclass
class Field:
    """Weights of state 1 against state 0 by feature slot, and the log weights of start and steps."""

    emission: object
    start: float
    steps: object  # steps[a][b]: from a to b


def core(word: str) -> str:
    """A word in lower case without what is no letter or digit at its ends."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def marks(word: str) -> list[str]:
    """What a word can be known by: itself and its beginnings."""
    return [f"w:{word}"] + [f"p{k}:{word[:k]}" for k in (4, 5) if len(word) > k] if word else []


def slots(word: str) -> list[int]:
    """Feature slots of a word: bias, itself, beginnings, ending, kind; always eight, the bias filling gaps."""
    w = core(word)
    names = ["bias", f"w:{w}", f"p3:{w[:3]}", f"p4:{w[:4]}", f"p5:{w[:5]}", f"s3:{w[-3:]}", f"k:{min(len(w), 12)}", f"c:{w.isalpha()}{word[:1].isupper()}"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for n in names]


def _labelled_texts(docs: DataFrame, labels: DataFrame, text: str, key: str, sample: Sample) -> DataFrame:
    """(text, toxic): distinct labelled texts, a bounded number of each kind, in the order of a hash.

    Ids and labels are joined before texts are touched, and the sample is drawn by text
    hash, so only sampled texts travel.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    hashed = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"))
    kinds = hashed.join(known, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"))
    drawn = stage(
        kinds.where("toxic").orderBy("h").limit(sample.toxic_texts).unionByName(kinds.where("NOT toxic").orderBy("h").limit(sample.clean_texts))
    )
    return docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("text", "toxic")


def _seen(batches: Iterator) -> Iterator:
    """(mark, toxic, number, before) of each text, each once a text. A frame goes on when it is full, so that a worker holds few texts' marks."""
    import pandas as pd

    names = ["mark", "toxic", "number", "before"]
    for frame in batches:
        rows = []
        for text, toxic in zip(frame["text"], frame["toxic"]):
            own, before, number = set(), "", zlib.crc32(text.encode("utf-8", "surrogatepass"))
            for word in map(core, text.split()):
                last = zlib.crc32(before.encode("utf-8", "surrogatepass"))
                own.update((mark, bool(toxic), number, last) for mark in marks(word))
                before = word
            rows.extend(own)
            if len(rows) >= FRAME:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def _cut(batches: Iterator, known: set[str]) -> Iterator:
    """(words, tags) of the pieces of each text. A frame goes on when its pieces have many tokens."""
    import pandas as pd

    for frame in batches:
        rows, size = [], 0
        for text, bad in zip(frame["text"], frame["toxic"]):
            words = text.split()
            for i in range(0, len(words), PIECE):
                piece = words[i:i + PIECE]
                rows.append((piece, "".join("01"[bad and any(m in known for m in marks(core(w)))] for w in piece)))
            size += len(words)
            if size >= FRAME:
                yield pd.DataFrame(rows, columns=["words", "tags"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["words", "tags"])


def _toxic_marks(texts: DataFrame) -> set[str]:
    """Marks of toxic words: many different neighbours in toxic texts, nearly none in others. Bounded by the sample."""
    total = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(True):
        return set()
    rows = texts.mapInPandas(_seen, "mark string, toxic boolean, number long, before long")
    pairs = rows.groupBy("mark", "before").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    stats = pairs.groupBy("mark").agg(F.count_if(F.col("t") > 0).alias("neighbours"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    least = max(3, total[True] // 100)
    rate = F.col("c") / max(1, total.get(False, 0)) <= 0.05 * F.col("t") / total[True]
    return {r.mark for r in stats.where((F.col("neighbours") >= least) & rate).select("mark").collect()}


def _pieces(texts: DataFrame, toxic: set[str], sample: Sample) -> list:
    """Training pieces (words, labels): all that hold a toxic word, and as many others, up to the bound."""
    known = texts.sparkSession.sparkContext.broadcast(toxic)
    rows = texts.mapInPandas(lambda batches: _cut(batches, known.value), "words array<string>, tags string").withColumn("h", F.xxhash64("words"))
    kind = F.contains("tags", F.lit("1"))
    # one of each different piece, so that copies do not fill the sample
    drawn = lambda part: part.groupBy("h").agg(F.first("words").alias("words"), F.first("tags").alias("tags")).orderBy("h").limit(sample.pieces)
    return drawn(rows.where(kind)).unionByName(drawn(rows.where(~kind))).collect()


def forward_backward(u, starts, lengths, field: Field):
    """Forward and backward log odds of state 1 of every token; their sum is the log odds of the marginal.

    ``u``: log odds of the words alone, texts end to end, longest first.
    """
    import numpy as np

    forward, backward = np.empty_like(u), np.zeros_like(u)
    (s00, s01), (s10, s11) = field.steps
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    for t in range(len(active)):
        at = starts[:active[t]] + t
        before = forward[at - 1] if t else None
        forward[at] = u[at] + (np.logaddexp(s01, s11 + before) - np.logaddexp(s00, s10 + before) if t else field.start)
    for t in range(len(active) - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        after = u[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(s10, s11 + after) - np.logaddexp(s00, s01 + after)
    return forward, backward


def fit_field(pieces: list, rounds: int = 60, rate: float = 0.5, decay: float = 1e-5) -> Field:
    """Weights of highest conditional likelihood, by gradient steps of their own size; a wary field without pieces."""
    import numpy as np

    field = Field(np.zeros(SLOTS), -2.0, np.array([[0.0, 0.0], [0.0, 0.0]]))
    if not any("1" in r.tags for r in pieces):
        field.emission[slots("")[0]] = -6.0
        return field
    pieces = sorted(pieces, key=lambda r: -len(r.words))
    lengths = np.array([len(r.words) for r in pieces])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    cache = {w: slots(w) for r in pieces for w in r.words}
    ids = np.array([cache[w] for r in pieces for w in r.words], np.int32)
    gold = np.array([c == "1" for r in pieces for c in r.tags], float)
    linked = np.ones(len(gold), bool)
    linked[starts] = False
    inner = np.flatnonzero(linked)  # tokens with one before them
    flat = ids.ravel()
    squares, step_squares, start_square = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[inner - 1].astype(int), gold[inner].astype(int)), 1)
    for _ in range(rounds):
        u = field.emission[ids].sum(axis=1)
        forward, backward = forward_backward(u, starts, lengths, field)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
        error = gold - p
        gradient = np.bincount(flat, np.repeat(error, ids.shape[1]), SLOTS) / len(gold) - decay * field.emission
        squares += gradient * gradient
        expected = _expected_steps(forward[inner - 1], u[inner] + backward[inner], field.steps)
        steps = (seen - expected) / len(gold)
        step_squares += steps * steps
        begin = float(error[starts].sum()) / len(gold)
        start_square += begin * begin
        field.emission += rate * gradient / np.sqrt(squares)
        field.steps = field.steps + rate * 0.2 * steps / np.sqrt(step_squares)
        field.start += rate * 0.2 * begin / start_square ** 0.5
    return field


def _expected_steps(before, after, steps):
    """Expected number of each step, from the odds up to one token and from the next one on."""
    import numpy as np

    (s00, s01), (s10, s11) = steps
    cells = np.stack([np.full_like(before, s00), s01 + after, s10 + before, s11 + before + after])
    cells = np.exp(cells - cells.max(axis=0))
    return (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: Sample = Sample()) -> Field:
    """The field for ``docs`` labelled by ``labels`` (doc_id, toxic); documents without a label teach nothing."""
    texts = stage(_labelled_texts(docs, labels, text, key, sample))
    toxic = _toxic_marks(texts)
    return fit_field(_pieces(texts, toxic, sample) if toxic else [])


class _Emission(dict):
    """Log odds of a word alone, remembered."""

    def __init__(self, weights) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = float(self.weights[slots(word)].sum())
        if len(self) > 300_000:
            self.clear()
        if len(word) < 64:
            self[word] = value
        return value


def tag(texts: list, field: Field, emission: dict, tokens_at_once: int = 1_000_000) -> list[dict]:
    """score and spans of each text, in order."""
    import numpy as np

    out: list = [None] * len(texts)
    group, size = [], 0

    def flush() -> None:
        group.sort(key=lambda g: -len(g[1]))
        places, lengths = [i for i, _ in group], np.array([len(w) for _, w in group])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        u = np.concatenate([w for _, w in group])
        group.clear()
        p, backward = forward_backward(u, starts, lengths, field)
        p += backward
        del u, backward
        np.negative(np.clip(p, -500, 500, out=p), out=p)
        np.divide(1, np.add(1, np.exp(p, out=p), out=p), out=p)
        highest = np.maximum.reduceat(p, starts)
        for i, a, n, score in zip(places, starts, lengths, highest):
            spans = []
            if score >= 0.5:
                high = p[a:a + n] >= 0.5
                before = False
                for token, match in enumerate(re.finditer(r"\S+", texts[i])):
                    if high[token]:
                        if before:
                            spans[-1] = {"start": spans[-1]["start"], "stop": match.end(), "probability": max(spans[-1]["probability"], float(p[a + token]))}
                        else:
                            spans.append({"start": match.start(), "stop": match.end(), "probability": float(p[a + token])})
                    before = high[token]
            out[i] = {"score": float(score), "spans": spans}

    for i, text in enumerate(texts):
        words = re.findall(r"\S+", text) if text else []
        if not words:
            out[i] = {"score": 0.0, "spans": []}
            continue
        group.append((i, np.fromiter(map(emission.__getitem__, words), float, len(words))))
        size += len(words)
        if size >= tokens_at_once:
            flush()
            size = 0
    if group:
        flush()
    return out


def toxicity(text: Column, spark, field: Field) -> Column:
    """struct(score, spans) of ``text``: the highest token probability, and the toxic runs by character offset.

    A null, empty or blank text scores 0. Nothing is cut: a text of any length is tagged as one sequence.
    """
    import pyarrow as pa

    shared = spark.sparkContext.broadcast(field)
    kind = pa.struct([
        ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))),
    ])
    caches: list = []

    def tagged(texts: pa.Array) -> pa.Array:
        if not caches:
            caches.append(_Emission(shared.value.emission))
        found = pa.array(tag(texts.to_pylist(), shared.value, caches[0]), kind)
        pa.default_memory_pool().release_unused()  # or the worker keeps it while other steps use it
        return found

    tagged.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(tagged, SCHEMA)(text)


def clean_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with their own columns."""
    field = train(docs, labels, text, key)
    rows = docs.select(F.struct("*").alias("row"))
    return rows.where(toxicity(F.col(f"row.{text}"), docs.sparkSession, field)["score"] < least).select("row.*")
