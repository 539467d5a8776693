"""Benchmark decontamination: BM25 retrieval of test items for every passage, then overlap with question and answer.

The test items are indexed: each term has postings in item order, cut into blocks
that carry the highest weight inside. A weight is the BM25 part of a term in an item,
divided by the score the item gives itself, so a passage that holds all of an item
scores 1 whatever the item's length. Every document is cut into passages of twice the
longest item, half of it overlapping, so any item lies whole in one passage.

Retrieval returns all items at or above the threshold: block-max WAND skips postings
whose block maxima cannot add up to it. A passage is put to it only if for some item
the rarer terms in it and all common terms of the item could together reach the
threshold; that bound is summed for all passages of a document at once and loses
nothing above the threshold.

An item retrieved is verified by the share of its question's and its answer's word
n-grams in the passage. The answer is the last sentence, or the last quarter of the
words where there is only one. A changed word takes n of them away, so short parts have
shorter n-grams, down to words; and where the passage holds nearly all words of an item,
the question alone is asked for: a few changed words may be the whole of an answer.

The index is broadcast in shards of at most ``SHARD_WORDS`` words; a larger test set
takes more passes over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_WORDS = 1_000_000
BLOCK = 32  # postings of a term in one block
WORDS = re.compile(r"\w+").findall
LEAK = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, first_word: bigint>>"


@dataclass(frozen=True)
class Settings:
    """``threshold``: least share of an item's own score; ``overlap``: least share of n-grams of question and answer;
    ``whole``: share of an item's words from which on the question is enough."""

    threshold: float = 0.5
    overlap: float = 0.5
    whole: float = 0.85
    n: int = 3
    k1: float = 1.2
    b: float = 0.75


def split_item(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer."""
    sentences = [w for w in map(WORDS, re.split(r"[.!?]+(?=\s|$)", text.lower())) if w]
    if len(sentences) > 1 and sum(map(len, sentences[:-1])) >= len(sentences[-1]) >= 3:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = [w for s in sentences for w in s]
    cut = max(1, len(words) - max(1, len(words) // 4)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def ngrams(words: list[str], n: int) -> set:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def overlap(part: list[str], passage: list[str], n: int) -> float:
    """Share of the n-grams of ``part`` that ``passage`` holds; 1 for an empty part."""
    wanted = ngrams(part, n)
    return len(wanted & ngrams(passage, min(n, len(part)))) / len(wanted) if wanted else 1.0


def size_for(part: list[str], n: int) -> int:
    """Words in an n-gram of a part: a quarter of it at most, so that one changed word leaves most n-grams."""
    return max(1, min(n, len(part) // 4))


def verified(question: list[str], answer: list[str], passage: list[str], settings: Settings) -> tuple[float, float, bool]:
    """Overlap of question and answer with the passage, and whether the passage leaks the item."""
    asked, told = (overlap(part, passage, size_for(part, settings.n)) for part in (question, answer))
    found = asked >= settings.overlap and (told >= settings.overlap or overlap(question + answer, passage, 1) >= settings.whole)
    return asked, told, found


class Index:
    """Inverted index of items (id, text) under document frequencies of the whole test set."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], count: int, mean: float, settings: Settings) -> None:
        self.settings = settings
        self.ids, self.parts, self.length = [], [], 0
        postings: dict[str, list[tuple[int, float]]] = {}
        for item_id, text in sorted(items):
            question, answer = split_item(text)
            terms = Counter(question + answer)
            size = sum(terms.values())
            if not size:
                continue
            weights = {
                t: math.log(1 + (count - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (settings.k1 + 1)
                / (tf + settings.k1 * (1 - settings.b + settings.b * size / mean))
                for t, tf in terms.items()
            }
            own = sum(weights.values())
            for t, w in weights.items():
                postings.setdefault(t, []).append((len(self.ids), w / own))
            self.ids.append(item_id)
            self.parts.append((question, answer))
            self.length = max(self.length, size)
        self.postings = postings
        self.most = {t: max(w for _, w in p) for t, p in postings.items()}
        self.blocks = {t: [(p[i:i + BLOCK][-1][0], max(w for _, w in p[i:i + BLOCK])) for i in range(0, len(p), BLOCK)] for t, p in postings.items()}
        # terms in most items first: as long as they alone reach at most half the threshold in any item, they count as common
        self.common = np.zeros(len(self.ids))
        rare = sorted(postings, key=lambda t: (-len(postings[t]), t))
        while rare and max(self.common[i] + w for i, w in postings[rare[0]]) < settings.threshold / 2:
            for i, w in postings[rare.pop(0)]:
                self.common[i] += w
        self.rare = {t: k for k, t in enumerate(rare)}
        self.first = np.concatenate(([0], np.cumsum([len(postings[t]) for t in rare]))).astype(np.int64)
        self.items = np.array([i for t in rare for i, _ in postings[t]], np.int64)
        self.weights = np.array([w for t in rare for _, w in postings[t]], float)

    def promising(self, words: list[str], step: int) -> list[int]:
        """Starts of the passages in which some item may reach the threshold."""
        get = self.rare.get
        terms = np.array([get(w, -1) for w in words], np.int64)
        passages = max(1, -(-len(words) // step) - 1)
        at = np.flatnonzero(terms >= 0)
        if self.common.max() >= self.settings.threshold - 1e-9:
            return [step * k for k in range(passages)]
        # a word lies in the passage that begins in its own stretch and in the one before
        stretch, found = at // step, terms[at]
        pairs = np.concatenate((stretch * len(self.rare) + found, (stretch - 1) * len(self.rare) + found))
        pairs = np.unique(pairs[pairs >= 0])
        passage, term = np.divmod(pairs, max(1, len(self.rare)))
        term, passage = term[passage < passages], passage[passage < passages]
        if not len(term):
            return []
        sizes = self.first[term + 1] - self.first[term]
        flat = np.repeat(self.first[term] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        keys, inverse = np.unique(np.repeat(passage, sizes) * len(self.ids) + self.items[flat], return_inverse=True)
        reach = np.bincount(inverse, self.weights[flat]) + self.common[keys % len(self.ids)]
        return (np.unique(keys[reach >= self.settings.threshold - 1e-9] // len(self.ids)) * step).tolist()

    def retrieve(self, words) -> list[tuple[int, float]]:
        """All (item number, score) at or above the threshold, by block-max WAND."""
        least = self.settings.threshold - 1e-9
        lists = [[self.postings[t], self.blocks[t], self.most[t], 0] for t in set(words) if t in self.postings]
        end, found = len(self.ids), []
        while lists:
            lists.sort(key=lambda x: x[0][x[3]][0])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[2]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0][lists[pivot][3]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]][0] == item:
                pivot += 1
            bound, until = 0.0, end
            for x in lists[:pivot + 1]:
                block = x[3] // BLOCK
                while block < len(x[1]) and x[1][block][0] < item:
                    block += 1
                if block < len(x[1]):
                    bound += x[1][block][1]
                    until = min(until, x[1][block][0] + 1)
            if bound >= least:
                if lists[0][0][lists[0][3]][0] == item:
                    score = sum(x[0][x[3]][1] for x in lists[:pivot + 1])
                    if score >= least:
                        found.append((item, score))
                target = item if lists[0][0][lists[0][3]][0] < item else item + 1
            else:  # no item before the end of the nearest block, or before the next list begins, can be reached
                following = lists[pivot + 1][0][lists[pivot + 1][3]][0] if pivot + 1 < len(lists) else end
                target = max(item + 1, min(until, following))
            for x in lists[:pivot + 1]:
                p, at = x[0], x[3]
                while at < len(p) and p[at][0] < target:
                    at += 1
                x[3] = at
            lists = [x for x in lists if x[3] < len(x[0])]
        return found

    def leaks(self, text: str | None) -> list[dict]:
        """The verified items of a text, each where it scores best."""
        words = WORDS(text.lower()) if text else []
        if not words or not self.ids:
            return []
        step = self.length
        best: dict[int, dict] = {}
        for start in self.promising(words, step):
            passage = words[start:start + 2 * step]
            for item, score in self.retrieve(passage):
                question, answer, found = verified(*self.parts[item], passage, self.settings)
                if found and (item not in best or score > best[item]["score"]):
                    best[item] = {"item_id": self.ids[item], "score": min(score, 1.0), "question_overlap": question, "answer_overlap": answer, "first_word": start}
        return [best[i] for i in sorted(best)]


def indexes(benchmark: DataFrame, text: str = "text", key: str = "item_id", settings: Settings = Settings()) -> list[Index]:
    """The index of the test set in shards. Items without words or without an id are left out; equal rows count once.

    An item with several texts has all of them tested. Document frequencies are of the whole test set.
    """
    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    rows = rows.withColumn("terms", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    size = rows.agg(F.count("*"), F.sum(F.size("terms"))).first()
    shards = max(1, -(-(size[1] or 0) // SHARD_WORDS))
    found = []
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        items = [(r.item_id, r.text or "") for r in part.select("item_id", "text").collect()]
        if shards == 1:
            lists = [WORDS(t.lower()) for _, t in items]
            frequency = Counter(w for ws in lists for w in set(ws))
        else:
            own = part.select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
            every = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
            frequency = Counter({r.term: r.n for r in every.join(own, "term").collect()})
        for _, t in items:  # a word that the two tokenisers cut differently occurs at least here
            for w in WORDS(t.lower()):
                frequency.setdefault(w, 1)
        found.append(Index(items, frequency, size[0], max(1.0, (size[1] or 0) / max(1, size[0])), settings))
    return found


def leaks(text: Column, spark, index: Index) -> Column:
    """The items of one shard that ``text`` leaks, as an array of structs; empty for a null or empty text."""
    import pyarrow as pa

    shared = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.leaks(t.as_py()) for t in texts], kind)

    found.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(found, LEAK)(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score, question_overlap, answer_overlap, first_word."""
    parts = []
    for index in indexes(benchmark, settings=settings):
        rows = docs.select(F.col(key).alias("doc_id"), leaks(F.col(text), docs.sparkSession, index).alias("found"))
        parts.append(rows.select("doc_id", F.inline("found")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"))
    for index in indexes(benchmark, settings=settings):
        rows = rows.where(F.size(leaks(F.col(f"row.{text}"), docs.sparkSession, index)) == 0)
    return rows.select("row.*")
