"""Hierarchical Pitman-Yor language model over words, with seating sampled by Gibbs sweeps over the whole corpus.

A word is served in the restaurant of the whole word before. That restaurant orders
its tables from the one of its last two characters, this one from the restaurant of
the last character, and that from the restaurant without context, whose tables come
from a uniform base over the known words and one unknown. Restaurants of endings are
hashed into 65,536 and 1,024, so their totals are tables of fixed size; there are as
many restaurants of words as words, and their totals are a Spark table that is joined
in every sweep. Words are told apart by 64 bits, as contexts by 48 bits and the ending.

The corpus is read once, into blocks, which send the pairs of a word and the context
before it to buckets of words: packed, one row per block and bucket. A bucket merges
them into one row, so that all restaurants that serve a word are together, and keeps
where each block's pairs went. These tables are dealt by bucket and stay where they are.
A sweep reseats the customers of every dish, customer by customer, given the totals of
the sweep before (from 64 customers on in runs of a sixteenth). Only the tables of each
context move: packed, from buckets to ranges of contexts, where they are summed, and the
sums back. Draws are a function of word, restaurant, customer and sweep, so a lost task
repeats itself exactly. Predictive probabilities are averaged over the sweeps after the
burn-in and go back to the blocks in their order of pairs, where every text is summed up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parvis.llm.common import forget, release, stage, stage_by

END = b"\n"  # holds white space, so it is no word
PARENTS, CHILDREN = 1 << 10, 1 << 6  # restaurants of one character, and of two for each of them
CONTEXTS = PARENTS * CHILDREN
BLOCK_BYTES = 27 << 20  # text in a block
MERGED_BLOCKS = 4_096  # blocks whose pairs are merged at once
SINGLE = 64  # customers seated one by one
SLICE = 1 << 10  # texts split at once
BUCKET_PAIRS = 1 << 19  # pairs of a word and its context that one task has at once, unless one word has more
PAIR_BYTES = 14  # text per pair, about
SHARD_BLOCKS = 1  # blocks of text for each range of contexts


@dataclass
class Totals:
    """Customers and tables of the restaurants of endings, by level: 0 without context, 1 and 2 by context number."""

    customers: list = field(default_factory=lambda: [np.zeros(1), np.zeros(PARENTS), np.zeros(CONTEXTS)])
    tables: list = field(default_factory=lambda: [np.zeros(1), np.zeros(PARENTS), np.zeros(CONTEXTS)])


@dataclass
class Model:
    """Totals of the last sweep (before the first: one table per dish), discounts by level, and the training counts."""

    totals: list
    discounts: tuple
    strength: float
    tokens: int
    types: int
    burn_in: int


def context_of(word: bytes) -> int:
    """Number of the restaurant of the ending of ``word``; 0 at the beginning of a text."""
    ending = word.decode("utf-8", "replace")[-2:]
    last, before = ending[-1:].encode(), ending[:-1].encode()
    return (zlib.crc32(last) % PARENTS) * CHILDREN + zlib.crc32(before) % CHILDREN


LAID = "bucket long, block long, words binary, sizes binary, contexts binary, sums binary, places binary, doc_ids array<long>, lengths array<int>, endings binary, packed binary"
LAID_SCHEMA = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), *[(name, pa.binary()) for name in ("words", "sizes", "contexts", "sums", "places")],
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("endings", pa.binary()), ("packed", pa.binary()),
])


def _pack(values, sizes) -> pa.Array:
    """Numbers end to end, so many for each row, as binary values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(np.asarray(sizes) * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(rows: list, kind):
    """The numbers of binary values end to end."""
    return np.frombuffer(b"".join(rows), kind)


def _squeeze(values) -> bytes:
    """Numbers that are small for their type: bytes of equal weight together pack better."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T), 1)


def _spread(packed: bytes, kind):
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(places) -> bytes:
    """Places that mostly rise, as squeezed differences."""
    return _squeeze(np.diff(places, prepend=0).astype(np.int32))


def _walked(packed: bytes):
    return np.cumsum(_spread(packed, np.int32), dtype=np.int64)


def _tight(contexts) -> bytes:
    """Contexts with their endings, which are few, squeezed."""
    parts = contexts.view(np.uint16).reshape(-1, 4)
    return parts[:, 1:].tobytes() + _squeeze(parts[:, 0].copy())


def _loose(packed: bytes, n: int):
    parts = np.empty((n, 4), np.uint16)
    parts[:, 1:] = np.frombuffer(packed, np.uint16, 3 * n).reshape(-1, 3)
    parts[:, 0] = _spread(packed[6 * n:], np.uint16)
    return parts.view(np.int64).ravel()


def _turned(contexts):
    """What the contexts of a word are sorted by: first the ending, then the rest."""
    x = contexts.view(np.uint64)
    return (x << np.uint64(48)) | (x >> np.uint64(16))


def _ranks(endings, end: int):
    """Ranks of the contexts of a block's words, which are in order of their hashes; the end token's context is 0."""
    keys = (endings.astype(np.int64) << 32) + np.arange(1, len(endings) + 1)
    keys[end] = 0
    ranks = np.empty(len(keys), np.int32)
    ranks[np.argsort(keys)] = np.arange(len(keys), dtype=np.int32)
    return ranks


def _pairs(numbers, lengths, ranks):
    """Word number of each token and rank of the context before it, as one number. At the beginning of a text the end token is the context."""
    keys = numbers.astype(np.int64) * len(ranks)
    keys[1:] += ranks[numbers[:-1]]
    keys[:1] += ranks[numbers[lengths[0] - 1]]
    return keys


class _Endings(dict):
    """Contexts of endings of two ASCII characters at most."""

    def __missing__(self, tail: bytes) -> int:
        self[tail] = found = context_of(tail)
        return found


def _endings(words, n: int):
    known = _Endings()
    return np.fromiter((known[t] if (t := w[-2:]).isascii() else context_of(w) for w in words), np.uint16, n)


def _heads(values):
    """Where a run of equal values begins."""
    return np.concatenate(([True], values[1:] != values[:-1]))[:len(values)]


def _tokens(texts: pa.Array) -> tuple:
    """Numbers of the words of all texts and their end tokens, the number of tokens of each text, and the words by number, the end token last."""
    parts, sizes = [], []
    for i in range(0, len(texts), SLICE):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, SLICE).fill_null("")))
        owner, found = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        real = pc.binary_length(found).to_numpy() > 0  # white space at either end leaves an empty one
        sizes.append(np.bincount(owner[real], minlength=len(lists)))
        parts.append(found if real.all() else found.filter(pa.array(real)))
    coded = pa.chunked_array(parts).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    words = [*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), END]
    lengths = np.concatenate(sizes).astype(np.int32) + 1
    numbers = np.full(int(lengths.sum()), len(words) - 1, np.int32)
    inner = np.ones(len(numbers), bool)
    inner[np.cumsum(lengths) - 1] = False
    numbers[inner] = coded.indices.to_numpy()
    return numbers, lengths, words


def _block(block: int, ids: list, texts: pa.Array, learn: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: one per bucket of words, and one with the texts as word numbers."""
    flat, lengths, words = _tokens(texts)
    endings = _endings(words, len(words))
    # 64 bits tell words apart from here on; numbers are in their order
    hashed, first, numbers = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), return_index=True, return_inverse=True)
    del words
    n, end, endings = len(hashed), int(numbers[-1]), endings[first]
    flat = numbers.astype(np.int32)[flat]
    contexts = (hashed & np.uint64(-CONTEXTS & (1 << 64) - 1) | endings.astype(np.uint64)).view(np.int64)
    contexts[end] = 0
    ranks = _ranks(endings, end)
    marked = _pairs(flat, lengths, ranks) * 2
    marked += np.repeat(np.array(learn, bool), lengths)
    marked.sort()
    learnt = (marked & 1).astype(np.int32)
    marked >>= 1
    heads = np.flatnonzero(_heads(marked))
    counts, marked = np.add.reduceat(learnt, heads).astype(np.int32), marked[heads]
    del learnt, heads
    owners = (marked // n).astype(np.int32)
    sizes = np.bincount(owners, minlength=n).astype(np.int32)
    marked -= np.multiply(owners, n, dtype=np.int64)
    contexts = contexts[np.argsort(ranks)[marked]]
    del owners, marked
    a = np.searchsorted((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    b = np.concatenate(([0], np.cumsum(sizes)))[a]
    yield pa.RecordBatch.from_pylist([{
        "bucket": i, "block": block, "words": hashed[a[i]:a[i + 1]].tobytes(), "sizes": sizes[a[i]:a[i + 1]].tobytes(),
        "contexts": _tight(contexts[b[i]:b[i + 1]]), "sums": _squeeze(counts[b[i]:b[i + 1]]),
    } for i in np.flatnonzero(np.diff(a)).tolist()], LAID_SCHEMA)
    yield pa.RecordBatch.from_pylist([{
        "bucket": -block, "block": block, "doc_ids": ids, "lengths": lengths.tolist(), "endings": _squeeze(endings), "packed": _squeeze(flat),
    }], LAID_SCHEMA)


def _blocks(buckets: int):
    """Blocks are numbered by partition and place in it: small numbers, and the same again if a task is repeated."""

    def cut(batches: Iterator) -> Iterator:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, learn, texts = batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), batch.column("text")
            start, size = 0, 0
            for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
                size += length + 1
                if size >= BLOCK_BYTES or i + 1 == len(texts):
                    block += 1
                    yield from _block(block, ids[start:i + 1], texts.slice(start, i + 1 - start), [bool(x) for x in learn[start:i + 1]], buckets)
                    start, size = i + 1, 0
                    pa.default_memory_pool().release_unused()

    return cut


def _merged(rows: pa.Table) -> pa.Table:
    """The rows of a bucket as one, words and contexts in order with summed counts, and the places of each block's pairs in it. Texts stay as they are."""
    bucket = rows.column("bucket")[0].as_py()
    if bucket < 0:
        return rows
    rows = rows.sort_by("block").select(["block", "words", "sizes", "contexts", "sums"]).to_pylist()
    words, contexts, sums, places, blocks = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
    for i in range(0, len(rows), MERGED_BLOCKS):
        some = rows[i:i + MERGED_BLOCKS]
        sizes = [np.frombuffer(r["sizes"], np.int32) for r in some]
        blocks += [(r["block"], int(n.sum())) for r, n in zip(some, sizes)]
        before = len(words)
        words = np.concatenate([words, *[np.repeat(np.frombuffer(r["words"], np.uint64), n) for r, n in zip(some, sizes)]])
        contexts = np.concatenate([contexts, *[_loose(r["contexts"], int(n.sum())) for r, n in zip(some, sizes)]])
        sums = np.concatenate([sums, *[_spread(r["sums"], np.int32) for r in some]])
        order = np.lexsort((_turned(contexts), words))
        words, contexts = words[order], contexts[order]
        heads = _heads(words) | _heads(contexts)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(heads) - 1
        sums, words, contexts = np.add.reduceat(sums[order], np.flatnonzero(heads)), words[heads], contexts[heads]
        places = [place[:before][p] for p in places] + [place[before:]]
    heads = np.flatnonzero(_heads(words))
    whole = {"bucket": bucket, "words": words[heads].tobytes(), "sizes": np.diff(np.append(heads, len(words))).astype(np.int32).tobytes(), "contexts": _tight(contexts), "sums": _squeeze(sums)}
    places = np.split(np.concatenate(places), np.cumsum([n for _, n in blocks])[:-1])
    return pa.Table.from_pylist([whole] + [{"bucket": bucket, "block": block, "places": _steps(p)} for (block, _), p in zip(blocks, places)], LAID_SCHEMA)


def _uniform(key, sweep: int, step: int):
    """Numbers in [0, 1) from 64-bit keys, the same for the same arguments everywhere."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((sweep * 1_000_003 + step * 7_919 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53


def _falling(values):
    """Stable order of whole numbers from the largest on; the small ones, which are most, by radix sort."""
    order = np.argsort(65_535 - np.minimum(values, 65_535).astype(np.uint16), kind="stable")
    top = order[:np.count_nonzero(values >= 65_535)]
    top[:] = top[np.argsort(-values[top], kind="stable")]
    return order


def seated(customers, strength: float, others, below, discount: float, key, sweep: int):
    """Tables of each dish after its customers are seated one after the other.

    ``others``: tables of the other dishes of its restaurant; ``below``: the dish's
    probability in the parent. A customer opens a table with weight (strength + discount
    * all tables, the dish's own so far among them) * below, against those seated less
    ``discount`` per table of the dish. From ``SINGLE`` customers on, a sixteenth of those seated comes at once
    and opens the expected number of tables, rounded at random.
    """
    tables = np.minimum(customers, 1).astype(float)
    order = np.flatnonzero(customers > 1)
    order = order[_falling(customers[order])]
    below = np.broadcast_to(below, customers.shape)[order]
    rest, each = (strength + discount * others[order]) * below, discount * below
    many, keys, found = customers[order], key[order], tables[order]
    sat, active = 1, int(np.searchsorted(-many, -1, "left"))
    while active:
        run = 1 if sat < SINGLE else sat // 16
        coming = np.minimum(many[:active] - sat, run)
        weight = rest[:active] + each[:active] * found[:active]
        chance = weight / (weight + sat - discount * found[:active])
        found[:active] += np.floor(coming * chance + _uniform(keys[:active], sweep, sat))
        sat += run
        active = int(np.searchsorted(-many, -sat, "left"))
    tables[order] = np.minimum(found, many)
    return tables


def _groups(values) -> tuple:
    """Distinct values in order, and which of them each value is; values in order are not sorted."""
    if (values[1:] < values[:-1]).any():
        return np.unique(values, return_inverse=True)
    heads = _heads(values)
    return values[heads], np.cumsum(heads) - 1


class Seats:
    """All restaurants' seats for the words of some rows; restaurant totals come from outside."""

    def __init__(self, keys, contexts, counts, rows, model: Model) -> None:
        self.model, self.rows, self.n = model, rows, len(keys)
        self.at2 = contexts
        groups, self.up2 = _groups(rows * PARENTS + contexts // CHILDREN)
        self.at1, self.up1 = groups % PARENTS, groups // PARENTS
        with np.errstate(over="ignore"):
            self.key0 = keys
            self.key1 = keys[self.up1] * np.uint64(31) + (self.at1 + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            self.key2 = keys[rows] * np.uint64(37) + (contexts + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        self.c2 = counts.astype(float)
        self.t2 = np.minimum(self.c2, 1)
        self._carry1()
        self.t1 = np.minimum(self.c1, 1)
        self._carry0()
        self.t0 = np.minimum(self.c0, 1)

    def _carry1(self) -> None:
        self.c1 = np.bincount(self.up2, self.t2, len(self.at1))

    def _carry0(self) -> None:
        self.c0 = np.bincount(self.up1, self.t1, self.n)

    def predictive(self, totals: Totals, level: int):
        """Probability of each word in its restaurants at ``level``."""
        m = self.model
        below = np.full(self.n, 1.0 / (m.types + 1))
        for k, (c, t, at, up) in enumerate(((self.c0, self.t0, np.zeros(self.n, np.int64), slice(None)), (self.c1, self.t1, self.at1, self.up1), (self.c2, self.t2, self.at2, self.up2))[:level + 1]):
            everyone, tables = totals.customers[k][at], totals.tables[k][at]
            below = (np.maximum(c - m.discounts[k] * t, 0.0) + (m.strength + m.discounts[k] * tables) * below[up]) / (m.strength + everyone)
        return below

    def sweep(self, totals: Totals, number: int) -> None:
        """Reseats all dishes, from the longest contexts to none."""
        m = self.model
        others = lambda k, at, t: np.maximum(totals.tables[k][at] - t, 0)
        self.t2 = seated(self.c2, m.strength, others(2, self.at2, self.t2), self.predictive(totals, 1)[self.up2], m.discounts[2], self.key2, 3 * number)
        self._carry1()
        self.t1 = seated(self.c1, m.strength, others(1, self.at1, self.t1), self.predictive(totals, 0)[self.up1], m.discounts[1], self.key1, 3 * number + 1)
        self._carry0()
        self.t0 = seated(self.c0, m.strength, others(0, 0, self.t0), 1.0 / (m.types + 1), m.discounts[0], self.key0, 3 * number + 2)


class WordSeats(Seats):
    """Seats with the restaurants of whole words as level 3; their totals come pair by pair. The low 16 bits of a context are its ending."""

    def __init__(self, keys, contexts, counts, rows, model: Model) -> None:
        groups, self.up3 = _groups(rows * CONTEXTS + contexts % CONTEXTS)
        self.at3, self.rows3 = contexts, rows
        with np.errstate(over="ignore"):
            self.key3 = keys[rows] * np.uint64(41) + (contexts.view(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        self.c3 = counts.astype(float)
        self.t3 = np.minimum(self.c3, 1)
        super().__init__(keys, groups % CONTEXTS, np.bincount(self.up3, self.t3, len(groups)), groups // CONTEXTS, model)

    def seat(self, t3, t2, t1, t0) -> None:
        """Takes the tables of a sweep before."""
        self.t3, self.t2, self.t1, self.t0 = (t.astype(float) for t in (t3, t2, t1, t0))
        self.c2 = np.bincount(self.up3, self.t3, len(self.at2))
        self._carry1()
        self._carry0()

    def below(self, totals: Totals):
        """Probability of each word after the endings of its contexts."""
        return self.predictive(totals, 2)[self.up3]

    def predictive_words(self, below, customers, tables):
        """Probability of each word after each of its contexts, given the totals of those restaurants."""
        m = self.model
        return (np.maximum(self.c3 - m.discounts[3] * self.t3, 0.0) + (m.strength + m.discounts[3] * tables) * below) / (m.strength + customers)

    def sweep_words(self, totals: Totals, below, tables, number: int) -> None:
        m = self.model
        self.t3 = seated(self.c3, m.strength, np.maximum(tables - self.t3, 0), below, m.discounts[3], self.key3, 3 * number)
        self.c2 = np.bincount(self.up3, self.t3, len(self.at2))
        self.sweep(totals, number)


STATE = "bucket long, range long, tables binary, t3 binary, t2 binary, t1 binary, t0 binary, total binary, marks binary"
STATE_SCHEMA = pa.schema([("bucket", pa.int64()), ("range", pa.int64()), *[(name, pa.binary()) for name in ("tables", "t3", "t2", "t1", "t0", "total", "marks")]])
MARKS = [(k, what) for k in range(3) for what in ("customers", "tables")] + [(k, "few") for k in range(4)]
MARK_SIZES = [4 if what == "few" else (1, PARENTS, CONTEXTS)[k] for k, what in MARKS]


def _contexts(row: dict):
    """The contexts of a merged row, and the row's word that each belongs to."""
    sizes = np.frombuffer(row["sizes"], np.int32)
    return _loose(row["contexts"], int(sizes.sum())), np.repeat(np.arange(len(sizes)), sizes)


def _ranged(contexts, ranges: int):
    """Where the ranges of sorted contexts begin, and which ranges these are."""
    own = ((contexts >> 32) + (1 << 31)) * ranges >> 32
    heads = np.flatnonzero(_heads(own))
    return heads, own[heads]


def _own(ranges: int):
    """Each bucket's contexts with their customers there, by range; a row is numbered bucket * ranges + range."""

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                contexts, at = np.unique(_contexts(row)[0], return_inverse=True)
                n = np.bincount(at, _spread(row["sums"], np.int64), len(contexts)).astype(np.int64)
                heads, own = _ranged(contexts, ranges)
                sizes = np.diff(np.append(heads, len(contexts)))
                yield pa.RecordBatch.from_arrays([pa.array(row["bucket"] * ranges + own), _pack(contexts, sizes), _pack(n, sizes)], ["bucket", "context", "n"])

    return cut


ASKED = "range long, bucket long, places binary, customers binary"
ASKED_SCHEMA = pa.schema([("range", pa.int64()), ("bucket", pa.int64()), ("places", pa.binary()), ("customers", pa.binary())])


def _numbered(ranges: int):
    """Of a range, where each bucket's contexts are among all; and, as bucket -1, the customers of all."""

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        own = rows[0]["bucket"] % ranges
        contexts, at = np.unique(_numbers([r["context"] for r in rows], np.int64), return_inverse=True)
        customers = np.bincount(at, _numbers([r["n"] for r in rows], np.int64)).astype(np.int64)
        places = np.split(at, np.cumsum([len(r["context"]) // 8 for r in rows])[:-1])
        return pa.Table.from_pylist(
            [{"range": own, "bucket": -1, "customers": customers.tobytes()}] + [{"range": own, "bucket": r["bucket"] // ranges, "places": _steps(p)} for r, p in zip(rows, places)], ASKED_SCHEMA
        )

    return number


BACK = "bucket long, range long, customers binary, tables binary"


def _added(asked: pa.Table, tables: pa.Table) -> pa.Table:
    """Customers and tables of a range's restaurants, for each bucket's contexts."""
    everyone, *asked = asked.sort_by("bucket").to_pylist()
    values = [np.frombuffer(x, np.int64) for x in tables.sort_by("bucket").column("tables").to_pylist()]
    sizes, places = [len(x) for x in values], np.concatenate([_walked(r["places"]) for r in asked])
    customers = np.frombuffer(everyone["customers"], np.int64)
    sums = np.bincount(places, np.concatenate(values), len(customers)).astype(np.int64)
    return pa.Table.from_arrays([
        pa.array([r["bucket"] for r in asked], pa.int64()), pa.array([r["range"] for r in asked], pa.int64()), _pack(customers[places], sizes), _pack(sums[places], sizes),
    ], ["bucket", "range", "customers", "tables"])


def _seats(row: dict, model: Model) -> WordSeats:
    """Seats of a merged row; before the first sweep it has no tables yet."""
    contexts, owners = _contexts(row)
    seats = WordSeats(np.frombuffer(row["words"], np.uint64), contexts, _spread(row["sums"], np.int64), owners, model)
    if row.get("t3") is not None:
        seats.seat(*(np.frombuffer(row[name], np.int32) for name in ("t3", "t2", "t1", "t0")))
    return seats


def _marks(seats: WordSeats) -> bytes:
    """Totals of the restaurants of endings in a bucket, and how many dishes of each level have one, two customers."""
    sums = []
    for k, (c, t, at) in enumerate(((seats.c0, seats.t0, np.zeros(seats.n, np.int64)), (seats.c1, seats.t1, seats.at1), (seats.c2, seats.t2, seats.at2))):
        sums += [np.bincount(at, c, MARK_SIZES[2 * k]), np.bincount(at, t, MARK_SIZES[2 * k])]
    sums += [[np.count_nonzero(c == 1), np.count_nonzero(c == 2), np.count_nonzero(c), c.sum()] for c in (seats.c0, seats.c1, seats.c2, seats.c3)]
    return np.concatenate(sums).astype(np.int64).tobytes()


def _stated(bucket: int, seats: WordSeats, contexts, at, ranges: int, total) -> list:
    """A bucket's rows of STATE: its seats, and the tables of its contexts by range."""
    tables = np.bincount(at, seats.t3, len(contexts)).astype(np.int64)
    heads, own = _ranged(contexts, ranges)
    rows = [{"bucket": bucket, "range": r, "tables": x.tobytes()} for r, x in zip(own.tolist(), np.split(tables, heads[1:]))]
    found = {name: getattr(seats, name).astype(np.int32).tobytes() for name in ("t3", "t2", "t1", "t0")}
    return [*rows, {"bucket": bucket, **found, "total": None if total is None else total.tobytes(), "marks": _marks(seats)}]


def _first(ranges: int):
    """Rows of STATE when every dish has one table."""

    def seat(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                seats = _seats(row, Model([], (0.5,) * 4, 1.0, 0, 0, 0))
                yield pa.RecordBatch.from_pylist(_stated(row["bucket"], seats, *np.unique(seats.at3, return_inverse=True), ranges, None), STATE_SCHEMA)

    return seat


def _gathered(state: DataFrame, model: Model) -> tuple[Totals, list]:
    """Totals of the restaurants of endings, and how many dishes of each level have one, two customers."""

    def add(batches: Iterator) -> Iterator:
        sums = np.zeros(sum(MARK_SIZES), np.int64)
        for batch in batches:
            for marks in batch.column(0).to_pylist():
                sums += np.frombuffer(marks, np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    rows = state.where("marks IS NOT NULL").select("marks").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(sum(MARK_SIZES))
    sums[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    totals, few = Totals(), []
    for (k, name), part in zip(MARKS, np.split(sums, np.cumsum(MARK_SIZES)[:-1])):
        if name == "few":
            few.append(part)
        else:
            getattr(totals, name)[k] = part
    return totals, few


def _step(shared, number: int, sweep: bool, ranges: int):
    """Adds what the seats predict after the burn-in, then reseats."""

    def step(rows: pa.Table, back: pa.Table) -> pa.Table:
        model, row, back = shared.value, rows.to_pylist()[0], back.sort_by("range")
        seats, totals = _seats(row, model), model.totals[0]
        contexts, at = np.unique(seats.at3, return_inverse=True)
        customers, tables = (_numbers(back.column(name).to_pylist(), np.int64).astype(float)[at] for name in ("customers", "tables"))
        below, total = seats.below(totals), None
        if number > model.burn_in:
            total = np.zeros(len(at), np.float32) if row["total"] is None else np.frombuffer(row["total"], np.float32)
            total = total + seats.predictive_words(below, customers, tables).astype(np.float32)
        if sweep:
            seats.sweep_words(totals, below, tables, number)
        return pa.Table.from_pylist(_stated(row["bucket"], seats, contexts, at, ranges, total), STATE_SCHEMA)

    return step


def fit(corpus: DataFrame, buckets: int, ranges: int, sweeps: int = 5, burn_in: int = 2, strength: float = 1.0) -> tuple[DataFrame, Model]:
    """Rows of STATE with the summed probabilities of all sweeps after the burn-in, from merged rows (bucket, words, sizes, contexts, sums).

    Discounts are n1 / (n1 + 2 n2) of each level, n1 and n2 the dishes with one and two
    customers when every dish has one table.
    """
    if not 0 <= burn_in < sweeps:
        raise ValueError("at least one sweep must follow the burn-in")
    spark = corpus.sparkSession
    # where each bucket's contexts are in their ranges, and the customers of their restaurants, which stay the same
    own = stage(corpus.mapInArrow(_own(ranges), "bucket long, context binary, n binary"))
    asked = own.groupBy(F.pmod("bucket", F.lit(ranges)).alias("range")).applyInArrow(_numbered(ranges), ASKED)
    asked = stage_by(asked, "range", ranges)
    forget(own)
    release(spark)
    model = Model([], (0.5,) * 4, strength, 0, 0, burn_in)
    state = stage_by(corpus.mapInArrow(_first(ranges), STATE), "bucket", buckets)
    for number in range(sweeps + 1):
        totals, few = _gathered(state, model)
        if not number:
            model.discounts = tuple(float(np.clip(f[0] / max(f[0] + 2 * f[1], 1.0), 0.1, 0.95)) for f in few)
            model.tokens, model.types = int(few[3][3]), int(few[0][2])
        model.totals = [totals]
        tables = state.where("range IS NOT NULL").select("range", "bucket", "tables")
        back = asked.groupBy("range").cogroup(tables.groupBy("range")).applyInArrow(_added, BACK)
        seats = state.where("range IS NULL").select("bucket", "t3", "t2", "t1", "t0", "total")
        before, step = state, _step(spark.sparkContext.broadcast(model), number, number < sweeps, ranges)
        state = stage_by(corpus.join(seats.hint("merge"), "bucket").groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(step, STATE), "bucket", buckets)
        forget(before)
        del back, tables, seats
        release(spark)
    forget(asked)
    return state, model


ANSWERS = "home long, bucket long, known binary, logs binary"


def _answers(times: int):
    """For each block, to the bucket of its texts, the training counts of its words and the logs of its pairs in a bucket, in the block's order."""

    def answer(rows: pa.Table, state: pa.Table) -> pa.Table:
        whole = rows.filter(pc.is_null(rows.column("block"))).to_pylist()[0]
        sizes = np.frombuffer(whole["sizes"], np.int32)
        owners = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(owners, _spread(whole["sums"], np.int64), len(sizes)).astype(np.int64)
        logs = np.log10(np.frombuffer(state.column("total")[0].as_py(), np.float32).astype(float) / times).astype(np.float32)
        found = []
        for row in rows.filter(pc.is_valid(rows.column("block"))).to_pylist():
            places = _walked(row["places"])
            words = owners[places]
            found.append({"home": -row["block"], "bucket": whole["bucket"], "known": known[words[_heads(words)]].tobytes(), "logs": logs[places].tobytes()})
        return pa.Table.from_pylist(found, pa.schema([("home", pa.int64()), ("bucket", pa.int64()), ("known", pa.binary()), ("logs", pa.binary())]))

    return answer


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(tokens: int, types: int):
    def block(words: pa.Table, texts: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        logs, known = (_numbers(words.column(name).to_pylist(), kind) for name, kind in (("logs", np.float32), ("known", np.int64)))
        base = np.log10((known + 0.1) / (tokens + 0.1 * (types + 1)))
        numbers, endings = _spread(texts.column("packed")[0].as_py(), np.int32), _spread(texts.column("endings")[0].as_py(), np.uint16)
        lengths = texts.column("lengths").combine_chunks().flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        keys = _pairs(numbers, lengths, _ranks(endings, int(numbers[lengths[0] - 1])))
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int32)
        at[order] = np.cumsum(_heads(keys[order])) - 1
        del keys, order

        def add(x, at):
            sums = np.zeros(len(lengths), np.int64 if x.dtype.kind == "i" else float)
            for i in range(0, len(lengths), 512):
                a, b = starts[i], starts[i + 512] if i + 512 < len(starts) else len(at)
                sums[i:i + 512] = np.add.reduceat(x[at[a:b]], starts[i:i + 512] - a, dtype=sums.dtype)
            return sums

        return pa.table({
            "doc_id": texts.column("doc_ids").combine_chunks().flatten(), "n_tokens": pa.array(lengths.astype(np.int64)),
            "n_known": pa.array(add((known > 0).astype(np.int64), numbers)), "train_tokens": pa.array(np.full(len(lengths), tokens)),
            "base_score": pa.array(add(base, numbers)), "score": pa.array(add(logs, at)),
        })

    return block


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id", learn: str = "learn", sweeps: int = 5, burn_in: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` marks the rows that the model learns from; a null counts as false. A-Z
    count as a-z; each text ends with an end token, so a null or empty text has one token.
    Words not in the training texts share the base's one unknown word. Without any
    training text all words are that one. Perplexity is 10 ** (-score / n_tokens).
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pairs = size // PAIR_BYTES
    buckets = max(1, -(-pairs // BUCKET_PAIRS), min(16, pairs // 4096))
    flow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(learn).alias("learn"))
    laid = stage_by(flow.mapInArrow(_blocks(buckets), LAID).groupBy("bucket").applyInArrow(_merged, LAID), "bucket", buckets)
    release(docs.sparkSession)
    corpus = laid.where("words IS NOT NULL").select("bucket", "words", "sizes", "contexts", "sums")
    state, model = fit(corpus, buckets, -(-size // (SHARD_BLOCKS * BLOCK_BYTES)) or 1, sweeps, burn_in)
    asked = laid.where("packed IS NULL").select("bucket", "block", "sizes", "sums", "places")
    served = state.where("range IS NULL").select("bucket", "total")
    picked = asked.groupBy("bucket").cogroup(served.groupBy("bucket")).applyInArrow(_answers(sweeps - burn_in), ANSWERS)
    texts = laid.where("packed IS NOT NULL").select("bucket", "doc_ids", "lengths", "endings", "packed")
    return picked.groupBy("home").cogroup(texts.groupBy("bucket")).applyInArrow(_summed(model.tokens, model.types), SCORES)
