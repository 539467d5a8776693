"""Exact Jaccard join of n-gram sets by prefix trees.

1. Each text becomes the set of its distinct word n-grams (64-bit hashes). Equal sets
   form a class, told by 128 bits; one row per class goes on.
2. A class takes its rarest n-grams, as many as the threshold demands: two sets that
   are similar enough share one of them. Rarity is looked up in a table of counters of
   fixed size, which orders n-grams alike everywhere; it is no filter.
3. Classes that share such an n-gram are compared by size and by parity bitmaps, whose
   distance never exceeds the number of n-grams in which two sets differ. What passes
   ties the classes into candidate groups.
4. Inside a group, sets in one order of their n-grams are stored in a prefix tree with
   merged single branches. Each set walks the tree; sets below a branch share the
   overlap counted so far, and branches whose remaining lengths cannot reach the needed
   overlap are left. A walk ends early only when all sets it could still find are
   already in its component, which no further link can change.

Large groups, of an n-gram or of candidates, are cut into blocks, and every pair of
blocks is a task of its own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis.llm.common import ascii_lower, forget, stage, words
from parvis.llm.components import connected_components

COUNTERS = 1 << 18  # counters of the rarity table: 1 MB, whatever the input
BLOCK_MEMBERS = 8_192  # classes of an n-gram in one block
BLOCK_NGRAMS = 1 << 20  # n-grams of the sets in one block of a candidate group
BITMAP = 1 << 12  # most bits of a parity bitmap, which goes with every shared n-gram of a prefix; any width is a valid bound
BROADCAST_IDS = 1 << 20  # as many ids at most are broadcast to find their texts: 8 MB; more are joined


def ngram_set(text: Column, n: int) -> Column:
    """Distinct hashes of ``n`` words in a row; of the whole sequence if it is shorter; none without words."""
    return F.transform(F.array(words(ascii_lower(text))), lambda w: F.when(
        F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))
    ).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))[0]


def needed_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), ngram_set(F.col(text), n).alias("grams"))


def rarity(sets: DataFrame):
    """Counters of n-gram occurrences over all rows, by the low bits of the hash; a NumPy array of ``COUNTERS`` numbers."""
    import numpy as np

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            grams = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(grams & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    rows = sets.select("grams").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(COUNTERS, np.int64)
    for r in rows:
        table[r.slot] = r.n
    return table


def _keys(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, size, h1, h2, bitmap and prefix (the rarest n-grams) of every row; empty sets have an empty prefix."""
    import numpy as np

    table = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, prefixes, bitmaps = table.value, [], []
            values, offsets = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for a, b in zip(offsets[:-1], offsets[1:]):
                grams, size = values[a:b], int(b - a)
                kept = size - -(-percent * size // 100) + 1 if size else 0
                order = np.lexsort((grams, counts[grams & (COUNTERS - 1)]))[:kept]
                prefixes.append(grams[order])
                width = min(1 << max(6, (size * (100 - percent) // 20).bit_length()), BITMAP)  # five bits or more for an n-gram that may differ
                bits = np.bincount((grams >> 24) & (width - 1), minlength=width) & 1
                bitmaps.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
            lengths = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum([len(p) for p in prefixes], out=lengths[1:])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(bitmaps, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))],
                ["doc_id", "size", "h1", "h2", "bitmap", "prefix"],
            )

    ready = sets.select("doc_id", "grams", F.size("grams").cast("long").alias("size"), F.sort_array("grams").alias("s"))
    ready = ready.select("doc_id", "grams", "size", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), F.col("s")).alias("h2"))
    return ready.mapInArrow(keyed, "doc_id long, size long, h1 long, h2 long, bitmap binary, prefix array<long>")


def _fold(bitmap: int, width: int, to: int) -> int:
    """Parity bits of ``width`` slots as those of ``to`` slots."""
    while width > to:
        width //= 2
        bitmap = (bitmap >> width) ^ (bitmap & ((1 << width) - 1))
    return bitmap


def _tied(percent: int):
    """Over rows sorted by (gram, one, two): a spanning forest of the pairs that may be similar, as edges (a, b)."""

    def forest(rows: list) -> list[tuple[int, int]]:
        edges, left = [], rows
        crossing = rows[0][4] != rows[0][5]
        while left:
            reached, left = [left[0]], left[1:]
            while reached and left:
                node, size, bits, width, _, _, block = reached.pop()
                rest = []
                for other in left:
                    m, small = other[1], min(width, other[3])
                    fits = 100 * min(size, m) >= percent * max(size, m) and not (crossing and block == other[6])
                    if fits:
                        apart = (_fold(bits, width, small) ^ _fold(other[2], other[3], small)).bit_count()
                        fits = apart <= size + m - 2 * needed_overlap(size, m, percent)
                    if fits:
                        edges.append((node, other[0]))
                        reached.append(other)
                    else:
                        rest.append(other)
                left = rest
        return edges

    def ties(batches: Iterator) -> Iterator:
        import pandas as pd

        at, group = None, []
        for frame in batches:
            edges = []
            for r in frame.itertuples(index=False):
                if at != (r.gram, r.one, r.two):
                    edges += forest(group) if len(group) > 1 else []
                    at, group = (r.gram, r.one, r.two), []
                group.append((r.node, r.size, int.from_bytes(r.bitmap, "little"), 8 * len(r.bitmap), r.one, r.two, r.block))
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
        edges = forest(group) if len(group) > 1 else []
        yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return ties


def _blocks(rows: DataFrame, block: Column, blocks: Column) -> DataFrame:
    """A row for each pair of blocks that its own block belongs to: block, one <= two."""
    rows = rows.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")


def candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of classes that may be linked with another one. ``classes``: node, size, bitmap, prefix."""
    grams = classes.select("node", F.explode("prefix").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    members = grams.join(shared, "gram").join(classes.select("node", "size", "bitmap"), "node")
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS)
    paired = _blocks(members, F.pmod(F.xxhash64("node"), blocks), blocks).select("gram", "one", "two", "block", "node", "size", "bitmap")
    ordered = paired.repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two")
    return connected_components(ordered.mapInPandas(_tied(percent), "a long, b long"))


class Tree:
    """Sets of increasing numbers in a prefix tree whose single branches are merged."""

    __slots__ = ("run", "below", "least", "most", "sets")

    def __init__(self, run, least: int, most: int) -> None:
        self.run, self.below, self.least, self.most, self.sets = run, {}, least, most, []

    def add(self, items, name) -> None:
        import numpy as np

        node, at, size = self, 0, len(items)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if at == size:
                node.sets.append(name)
                return
            child = node.below.get(items[at])
            if child is None:
                leaf = Tree(items[at:], size, size)
                leaf.sets.append(name)
                node.below[items[at]] = leaf
                return
            m = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:m] != items[at:at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.run):  # cut the branch where the sets part
                upper = Tree(child.run[:same], child.least, child.most)
                child.run = child.run[same:]
                upper.below[child.run[0]] = child
                node.below[items[at]] = upper
                child = upper
            node, at = child, at + same

    def similar(self, items, member, percent: int, done) -> Iterator:
        """Names of stored sets similar to ``items``; ``member`` marks its numbers. ``done()`` ends the walk."""
        import numpy as np

        size, stack = len(items), [(self, 0, 0)]
        while stack and not done():
            node, depth, overlap = stack.pop()
            overlap += int(np.count_nonzero(member[node.run]))
            depth += len(node.run)
            if node.most * 100 < percent * size or size * 100 < percent * node.least:
                continue
            after = size - int(np.searchsorted(items, node.run[-1], "right")) if len(node.run) else size
            shortest = max(node.least, -(-percent * size // 100))
            if overlap + min(after, node.most - depth) < needed_overlap(size, shortest, percent):
                continue
            if node.sets and overlap >= needed_overlap(size, depth, percent):
                yield from node.sets
            stack.extend((child, depth, overlap) for child in node.below.values())


class Union:
    """Disjoint sets with a count of those among the names stored so far."""

    def __init__(self) -> None:
        self.up, self.count = {}, 0

    def add(self, x) -> None:
        if x not in self.up:
            self.up[x] = x
            self.count += 1

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.count -= 1


def tree_join(nodes, grams, blocks, labels, percent: int) -> list[tuple[int, int]]:
    """(label, least label of its component) over the sets of one task.

    With one block, all pairs are looked for; with two, those across. Sets of equal
    ``labels`` are known to be connected.
    """
    import numpy as np

    sizes = np.array([len(g) for g in grams])
    flat, numbers = np.unique(np.concatenate(grams), return_inverse=True)
    counts = np.bincount(numbers, minlength=len(flat))
    rank = np.empty(len(flat), np.int64)  # frequent first, so that similar sets share the beginning
    rank[np.lexsort((flat, -counts))] = np.arange(len(flat))
    ends = np.cumsum(sizes)
    items = [np.sort(rank[numbers[e - s:e]]) for e, s in zip(ends, sizes)]
    order = sorted(range(len(nodes)), key=lambda i: (int(sizes[i]), nodes[i]))
    first = min(blocks)
    crossing = max(blocks) != first
    tree, union, member = Tree(np.zeros(0, np.int64), 1 << 60, 0), Union(), np.zeros(len(flat), bool)
    for label in labels:
        union.add(label)
    stored = Union() if not crossing else None
    if crossing:
        for i in order:
            if blocks[i] == first:
                tree.add(items[i], labels[i])
    inside = list({labels[i] for i in order if blocks[i] == first}) if crossing else []
    apart = [len(inside)]  # components of the stored block, known after each join
    for i in order:
        if crossing and blocks[i] == first:
            continue
        mine = labels[i]
        if crossing:
            done = lambda mine=mine: apart[0] == 1 and union.root(mine) == union.root(inside[0])
            if done():
                continue
        else:
            stored.add(mine)
            done = lambda: stored.count == 1
        member[items[i]] = True
        for other in tree.similar(items[i], member, percent, done):
            union.join(mine, other)
            if crossing:
                apart[0] = len({union.root(x) for x in inside}) if apart[0] > 1 else 1
            else:
                stored.join(mine, other)
        member[items[i]] = False
        if not crossing:
            tree.add(items[i], mine)
    return [(int(x), int(union.root(x))) for x in dict.fromkeys(labels)]


def _joined(percent: int):
    def join(frame):
        import pandas as pd

        grams = [g for g in frame["grams"]]
        found = tree_join(list(frame["node"]), grams, list(frame["block"]), list(frame["label"]), percent)
        return pd.DataFrame(found, columns=["node", "component"], dtype="int64")

    return join


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Two rows are linked when 100 * intersection >= ``percent`` * union of their sets of
    ``n``-grams. A-Z count as a-z. Texts without words (null, empty) have an empty set and
    are linked with nothing. Rows with the same doc_id are the same document for links.
    A row without doc_id has the component of the rows it equals, or null.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    sets = _sets(docs, text, key, n)
    rows = stage(_keys(sets, percent))
    known = rows.where("size > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("prefix").alias("prefix")
    )
    classes = stage(classes)
    ids = classes.select("h1", "h2", "node")
    # documents with several rows, and so perhaps several sets, tie those together
    several = known.select("doc_id", "h1", "h2").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    same = known.join(several, "doc_id", "left_semi").join(ids, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # a class is told by its own hash from here on, since doc_ids may be repeated
    groups = candidate_groups(classes.select(F.col("h1").alias("node"), "size", "bitmap", "prefix"), percent)

    # the whole sets of the classes in groups, each from one row: the texts first, so that no other text is moved
    wanted = stage(ids.withColumnsRenamed({"node": "doc_id", "h1": "node"}).drop("h2").join(groups, "node"))
    own, count = wanted.select("doc_id").distinct(), wanted.count()
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    texts = stage(texts.join(F.broadcast(own) if count <= BROADCAST_IDS else own, "doc_id", "left_semi"))
    full = texts.join(wanted, "doc_id").select("node", "component", ngram_set(F.col("text"), n).alias("grams"))
    # compared as a column of a written table, or the hash of every text would become a key of the join
    sets_of = stage(full)
    full = sets_of.where(F.xxhash64(F.sort_array("grams")) == F.col("node"))
    if sets_of.count() > count:  # repeated doc_ids
        full = stage(full.dropDuplicates(["node"]))
    blocks = full.groupBy("component").agg(F.ceil(F.sum(F.size("grams")) / BLOCK_NGRAMS).alias("blocks"))
    placed = full.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("label", F.col("node"))
    labels = labelled = stage(
        placed.select("component", "block", "node", "label", "grams").groupBy("component", "block")
        .applyInPandas(_joined(percent), "node long, component long")
    )
    large = blocks.where("blocks > 1")
    if not large.isEmpty():
        across = _blocks(placed.drop("label").join(large.select("component"), "component", "left_semi"), F.col("block"), F.col("blocks")).where("one < two")
        across = across.join(labels.select("node", F.col("component").alias("label")), "node").select("component", "one", "two", "block", "node", "label", "grams")
        ties = across.groupBy("component", "one", "two").applyInPandas(_joined(percent), "node long, component long")
        roots = connected_components(ties.toDF("a", "b")).toDF("label", "root")
        labels = labels.withColumnRenamed("component", "label").join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("component"))

    # back to documents: the least doc_id of a component
    named = ids.withColumnsRenamed({"node": "rep", "h1": "node"}).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named)
    for done in (groups, wanted, texts, sets_of, labelled):
        forget(done)
    if not same.isEmpty():
        joined = connected_components(same.unionByName(named.join(named.groupBy("component").agg(F.min("rep").alias("b")), "component").select(F.col("rep").alias("a"), "b")))
        named = named.join(joined.toDF("rep", "least"), "rep", "left").withColumn("least", F.coalesce("least", "rep"))
    else:
        named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component")
    out = rows.select("doc_id", F.col("size").alias("n_shingles"), "h1", "h2").join(named.select(F.col("node").alias("h1"), "h2", "least"), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
