"""Near-duplicate documents by word n-gram Jaccard similarity: a join on prefix trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.bytestext import U64, mix, row_blocks, shingle_sets, text_bytes
from kinfold.llm.components import components
from kinfold.llm.hits import filled_ids, id_slot, key_bits
from kinfold.llm.scratch import bounded_batches, drop_table, lean, materialise, release

#: Rows of bytes worked on at once.
BLOCK = 2 << 20
#: Most entries of the list of frequent n-grams that end the global order, and of a task's share in it (16 bytes each,
#: whatever the input).
FREQUENT, TASK_FREQUENT = 1 << 19, 1 << 17
#: Rounds of stars before the remaining pairs are counted.
STARS = 2
#: Members that a tree has when pairs are verified, and documents of one tree when candidates are sought.
JOB, TREE = 256, 2048
#: n-grams of a path beyond the one that a tree is about (what lies further counts as shared until it is verified).
LOOK = 128
#: Candidates that a document has of one tree in the first round; each later round takes eight times as many more.
FIRST_ROUND = 16
#: Documents of trees that a task walks at once, and the pairs of a query and a document that a walk may begin with.
FOREST, CELLS = 4096, 1 << 20
#: Keys of frequent n-grams lie above all others.
LATE = 1 << 62
PAD = (1 << 63) - 1

CONST = U64(0xA0761D6478BD642F)


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in row_blocks(offsets, BLOCK):
        yield from enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width), a)


def _count_frequent(width: int):  # noqa: ANN202
    """Per task: n-grams that occur in at least 3 of its documents, the most frequent first, with counts."""

    def fold(held: list[np.ndarray], old: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return old
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = np.concatenate([old[0], keys[n >= 3]]), np.concatenate([old[1], n[n >= 3]])
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n, len(keys)).astype(np.int64)
        if len(keys) > TASK_FREQUENT:
            top = np.argpartition(-n, TASK_FREQUENT)[:TASK_FREQUENT]
            keys, n = keys[top], n[top]
        return keys, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = (np.zeros(0, U64), np.zeros(0, np.int64))
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, s in _sets(b, 0, width):
                held.append(s)
                size += len(s)
                if size > 1 << 21:
                    old, held, size = fold(held, old), [], 0
        keys, n = fold(held, old)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    return run


class Order:
    """The global order of n-grams: by hash, but the frequent ones last, by frequency.  Any fixed order gives exact
    results; this one keeps passages that many documents share out of the prefixes."""

    def __init__(self, grams: list[int]) -> None:
        keys = np.array(grams, np.int64).view(U64)
        at = np.argsort(keys)
        self.keys, self.rank = keys[at], at

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a set sorted by hash: the others, then the frequent ones, rarest first, and their ranks."""
        if not len(self.keys) or not len(s):
            return s, s[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        late = self.keys[at] == s
        rank = self.rank[at[late]]
        turn = np.argsort(-rank)  # the list is most frequent first, so larger ranks are rarer
        return s[~late], s[late][turn], rank[turn]

    def sort(self, s: np.ndarray) -> np.ndarray:
        return np.concatenate(self.split(s)[:2])

    def sort_keys(self, s: np.ndarray) -> np.ndarray:
        """The set as numbers whose order is the global one.  Two of the hash's bits are left out: n-grams that agree in
        the others count as one here, which makes candidates more, never fewer."""
        rare, _, rank = self.split(s)
        return np.concatenate([(rare >> U64(2)).astype(np.int64), LATE + len(self.keys) - rank])


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    sums = ([int(mix(s ^ c).sum(dtype=U64)) for s in sets] for c in (U64(0), CONST))
    return tuple(pa.array(np.array(x, U64).view(np.int64)) for x in sums)


def _prefixes(order: Order, width: int, percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in _sets(b, 1, width)]
            pre = [order.sort_keys(s)[: len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0] for s in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in pre])]).astype(np.int32)
            flat = np.concatenate(pre) if pre else np.zeros(0, np.int64)
            h1, h2 = _digests(sets)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array(map(len, sets), pa.int32()), "h1": h1, "h2": h2, "prefix": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))})

    return run


#: Number of a set: equal sets have the same.
VERTEX = ("n", "h1", "h2")


def _ordered_sets(order: Order, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in _sets(b, 1, width)]
            grams = [order.sort(s).astype(">u8").tobytes() for s in sets]
            h1, h2 = _digests(sets)
            yield pa.RecordBatch.from_pydict({"n": pa.array(map(len, sets), pa.int32()), "h1": h1, "h2": h2, "grams": pa.array(grams, pa.binary())})

    return run


def _wanted(bits: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(filled_ids(bits, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    return run


def sets_of(pairs: DataFrame, classes: DataFrame, rows: DataFrame, order: Order, width: int) -> DataFrame:
    """``v, grams``: the globally ordered sets of the vertices in ``pairs``, from the texts of their representatives.  A
    fixed-size bitmap of their keys keeps most other texts out of the shuffle of the semi-join."""
    asked = pairs.select(F.explode(F.array("q", "m")).alias("v")).distinct().join(classes.select("v", "rep"), "v")
    ids = asked.select(F.col("rep").alias("doc_id")).distinct()
    some = rows.where("doc_id IS NOT NULL").mapInArrow(lean(_wanted(key_bits(ids, id_slot("doc_id")))), "doc_id long, text string")
    texts = some.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = texts.mapInArrow(lean(_ordered_sets(order, width)), "n int, h1 long, h2 long, grams binary").select(F.xxhash64(*VERTEX).alias("v"), "grams")
    return materialise(sets.join(asked.select("v").hint("shuffle_hash"), "v", "left_semi").dropDuplicates(["v"]), "ngram-sets")


def possible(percent: int) -> F.Column:
    """Whether a pair that shares ``together`` prefix grams (sizes ``nq`` and ``nm``) can still be similar.

    Of two prefixes, every shared gram up to the end of the one that ends first lies in both; beyond it that set has
    its size less its prefix left.  So the overlap is at most ``together`` plus the larger of the two remainders.
    """
    ceiling = lambda c: F.ceil(F.lit(percent) * F.col(c) / F.lit(100.0))
    need = F.ceil(F.lit(percent) * (F.col("nq") + F.col("nm")) / F.lit(100.0 + percent))
    sizes = F.lit(100) * F.least("nq", "nm") >= F.lit(percent) * F.greatest("nq", "nm")
    return sizes & (F.col("together") + F.greatest(ceiling("nq"), ceiling("nm")) - 1 >= need - F.lit(1e-9))


def in_reach(percent: int) -> F.Column:
    """Whether a document and the head ``h`` of a shared n-gram can be similar, by the n-gram's places in both ordered sets:
    they share no more than the fewer n-grams before it, itself, and the fewer after it."""
    before = F.least("pos", "h.pos")
    after = F.least(F.col("n") - F.col("pos") - 1, -F.col("h.n") - F.col("h.pos") - 1)
    return before + 1 + after >= F.ceil(F.lit(percent) * (F.col("n") - F.col("h.n")) / F.lit(100.0 + percent) - F.lit(1e-9))


class PrefixTree:
    """A trie of globally ordered sets, kept flat: the sets in lexicographic order, each with the depth at which it
    leaves its predecessor's path.  Walking them in that order visits every edge of the trie once."""

    STEP = 32

    def __init__(self, sets: list[tuple[int, bytes]]) -> None:
        self.sets = sorted(sets, key=lambda x: x[1])
        self.arrays = [np.frombuffer(g, ">u8").astype(U64) for _, g in self.sets]
        self.depth = [0]
        for a, b in zip(self.arrays, self.arrays[1:]):
            m = min(len(a), len(b))
            odd = np.flatnonzero(a[:m] != b[:m])
            self.depth.append(int(odd[0]) if len(odd) else m)

    def similar(self, grams: bytes, percent: int) -> Iterator[int]:
        """Ids of the sets x with ``100 * |x & q| >= percent * |x | q|``.

        ``shared[d]`` is the overlap of the current path's first d grams with q; a branch reuses what lies above its
        fork.  Below a node, no set can gain more than the grams it has left (or q has left): when that is too few,
        the walk stops there, and sets that fork further down are dismissed by one comparison each.
        """
        q = np.sort(np.frombuffer(grams, ">u8").astype(U64))
        shared = np.zeros(1, np.int64)
        for (key, _), x, fork in zip(self.sets, self.arrays, self.depth, strict=True):
            known = min(fork, len(shared) - 1)
            total = len(x) + len(q)
            need = -(-percent * total // (100 + percent))
            parts, at, have = [shared[: known + 1]], known, int(shared[known])
            while at < len(x) and have + min(len(x) - at, len(q) - have) >= need:
                part = x[at : at + self.STEP]
                where = np.minimum(np.searchsorted(q, part), max(len(q) - 1, 0))
                parts.append(have + np.cumsum(q[where] == part))
                have, at = int(parts[-1][-1]), at + len(part)
            shared = np.concatenate(parts)
            if at == len(x) and have >= need and 100 * have >= percent * (total - have):
                yield key


def _verify(percent: int):  # noqa: ANN202
    """Rows sorted by job: the queries of a job come before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, queries, members, out = None, [], [], []

        def done() -> None:
            if queries and members:
                tree = PrefixTree(members)
                for g in queries:
                    out.extend((job[0], m) for m in tree.similar(g, percent))

        for b in batches:
            q, part, m, grams = (c.to_pylist() for c in b.columns)
            for i in range(b.num_rows):
                if (q[i], part[i]) != job:
                    done()
                    job, queries, members = (q[i], part[i]), [], []
                if m[i] is None:
                    queries.append(grams[i])
                else:
                    members.append((m[i], grams[i]))
            if len(out) > 10000:
                yield _pairs(out)
                out.clear()
        done()
        yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], pa.int64()), "m": pa.array([r[1] for r in rows], pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(q, m)`` whose sets are similar.  A query's members are dealt into jobs of about ``JOB``, each with
    its own prefix tree, so a query with very many members fills no task."""
    count = pairs.groupBy("q").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > JOB)
    jobs = pairs.join(count, "q", "left").select("q", "m", F.pmod(F.xxhash64("m"), F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(JOB)).cast("long")).cast("int").alias("part"))
    members = jobs.join(sets, jobs["m"] == sets["v"]).select("q", "part", "m", "grams")
    heads = jobs.select("q", "part").distinct()
    heads = heads.join(sets, heads["q"] == sets["v"]).select("q", "part", F.lit(None).cast("long").alias("m"), "grams")
    rows = heads.unionByName(members).repartition("q", "part").sortWithinPartitions("q", "part", F.col("m").asc_nulls_first())
    return rows.mapInArrow(lean(_verify(percent)), "q long, m long")


class PathTree:
    """Tries of documents that share an n-gram, side by side under one root: each document's path holds the n-grams of
    its prefix that follow the shared one and that documents of other components have too.  Kept flat: paths in
    lexicographic order, and per depth the nodes as ranges of them, with what bounds all documents below a node."""

    def __init__(self, tree: np.ndarray, paths: list[np.ndarray], places: list[np.ndarray], n: np.ndarray, at: np.ndarray) -> None:
        m, depth = len(paths), max(map(len, paths)) + 2  # first the tree, last padding, so every path ends
        keys = np.full((m, depth), PAD, np.int64)
        keys[:, 0] = tree
        left = np.repeat((n - at - 1)[:, None], depth, axis=1)
        for i, (k, p) in enumerate(zip(paths, places, strict=True)):
            keys[i, 1 : len(k) + 1] = k
            left[i, 1 : len(k) + 1] = n[i] - p - 1
        self.order = np.lexsort(keys.T[::-1])
        keys, left, n = keys[self.order], left[self.order], n[self.order]
        self.names = np.unique(np.concatenate([*paths, np.zeros(0, np.int64)]))
        self.levels = []
        new = np.zeros(m, bool)
        new[0] = True
        for d in range(depth):
            new = new.copy()
            new[1:] |= keys[1:, d] != keys[:-1, d]
            lo = np.flatnonzero(new)
            self.levels.append((lo, np.append(lo[1:], m), keys[lo, d], np.maximum.reduceat(left[:, d], lo), np.minimum.reduceat(n, lo), np.maximum.reduceat(n, lo)))

    def walk(self, tree: np.ndarray, paths: list[np.ndarray], n: np.ndarray, end: np.ndarray, beyond: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
        """All queries go down together, each in its own tree, a depth at a time: ``(query, first, last, shared)`` where
        a walk ends.

        A node's ``shared`` is its parent's, plus one if the query has its n-gram.  Below it no document can share more
        than what it has left, so a subtree goes when that is too few, or its sizes do not suit.  Beyond the end of the
        query's own prefix nothing is known of what it shares, and the walk ends.
        """
        wide = len(self.names) + 1
        own = np.sort(np.concatenate([i * wide + np.searchsorted(self.names, k) for i, k in enumerate(paths)] + [np.full(1, PAD)]))
        q, node = np.arange(len(paths)), np.searchsorted(self.levels[0][2], tree)
        shared = np.zeros(len(q), np.int64)
        for above, (lo, hi, key, left, least, most) in zip(self.levels, self.levels[1:]):
            first = np.searchsorted(lo, above[0][node])
            many = np.searchsorted(lo, above[1][node]) - first
            ends = np.cumsum(many)
            node = np.repeat(first - (ends - many), many) + np.arange(int(ends[-1]))
            q, shared = np.repeat(q, many), np.repeat(shared, many)
            sizes = (percent * n[q] <= 100 * most[node]) & (percent * least[node] <= 100 * n[q]) & (most[node] >= n[q])
            q, node, shared = q[sizes], node[sizes], shared[sizes]
            out = (key[node] > end[q]) | (key[node] == PAD)
            yield q[out], lo[node[out]], hi[node[out]], shared[out]
            q, node, shared = q[~out], node[~out], shared[~out]
            if not len(q):
                return
            name = q * wide + np.searchsorted(self.names, key[node])
            shared = shared + (own[np.searchsorted(own, name)] == name)
            need = -(-percent * (n[q] + least[node]) // (100 + percent))
            stay = 1 + shared + beyond[q] + left[node] >= need
            q, node, shared = q[stay], node[stay], shared[stay]
            if not len(q):
                return


def tree_pairs(rows: list[list], percent: int, skip: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates ``(query, other)`` among documents of the same tree that lie in different components, and the trees
    that have more of them than were taken.  Columns: tree, whether only pairs of two blocks count, document, size,
    component, place of the shared n-gram, end of the prefix, path, places of the path, n-grams beyond the path, block,
    the component now, and whether the document may be the larger one here.  Ranks disregard what rounds have joined since the first, so that each candidate has its
    turn in one round."""
    tree, across, doc, n, comp, at, end, beyond, block, now, native = (np.array(rows[k], np.int64) for k in (0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12))
    paths, places = [np.array(x, np.int64) for x in rows[7]], [np.array(x, np.int64) for x in rows[8]]
    trie = PathTree(tree, paths, places, n, at)
    rest = -(-percent * n // 100) - 1  # what a set has beyond its prefix
    found: list[tuple[np.ndarray, ...]] = []
    load = np.cumsum(np.bincount(tree)[tree])  # a query begins with as many as its tree has
    cuts = [0, *np.flatnonzero(load[1:] // CELLS != load[:-1] // CELLS) + 1, len(doc)]
    for a, b in zip(cuts, cuts[1:]):
        for q, lo, hi, shared in trie.walk(tree[a:b], paths[a:b], n[a:b], end[a:b], beyond[a:b], percent):
            if not len(q):
                continue
            many = hi - lo
            ends = np.cumsum(many)
            y = trie.order[np.repeat(lo - (ends - many), many) + np.arange(int(ends[-1]))]
            x, shared = np.repeat(q, many) + a, np.repeat(shared, many)
            good = (comp[x] != comp[y]) & ((n[x] < n[y]) | ((n[x] == n[y]) & (doc[x] < doc[y]))) & (100 * n[x] >= percent * n[y])
            good &= ((across[x] == 0) | (block[x] != block[y])) & (native[y] > 0)
            x, y, shared = x[good], y[good], shared[good]
            # after the end of the path that ends first, they share no more than what either has left there
            have = 1 + shared + np.maximum(np.minimum(beyond[x], LOOK + beyond[y]), np.minimum(beyond[y], LOOK + beyond[x]))
            # of the two, the set whose prefix ends first has its size less its prefix left
            ceiling = have + np.where(end[x] <= end[y], rest[x], rest[y])
            good = ceiling >= -(-percent * (n[x] + n[y]) // (100 + percent))
            found.append((x[good], y[good], have[good]))
    if not found:
        return doc[:0], doc[:0], tree[:0]
    x, y, have = (np.concatenate(c) for c in zip(*found, strict=True))
    turn = np.lexsort((doc[y], -have, x))
    x, y = x[turn], y[turn]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    apart = now[x] != now[y]
    take = apart & (rank >= skip) & (rank < skip + keep)
    return doc[x[take]], doc[y[take]], np.unique(tree[x[apart & (rank >= skip + keep)]])


def _trees(percent: int, skip: int, keep: int):  # noqa: ANN202
    """Rows sorted by tree and tile: gram, class of size, tile (two blocks), and the columns of :func:`tree_pairs` from the document on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names = None, []
        cols: list[list] = [[] for _ in range(13)]

        def done() -> Iterator[pa.RecordBatch]:
            if len(cols[0]) > 1:
                q, m, more = tree_pairs(cols, percent, skip, keep)
                if len(q) or len(more):
                    again = [names[t] for t in more.tolist()]
                    pairs, trees = pa.nulls(len(q), pa.int64()), pa.nulls(len(again), pa.int64())
                    ends = (pa.concat_arrays([pa.array(c), trees]) for c in (q, m))
                    marks = (pa.concat_arrays([pairs, pa.array([t[k] for t in again], pa.int64())]) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([*ends, *marks], ["q", "m", "gram", "cls"])
            for c in (*cols, names):
                c.clear()

        for b in batches:
            lists = [c.to_pylist() for c in b.columns]
            for row in zip(*lists, strict=True):
                if row[:4] != key:
                    if len(cols[0]) >= FOREST:
                        yield from done()
                    key = row[:4]
                    names.append(row[:2])
                for c, v in zip(cols, (len(names) - 1, row[2] != row[3], *row[4:]), strict=True):
                    c.append(v)
        yield from done()

    return run


def worth_a_tree(percent: int) -> F.Column:
    """Whether an n-gram's documents (``m`` of them, sizes and numbers of n-grams that follow from ``least`` to ``most``) can have
    a candidate.  Of a pair of sizes a <= b that suit each other, the prefixes share at most ``1 + follow`` and the rest
    has at most ceil(t * b) - 1, while t * (a + b) / (1 + t) are needed; of two documents both numbers are known."""
    t = F.lit(percent / 100.0)
    a, b = F.col("least.n"), F.col("most.n")
    follow = F.when(F.col("m") == 2, F.least("least.follow", "most.follow")).otherwise(F.col("follow"))
    enough = 1 + follow + F.ceil(t * b) - 1 >= F.ceil(t * (a + b) / (1 + t) - F.lit(1e-9))
    suits = a >= t * b - F.lit(1e-9)
    return F.when(suits, enough).otherwise(F.col("m") > 2)


def paths_of(open_: DataFrame) -> DataFrame:
    """``rep, n, c, end, path``: per document its n-grams in ``open_`` in order, with their places (no more than a prefix)."""
    path = F.array_sort(F.collect_list(F.struct("gram", "pos")))
    return open_.groupBy("rep").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("end").alias("end"), path.alias("path"))


def candidates(paths: DataFrame, labels: DataFrame | None, trees: DataFrame | None, percent: int, skip: int, keep: int) -> DataFrame:
    """``q, m`` from the trees of the n-grams in ``paths`` whose documents, by ``labels``, are still in different
    components, and ``gram, cls`` of trees that have more.  Light rows say which n-grams are worth a tree; only for those
    the paths are dealt.  ``trees`` are those that the round before left unfinished (none: the first round, all trees);
    components only grow, so no other tree has a candidate left."""
    if labels is not None:
        paths = paths.join(labels.select(F.col("v").alias("rep"), "component"), "rep", "left").withColumn("now", F.coalesce("component", "rep")).drop("component")
    else:
        paths = paths.withColumn("now", F.col("c"))
    grams = F.transform("path", lambda x: x["gram"])
    light = paths.select("rep", "n", "now", (F.size("path") - 1).alias("_last"), F.posexplode(grams).alias("_k", "gram")).withColumn("follow", F.col("_last") - F.col("_k"))
    # sizes that suit each other are of one class or of neighbouring ones: a document goes to its own class, and to the
    # next as the smaller one
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100 - 1e-6))).cast("int")
    light = light.select("rep", "n", "now", "follow", "gram", F.explode(F.array(F.struct(own.alias("cls"), F.lit(1).alias("native")), F.struct((own + 1).alias("cls"), F.lit(0).alias("native")))).alias("s"))
    light = light.select("rep", "n", "now", "follow", "gram", "s.cls", "s.native")
    if trees is not None:
        light = light.join(trees, ["gram", "cls"], "left_semi")
    both = F.struct("n", "follow")
    size = light.groupBy("gram", "cls").agg(F.count(F.lit(1)).alias("m"), F.max("native").alias("_any"), F.min("now").alias("_lo"), F.max("now").alias("_hi"), F.min(both).alias("least"), F.max(both).alias("most"), F.max("follow").alias("follow"))
    # an n-gram that very many have is dealt over tiles of two blocks each
    size = size.where("_any = 1 AND _lo <> _hi").where(worth_a_tree(percent)).select("gram", "cls", F.ceil(F.col("m") / F.lit(TREE)).cast("int").alias("blocks"))
    wanted = light.select("rep", "gram", "cls", "native").join(size, ["gram", "cls"]).groupBy("rep").agg(F.collect_list(F.struct("gram", "cls", "native", "blocks")).alias("wanted"))
    each = paths.join(wanted, "rep").select("rep", "n", "c", "now", "end", "path", grams.alias("keys"), F.explode("wanted").alias("w"))
    each = each.select("*", "w.gram", "w.cls", "w.native", F.array_position("keys", F.col("w.gram")).cast("int").alias("_k"), F.pmod(F.xxhash64("rep"), F.col("w.blocks").cast("long")).cast("int").alias("block"))
    ahead = F.slice("path", F.col("_k") + 1, F.lit(LOOK))
    others = F.when(F.col("w.blocks") > 1, F.sequence(F.lit(0), F.col("w.blocks") - 1)).otherwise(F.array(F.lit(0)))
    tiles = each.withColumn("_other", F.explode(others))
    rows = tiles.select(
        "gram", "cls", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "rep", "n", "c", F.get("path", F.col("_k") - 1)["pos"].alias("pos"), "end",
        F.transform(ahead, lambda x: x["gram"]).alias("ahead"), F.transform(ahead, lambda x: x["pos"]).alias("places"), F.greatest(F.size("path") - F.col("_k") - LOOK, F.lit(0)).alias("beyond"), "block", "now", "native",
    )
    tree = ("gram", "cls", "i", "j")
    return rows.repartition(*tree).sortWithinPartitions(*tree).mapInArrow(lean(_trees(percent, skip, keep)), "q long, m long, gram long, cls long")


def shared_postings(ones: DataFrame) -> DataFrame:
    """``rep, pos, gram, df``: the n-grams of prefixes that several sets have.  Most are of one set only and leave here, so
    a row in the exchange holds no more than the n-gram and its place, and crosses it once.  Frequent n-grams are counted
    before their exchange."""
    posted = ones.select("rep", F.posexplode("prefix").alias("pos", "gram"))
    rare = posted.where(F.col("gram") < LATE).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    late = posted.where(F.col("gram") >= LATE)
    late = late.join(late.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    return rare.unionByName(late).where("df > 1")


def still_open(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with their components, where an n-gram's documents still lie in different ones."""
    if labels is not None:
        named = labels.select(F.col("v").alias("rep"), F.col("component").alias("_c"))
        postings = postings.join(named, "rep", "left").withColumn("c", F.coalesce("_c", "rep")).drop("_c")
    mixed = postings.groupBy("gram").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("gram")
    return postings.join(mixed, "gram")


def similar_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links).

    A document's set holds its distinct word ``width``-grams (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) as
    64-bit hashes; a shorter text is one gram; a text without words has none and links with nothing.  Two documents
    link when ``100 * |A & B| >= percent * |A | B|``.  Rows without a key are their own (null) component; rows that
    share a key are rows of their own, each in the component of its text.  Null and empty texts have no words, equal
    texts link, an empty table gives an empty result, and other columns are not looked at.

    1. Equal sets collapse into one representative, pre-aggregated, whatever the group's size.
    2. Each representative posts the prefix of its globally ordered set that any similar set must touch.
    3. ``STARS`` rounds: per posted gram, all are paired with the document nearest to the middle of its group (not with each
       other); pairs that share enough posted grams are verified.  This joins large groups of copies cheaply.
    4. The documents of each gram that are then still in different components form a trie of what follows that gram in
       their prefixes.  All of them walk it together, sharing partial overlaps and leaving subtrees whose remaining
       lengths are too short (:class:`PathTree`).  What is left at the end of a walk is verified on whole sets.
       Each document takes its best candidates first; rounds go on until none is left between components, so the
       result is exact.
    A gram that very many have is dealt over tiles of ``TREE`` documents.  Only links leave a tree or a verification, and
    no gram's documents are gathered before they are dealt.  Sets of all documents are never stored: the texts of pairs
    that are verified are read again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = rows.select("text").mapInArrow(lean(_count_frequent(width)), "gram long, n long")
    top = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT)
    order = Order([r.gram for r in top.collect()])
    sized = materialise(rows.mapInArrow(lean(_prefixes(order, width, percent)), "doc_id long, n int, h1 long, h2 long, prefix array<long>"), "ngram-prefixes")

    # a vertex is a set, whatever rows have it; rows that share a key but not a text are different vertices
    vertices = sized.select("doc_id", "n", F.xxhash64(*VERTEX).alias("v"), "prefix")
    ids = materialise(vertices.drop("prefix"), "ngram-rows")
    real = "n > 0 AND doc_id IS NOT NULL"
    classes = materialise(ids.where(real).groupBy("v").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    ones = materialise(vertices.where(real).select(F.col("v").alias("rep"), "n", "prefix").dropDuplicates(["rep"]), "ngram-ones")
    drop_table(sized)
    release(spark)
    shared = materialise(shared_postings(ones), "ngram-shared")
    release(spark)
    # the more others share of a document's prefix, the nearer it is to the middle of a group of copies
    each = ones.select("rep", "n", F.element_at("prefix", -1).alias("end"))
    each = each.join(shared.groupBy("rep").agg(F.sum("df").alias("_df")), "rep").select("rep", "n", "end", (F.col("_df") / F.col("n")).alias("middle"))
    open_ = materialise(shared.join(each, "rep").select("gram", "rep", "n", "pos", "end", "middle", F.col("rep").alias("c")), "ngram-open")
    for gone in (shared, ones):
        drop_table(gone)
    release(spark)

    done: DataFrame | None = None
    used: DataFrame | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None

    def link(pairs: DataFrame) -> None:
        nonlocal done, links, labels
        if done is not None:
            pairs = pairs.join(done, ["q", "m"], "left_anti")
        pairs = materialise(pairs, "ngram-pairs")
        if pairs.isEmpty():
            return
        sets = sets_of(pairs, classes, rows, order, width)
        release(spark)
        found = materialise(verified(pairs, sets, percent), "ngram-links")
        drop_table(sets)
        release(spark)
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if labels is not None:
            drop_table(labels)
        labels = components(links, "q", "m")
        release(spark)

    def renew() -> None:
        nonlocal open_
        now = materialise(still_open(open_, labels), "ngram-open")
        drop_table(open_)
        open_ = now
        release(spark)

    for _ in range(STARS):
        heads = open_ if used is None else open_.join(used, "rep", "left_anti")
        heads = heads.groupBy("gram").agg(F.max(F.struct("middle", (-F.col("n")).alias("n"), (-F.col("rep")).alias("rep"), "c", "pos")).alias("h"))
        star = open_.join(heads, "gram").where(F.col("c") != F.col("h.c")).where(in_reach(percent))
        h, hn, r, n = -F.col("h.rep"), -F.col("h.n"), F.col("rep"), F.col("n")
        first = (hn < n) | ((hn == n) & (h < r))
        star = star.select(h.alias("h"), *(F.when(first, a).otherwise(b).alias(c) for a, b, c in ((h, r, "q"), (r, h, "m"), (hn, n, "nq"), (n, hn, "nm"))))
        counted = materialise(star.groupBy("h", "q", "m", "nq", "nm").agg(F.count(F.lit(1)).alias("together")).where(possible(percent)), "ngram-star")
        link(counted.select("q", "m").distinct())
        heads = counted.select(F.col("h").alias("rep")).distinct()
        used = heads if used is None else used.unionByName(heads)
        renew()
    skip, keep, trees = 0, FIRST_ROUND, None
    paths = materialise(paths_of(open_), "ngram-paths")
    drop_table(open_)
    release(spark)
    while True:
        found = materialise(candidates(paths, labels, trees, percent, skip, keep), "ngram-candidates")
        release(spark)
        link(found.where("q IS NOT NULL").select("q", "m").distinct())
        if trees is not None:
            drop_table(trees)
        trees = materialise(found.where("gram IS NOT NULL").select("gram", F.col("cls").cast("int").alias("cls")).distinct(), "ngram-trees")
        drop_table(found)
        if trees.isEmpty():
            drop_table(trees)
            break
        skip, keep = skip + keep, 8 * keep
    drop_table(paths)

    if labels is not None:
        least = classes.join(labels, "v").groupBy("component").agg(F.min("rep").alias("least"))
        classes = classes.join(labels, "v", "left").join(least, "component", "left").select("v", F.coalesce("least", "rep").alias("rep"))
    ids = ids.join(classes, "v", "left")
    own = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    return ids.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs, width=4, percent=85)
