"""Near-duplicate embeddings: a neighbour graph refined by NN-descent, audited, cut at a cosine threshold."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.components import components
from kinfold.llm.scratch import bounded_batches, drop_table, materialise

#: Neighbours that a list holds while the graph is refined.
NEIGHBOURS = 8
#: Vectors that one block or one side of a tile has.
BLOCK = 384
#: Least random-hyperplane tables that seed a label's graph, and rounds of neighbours-of-neighbours joins.
TABLES, ROUNDS = 4, 2
#: Chance that a pair at the threshold meets in one of a label's tables, whatever the label's size.
MEET = 0.99
#: Vectors whose links the audit finds by brute force (a bounded sample by hash, labels in turn), and the recall it asks for.
AUDIT, RECALL = 2048, 0.97
#: Times that tables and rounds are added when the audit is not met.
RETRIES = 3


def _valid(vector: str, label: str, key: str) -> F.Column:
    v = F.col(vector)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [np.array(x, "<f8").tobytes() for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "vec"])


def grouped(work: Callable[[list, list[list]], Iterator[pa.RecordBatch]], n_key: int):  # noqa: ANN201
    """Rows sorted by their first ``n_key`` columns, handed over a group at a time; groups are bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cols = None, None
        for b in batches:
            lists = [c.to_pylist() for c in b.columns]
            keys = list(zip(*lists[:n_key], strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != key:
                    if key is not None:
                        yield from work(key, cols)
                    key, cols = keys[at], [[] for _ in lists[n_key:]]
                for held, new in zip(cols, lists[n_key:], strict=True):
                    held.extend(new[at:to])
                at = to
        if key is not None:
            yield from work(key, cols)

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each vertex of a boolean matrix."""
    at = np.arange(len(linked))
    while True:
        near = np.where(linked, at[None, :], len(at)).min(axis=1)
        nxt = np.minimum(at, near)
        nxt = nxt[nxt]
        if (nxt == at).all():
            return at
        at = nxt


EDGES = "u long, v long, sim double"


def _edges(u, v, sim) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _best(k: int, threshold: float):  # noqa: ANN202
    """Of a block: every vector's nearest, and a star of each group that links join (so that lists full of copies
    cannot split it).  Columns: id, vector, and the similarity that a neighbour must exceed."""

    def work(_: list, cols: list[list]) -> Iterator[pa.RecordBatch]:
        ids, least = np.array(cols[0], np.int64), np.array(cols[2], np.float64)
        if len(ids) < 2:
            return
        m = _unit(cols[1])
        for a in range(0, len(ids), BLOCK):
            part, own = m[a : a + BLOCK], ids[a : a + BLOCK]
            sim = part @ part.T
            np.fill_diagonal(sim, -2)
            n = min(k, len(own) - 1)
            if n < 1:
                continue
            top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            val = np.take_along_axis(sim, top, axis=1)
            r, c = np.nonzero(val > least[a : a + BLOCK, None])
            root = _roots(sim >= threshold)
            s = np.flatnonzero(root != np.arange(len(own)))
            # a star edge stands for a chain of links: its similarity is the mark 3, which no cosine has
            yield _edges(np.concatenate([own[r], own[s]]), np.concatenate([own[top[r, c]], own[root[s]]]), np.concatenate([val[r, c], np.full(len(s), 3.0)]))

    return work


def tables_for(bits: int, threshold: float) -> int:
    """Tables of ``bits`` hyperplanes in which a pair at the threshold meets with a chance of ``MEET``: each plane leaves
    it together with a chance of 1 - angle / pi.  (Below a cosine of 0 the number is that of 0.)"""
    apart = 1 - (1 - np.arccos(np.clip(threshold, 0, 1)) / np.pi) ** bits
    return max(TABLES, int(np.ceil(np.log(1 - MEET) / np.log(apart)))) if bits and apart > 0 else TABLES


def _sign_bits(tables: dict, bits: dict, seed: int):  # noqa: ANN202
    """Random-hyperplane signatures: a row per vector and table of its label."""
    every = range(min((t.start for t in tables.values()), default=0), max((t.stop for t in tables.values()), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, raw = (c.to_pylist() for c in b.columns)
            out = []
            for size in {len(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if len(x) == size]
                m = _unit([raw[i] for i in at])
                for t in every:
                    planes = np.random.default_rng([seed, t, size]).standard_normal((size // 8, 24))
                    signs = (m @ planes > 0).astype(np.int64)
                    for row, i in enumerate(at):
                        label = labels[i]
                        n = bits[label, size]
                        if t in tables[label, size]:
                            out.append((label, size, t, int(signs[row, :n] @ (1 << np.arange(n))) if n else 0, ids[i]))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["label", "size", "t", "sig", "u"])

    return run


def seeds(vectors: DataFrame, attempt: int, threshold: float, seed: int) -> DataFrame:
    """Edges among vectors that a random-hyperplane table puts together.  Bits follow the label's number of vectors
    (a table of labels), and the number of tables follows the bits; every attempt has tables of its own.  A signature
    that still has many is dealt over several blocks by hash."""
    sizes = vectors.groupBy("label", F.octet_length("vec").alias("size")).count().collect()  # one row per label
    bits = {(r.label, r.size): min(24, max(0, int(np.ceil(np.log2(r["count"] / (BLOCK / 2)))))) for r in sizes}
    number = {k: tables_for(n, threshold) for k, n in bits.items()}
    tables = {k: range(n * attempt, n * (attempt + 1)) for k, n in number.items()}
    signed = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vec").mapInArrow(_sign_bits(tables, bits, seed), "label long, size int, t int, sig long, u long")
    signed = materialise(signed, "nn-signatures")
    where = ["label", "size", "t", "sig"]
    many = signed.groupBy(*where).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    dealt = signed.join(many, where, "left").withColumn("part", F.pmod(F.xxhash64("u", "t"), F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(BLOCK // 2)).cast("long")).cast("int"))
    rows = dealt.join(vectors.select(F.col("vec_id").alias("u"), "vec"), "u").select(*where, "part", "u", "vec", F.lit(-1.0).alias("least"))
    edges = materialise(rows.repartition(*where, "part").sortWithinPartitions(*where, "part").mapInArrow(grouped(_best(NEIGHBOURS, threshold), 5), EDGES), "nn-edges")
    drop_table(signed)
    return edges


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """Each vector's ``k`` nearest of what is known."""
    once = edges.where("sim < 3").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def descend(vectors: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """One round: around every vector its neighbours, and those that have it as theirs, are compared with each other;
    edges that improve on an end's list come back."""
    least = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(-1.0).alias("least"))
    both = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("m"))).distinct()
    member = vectors.select(F.col("vec_id").alias("m"), "vec").join(least.withColumnRenamed("u", "m"), "m", "left").select("m", "vec", F.coalesce("least", F.lit(-1.0)).alias("least"))
    # a vector that very many have as a neighbour is dealt over several blocks
    rows = both.join(member, "m").withColumn("part", F.lit(0))
    heavy = both.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    rows = rows.join(heavy, "c", "left").withColumn("part", F.pmod(F.xxhash64("m", "c"), F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(BLOCK // 2)).cast("long")).cast("int"))
    rows = rows.select("c", "part", "m", "vec", "least").repartition("c", "part").sortWithinPartitions("c", "part")
    return rows.mapInArrow(grouped(_best(3, threshold), 2), EDGES)


def _count_tile(threshold: float):  # noqa: ANN202
    """Columns after component and tile: which side, id, vector, copies.  Per id the copies it links to."""

    def work(key: list, cols: list[list]) -> Iterator[pa.RecordBatch]:
        side, ids, w = np.array(cols[0]), np.array(cols[1], np.int64), np.array(cols[3], np.int64)
        m = _unit(cols[2])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if key[1] == key[2]:
            linked = m @ m.T >= threshold
            np.fill_diagonal(linked, False)
            yield pa.RecordBatch.from_pydict({"u": pa.array(ids), "n": pa.array(linked @ w)})
        else:
            linked = m[a] @ m[b].T >= threshold
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate([ids[a], ids[b]])), "n": pa.array(np.concatenate([linked @ w[b], linked.T @ w[a]]))})

    return work


def link_counts(vectors: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``u, n``: links of each vector within its component, with copies.  A full list is thereby enlarged to all that
    its component holds; components are compared in tiles of ``BLOCK``, and only counts leave a tile."""
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nb"))
    rows = members.join(size, "component").join(vectors.select(F.col("vec_id").alias("v"), "vec", "copies"), "v")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("v"), F.col("nb").cast("long")).cast("int"))
    rows = rows.select("component", "v", "vec", "copies", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    tiles = rows.select("component", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.when(F.col("blk") <= F.col("other"), 0).otherwise(1).alias("side"), "v", "vec", "copies")
    tiles = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return tiles.mapInArrow(grouped(_count_tile(threshold), 3), "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))


def _audit(queries: list[tuple], threshold: float):  # noqa: ANN202
    """Brute force: how many others (with copies) each audited vector links to."""
    by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for label, size in {(q[1], len(q[2])) for q in queries}:
        some = [q for q in queries if (q[1], len(q[2])) == (label, size)]
        by[label, size] = np.array([q[0] for q in some], np.int64), _unit([q[2] for q in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, raw, copies = (c.to_pylist() for c in b.columns)
            for (label, size), (q, m) in by.items():
                at = [i for i, x in enumerate(raw) if labels[i] == label and len(x) == size]
                if at:
                    linked = m @ _unit([raw[i] for i in at]).T >= threshold
                    linked &= q[:, None] != np.array([ids[i] for i in at])[None, :]
                    yield pa.RecordBatch.from_pydict({"u": pa.array(q), "n": pa.array(linked @ np.array([copies[i] for i in at], np.int64))})

    return run


def judge(rows: list) -> dict[str, tuple[int, float]]:
    """Of rows ``label, true, found``: per label, and per power of four of the links, how many vectors with links were
    audited and the mean share of a vector's links that was found.  Every vector counts the same, so a large component
    does not outweigh pairs."""
    shares: dict[str, list[float]] = {}
    for r in rows:
        if r.true:
            for group in (f"label {r.label}", f"{4 ** ((r.true.bit_length() - 1) // 2)} links or more"):
                shares.setdefault(group, []).append(min(1.0, r.found / r.true))
    return {k: (len(v), sum(v) / len(v)) for k, v in shares.items()}


def near_duplicates(table: DataFrame, *, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 5) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, reaches
    ``threshold``.  Rows without a key, and vectors that are null, zero or hold a null or non-finite component, link
    with nothing (a null key has a null component and is not kept); vectors of different lengths never link.

    Equal vectors of a label are one vertex with a number of copies.  The graph is seeded by random hyperplanes and
    refined by joins of neighbours with neighbours' neighbours; edges below the threshold go.  The audit compares the
    links of ``AUDIT`` vectors with brute force over all rows; if a label or a size of neighbourhood is below ``RECALL``
    (see :func:`judge`), more tables and rounds follow, and after the last ones an error.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("_ok", _valid("embedding", "label", "vec_id"))
    packed = materialise(rows.where("_ok").select("vec_id", "label", "embedding").mapInArrow(_pack, "vec_id long, label long, vec binary"), "nn-rows")
    classes = packed.groupBy("label", "vec").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    vectors = materialise(classes.select("vec_id", "label", "vec", "copies"), "nn-vectors")
    turn = Window.partitionBy("label").orderBy("_h", "vec_id")
    ranked = vectors.withColumn("_h", F.xxhash64(F.lit(seed), "vec_id")).withColumn("_r", F.row_number().over(turn)).where(F.col("_r") <= AUDIT)
    queries = [(r.vec_id, r.label, bytes(r.vec)) for r in ranked.orderBy("_r", "_h").limit(AUDIT).collect()]

    truth = vectors.select("vec_id", "label", "vec", "copies").mapInArrow(_audit(queries, threshold), "u long, n long").groupBy("u").agg(F.sum("n").alias("true"))
    truth = materialise(truth, "nn-audit")
    asked = {q[0]: q[1] for q in queries}
    held: list[DataFrame] = []
    for attempt in range(RETRIES + 1):
        held.append(seeds(vectors, attempt, threshold, seed))
        for _ in range(ROUNDS):
            edges = functools.reduce(DataFrame.unionByName, held)
            graph = materialise(nearest(edges, NEIGHBOURS), "nn-graph")
            stars = edges.where("sim >= 3").distinct()
            grown = materialise(graph.unionByName(stars).unionByName(descend(vectors, graph, threshold)), "nn-edges")
            for gone in (graph, *held):
                drop_table(gone)
            held = [grown]
        members = components(held[0].where(F.col("sim") >= threshold), "u", "v")
        counts = materialise(link_counts(vectors, members, threshold), "nn-counts")
        found = truth.join(counts, "u", "left").select("u", "true", F.coalesce("n", F.lit(0)).alias("found")).collect()
        low = {k: v for k, v in judge([Row(label=asked[r.u], true=r.true, found=r.found) for r in found]).items() if v[1] < RECALL}
        if not low:
            break
    else:
        raise RuntimeError(f"near_duplicates misses links: the audit asks for {RECALL} and found, of vectors with links, " + ", ".join(f"{share:.3f} of {n} ({k})" for k, (n, share) in sorted(low.items())))
    drop_table(held[0])
    named = vectors.join(members, vectors["vec_id"] == members["v"], "left").join(counts, vectors["vec_id"] == counts["u"], "left")
    named = named.select("label", "vec", F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    linked = packed.join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
