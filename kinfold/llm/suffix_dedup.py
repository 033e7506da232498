"""Removal of byte passages that an earlier document holds, by suffix arrays sorted in two stages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bytestext import BASE, INVERSE, U64, mix, powers, text_bytes
from kinfold.llm.scratch import bounded_batches, materialise, partitions

#: Bytes of an anchor; a passage of ``length`` bytes holds one that its content alone decides.
ANCHOR = 24
#: Bytes of text worked on at once, and of one suffix array.
BLOCK = 1 << 20
#: Anchors held before they are sent on.
FLUSH = 1 << 20
#: A packed minimum: the hash in the upper 40 bits, the place in the lower 24.
PLACE = U64((1 << 24) - 1)


# --- the suffix array ------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of at least their first ``depth`` bytes, by two-stage sorting.

    Stage 1 sorts directly only the suffixes smaller than their successors.  Stage 2 scans the buckets of first bytes
    upwards: each suffix met puts its predecessor, if that is larger than its successor, at the end of what its
    bucket has so far.  A bucket's induced suffixes precede its sorted ones.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the end is smaller than any byte
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    rising = step[nxt] > 0  # smaller than its successor
    direct = np.flatnonzero(rising)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").reshape(-1), kind="stable")]
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(text[-1])].append(np.array([n - 1], np.int64))
    out: list[np.ndarray] = []

    def put(chunk: np.ndarray) -> None:
        before = chunk[chunk > 0] - 1
        before = before[~rising[before]]
        if len(before):
            to = text[before]
            at = np.argsort(to, kind="stable")
            to, before = to[at], before[at]
            edges = np.flatnonzero(to[1:] != to[:-1]) + 1
            for part, c in zip(np.split(before, edges), to[np.concatenate([[0], edges])].tolist(), strict=True):
                induced[c].append(part)

    for c in range(256):
        k = 0
        while k < len(induced[c]):  # a run of one byte adds to its own bucket
            put(induced[c][k])
            k += 1
        out.extend(induced[c])
        sorted_part = direct[cuts[c] : cuts[c + 1]]
        if len(sorted_part):
            put(sorted_part)
            out.append(sorted_part)
    return np.concatenate(out)


def first_owner(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each passage of ``length`` bytes at ``starts`` the smallest owner of an equal one."""
    if not len(starts):
        return owners
    at = np.full(len(text), -1, np.int64)
    at[starts] = np.arange(len(starts))
    order = at[suffix_array(text, -(-length // 8) * 8)]
    order = order[order >= 0]
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
    a, b = starts[order[:-1]], starts[order[1:]]
    same = np.ones(len(a), bool)
    for k in sorted({*range(0, length - 7, 8), length - 8}):  # does the common prefix of neighbours reach length?
        same &= words[a + k] == words[b + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(owners[order], np.concatenate([[0], np.flatnonzero(~same) + 1]))
    out = np.empty_like(owners)
    out[order] = least[group]
    return out


# --- anchors ---------------------------------------------------------------------------------------------------


def window_anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of ``length`` bytes the packed least hash of the ``ANCHOR``-grams within, leftmost if equal."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    grams = len(data) - ANCHOR + 1
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data))[: len(data)], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:grams]) * powers(INVERSE, len(data))[:grams])
    h = (h & ~PLACE) | np.arange(grams, dtype=U64)
    width, have = length - ANCHOR + 1, 1
    while have < width:  # minima of doubled widths
        step = min(have, width - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h[:n]


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, last row, from, to)`` of blocks of bytes; a row over ``BLOCK`` is cut into pieces that overlap
    by ``length - 1`` bytes, so that each start is in one piece."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        if last > row:
            last = min(last, n)
            yield row, last, int(offsets[row]), int(offsets[last])
            row = last
        else:
            a, end = int(offsets[row]), int(offsets[row + 1])
            while a < end:
                yield row, row + 1, a, min(end, a + BLOCK + length - 1)
                a += BLOCK
            row += 1


def block_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Per block: its bytes, where it begins, its windows' starts in it (rows' ends respected) and packed anchors."""
    for first, last, a, b in pieces(offsets, length):
        part = data[a:b]
        packed = window_anchors(part, length)
        if not len(packed):
            continue
        good = np.ones(len(packed), bool)
        for end in offsets[first + 1 : last] - a:
            good[max(0, end - length + 1) : end] = False
        starts = np.flatnonzero(good)
        yield part, a, starts, packed[starts]


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _anchor_lists(buckets: int, length: int):  # noqa: ANN202
    """Per flush and bucket: sorted anchor hashes (deltas), the texts that have them (places in a list), the list."""

    def flush(hashes: list[np.ndarray], tags: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        h, t = np.concatenate(hashes), np.concatenate(tags)
        bucket = (h % U64(buckets)).astype(np.int32)
        at = np.lexsort((h, bucket))
        h, t, bucket = h[at], t[at], bucket[at]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(h)]
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            names, place = np.unique(t[a:b], return_inverse=True)
            rows.append((int(bucket[a]), _pack(np.diff(h[a:b], prepend=U64(0))), _pack(place.astype(np.uint32)), names.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "places", "tags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tags, size = [], [], 0
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            tag = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for _, a, starts, packed in block_windows(data, offsets, length):
                new = np.concatenate([[True], packed[1:] != packed[:-1]])
                row = np.searchsorted(offsets, starts[new] + a, "right") - 1
                hashes.append(packed[new] >> U64(24))
                tags.append(tag[row])
                size += int(new.sum())
                if size > FLUSH:
                    yield from flush(hashes, tags)
                    hashes, tags, size = [], [], 0
        yield from flush(hashes, tags)

    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: the anchors that at least two texts have, per text."""

    def done(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, t = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        at = np.lexsort((t, h))
        h, t = h[at], t[at]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[new], t[new]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        h, t = h[twin], t[twin]
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_pydict({"tag": pa.array(t[k : k + 100_000]), "anchor": pa.array(h[k : k + 100_000].astype(np.int64))})

    bucket, held = None, []
    for b in batches:
        for n, hashes, places, tags in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if n != bucket:
                yield from done(held)
                bucket, held = n, []
            held.append((np.cumsum(_unpack(hashes, "<u8"), dtype=U64), np.frombuffer(tags, np.int64)[_unpack(places, "<u4")]))
    yield from done(held)


# --- removal ---------------------------------------------------------------------------------------------------

SPANS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("context", pa.binary())])
SPANS_DDL = "anchor long, doc_id long, tag long, start long, windows long, context binary"


def _runs(starts: np.ndarray, *breaks: np.ndarray) -> np.ndarray:
    """Where runs of consecutive starts begin; a run also ends where any of ``breaks`` changes."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for x in breaks:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    flat = data[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _span_rows(anchor, doc, tag, start, windows, context) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(tag), pa.array(start), pa.array(windows), context], schema=SPANS)


def _within_blocks(length: int):  # noqa: ANN202
    """Map side: the contexts of marked anchors.  Of equal contexts in a block only those of the smallest document go on,
    keyed by anchor; the others are removed here (rows without a context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tag = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(b.column(2))
            marks = b.column(3)
            for part, a, starts, packed in block_windows(data, offsets, length):
                row = np.searchsorted(offsets, starts + a, "right") - 1
                at = _runs(starts, row, packed)
                n = np.diff(np.append(at, len(starts)))
                starts, row, anchor = starts[at], row[at], (packed[at] >> U64(24)).astype(np.int64)
                marked = np.zeros(len(starts), bool)
                cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    own = np.sort(marks[int(row[x])].values.to_numpy(zero_copy_only=False))
                    seg = anchor[x:y]
                    marked[x:y] = own[np.minimum(np.searchsorted(own, seg), len(own) - 1)] == seg
                starts, row, anchor, n = starts[marked], row[marked], anchor[marked], n[marked]
                if not len(starts):
                    continue
                context = _gather(part, starts, n + length - 1)
                least: dict[bytes, int] = {}
                owners, bodies = doc[row].tolist(), context.to_pylist()
                for body, owner in zip(bodies, owners, strict=True):
                    if least.setdefault(body, owner) > owner:
                        least[body] = owner
                gone = np.array([least[body] < owner for body, owner in zip(bodies, owners, strict=True)])
                start = starts + a - offsets[row]
                if gone.any():
                    yield _span_rows(anchor[gone], doc[row[gone]], tag[row[gone]], start[gone], n[gone], pa.nulls(int(gone.sum()), pa.binary()))
                stay = ~gone
                yield _span_rows(anchor[stay], doc[row[stay]], tag[row[stay]], start[stay], n[stay], context.filter(pa.array(stay)))

    return run


def _across_blocks(length: int):  # noqa: ANN202
    """Reduce side: rows sorted by anchor and document.  A context that an earlier document has goes whole; anchors with
    one context are done.  The contexts of the others are joined to suffix arrays of about ``BLOCK`` bytes.  Of a
    group that exceeds it, first holders' contexts go on into the next array, so a group of any size is exact."""

    def decide(held: list[tuple]) -> tuple[pa.RecordBatch | None, np.ndarray]:
        sizes = np.array([len(x[5]) for x in held], np.int64)
        windows = np.array([x[4] for x in held], np.int64)
        text = np.frombuffer(b"".join(x[5] for x in held), np.uint8)
        first = np.cumsum(sizes) - sizes
        item = np.repeat(np.arange(len(held)), windows)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        owner = np.array([x[1] for x in held], np.int64)[item]
        gone = first_owner(text, first[item] + inside, owner, length) < owner
        whole = np.bincount(item, ~gone, len(held)) > 0
        if not gone.any():
            return None, whole
        i, k = item[gone], inside[gone]
        at = _runs(k, i)
        n = np.diff(np.append(at, len(k)))
        rows = [held[j] for j in i[at].tolist()]
        return _span_rows([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], np.array([x[3] for x in rows], np.int64) + k[at], n, pa.nulls(len(at), pa.binary())), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        first: dict[bytes, int] = {}
        size = group_size = 0
        anchor = None
        for b in batches:
            none = b.column(5).is_null()
            if none.true_count:
                yield b.filter(none)  # removed already
                b = b.filter(pa.compute.invert(none))
            cols = [c.to_pylist() for c in b.columns]
            gone: list[int] = []
            for i, (key, doc, body) in enumerate(zip(cols[0], cols[1], cols[5], strict=True)):
                if key != anchor:
                    if len(first) > 1:
                        held += group
                        size += group_size
                    group, first, group_size, anchor = [], {}, 0, key
                    if size > BLOCK:
                        out, _ = decide(held)
                        if out is not None:
                            yield out
                        held, size = [], 0
                if first.setdefault(body, doc) < doc:
                    gone.append(i)
                    continue
                group.append((key, doc, cols[2][i], cols[3][i], cols[4][i], body))
                group_size += len(body)
                if group_size > 8 * BLOCK:
                    out, whole = decide(group)
                    if out is not None:
                        yield out
                    group = [y for y, w in zip(group, whole.tolist(), strict=True) if w]
                    group_size = 0  # what stays is first in order, and bounded by the distinct contexts
            if gone:
                yield b.take(pa.array(gone)).set_column(5, "context", pa.nulls(len(gone), pa.binary()))
        if len(first) > 1:
            held += group
        if held:
            out, _ = decide(held)
            if out is not None:
                yield out

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
KEPT_DDL = "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<from: bigint, to: bigint>>"


def _cut(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, tag, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, merged = (text or "").encode(), []
                for s, n in sorted((x["start"], x["windows"]) for x in spans or ()):
                    e = s + n + length - 1
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept = b"".join(raw[p:q] for p, q in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(raw)], strict=True))
                rows.append((doc, tag, len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"from": s, "to": e} for s, e in merged]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KEPT, strict=True)], schema=KEPT)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 50, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``with_text``,
    the remaining bytes (``kept``) and the removed byte ranges (``spans``); null where nothing is removed.

    A byte goes when it lies in a string of ``length`` bytes that also starts in a document with a smaller key.
    Strings are judged on the input.  Null texts are empty.  A row without a key keeps everything and takes nothing
    from others; rows that share a key take nothing from each other.

    1. Equal texts: only the smallest key's text is looked at; the others go whole.
    2. Every string of ``length`` bytes has an anchor, its least-hashed ``ANCHOR``-gram.  Anchors that two texts share
       mark the places that can match; sorted lists of 40-bit hashes cross the shuffle, a few bytes each.
    3. The bytes around marked anchors meet by anchor in key order.  Equal contexts collapse first, already in the
       map task's block, so that a passage found everywhere leaves each block once; contexts that differ are put
       into suffix arrays (see :func:`suffix_array`).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    raw = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(raw.cast("binary"), 256)
    tag = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw.alias("text"), sha.alias("sha"), tag.alias("tag"))
    ids = materialise(rows.select("doc_id", "tag", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-ids")
    firsts = ids.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("tag").alias("tag"))

    buckets = partitions(spark)
    lists = rows.where("doc_id IS NOT NULL").select("tag", "text").mapInArrow(_anchor_lists(buckets, length), "bucket int, hashes binary, places binary, tags binary")
    marks = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors, "tag long, anchor long")
    marked = marks.groupBy("tag").agg(F.collect_list("anchor").alias("anchors")).join(firsts.select("tag", F.col("first").alias("doc_id")), "tag")
    passages = rows.select("doc_id", "tag", "text").join(marked.hint("shuffle_hash"), ["doc_id", "tag"])
    passages = materialise(passages.select("doc_id", "tag", "text", "anchors"), "suffix-passages", codec="zstd")

    found = passages.mapInArrow(_within_blocks(length), SPANS_DDL)
    found = found.repartition(buckets, "anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_across_blocks(length), SPANS_DDL)
    spans = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    cut = passages.select("doc_id", "tag", "text").dropDuplicates(["doc_id", "tag"]).join(spans, ["doc_id", "tag"]).mapInArrow(_cut(length), KEPT_DDL)
    if not with_text:
        cut = cut.drop("kept", "spans")

    done = ids.join(firsts.select("sha", "first"), "sha", "left").join(cut, ["doc_id", "tag"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)
    extra = [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))).otherwise(F.col("spans")).alias("spans")] if with_text else []
    return done.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *extra,
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, length=50, with_text=False)
