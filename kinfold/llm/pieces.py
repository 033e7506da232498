"""SentencePiece encoding and decoding on a relational lattice."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.scratch import bounded_batches, filesystem, lean, normal_uri, partitions, scratch_path
from kinfold.llm.warc import _put

#: Fixed values of the model format: the mark of a space, the byte pieces' form, model types, types of pieces.
SPACE_MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED = 1, 4
#: Characters of text that share a file of places and a list of distinct segments.
CHUNK = 32 << 20
#: Characters cut at once, segments put together at once.
WINDOW, BLOCK = 4 << 20, 1 << 20
#: Distinct segments that leave a worker at once.
ROWS = 1 << 15
#: Bits of a segment's number in its chunk, and of a chunk's number in its task.
PLACE_BITS, CHUNK_BITS = 28, 12
#: Tasks that lattices are dealt over, as a multiple of the shuffle partitions.
LATTICE_TASKS = 2

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SYMBOLS = r"\x00-\x1f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
BY_CLASS = re.compile(rf" *[{LATIN}]+| *[0-9]| *[{SYMBOLS}]+| +")
BY_SPACE = re.compile(r" *[^ ]+| +")
OTHER = re.compile(rf"[^ 0-9{LATIN}{SYMBOLS}]")
BREAK = re.compile(r"[^ ] ")
ONE_CLASS = re.compile(rf" *(?:[{LATIN}]+|[0-9]|[{SYMBOLS}]+)?")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message (varints, fixed widths and byte strings)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


class Pieces:
    """A piece table: ``text`` has a piece's id and score, ``bytes_of`` the bytes that an id spells.

    Pieces are numbered by ``code``: the rank of the score, or beyond all ranks a number for others of an equal score.
    ``lookup`` turns a code into an id; the entries from its end stand for what has no piece: byte ``b`` at ``-1 - b``,
    unknown at ``-257``.
    """

    def __init__(self, kind: int, text: dict[str, tuple[int, float]], unknown: int, first_byte: int | None, bytes_of: list[bytes]) -> None:
        self.kind, self.text, self.unknown, self.first_byte, self.bytes_of = kind, text, unknown, first_byte, bytes_of
        self.longest = max(map(len, text))
        self.bigrams = {t[i : i + 2] for t in text for i in range(len(t) - 1)}
        # cuts between classes are safe only if no piece spans them; checked against the table, not taken for granted
        self.by_class = all(ONE_CLASS.fullmatch(t) for t in text if not OTHER.search(t))
        self.by_space = all(" " not in t.lstrip(" ") for t in text)
        ranks = {s: k for k, s in enumerate(sorted({s for _, s in text.values()}, reverse=True))}
        self.ranks, self.tie_bits = len(ranks), (max(Counter(s for _, s in text.values()).values()) - 1).bit_length()
        # an edge of the lattice is one long: rank, the bits of its two ends, number among equals
        self.mask_bits = 63 - self.tie_bits - self.ranks.bit_length()
        if self.mask_bits < 16:
            raise ValueError("too many pieces, or pieces of one score, for this lattice")
        # equals are counted from the end of the ranks that has them, so that codes stay small
        tied = [ranks[s] for s, n in Counter(s for _, s in text.values()).items() if n > 1] or [0]
        self.sign, self.base = (1, 0) if max(tied) < self.ranks - min(tied) else (-1, self.ranks - 1)
        turn: Counter = Counter()
        self.code: dict[str, int] = {}
        self.edge: dict[str, int] = {}
        for t, (_, s) in sorted(text.items(), key=lambda x: x[1][0]):
            r, k = ranks[s], turn[s]
            self.edge[t] = r << (self.mask_bits + self.tie_bits) | k
            self.code[t] = r if k == 0 else self.beyond(r, k)
            turn[s] += 1
        #: Stands for a character that has no piece, after all other edges.
        self.none = self.ranks << (self.mask_bits + self.tie_bits)
        self.lookup = np.full(max(self.ranks + 1, *self.code.values()) + 258, unknown, np.uint32)
        for t, c in self.code.items():
            self.lookup[c] = text[t][0]
        if first_byte is not None:
            self.lookup[-256:] = np.arange(first_byte + 255, first_byte - 1, -1)
        self.number_bits = (len(self.lookup) + 1).bit_length()
        self.spell_at = np.concatenate([[0], np.cumsum([len(x) for x in bytes_of])])
        self.spell = np.frombuffer(b"".join(bytes_of), np.uint8)

    def beyond(self, rank, turn):  # noqa: ANN001, ANN201
        """Code of a piece that is not the first of its score (of numbers or columns)."""
        return (rank - self.base) * (self.sign * ((1 << self.tie_bits) - 1)) + (turn + self.ranks)

    @property
    def most(self) -> int:
        """Characters of the longest segment that a lattice takes (its boundaries are bits)."""
        return self.mask_bits - 1

    @staticmethod
    def load(path: str) -> Pieces:
        """The table of a model file.  Models that change the text before they encode it (but for the space mark put in
        front), or that have pieces set by the user, are refused: this lattice would encode them differently."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer, rules = (dict(_fields(next((v for k, v in fields if k == n), b""))) for n in (2, 3))
        if rules.get(1, b"identity") != b"identity" or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError(f"{path}: only models with the identity normaliser, a space mark in front and kept spaces are supported")
        if any(dict(_fields(v)).get(3, NORMAL) == USER_DEFINED for k, v in fields if k == 1):
            raise ValueError(f"{path}: pieces set by the user are not supported")
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        text = {model.id_to_piece(i).replace(SPACE_MARK, " "): (i, model.get_score(i)) for i in plain}
        byte = [i for i in range(n) if model.is_byte(i)]
        bytes_of = [b""] * n
        for t, (i, _) in text.items():
            bytes_of[i] = t.encode()
        for k, i in enumerate(byte):
            bytes_of[i] = bytes([k])
        return Pieces(trainer.get(3, UNIGRAM), text, model.unk_id(), byte[0] if len(byte) == 256 else None, bytes_of)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``piece, edge, code, score``: a table of the vocabulary's size."""
        return spark.createDataFrame([(t, self.edge[t], self.code[t], s) for t, (_, s) in self.text.items()], "piece string, edge long, code int, score double")

    def windows(self, text: str) -> Iterator[str]:
        """A long text in parts, cut before a space that follows another character: no piece reaches across."""
        at = 0
        while self.by_space and len(text) - at > WINDOW:
            cut = BREAK.search(text, at + WINDOW)
            if not cut:
                break
            yield text[at : cut.end() - 1]
            at = cut.end() - 1
        yield text[at:]

    def segments(self, text: str) -> Iterator[list[str]]:
        """Cut a text (space mark put in front) where no piece can reach across, so that segments encode alone; a list
        for each window."""
        if not text:
            return
        for part in self.windows(" " + text.replace(SPACE_MARK, " ")):
            if not self.by_space:
                yield [part]
            else:
                yield BY_CLASS.findall(part) if self.by_class and not OTHER.search(part) else BY_SPACE.findall(part)

    def plain_ids(self, ch: str) -> list[int]:
        if ch in self.text:
            return [self.text[ch][0]]
        return [self.unknown] if self.first_byte is None else [self.first_byte + b for b in ch.encode()]

    def encode_long(self, segment: str) -> list[int]:
        """A segment beyond the lattice's bits, by the same rules: cut between characters that no piece has side by
        side, then the same merges from a heap, or the same best path."""
        cuts = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.bigrams), len(segment)]
        one = self._best_path if self.kind == UNIGRAM else self._merges
        return [i for a, b in zip(cuts, cuts[1:]) for i in one(segment[a:b])]

    def _best_path(self, segment: str) -> list[int]:
        n = len(segment)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), -1)] * n
        floor = min(s for _, s in self.text.values()) - 10
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                known = self.text.get(segment[s:e])
                if known or s == e - 1:
                    value = best[s][0] + (known[1] if known else floor)
                    if value > best[e][0]:
                        best[e] = (value, s)
        parts, e = [], n
        while e:
            parts.append(segment[best[e][1] : e])
            e = best[e][1]
        return [i for p in reversed(parts) for i in ([self.text[p][0]] if p in self.text else self.plain_ids(p))]

    def _merges(self, segment: str) -> list[int]:
        n = len(segment)
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int) -> None:
            if 0 <= a and end[a] < n and (known := self.text.get(segment[a : end[end[a]]])):
                heapq.heappush(heap, (-known[1], a, end[a], end[end[a]]))

        for a in range(n - 1):
            offer(a)
        gone = bytearray(n)
        while heap:
            _, a, mid, to = heapq.heappop(heap)
            if gone[a] or gone[mid] or end[a] != mid or end[mid] != to:
                continue
            gone[mid], end[a] = 1, to
            if to < n:
                before[to] = a
            offer(before[a])
            offer(a)
        out, a = [], 0
        while a < n:
            p = segment[a : end[a]]
            out += [self.text[p][0]] if p in self.text else self.plain_ids(p)
            a = end[a]
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    return _loaded.get(path) or _loaded.setdefault(path, Pieces.load(path))


# --- the lattice -----------------------------------------------------------------------------------------------

DONE = 1  # of merge_fold: no boundaries, so the word needs the waiting list


def _left(x: Column, k: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(k) if isinstance(k, int) else k)


def _right(x: Column, k: int) -> Column:
    return F.call_function("shiftright", x, F.lit(k))


def _with(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once (the optimiser would put it in wherever it is named)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Edges:
    """An array of longs, an edge each: rank of the score, bits of the two ends, number among pieces of one score.
    Sorted, the best score comes first, then the leftmost."""

    def __init__(self, table: Pieces) -> None:
        self.table, self.tie, self.bits = table, table.tie_bits, table.mask_bits
        self.low = F.lit((1 << self.tie) - 1).cast("long")
        self.span = F.lit((1 << self.bits) - 1).cast("long")

    def code(self, e: Column) -> Column:
        rank, turn = _right(e, self.bits + self.tie).cast("int"), e.bitwiseAND(self.low).cast("int")
        return F.when(turn == 0, rank).otherwise(self.table.beyond(rank, turn)) if self.tie else rank

    def ends(self, e: Column) -> Column:
        x = _right(e, self.tie) if self.tie else e
        return x.bitwiseAND(self.span)

    def all(self, e: Column) -> Column:
        """All boundaries from one end to the other: with lower end a and upper end b, 2 * b - a."""
        p = self.ends(e)
        return p * F.lit(2) - p.bitwiseAND(-p) * F.lit(3)

    def meets(self, mask: Column, e: Column) -> Column:
        return mask.bitwiseAND(self.ends(e)) == self.ends(e)

    def inside(self, mask: Column, e: Column) -> Column:
        """Boundaries on the edge, its ends among them: 2 if it is one symbol, 3 if it is two."""
        return F.bit_count(mask.bitwiseAND(self.all(e)))

    def merged(self, mask: Column, e: Column) -> Column:
        return mask - mask.bitwiseAND(self.all(e)) + self.ends(e)


def merge_fold(edges: Column, n: Column, by: Edges) -> Column:
    """Boundaries (bits of a long) that are left of a word of ``n`` characters after the model's merges.

    ``edges``: edges of two characters and more, sorted.  An edge merges when it is just two symbols.  One that is passed over
    while its parts are not yet whole has to be tried again after every later merge, before any worse edge: that is the
    order in which the model itself merges.  Hardly any word has such an edge, so a first fold goes without the list of
    those that wait, and only where one would have to wait the fold is done again with it.
    """
    full = _left(F.lit(1).cast("long"), n + 1) - 1

    def quick(mask: Column, e: Column) -> Column:
        count = by.inside(mask, e)
        return F.when(~by.meets(mask, e), mask).when(count == 3, by.merged(mask, e)).when(count < 3, mask).otherwise(F.lit(DONE).cast("long"))

    none = F.filter(edges, lambda e: F.lit(False))

    def again(mask: Column, wait: Column) -> Column:
        def one(m: Column, _: Column) -> Column:
            e = F.get(F.filter(wait, lambda x: by.meets(m, x) & (by.inside(m, x) == 3)), F.lit(0))
            return F.coalesce(by.merged(m, e), m)

        return F.when(F.size(wait) == 0, mask).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(wait), F.lit(1))), mask, one))

    def step(acc: Column, e: Column) -> Column:
        mask, wait = acc["mask"], acc["wait"]
        merged = F.struct(again(by.merged(mask, e), wait).alias("mask"), wait.alias("wait"))
        waiting = F.struct(mask.alias("mask"), F.array_append(wait, e).alias("wait"))
        return F.when(~by.meets(mask, e), acc).when(by.inside(mask, e) == 3, merged).when(by.inside(mask, e) > 3, waiting).otherwise(acc)

    whole = F.aggregate(edges, F.struct(full.alias("mask"), none.alias("wait")), step, lambda acc: acc["mask"])
    return _with(F.aggregate(edges, full, quick), lambda m: F.when(m == DONE, whole).otherwise(m))


def viterbi_fold(edges: Column, n: Column) -> Column:
    """Boundaries of the path of the greatest total score (of equals the one whose last piece is longest).

    ``edges``: structs ``(stop, start, len, score)`` in order.  The state has the best score and boundaries up to each
    place; an edge improves the place where it ends.
    """
    bad = F.lit(float("-inf"))
    cell = lambda s, m: F.struct(s.alias("s"), m.alias("m"))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: cell(F.when(i == 0, F.lit(0.0)).otherwise(bad), F.when(i == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))

    def step(best: Column, e: Column) -> Column:
        stop = e["start"] + e["len"]
        score = F.get(best, e["start"])["s"] + e["score"]
        mask = F.get(best, e["start"])["m"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), stop))
        return F.transform(best, lambda c, i: F.when((i == stop) & (score > c["s"]), cell(score, mask)).otherwise(c))

    return F.aggregate(edges, start, step, lambda best: F.get(best, n)["m"])


def encode_words(words: DataFrame, table: Pieces, keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """``keys`` and ``path`` of each row's ``word`` (1 to ``table.most`` characters).  ``keys`` hold ``word`` and tell
    rows apart; ``table.lookup`` turns the numbers of a path into ids.

    Substrings up to the longest piece's length are exploded (a join on the word's length) and equi-joined to the piece
    table (as large as the vocabulary, so broadcast); edges are grouped by word; a fold picks the path: merges in order
    of score for a BPE model, the best total for a unigram model.  Single characters without a piece become byte pieces.
    """
    spark, most, wide = words.sparkSession, table.most, table.longest
    by, n = Edges(table), F.length("word")
    spans = [(k, s, m, (1 << s) | (1 << (s + m))) for k in range(1, most + 1) for s in range(k) for m in range(1, min(wide, k - s) + 1)]
    spans = spark.createDataFrame(spans, "_n int, start int, len int, ends long")
    names = table.frame(spark).select(F.xxhash64("piece").alias("_h"), F.col("piece").alias("_p"), "edge", "code", "score")
    cut = words.where(n.between(1, most)).select(*keys, n.alias("_n")).join(F.broadcast(spans), "_n")
    cut = cut.select(*keys, "start", "len", "ends", F.substring(F.col("word"), F.col("start") + 1, F.col("len")).alias("piece"))
    # the join is by a hash, as a long finds its row faster than a string; the strings are compared too
    known = cut.withColumn("_h", F.xxhash64("piece")).join(F.broadcast(names), "_h", "left")
    same = F.col("_p") == F.col("piece")
    known = known.select(*keys, "start", "len", "ends", *(F.when(same, F.col(c)).alias(c) for c in ("edge", "code", "score"))).where(F.col("edge").isNotNull() | (F.col("len") == 1))
    none = table.ranks  # the code of what has no piece

    def spelled(at: Column) -> Column:
        raw = F.encode(F.substring(F.col("word"), at, F.lit(1)), "UTF-8")
        if table.first_byte is None:
            return F.array(F.lit(-257))
        return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.lit(-1) - F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))

    if table.kind == UNIGRAM:
        floor = min(s for _, s in table.text.values()) - 10.0
        edge = F.struct((F.col("start") + F.col("len")).alias("stop"), "start", "len", F.coalesce("score", F.lit(floor)).alias("score"), F.coalesce("code", F.lit(none)).alias("code"))
        lattice = known.groupBy(*keys).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        on = lambda m: F.filter("edges", lambda e: (m.bitwiseAND(_left(_left(F.lit(1).cast("long"), e["len"] + 1) - 1, e["start"]))) == _left(F.lit(1).cast("long"), e["start"]) + _left(F.lit(1).cast("long"), e["stop"]))
        chosen = _with(viterbi_fold(F.col("edges"), n), lambda m: F.array_sort(F.transform(on(m), lambda e: F.struct(e["start"].alias("at"), e["code"].alias("code")))))
    else:
        lattice = known.select(*keys, (F.coalesce("edge", F.lit(table.none)) + _left(F.col("ends"), by.tie)).alias("e")).groupBy(*keys).agg(F.sort_array(F.collect_list("e")).alias("edges"))
        # every character has an edge, and the fold needs the longer ones alone
        longer = F.filter("edges", lambda e: by.ends(e).bitwiseAND(by.ends(e) * F.lit(2)) == 0)
        low = lambda p: F.bit_count(p.bitwiseAND(-p) - 1).cast("int")
        on = lambda m: F.filter("edges", lambda e: by.meets(m, e) & (by.inside(m, e) == 2))
        chosen = _with(merge_fold(longer, n, by), lambda m: F.array_sort(F.transform(on(m), lambda e: F.struct(low(by.ends(e)).alias("at"), by.code(e).alias("code")))))
    plain = lambda c: F.transform(c, lambda x: x["code"])
    mixed = lambda c: F.flatten(F.transform(c, lambda x: F.when(x["code"] == none, spelled(x["at"] + 1)).otherwise(F.array(x["code"]))))
    path = _with(chosen, lambda c: F.when(F.exists(c, lambda x: x["code"] == none), mixed(c)).otherwise(plain(c)))
    return lattice.select(*keys, path.alias("path"))


def decode_ids(rows: DataFrame, key: str, ids: str, table: Pieces) -> DataFrame:
    """``key, text`` of each row's array of ids: a positional explode, an equi-join to the piece table, and the bytes in
    order without the leading space mark.  Bytes that are not UTF-8 decode to replacement characters."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(table.bytes_of)], "id int, bytes binary")
    each = rows.select(key, F.posexplode(ids).alias("pos", "id")).join(F.broadcast(known), "id", "left")
    parts = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex(F.coalesce("bytes", F.lit(b""))).alias("h")))).alias("p"))
    whole = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))
    text = F.try_validate_utf8(whole.cast("string"))
    text = F.coalesce(text, F.make_valid_utf8(whole.cast("string")))
    return rows.select(key).join(parts.select(key, F.regexp_replace(text, "^ ", "").alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


# --- documents -------------------------------------------------------------------------------------------------


def _file(folder: str, chunk: int) -> str:
    return f"{folder}/chunk-{chunk:016x}.parquet"


def _cut(model: str, folder: str):  # noqa: ANN202
    """Texts (last column) to chunks: a file of documents as lists of segment numbers, in order, with the digest of the
    text, and the chunk's distinct segments as rows.  Segments beyond the lattice are encoded here, into a second file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, numbers = pieces(model), TaskContext.get().partitionId(), itertools.count()
        held: list[pa.RecordBatch] = []
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__

        def numbered(text: str | None) -> tuple[np.ndarray, bytes]:
            own = [np.fromiter(map(index.__getitem__, s), np.int32, len(s)) for s in table.segments(text or "")]
            return np.concatenate([*own, np.zeros(0, np.int32)]), hashlib.blake2b((text or "").replace(SPACE_MARK, " ").encode(), digest_size=16).digest()

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << CHUNK_BITS | next(numbers)
            words = list(index)
            # frequent segments get small numbers, whose upper bytes are the same: fewer bytes in the file
            flat = [b.column(b.num_columns - 1).values.to_numpy(zero_copy_only=False) for b in held]
            often = np.argsort(-np.sum([np.bincount(x, minlength=len(words)) for x in flat], axis=0), kind="stable")
            number = np.empty(len(words), np.int32)
            number[often] = np.arange(len(words), dtype=np.int32)
            words = [words[k] for k in often.tolist()]
            if len(words) >> PLACE_BITS or chunk >> (62 - PLACE_BITS) or chunk & (1 << CHUNK_BITS) - 1 == (1 << CHUNK_BITS) - 1:
                raise ValueError("a task has too many texts; deal them over more partitions")
            long = [k for k, w in enumerate(words) if len(w) > table.most]
            if long:
                ids = pa.table({"at": pa.array(long, pa.int32()), "ids": pa.array([table.encode_long(words[k]) for k in long], pa.list_(pa.uint32()))})
                _put(f"{_file(folder, chunk)}.long", lambda out: pq.write_table(ids, out, compression="zstd"))

            def rows(out) -> None:  # noqa: ANN001
                with pq.ParquetWriter(out, held[0].schema, compression="zstd", compression_level=3, use_dictionary=[f.name for f in held[0].schema if f.name != "_segments"], column_encoding={"_segments.list.element": "BYTE_STREAM_SPLIT"}) as w:
                    for b, x in zip(held, flat, strict=True):
                        lists = pa.ListArray.from_arrays(b.column(b.num_columns - 1).offsets, pa.array(number[x]))
                        w.write_batch(b.set_column(b.num_columns - 1, b.schema.field(b.num_columns - 1), lists))

            _put(_file(folder, chunk), rows)
            some = [k for k, w in enumerate(words) if len(w) <= table.most]
            for k in range(0, len(some) or 1, ROWS):
                now = some[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array((chunk << PLACE_BITS) + np.array(now, np.int64)), pa.array([words[i] for i in now], pa.string())], names=["place", "word"])
            held.clear()
            index.clear()
            index[" "]  # each chunk has a row, whatever its texts

        index[" "]
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(b.num_columns - 1).to_pylist()
            rows = [numbered(t) for t in texts]
            at = np.concatenate([[0], np.cumsum([len(r) for r, _ in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r for r, _ in rows])))
            keep = [b.column(i) for i in range(b.num_columns - 1)]
            held.append(pa.RecordBatch.from_arrays([*keep, pa.array([d for _, d in rows], pa.binary(16)), lists], names=[*b.schema.names[:-1], "_digest", "_segments"]))
            size += sum(len(t or "") for t in texts)
            if size >= CHUNK:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _packed(path: Column, table: Pieces) -> tuple[Column, Column]:
    """A path as a long of its first numbers (258 more than they are, so that none is 0) and an array of the others, mostly
    null: half the bytes of an array in the shuffle."""
    bits, many = table.number_bits, 63 // table.number_bits
    one = lambda i: _left(F.coalesce(F.get(path, F.lit(i)) + 258, F.lit(0)).cast("long"), bits * i)
    return sum((one(i) for i in range(1, many)), one(0)), F.when(F.size(path) > many, F.slice(path, many + 1, F.size(path)))


def _unpacked(first: np.ndarray, others: pa.ListArray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, numbers)`` of packed paths."""
    bits, many = table.number_bits, 63 // table.number_bits
    numbers = first[:, None] >> (bits * np.arange(many)) & (1 << bits) - 1
    have = numbers > 0
    n = have.sum(axis=1)
    cuts, rest = others.offsets.to_numpy().astype(np.int64), others.values.to_numpy(zero_copy_only=False)
    more = np.diff(cuts)
    size = n + more
    start = _starts(size)
    out = np.empty(int(size.sum()), np.int64)
    out[(start[:, None] + np.arange(many))[have]] = numbers[have] - 258
    rest = rest[cuts[0] : cuts[-1]]
    out[np.repeat(start + n - _starts(more), more) + np.arange(len(rest))] = rest
    return size, out


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _assemble(model: str, folder: str, with_ids: bool):  # noqa: ANN202
    """Rows sorted by place: the paths of a chunk's segments.  Its documents are read from the chunk's file, their ids are
    put together, and the ids decoded: an id's bytes come from the piece table, the space mark in front goes."""

    def chunk_rows(chunk: int, places: list[np.ndarray], sizes: list[np.ndarray], flats: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        store, path = filesystem(_file(folder, chunk))
        at, size = np.concatenate(places) & (1 << PLACE_BITS) - 1, np.concatenate(sizes)
        flat = table.lookup[np.concatenate(flats)]
        if store.get_file_info([f"{path}.long"])[0].is_file:
            with store.open_input_file(f"{path}.long") as f:
                more = pq.read_table(f).combine_chunks()
            lists = more.column("ids").combine_chunks() if isinstance(more.column("ids"), pa.ChunkedArray) else more.column("ids")
            at = np.concatenate([at, more.column("at").to_numpy()])
            size = np.concatenate([size, np.diff(lists.offsets.to_numpy())])
            flat = np.concatenate([flat, lists.values.to_numpy(zero_copy_only=False)])
        n = np.zeros(int(at.max()) + 1, np.int64)
        if len(at) != len(n):
            raise ValueError(f"chunk {chunk:x} has {len(n)} segments, {len(at)} came")
        first = np.zeros(len(n), np.int64)
        n[at], first[at] = size, _starts(size)
        # each distinct segment is spelled once
        spelled = table.spell_at[1:] - table.spell_at[:-1]
        raw = _gather(table.spell, table.spell_at[flat], spelled[flat])
        upto = np.concatenate([[0], np.cumsum(spelled[flat])])
        raw_first, raw_n = upto[first], upto[first + n] - upto[first]

        def joined(source: np.ndarray, begin: np.ndarray, much: np.ndarray, own: np.ndarray) -> bytes:
            return b"".join(_gather(source, begin[own[k : k + BLOCK]], much[own[k : k + BLOCK]]).tobytes() for k in range(0, len(own), BLOCK))

        with store.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            for group in range(file.num_row_groups):
                for b in file.read_row_group(group).to_batches():
                    lists, digests = b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_pylist()
                    cuts, all_ = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
                    rows = []
                    for lo, hi, digest in zip(cuts[:-1], cuts[1:], digests, strict=True):
                        own = all_[lo:hi]
                        ids = joined(flat.astype("<u4", copy=False), first, n, own)
                        back = joined(raw, raw_first, raw_n, own)[1:]
                        same = hashlib.blake2b(back, digest_size=16).digest() == digest
                        rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back), same, ids if with_ids else None))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                    out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    names = ["n_pieces", "ids_crc32", "decoded_crc32", "round_trip", "ids"]
                    keep = b.num_columns - 2
                    yield pa.RecordBatch.from_arrays([b.column(0), *out, *(b.column(i) for i in range(1, keep))], names=[b.schema.names[0], *names, *b.schema.names[1:keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        chunk, places, sizes, flats = None, [], [], []
        for b in batches:
            place = b.column(0).to_numpy()
            size, values = _unpacked(b.column(1).to_numpy(), b.column(2), table)
            cuts = np.concatenate([[0], np.cumsum(size)])
            whose = place >> PLACE_BITS
            edges = np.concatenate([[0], np.flatnonzero(whose[1:] != whose[:-1]) + 1, [len(whose)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if lo == hi:
                    continue
                if whose[lo] != chunk:
                    if chunk is not None:
                        yield from chunk_rows(chunk, places, sizes, flats)
                    chunk, places, sizes, flats = int(whose[lo]), [], [], []
                places.append(place[lo:hi])
                sizes.append(size[lo:hi])
                flats.append(values[cuts[lo] : cuts[hi]])
        if chunk is not None:
            yield from chunk_rows(chunk, places, sizes, flats)

    return run


def encode_documents(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip, ids`` and ``carry``.

    ``ids`` are the model's ids as little-endian 32-bit integers (null without ``with_ids``), no ids added in front or
    behind; a null or empty text has none.  ``round_trip``: the ids, decoded, have the digest of the text (a literal space
    mark reads as a space).  Rows are never compared with each other, so ties and repeated rows are encoded alike, null
    keys too; an empty table gives an empty result; other columns of ``docs`` are not looked at.

    1. Texts are cut where no piece can reach across.  Documents of about ``CHUNK`` characters share a list of distinct
       segments; the documents, as numbers in that list, go to a file in the shared folder, and the list goes on.
    2. The lists are dealt by segment.  Each distinct segment of the corpus goes through the lattice once
       (:func:`encode_words`); its path is joined back to the lists that have it.
    3. The paths meet again by chunk and are put together there; ids are decoded by the piece table.

    Nothing is held that grows with the corpus: a worker has the segments of one chunk.  Files are named by task and order
    and written whole, so a task that runs again leaves the same.  Segments of more than ``table.most`` characters are encoded by the same rules in Python, once for each chunk.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # lattices are small, so many of them fit beside each other before the aggregation has to sort
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 40_000)
    table = pieces(model)
    folder = normal_uri(scratch_path(spark, "pieces"))
    store, path = filesystem(folder)
    store.create_dir(path)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *carry, F.col(text).alias("_text"))
    lists = rows.mapInArrow(lean(_cut(model, folder)), "place long, word string").repartition(LATTICE_TASKS * partitions(spark), "word")
    # this holds for all rows; said here, both sides of the join have the same filter and read one exchange, and so they
    # do as the first place is carried along
    lists = lists.where(F.length("word").between(1, table.most) & F.col("place").isNotNull())
    firsts = lists.groupBy("word").agg(F.min("place").alias("_first"))
    first, others = _packed(F.col("path"), table)
    paths = encode_words(firsts, table, ("word", "_first")).select(F.col("word").alias("_w"), "_first", first.alias("first"), others.alias("others"))
    joined = lists.join(paths.hint("shuffle_hash"), (F.col("word") == F.col("_w")) & (F.col("place") >= F.col("_first"))).select("place", "first", "others")
    dealt = joined.repartition(partitions(spark), _right(F.col("place"), PLACE_BITS)).sortWithinPartitions("place")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    extra = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return dealt.mapInArrow(lean(_assemble(model, folder, with_ids)), f"doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids binary{extra}")


def op10_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("ids")
