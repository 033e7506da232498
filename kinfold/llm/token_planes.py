"""Token ids as plane-shuffled binary files.

A segment file holds the ids of a range of documents in ascending key order:

    magic "KFPLANE1" | blocks | documents | chunk index | footer

The ids are cut into blocks of a fixed number; a block is transposed into byte planes (all lowest bytes, then all
second bytes, ...) or bit planes, each compressed with zstandard on its own; a plane of zeros has length 0 and no
bytes.  The chunk index has, per block, its offset, its number of ids and its planes' lengths, so any range of ids is
read without the blocks before it.  The documents' table has keys and lengths.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.scratch import bounded_batches, filesystem, normal_uri, partitions, scratch_path
from kinfold.llm.warc import _put

MAGIC = b"KFPLANE1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQQQ8s")  # offsets of documents and chunk index, documents, blocks, ids
END_ID = 2
#: Words that a worker keeps encoded.
CACHE_WORDS = 400_000

#: The pre-tokenizer's pattern, its classes written out for the characters below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
#: A text with any other character is given to the tokenizer whole.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE never merges across pre-tokens, so each distinct one is encoded once by the library's model and
    kept; a full cache starts anew.  That shortcut is taken for files with the plain byte-level pre-tokenizer and no
    normaliser, and for texts that hold no added token's string and no character beyond its classes; all else goes
    to the tokenizer whole.  With ``plain_specials`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain_specials
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.wide = self.whole.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut, model = rules.get("pre_tokenizer") or {}, rules["model"]
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not rules.get("normalizer")
        self.shortcut = plain and model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        added = [t["content"] for t in rules.get("added_tokens", ()) if not (plain_specials and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        pack = struct.Struct
        for w in words:
            ids = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
            self.cache[w] = pack(f"<{len(ids)}{'I' if self.wide else 'H'}").pack(*ids)

    def encode(self, text: str) -> bytes:
        if not self.shortcut or OTHER.search(text) or (self.added and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        words = WORDS.findall(text)
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.cache))
            try:
                return b"".join(map(self.cache.__getitem__, words))
            except KeyError:  # the cache was cleared
                self._learn(set(words).difference(self.cache))
                return b"".join(map(self.cache.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def shuffle_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of 32-bit ids; an all-zero plane is empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    else:
        planes = [np.packbits((ids >> np.uint32(k)) & 1) for k in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def unshuffle_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        if p:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class SegmentWriter:
    def __init__(self, out: BinaryIO, mode: str = "byte", block: int = BLOCK, level: int = 1) -> None:
        self.out, self.mode, self.block = out, mode, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.index: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            to = len(whole) - len(whole) % self.block
            for k in range(0, to, self.block):
                self._flush(whole[k : k + self.block])
            self.held, self.n_held = [whole[to:]], len(whole) - to

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.press.compress(p) if p else b"" for p in shuffle_planes(ids, self.mode)]
        self.index.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.at += self.out.write(p)

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        docs = np.zeros(len(self.keys), [("key", "<i8"), ("null", "u1"), ("n", "<u8")])
        docs["key"], docs["null"], docs["n"] = [k or 0 for k in self.keys], [k is None for k in self.keys], self.lengths
        docs_at = self.at
        self.at += self.out.write(self.press.compress(docs.tobytes()))
        index_at = self.at
        self.at += self.out.write(self.press.compress(np.array(self.index, "<u8").tobytes()))
        self.out.write(FOOTER.pack(docs_at, index_at, len(self.keys), len(self.index), self.n_ids, MAGIC))


class SegmentReader:
    def __init__(self, f) -> None:  # noqa: ANN001
        self.f = f
        size = f.size()
        f.seek(size - FOOTER.size)
        docs_at, index_at, n_docs, n_blocks, self.n_ids, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a segment")
        self.open = zstandard.ZstdDecompressor()
        f.seek(docs_at)
        self.docs = np.frombuffer(self.open.decompress(f.read(index_at - docs_at)), [("key", "<i8"), ("null", "u1"), ("n", "<u8")])
        raw = self.open.decompress(f.read(size - FOOTER.size - index_at))
        self.index = np.frombuffer(raw, "<u8").reshape(n_blocks, -1) if n_blocks else np.zeros((0, 6), np.uint64)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.f.seek(at)
        return unshuffle_planes([self.open.decompress(self.f.read(s)) if s else b"" for s in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, first id's place in the segment, ids)`` in order; memory holds a block and a document."""
        held, at, nxt = np.zeros(0, "<u4"), 0, 0
        for key, null, n in self.docs.tolist():
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(nxt))
                have += len(parts[-1])
                nxt += 1
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else key, at, whole[:n]
            held = whole[n:]
            at += n


def _write(folder: str, tokenizer: str, end_id: int, mode: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        uri, told = f"{folder}/segment-{part:06d}.planes", [0, 0]
        end = np.array([end_id], "<u4")

        def rows(out) -> None:  # noqa: ANN001
            seg = SegmentWriter(out, mode)
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seg.add(key, np.concatenate([np.frombuffer(enc.encode(text or ""), enc.kind).astype("<u4"), end]))
            seg.close()
            told[:] = len(seg.keys), seg.n_ids

        _put(uri, rows)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": [uri], "documents": pa.array([told[0]], pa.int64()), "ids": pa.array([told[1]], pa.int64())})

    return run


SEGMENTS = "part int, segment string, documents long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _read(with_ids: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = filesystem(uri)
                with store.open_input_file(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for key, at, ids in SegmentReader(f).documents():
                        raw = ids.tobytes()
                        rows.append((key, first + at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        held += len(raw) if with_ids else 64
                        if held > 4 << 20:
                            yield _out(rows)
                            rows, held = [], 0
                    if rows:
                        yield _out(rows)

    return run


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def write_planes(docs: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, mode: str = "byte") -> DataFrame:
    """Encode and write all rows in ascending key order, one segment per range partition; returns the segments'
    table (``part, segment, documents, ids``), in memory on the driver: a row per file.

    Null texts are empty, null keys come first, rows that share a key follow each other in the order of their texts.
    A segment is written under an attempt's name and renamed, so a task that runs again leaves the same file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    store, path = filesystem(folder)
    store.create_dir(path)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = ordered.mapInArrow(_write(folder, tokenizer, end_id, mode), SEGMENTS).collect()
    return spark.createDataFrame(sorted(done), SEGMENTS)


def read_planes(segments: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Every document of the segments: ``doc_id, start, n_tokens, ids_crc32, ids`` (little-endian 32-bit)."""
    spark, at, rows = segments.sparkSession, 0, []
    for r in sorted(segments.collect()):
        rows.append((r.segment, at))
        at += r.ids
    listed = spark.createDataFrame(rows, "segment string, first long")
    return listed.repartition(max(1, len(rows)), "segment").mapInArrow(_read(with_ids), READ)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = normal_uri(scratch_path(spark, "planes"))
    segments = write_planes(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_planes(segments, with_ids=False).drop("ids")
