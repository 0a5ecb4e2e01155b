"""Token files with directly addressable codes.

An id is split into chunks of eight bits. Level k holds the k-th chunk of every
id that has one, one after another, with a bitmap that says whether the id goes
on at the next level and a rank directory (ones before each 64-bit word). The
place of an id's next chunk is the rank of its bit, so any id is read with a few
lookups and no block is decoded.

One image is self-contained: document ids, the documents' lengths (coded the
same way) and the tokens. Images are rows of a Parquet table in the shared
folder, as executors of a cluster share no other file system.

Null text is an empty text (its end id alone); a null doc_id sorts first and is
kept; repeated ids or rows keep one entry each, next to one another; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, segment_bases
from .tokenize import encoder, in_chunks

MAGIC = b"DACT0001"

#: Tokens after which an image is closed. A longer document makes a longer image.
IMAGE_TOKENS = 1 << 20

IMAGES = "pid int, seg long, n_docs long, n_tokens long, image binary"


class Codes:
    """Directly addressable codes of an array of unsigned numbers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # (chunks u1, bitmap words u8, ones before each word u4)

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @classmethod
    def of(cls, values: np.ndarray) -> Codes:
        values, levels = np.asarray(values, np.uint64), []
        while len(values):
            more = values > 255
            words = np.zeros(-(-len(values) // 64) * 8, np.uint8)
            bits = np.packbits(more, bitorder="little")
            words[: len(bits)] = bits
            words = words.view("<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            levels.append(((values & np.uint64(255)).astype(np.uint8), words, (np.concatenate([[0], ones[:-1]])).astype("<u4")))
            values = values[more] >> np.uint64(8)
        return cls(levels)

    def dump(self) -> bytes:
        out = [struct.pack("<I", len(self.levels))]
        for chunks, words, ones in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), words.tobytes(), ones.tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[Codes, int]:
        (k,), levels = struct.unpack_from("<I", data, at), []
        at += 4
        for _ in range(k):
            (n,) = struct.unpack_from("<Q", data, at)
            at, w = at + 8, -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at)
            words = np.frombuffer(data, "<u8", w, at + n)
            ones = np.frombuffer(data, "<u4", w, at + n + 8 * w)
            levels.append((chunks, words, ones))
            at += n + 12 * w
        return cls(levels), at

    @staticmethod
    def _rank(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        inside = words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return ones[w].astype(np.int64) + np.bitwise_count(inside)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at any places, in the order asked for."""
        at = np.asarray(at, np.int64)
        out, where = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (chunks, words, ones) in enumerate(self.levels):
            out[where] |= chunks[at].astype(np.uint64) << np.uint64(8 * k)
            on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if not on.any():
                break
            at, where = self._rank(words, ones, at[on]), where[on]
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """The numbers a..b-1: each level's part is one run, found by two ranks."""
        parts = []
        for chunks, words, ones in self.levels:
            if a >= b:
                break
            w = words[a >> 6 : (b + 63) >> 6]
            on = np.unpackbits(w.view(np.uint8), bitorder="little")[a & 63 :][: b - a] == 1
            parts.append((chunks[a:b], on))
            a = int(self._rank(words, ones, np.array([a]))[0])
            b = a + int(on.sum())
        values = np.zeros(0, np.uint64)
        for chunks, on in reversed(parts):
            upper, values = values, chunks.astype(np.uint64)
            if on.any():
                values[on] |= upper << np.uint64(8)
        return values


class TokenImage:
    """Reader of one image: ``doc(i)``, ``token(i)`` and ``tokens(places)``."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token image")
        (n,) = struct.unpack_from("<Q", view, 8)
        self.ids = np.frombuffer(view, "<i8", n, 16)
        self.null = np.frombuffer(view, np.uint8, n, 16 + 8 * n) == 1
        lengths, at = Codes.load(view, 16 + 9 * n)
        self.lengths = lengths.slice(0, len(lengths)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.codes, _ = Codes.load(view, at)

    @staticmethod
    def build(ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
        null = np.array([x is None for x in ids], np.uint8)
        keys = np.array([x or 0 for x in ids], "<i8")
        lengths = np.array([len(x) for x in tokens], np.uint64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        return b"".join([MAGIC, struct.pack("<Q", len(ids)), keys.tobytes(), null.tobytes(), Codes.of(lengths).dump(), Codes.of(flat).dump()])

    def doc(self, i: int) -> np.ndarray:
        return self.codes.slice(int(self.starts[i]), int(self.starts[i + 1])).astype(np.uint32)

    def tokens(self, at: np.ndarray) -> np.ndarray:
        return self.codes.access(at).astype(np.uint32)

    def token(self, i: int) -> int:
        return int(self.tokens(np.array([i]))[0])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, image_tokens: int = IMAGE_TOKENS) -> None:
    """Encode ``docs`` in ascending doc_id order and write the images to ``path``.

    Texts are dealt by ranges of (doc_id, hash of the text) before they are
    encoded, so each is encoded once; image (pid, seg) comes before any later one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seg, ids, tokens, n = TaskContext.get().partitionId(), 0, [], [], 0
        enc = encoder(tokenizer, end_id)

        def image():
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seg": [seg], "n_docs": [len(ids)], "n_tokens": [n], "image": pa.array([TokenImage.build(ids, tokens)], pa.binary())})

        for batch in batches:
            for part in in_chunks(batch):
                for key, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    if ids and n + len(x) > image_tokens:
                        yield image()
                        seg, ids, tokens, n = seg + 1, [], [], 0
                    ids.append(key)
                    tokens.append(x)
                    n += len(x)
        if ids:
            yield image()

    order = (F.col("doc_id"), F.xxhash64("text"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, IMAGES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, pid, seg, slot."""
    images = spark.read.schema(IMAGES).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, seg, data in zip(*(batch.column(c) for c in ("pid", "seg", "image")), strict=True):
                image = TokenImage(data.as_buffer())
                k = len(image.ids)
                crc = [zlib.crc32(image.doc(i).astype("<u4").tobytes()) for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, pid.as_py(), np.int32)), pa.array(np.full(k, seg.as_py(), np.int64)), pa.array(np.arange(k)), pa.array(image.ids, pa.int64(), mask=image.null), pa.array(image.starts[:-1]), pa.array(image.lengths), pa.array(crc, pa.int64())],
                    ["pid", "seg", "slot", "doc_id", "_start", "n_tokens", "ids_crc32"],
                )

    rows = images.mapInArrow(decode, "pid int, seg long, slot long, doc_id long, _start long, n_tokens long, ids_crc32 long")
    bases = segment_bases(images.select("pid", "seg", "n_tokens"), "pid", "seg", "n_tokens")
    return rows.join(bases, ["pid", "seg"]).select("doc_id", (F.col("base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", "pid", "seg", "slot")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, image_tokens: int = IMAGE_TOKENS) -> DataFrame:
    """Write the token files and return what is read back from them."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id, image_tokens)
    return read(docs.sparkSession, path)
