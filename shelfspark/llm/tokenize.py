"""Whole-text encoding with a public byte-level BPE vocabulary.

The tokenizers library does all encoding. Most of its time goes to repeated
words, so each distinct chunk is encoded once and its ids are looked up after.
A text is cut only where the byte-level pattern always starts a new piece: at a
single space, or a single line feed, that stands between two non-space
characters. Such a cut can't change the ids; a text with any other white space,
or with what may be a special token, goes whole through the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per Python worker before those not in current use are dropped.
CACHE_CHUNKS = 1_000_000

#: Fixed value: the id of a line feed in byte-level vocabularies of this family.
_LINE_FEED = 198

#: White space that no cut can stand beside, or "<|" of a special token.
_UNCUT = r"\A[ \n]|[ \n][ \n]|[ \n]\z|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"


class CachedEncoder:
    """``encode(texts)`` gives one uint32 array of ids per text (null: empty).

    Keys of the cache are chunks: a word that follows a space, or a line feed
    with the word after it. A text is read as if a line feed stood before it,
    whose id is dropped at the end.
    """

    def __init__(self, path: str, end_id: int | None = None, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.cache_chunks = cache_chunks
        # the cuts rely on a line feed being one piece of its own
        self.cuttable = self.tok.encode("\n a\n b\nc", add_special_tokens=False).ids.count(_LINE_FEED) == 3
        self.bpe = None
        if self.cuttable:
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            other = [b for b in range(256) if b not in plain]
            # the byte-level alphabet: bytes that print stand for themselves, the rest follow from 256 on
            self.letters = {b: 256 + i for i, b in enumerate(other)}
            self.tails = {c: self.tok.encode(c, add_special_tokens=False).ids for c in ".,;:!?)"}
            self.bpe = self.tok.model.tokenize
            for w in (" a", "\na", " Straße,", "\nñéèà.", " 漢字", "\nthe"):
                whole = self.tok.encode(w, add_special_tokens=False).ids
                if self._plain(w.lstrip(" ")) != whole:
                    self.bpe = None
                    break
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.offsets = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def _plain(self, chunk: str) -> list[int] | None:
        """Ids of a chunk that is letters, and perhaps one mark after them, which
        the pattern never cuts elsewhere: straight from the library's BPE model."""
        spaced = chunk[0] != "\n"
        core = chunk if spaced else chunk[1:]
        tail = self.tails.get(core[-1])
        if tail is not None:
            core = core[:-1]
        if not core.isalpha():
            return None
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.bpe("\u0120" + core if spaced else core)]
        if not spaced:
            ids.insert(0, _LINE_FEED)
        return ids if tail is None else ids + tail

    def _learn(self, new: list[str]) -> None:
        rest: list[str] = []
        for a in range(0, len(new), 1 << 16):
            done, flat, lengths = [], [], []
            for w in new[a : a + (1 << 16)]:
                ids = self._plain(w) if self.bpe else None
                if ids is None:
                    rest.append(w)
                else:
                    done.append(w)
                    flat += ids
                    lengths.append(len(ids))
            self._add(done, flat, lengths)
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            joined = "".join([w if w[0] == "\n" else "\n " + w for w in part])
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(ids == _LINE_FEED)
            assert len(starts) == len(part)
            # a chunk after a space has no line feed of its own
            spaced = np.array([w[0] != "\n" for w in part])
            self._add(part, np.delete(ids, starts[spaced]), np.diff(np.append(starts, len(ids))) - spaced)

    def _add(self, chunks: list[str], ids, lengths) -> None:
        n, k, m = len(self.slot), len(chunks), len(ids)
        while n + k >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + m] = ids
        self.offsets[n + 1 : n + k + 1] = self.used + np.cumsum(lengths)
        self.slot.update(zip(chunks, range(n, n + k)))
        self.used += m

    def _slots(self, chunks: list[str]) -> np.ndarray:
        found = list(map(self.slot.get, chunks))
        new = [w for w, s in zip(chunks, found) if s is None]
        if len(self.slot) > 1 and len(self.slot) + len(new) > self.cache_chunks:
            self._reset()
            found, new = [0 if w == "" else None for w in chunks], [w for w in chunks if w]
        self._learn(new)
        learnt = map(self.slot.__getitem__, new)
        return np.array([next(learnt) if s is None else s for s in found], np.int32)

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = pc.fill_null(pc.match_substring_regex(texts, _UNCUT), False).to_numpy(zero_copy_only=False) | (not self.cuttable)
        out: list = [self.end] * len(texts)
        if len(at := np.flatnonzero(whole & (n > 0))):
            for i, e in zip(at, self.tok.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
                out[i] = np.concatenate([np.array(e.ids, np.uint32), self.end])
        if len(at := np.flatnonzero(~whole & (n > 0))):
            led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.take(pa.array(at)), pa.scalar("\n", pa.large_string()))
            lists = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
            coded = pc.dictionary_encode(lists.flatten())
            # each text's first piece is the empty one before its first space: slot 0, without ids
            slots = self._slots(coded.dictionary.to_pylist())
            known = pa.ListArray.from_arrays(pa.array(self.offsets[: len(self.slot) + 1]), pa.array(self.flat[: self.used]))
            taken = known.take(pa.array(slots[coded.indices.to_numpy(zero_copy_only=False)]))
            ids = taken.values.to_numpy().astype(np.uint32)
            ends = taken.offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for i, a, b in zip(at, ends[:-1], ends[1:]):
                out[i] = np.concatenate([ids[a + 1 : b], self.end])
        return out


_ENCODERS: dict = {}


def encoder(path: str, end_id: int | None, cache_chunks: int = CACHE_CHUNKS) -> CachedEncoder:
    """One encoder per Python worker and vocabulary; it stays for the worker's next task."""
    key = (path, end_id, cache_chunks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(path, end_id, cache_chunks)
    return _ENCODERS[key]


def release(encoders: bool = True) -> None:
    """Give unused memory back at a task's end: a worker that waits for its next
    task keeps what it has. ``encoders``: other work runs here now, so drop them."""
    import ctypes
    import gc

    if encoders:
        _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def in_chunks(batch: pa.RecordBatch, column: str = "text", size: int = 8_000_000):
    """Slices of about ``size`` bytes of ``column``; a longer text stands alone."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a = total = 0
    for i, x in enumerate(n):
        if total and total + x > size:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(x)
    if a < len(n):
        yield batch.slice(a)
