"""Whole-text encoding with a public tokenizer, one library call for each distinct chunk of text.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts (before a space that follows a non-space; between
ASCII letters or digits and ASCII punctuation), so the ids of the chunks, in order, are the ids of the text. Natural text
repeats its chunks, so most are looked up and few are encoded. Cutting, hashing and lookup work on the bytes of a whole
Arrow batch at once. Texts that hold a special token's own string, or a non-ASCII space beside another space, go to the
library whole.
"""

from __future__ import annotations

import os

import numpy as np

from . import common

SPACE, LETTER, SIGN, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER  # 0xC3 leads Latin letters; others that lead are OTHER
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = SIGN  # not the apostrophe
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(577)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: UTF-8 of the white space outside ASCII: lead byte, then the others as ranges of (first, second) bytes.
_SPACES = ((0xC2, 0x85, 0x85, None), (0xC2, 0xA0, 0xA0, None), (0xE1, 0x9A, 0x9A, (0x80, 0x80)), (0xE2, 0x80, 0x80, (0x80, 0x8A)), (0xE2, 0x80, 0x80, (0xA8, 0xA9)), (0xE2, 0x80, 0x80, (0xAF, 0xAF)), (0xE2, 0x81, 0x81, (0x9F, 0x9F)), (0xE3, 0x80, 0x80, (0x80, 0x80)))
#: Longer chunks are encoded each time and not kept.
LONGEST = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Start and end of each white space outside ASCII, as rows."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    out = []
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    for lead, low, high, third in _SPACES:
        hit = (a == lead) & (b >= low) & (b <= high)
        if third:
            hit &= (c >= third[0]) & (c <= third[1])
        out.append(np.column_stack((at[hit], at[hit] + (3 if third else 2))))
    return np.concatenate(out)


class Encoder:
    """Ids of texts, ``end_id`` last, by :meth:`encode`.

    drops_space: the tokenizer lower-cases and drops white space (``word_bpe_49k``); else it is byte-level. special_as_text:
    the strings of special tokens are ordinary text; else they give their ids, as the library does by itself. Known
    chunks are held as 64-bit hashes (of at most ``LONGEST`` bytes) and are forgotten beyond ``cache_size`` chunks, so memory
    is bounded; two of so few chunks meet in one hash with probability below 1e-7.
    """

    def __init__(self, path: str, end_id: int, drops_space: bool = False, cache_size: int = 800_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.drops_space, self.cache_size = drops_space, cache_size
        self.wide = self.tok.get_vocab_size() > 65536 or end_id > 65535
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.end_id = end_id
        self.known = common.HashIndex(cache_size)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        # Ids of the known chunks and where each begins, in arrays that double; chunk 0 is the end.
        self.flat, self.at, self.n_chunks = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), 1
        self.flat[0], self.at[1] = self.end_id, 1

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 20_000) for e in self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def _add(self, ids: list[list[int]]) -> int:
        """Appends chunks; returns the number of the first."""
        first, begin = self.n_chunks, int(self.at[self.n_chunks])
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = begin + np.cumsum(n)
        last = int(ends[-1]) if len(ends) else begin
        while len(self.flat) < last:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.at) <= first + len(ids):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[begin:last] = np.fromiter((x for e in ids for x in e), self.kind, last - begin)
        self.at[first + 1 : first + 1 + len(ids)] = ends
        self.n_chunks = first + len(ids)
        return first

    def _chunks(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks of non-empty texts that begin at ``begins``, and the texts (as places in ``begins``) to take whole."""
        cls = _CLASS[data]
        signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] & 0xDF) == 0x97))  # multiplication and division signs
        cls[signs] = OTHER
        space = cls == SPACE
        begin = np.zeros(len(data), bool)
        begin[begins] = True
        before = np.concatenate(([True], space[:-1]))
        word = ~space & (before | begin)
        mask = (space & (begin | ~before)) | word
        if not self.drops_space:
            # A blank goes with the word after it; other white space before a word stands alone.
            inner = np.flatnonzero(word & ~begin)
            mask[inner - 1] = True
            mask[inner[data[inner - 1] == 32]] = False
        words = np.flatnonzero(word)
        pure = np.ones(len(words), bool)
        pure[np.searchsorted(words, np.flatnonzero(cls == OTHER), side="right") - 1] = False
        both = cls[:-1] + cls[1:]
        turn = np.flatnonzero((both == LETTER + SIGN) & (cls[:-1] != SPACE) & (cls[1:] != SPACE)) + 1
        turn = turn[~begin[turn]]
        mask[turn[pure[np.searchsorted(words, turn, side="right") - 1]]] = True
        whole = np.zeros(0, np.int64)
        if not self.drops_space and len(odd := _odd_spaces(data)):
            left, right = odd[:, 0] - 1, np.minimum(odd[:, 1], len(data) - 1)
            bad = (left >= 0) & space[left] | (odd[:, 1] < len(data)) & space[right]
            whole = np.unique(np.searchsorted(begins, odd[bad, 0], side="right") - 1)
        return np.flatnonzero(mask), whole

    def _with_special(self, raw: bytes, begins: np.ndarray) -> list[int]:
        out = set()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                out.add(int(np.searchsorted(begins, i, side="right")) - 1)
                i = raw.find(s, i + 1)
        return list(out)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): text i of an Arrow string array has ids[bounds[i] : bounds[i + 1]]; null is empty."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if self.n_chunks > self.cache_size or self.at[self.n_chunks] > 8 * self.cache_size:
            self._forget()
        some = np.flatnonzero(np.diff(bounds))
        if not len(data):
            return np.full(len(texts), self.end_id, self.kind), np.arange(len(texts) + 1)
        begins = bounds[some]
        raw = data.tobytes()
        special = self._with_special(raw, begins)
        if self.drops_space:
            data = _LOWER[data]
        start, whole = self._chunks(data, begins)
        whole = np.unique(np.concatenate((whole, special)).astype(np.int64))
        end = np.append(start[1:], len(data))
        if len(whole):
            inside = np.searchsorted(begins, start, side="right") - 1
            keep = ~np.isin(inside, whole) | np.isin(start, begins[whole])
            start, end = start[keep], end[keep]
            head = np.searchsorted(start, begins[whole])
            end[head] = np.append(begins, len(data))[whole + 1]
        if self.drops_space:
            keep = _CLASS[data[start]] != SPACE
            if len(whole):
                keep[head] = True
            start, end = start[keep], end[keep]
            head = np.searchsorted(start, begins[whole]) if len(whole) else None
        h = common.range_hashes(data, start, end, _BYTES)
        h[h == 0] = 1
        short = end - start <= LONGEST
        if len(whole):
            short[head] = False
        number = np.full(len(start), -1, np.int32)
        number[short] = self.known.find(h[short])
        new = np.flatnonzero(short & (number < 0))
        text = data.tobytes() if self.drops_space else raw
        if len(new):
            marks, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            s, e = start[new[one]].tolist(), end[new[one]].tolist()
            first = self._add(self._library([text[a:b].decode() for a, b in zip(s, e)]))
            self.known.learn(marks, first)
            number[new] = first + back
        known = self.n_chunks
        long = np.flatnonzero(~short)
        if len(long):
            raws = set(head.tolist()) if len(whole) else ()
            first = self._add(self._library([(raw if i in raws else text)[start[i] : end[i]].decode() for i in long.tolist()]))
            number[long] = first + np.arange(len(long))
        # The chunks of each text, then the end; ids are gathered in one go.
        many = np.diff(np.searchsorted(start, np.append(bounds[:-1], len(data))))
        order = np.zeros(len(number) + len(texts), np.int64)
        ends = np.cumsum(many + 1) - 1
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = number
        n = self.at[order + 1] - self.at[order]
        last = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[order] - (last - n), n) + np.arange(last[-1])]
        if len(long):
            self.n_chunks = known
        return ids, np.concatenate(([0], last[ends]))

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        import pyarrow as pa

        ids, bounds = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_ENCODERS: dict[tuple, Encoder] = {}
common._CACHES.append(_ENCODERS)


def encoder(path: str, end_id: int, drops_space: bool) -> Encoder:
    """One encoder for each Python worker, which Spark uses again for later tasks."""
    key = (path, end_id, drops_space)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, end_id, drops_space)
    return _ENCODERS[key]


def encoded(batches, enc: Encoder, limit: int = 512 << 10):
    """(batch of about ``limit`` bytes of text, ids, bounds) of Arrow batches whose second column is the text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit)))
            part = batch.slice(at, to - at)
            yield part, *enc.encode(part.column(1))
            at = to
