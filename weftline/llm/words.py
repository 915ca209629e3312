"""Encoding batches of texts with the tokenizers library, each distinct piece once.

Texts are cut into pieces that no pre-token crosses: a space and a word, a line
break, or a word at the start of a line. Pieces of a whole batch are found, hashed
and made distinct in arrays; the library encodes pieces not seen before, as large
texts; ids are then gathered for all pieces at once.
"""

from __future__ import annotations

import os

import numpy as np

LATEST = 100_000
#: Pieces that go to an encoder in one call.
TOGETHER = 500
#: Fixed value: the public byte-level pattern, for which the places to cut hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 18  # bytes cut at once, which a core's cache holds; longer texts go to the library whole
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_OTHER = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LOW = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def plain(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between other characters."""
    if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return False
    return not any(c in text for c in _ODD_ASCII) and (text.isascii() or not any(c in text for c in _ODD_OTHER))


def pieces_of(data: bytes, doc_starts: np.ndarray, long_pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and keys of the pieces of joined texts, told apart exactly. The key
    of a piece of up to 16 bytes is a mixed hash, the first and the last eight bytes;
    a longer one is known by its number in `long_pieces`, which grows."""
    raw = np.frombuffer(data, np.uint8)
    start = (raw == 32) | (raw == 10)
    start[1:] |= raw[:-1] == 10
    start[doc_starts] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(raw)))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    mask = _LOW[np.minimum(size, 8)]
    first = np.ascontiguousarray(eight[at]).view(np.uint64).ravel() & mask
    last = np.ascontiguousarray(eight[at + np.maximum(size - 8, 0)]).view(np.uint64).ravel() & mask
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ (last + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h & ~np.uint64(31) | np.minimum(size, 31).astype(np.uint64)  # sizes of 16 at most, or 31 for long pieces
    long = np.flatnonzero(size > 16)
    known = np.fromiter((long_pieces.setdefault(data[a : a + n], len(long_pieces)) for a, n in zip(at[long].tolist(), size[long].tolist(), strict=True)), np.uint64, len(long))
    mixed = known * np.uint64(0x9E3779B97F4A7C15)
    h[long], first[long], last[long] = (mixed ^ mixed >> np.uint64(29)) & ~np.uint64(31) | np.uint64(31), known, 0
    return at, size, np.stack([h, first, last], 1)


class Level:
    """Numbers by key, sorted by the keys' hashes."""

    def __init__(self) -> None:
        self.keys = np.zeros((0, 3), np.uint64)
        self.hashes = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for unknown ones. Of several keys with one hash only the first is found; the others are learned anew."""
        out = np.full(len(keys), -1, np.int64)
        spot = np.searchsorted(self.hashes, keys[:, 0])
        inside = np.flatnonzero(spot < len(self.hashes))
        at = spot[inside]
        hit = (self.keys[at] == keys[inside]).all(1)
        out[inside[hit]] = self.index[at[hit]]
        return out

    def add(self, keys: np.ndarray, index: np.ndarray) -> None:
        keys, index = np.concatenate([self.keys, keys]), np.concatenate([self.index, index])
        order = np.argsort(keys[:, 0], kind="stable")
        self.keys, self.index = keys[order], index[order]
        self.hashes = np.ascontiguousarray(self.keys[:, 0])


class PieceEncoder:
    """Ids of texts by pieces, or by whole texts where they can't be cut. What pieces encode to is remembered for up to `most`
    pieces; then the memory starts afresh, so it is bounded. Subclasses encode whole texts and lists of pieces."""

    def __init__(self, most: int, pattern: str = PATTERN, together: int = TOGETHER):
        self.most, self.cuts, self.together = most, pattern == PATTERN, together
        self._forget()

    def special(self, text: str) -> bool:
        """Whether a text holds a string that is a token of its own wherever it stands."""
        return False

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text."""
        raise NotImplementedError

    def listed(self, pieces: list[bytes], lead: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where each one's begin and end. `lead` may stand before each: a line break where they begin a line."""
        raise NotImplementedError

    def _forget(self) -> None:
        self.long: dict[bytes, int] = {}
        self.levels = [Level(), Level()]  # all known pieces but the latest, and these
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = self.known = 0

    def _learn(self, pieces: list[bytes], lead: bytes) -> None:
        for i in range(0, len(pieces), self.together):
            part = pieces[i : i + self.together]
            ids, begin, ends = self.listed(part, lead)
            n, k = self.known, len(part)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + k > len(self.begin):
                self.begin, self.count = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.count, np.zeros_like(self.count)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[n : n + k], self.count[n : n + k] = begin + self.used, ends - begin
            self.used += len(ids)
            self.known += k

    def _find(self, data: bytes, keys: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """The numbers of distinct pieces (keys with ascending hashes, starts and sizes), after learning those that are new."""
        out = self.levels[0].find(keys)
        rest = np.flatnonzero(out < 0)
        out[rest] = self.levels[1].find(keys[rest])
        new = np.flatnonzero(out < 0)
        pieces = [data[a : a + n] for a, n in spans[new].tolist()]
        kind = np.fromiter((0 if p[:1] == b" " else 2 if p == b"\n" else 1 for p in pieces), np.int8, len(pieces))
        for k, lead in ((0, b""), (1, b"\n"), (2, b"")):
            own = np.flatnonzero(kind == k)
            first = self.known
            self._learn([pieces[i] for i in own.tolist()], lead)
            out[new[own]] = first + np.arange(len(own))
        self.levels[1].add(keys[new], out[new])
        if len(self.levels[1].index) > LATEST:
            self.levels[0].add(self.levels[1].keys, self.levels[1].index)
            self.levels[1] = Level()
        return out

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with `end_id` (if any) after each text, and how many each text has with it. Null is empty."""
        extra = int(end_id is not None)
        counts = np.full(len(texts), extra, np.int64)
        whole: dict[int, np.ndarray] = {}
        blocks: list[tuple[list[int], bytes, np.ndarray]] = []
        held: list[bytes] = []
        docs: list[int] = []
        room = 0

        def close() -> None:
            nonlocal held, docs, room
            if held:
                blocks.append((docs, b"".join(held), np.cumsum([0, *map(len, held[:-1])])))
            held, docs, room = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode()
            if len(raw) > BLOCK or not self.cuts or not plain(text) or self.special(text):
                whole[i] = self.whole(text)
                continue
            if room + len(raw) > BLOCK:
                close()
            held.append(raw)
            docs.append(i)
            room += len(raw)
        close()
        if self.known > self.most:
            self._forget()
        owners, keys, spans = [], [], []
        base = 0
        for own, data, starts in blocks:
            at, size, key = pieces_of(data, starts, self.long)
            owners.append(np.array(own)[np.searchsorted(starts, at, "right") - 1])
            keys.append(key)
            spans.append(np.stack([at + base, size], 1))
            base += len(data)
        tokens, doc_of = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if blocks:
            data = b"".join(b[1] for b in blocks)
            owner, key, span = np.concatenate(owners), np.concatenate(keys), np.concatenate(spans)
            order = np.argsort(key[:, 0])
            sorted_key = key[order]
            new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]).any(1)])
            if (new[1:] & (sorted_key[1:, 0] == sorted_key[:-1, 0])).any():  # different pieces with one hash: sort by the whole key
                order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
                sorted_key = key[order]
                new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]).any(1)])
            first = np.flatnonzero(new)
            found = self._find(data, sorted_key[first], span[order[first]])
            where = np.empty(len(order), np.int64)
            where[order] = found[np.cumsum(new) - 1]
            n = self.count[where]
            tokens = self.ids[np.repeat(self.begin[where] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            counts += np.bincount(owner, n, len(counts)).astype(np.int64)
            doc_of = np.repeat(owner, n)
        if not whole:
            return (np.insert(tokens, np.cumsum(counts - 1), np.uint32(end_id)) if extra else tokens), counts
        for i, ids in whole.items():
            counts[i] += len(ids)
        out = np.full(int(counts.sum()), end_id or 0, np.uint32)
        firsts = np.cumsum(counts) - counts
        short = np.bincount(doc_of, minlength=len(texts)) if len(doc_of) else np.zeros(len(texts), np.int64)
        if len(tokens):
            out[firsts[doc_of] + np.arange(len(tokens)) - (np.cumsum(short) - short)[doc_of]] = tokens
        for i, ids in whole.items():
            out[firsts[i] : firsts[i] + len(ids)] = ids
        return out, counts


class BatchEncoder(PieceEncoder):
    """The tokenizers library over the tokenizer file at `path`."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of a token: byte-level symbols stand for one each
        for symbols, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(symbols)
        super().__init__(most)

    def special(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def listed(self, pieces: list[bytes], lead: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces go to the library as one text, which is cut by the tokens' bytes; a line break is one id of its own."""
        ids = self.whole((lead + lead.join(pieces)).decode())
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(lead))) + 1
        return ids, np.concatenate([[0], ends[:-1]]) + len(lead), ends
