"""Byte-level BPE by speculation: greedy tokens, vectorised checks of adjacent pairs, exact merging where a check fails.

A split of a word is what BPE gives exactly if every adjacent pair of its tokens is compatible, that is, if BPE over the
two tokens' bytes would not merge across their border.  So a word is first cut greedily into longest tokens; the pairs of
all new words are then tested at once by undoing merges, the later one first; words with a failing pair are merged exactly.
Words repeat, so each worker keeps the words it has met.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept per worker before the memory is emptied; bounds memory, changes no result.
CACHE_WORDS = 400_000
# Fixed value: the pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _splitter() -> Callable[[str], list[str]]:
    """A function that splits text by PATTERN.

    The standard library's engine is twice as quick, but knows no Unicode properties, holds U+001C .. U+001F for blanks and
    is slow with classes beyond the basic plane; so its classes are made from the properties, and texts that hold such
    characters go to the other engine.
    """
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    pattern, classes = PATTERN, {}
    for name in "LN":
        spans = [(m.start(), m.end() - 1) for m in regex.finditer(rf"\p{{{name}}}+", plane)]
        classes[name] = "".join(f"{re.escape(plane[a])}-{re.escape(plane[z])}" if plane[z] > plane[a] and ord(plane[z]) - ord(plane[a]) == z - a else re.escape(plane[a : z + 1]) for a, z in spans)
        pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", r"[^\s@L@N]").replace(rf"\p{{{name}}}", f"[@{name}]")
    for name, chars in classes.items():
        pattern = pattern.replace(f"@{name}", chars)
    quick, every, beyond = re.compile(pattern).findall, regex.compile(PATTERN).findall, re.compile("[\x1c-\x1f\ud800-\udfff\U00010000-\U0010ffff]").search
    return lambda text: every(text) if beyond(text) else quick(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printable}
    for k, b in enumerate(sorted(set(range(256)) - set(printable))):
        table[chr(0x100 + k)] = b
    return table


class Encoder:
    """One vocabulary with its merge tables; make it once per process with :func:`encoder`."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.ids = {bytes(letters[c] for c in token): k for token, k in vocab.items() if all(c in letters for c in token)}
        size = max(vocab.values()) + 1
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)  # -1: a single byte
        keys, merged = [], []
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ia, ib, both = vocab[a], vocab[b], vocab[a + b]
            if (ia, ib) in self.merges:
                continue
            self.merges[ia, ib] = (rank, both)
            keys.append(ia << 32 | ib)
            merged.append(rank)
            if self.rank[both] < 0:
                self.left[both], self.right[both], self.rank[both] = ia, ib, rank
        order = np.argsort(np.array(keys))
        self.pair_keys, self.pair_ranks = np.array(keys)[order], np.array(merged)[order]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        sound = self._sound_tokens()
        self.greedy = {token: k for token, k in self.ids.items() if k in sound}
        self.longest = max(map(len, self.greedy))
        self.split = _splitter()
        self.known: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}

    def _sound_tokens(self) -> set[int]:
        """Tokens that BPE gives for their own bytes: a byte, or two sound tokens whose pair is compatible."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fine = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound = set(self.byte_ids)
        for k, a, b, ok in zip(made.tolist(), self.left[made].tolist(), self.right[made].tolist(), fine.tolist(), strict=True):
            if ok and a in sound and b in sound:
                sound.add(k)
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair, whether BPE keeps the border between its tokens.

        ``own`` is the rank of the pair's own merge, which then counts as the end and not as a crossing.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(a.shape, np.iinfo(np.int64).max) if own is None else own.astype(np.int64).copy()
        fine = np.ones(a.shape, dtype=bool)
        open_ = np.arange(a.size)
        while open_.size:
            x, y = a[open_], b[open_]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), self.pair_keys.size - 1)
            crossing = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
            bad = crossing < limit[open_]
            fine[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            go = ~bad & ~done
            undo_left = go & (rx > ry)  # the later merge is undone first; of equal ones the right, which was made last
            undo_right = go & ~undo_left
            k = open_[undo_left]
            limit[k], a[k] = rx[undo_left], self.right[x[undo_left]]
            k = open_[undo_right]
            limit[k], b[k] = ry[undo_right] + 1, self.left[y[undo_right]]
            open_ = open_[go]
        return fine

    def _greedy(self, data: bytes) -> list[int]:
        out, i, n, get = [], 0, len(data), self.greedy.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                token = get(data[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
        return out

    def merge_exactly(self, data: bytes) -> list[int]:
        """BPE by its definition: the lowest-ranked adjacent pair merges first, of equal ones the leftmost."""
        parts = [self.byte_ids[b] for b in data]
        while len(parts) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.merges[parts[k], parts[k + 1]][1]]
        return parts

    def learn(self, words: list[str]) -> int:
        """Encode new words into memory; returns how many had to be merged exactly."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.sizes.clear()
            self.known.clear()  # the batch at hand may hold more words than that; it is learned all the same
        raw = [w.encode("utf-8", "replace") for w in words]
        whole = [self.greedy.get(r) for r in raw]
        guesses = [[k] if k is not None else self._greedy(r) for k, r in zip(whole, raw, strict=True)]
        lengths = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        failed = 0
        if lengths.size:
            flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64, count=int(lengths.sum()))
            word_of = np.repeat(np.arange(lengths.size), lengths)
            inner = word_of[1:] == word_of[:-1]
            pairs = flat[:-1][inner] << 32 | flat[1:][inner]
            different, back = np.unique(pairs, return_inverse=True)
            fine = self.compatible(different >> 32, different & 0xFFFFFFFF)[back]
            for k in np.unique(word_of[1:][inner][~fine]).tolist():
                guesses[k] = self._merge_long(raw[k])
                failed += 1
        self.known.update(zip(words, map(tuple, guesses), strict=True))
        self.sizes.update(zip(words, map(len, guesses), strict=True))
        return failed

    def _merge_long(self, data: bytes) -> list[int]:
        """Exact merging that stays quick for very long words: a heap over a linked list."""
        if len(data) <= 64:
            return self.merge_exactly(data)
        import heapq

        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(rank, k, both) for rank, both, k in heap]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, k, both = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or self.merges.get((ids[k], ids[j]), (-1, -1)) != (rank, both):
                continue
            ids[k], alive[j], after[k] = both, False, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _known_words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them in memory; new ones are learned together, so that their pairs are tested in one run of array operations."""
        words = [self.split(t) if t else [] for t in texts]
        for _ in range(2):  # the second time if memory was emptied on the way
            new = list(set(chain.from_iterable(words)).difference(self.known))
            if not new:
                break
            self.learn(new)
        return words

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after each other, where each text's begin and end); null and empty texts have none."""
        words = self._known_words(texts)
        flat = [list(chain.from_iterable(map(self.known.__getitem__, ws))) for ws in words]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(f) for f in flat], out=offsets[1:])
        return np.fromiter(chain.from_iterable(flat), dtype=np.int32, count=int(offsets[-1])), offsets

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        words, size = self._known_words(texts), self.sizes.__getitem__
        return np.array([sum(map(size, ws)) for ws in words], dtype=np.int64)


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """The process's encoder of a vocabulary file."""
    return Encoder(path)
