"""Averaged word and subword embeddings with independent logistic outputs (plain numpy; Spark parts are in subjects.py).

A sentence is the average of the embeddings of its words, their letter groups and its word pairs, all hashed into one
table; each subject has a logistic output of its own on that average.  Words are compared without accents and case, and
letter groups carry over scan noise.  One output more tells letterheads, legal bases and closing formulas.  It is learned
without any list: such sentences treat no subject and stand before the first or after the last sentence that does, while
sentences that go on with the one before also stand in between.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BUCKETS = 1 << 16
DIMENSION = 16

# ---------------------------------------------------------------- sentences
_ENUMERATOR = re.compile(r"\s*(?:(?:điều|dieu|article|khoản|khoan|mục|muc)\s+\d+[a-zđ]?\s*[.:]|\d+(?:\.\d+)*[.)]|[a-zđ]\)|\(?[ivxlc]+[.)]|[-–•*+]\s|\(\d+\))\s*", re.I)
_LEADER = re.compile(r"[ \t]*(?:\.[ \t]?){4,}\s*\d*\s*$|\s*…{2,}\s*\d*\s*$", re.M)
_END = re.compile(r"(?<=[.!?])[\"”»)]?\s+(?=\S)")
_BREAK = re.compile(r"\r\n?| | |\x0b|\x0c")
_BLANKS = re.compile(r"[ \t\u00a0]{2,}")


def fold(text: str) -> str:
    """Lower case without accents; đ becomes d."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c))


def _split(text: str) -> list[str]:
    return _END.split(text) if ". " in text or "! " in text or "? " in text else [text]


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: enumeration and leaders taken off, wrapped lines joined, a table row each by itself.

    A line goes on with the one before unless that ended, or ended with a semicolon and this begins no lower-case word.
    Pieces without a letter are no sentences.
    """
    if not text or text.isspace():
        return []
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    units: list[str] = []
    open_ = False  # the last unit may go on in the next line
    for line in _BLANKS.sub(" ", _BREAK.sub("\n", text)).split("\n"):
        if not line.strip():
            open_ = open_ and units[-1][-1] not in ".;:!?"
            continue
        ended = False
        if "..." in line or "…" in line or ". ." in line:
            short = _LEADER.sub("", line)
            ended, line = short != line, short
        row = "|" in line
        if row:
            line = " ".join(line.replace("|", " ").split())
        m = _ENUMERATOR.match(line)
        body = (line[m.end() :] if m else line).strip()
        if not body:
            open_ = False
            continue
        if open_ and not m and not row and (units[-1][-1] != ";" or body[0].islower()):
            units[-1] += " " + body
        else:
            units.append(body)
        open_ = not ended and not row and body[-1] not in ".:!?"
    every = (_ENUMERATOR.sub("", s, count=1) if s[:1].isdigit() else s for unit in units for s in _split(unit))
    return [s for s in every if any(map(str.isalpha, s))]


# ---------------------------------------------------------------- features
_WORD = re.compile(r"[^\W_]+")


def _hash(text: str, seed: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), seed)


class Features(NamedTuple):
    """Hashed features of some sentences: the table rows, where each sentence begins and ends, each feature's weight,
    and for gradients the same by table row: each feature's sentence and weight, the rows touched and where each begins."""

    rows: np.ndarray
    bounds: np.ndarray
    weights: np.ndarray
    sentence_by_row: np.ndarray
    weight_by_row: np.ndarray
    touched: np.ndarray
    first: np.ndarray


@lru_cache(maxsize=300_000)
def word_rows(word: str) -> tuple[int, tuple[int, ...]]:
    """(hash of the folded word, table rows of the word and its letter groups); numbers share one row."""
    folded = "0" if word[0].isdigit() and any(c.isdigit() for c in word[1:] or "0") and not any(c.isalpha() for c in word) else fold(word)
    h = _hash(folded, 7)
    rows = [h % BUCKETS]
    if len(folded) > 3:
        marked = f"<{folded}>"
        rows += [_hash(marked[k : k + n], 11) % BUCKETS for n in (4, 5) for k in range(len(marked) - n + 1)]
    return h, tuple(rows)


def pair_rows(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the word pairs inside each sentence, and the index of each pair's first word."""
    if hashes.size < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (hashes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + hashes[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(13)
    inside = np.ones(hashes.size - 1, bool)
    inner = bounds[1:-1]
    inside[inner[(inner > 0) & (inner < hashes.size)] - 1] = False
    first = np.flatnonzero(inside)
    return (mixed[first] % np.uint64(BUCKETS)).astype(np.int64), first


def training_features(texts: list[str]) -> Features:
    """Features of sentences with their weights: a word and its letter groups count together as one, as does a pair."""
    rows: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        words = [word_rows(w) for w in _WORD.findall(text)]
        if words:
            hashes = np.array([h for h, _ in words], np.int64)
            pairs, _ = pair_rows(hashes, np.array([0, hashes.size]))
            own = np.array([r for _, rs in words for r in rs], np.int64)
            own_weight = np.repeat([1 / len(rs) for _, rs in words], [len(rs) for _, rs in words])
            r, w = np.concatenate([own, pairs]), np.concatenate([own_weight, np.ones(pairs.size)]) / (len(words) + pairs.size)
            different, back = np.unique(r, return_inverse=True)
            rows.append(different)
            weights.append(np.bincount(back, w))
            bounds[k + 1] = different.size
    np.cumsum(bounds, out=bounds)
    empty = np.zeros(0, np.int64)
    every = np.concatenate(rows) if rows else empty
    order = np.argsort(every, kind="stable")
    touched, first = np.unique(every[order], return_index=True)
    weight = (np.concatenate(weights) if weights else empty).astype(np.float32)
    sentence = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    return Features(every.astype(np.int32), bounds, weight, sentence[order], weight[order], touched.astype(np.int32), first)


# ---------------------------------------------------------------- the model
class Model(NamedTuple):
    """Embeddings (buckets x dimension), output weights (dimension x subjects) and biases."""

    embeddings: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray


def initial(subjects: int, seed: int = 1) -> Model:
    """A model before training: an output for each subject, and the last one for formal sentences."""
    rng = np.random.default_rng(seed)
    subjects += 1
    return Model((rng.standard_normal((BUCKETS, DIMENSION)) * 0.3).astype(np.float32), (rng.standard_normal((DIMENSION, subjects)) * 0.3).astype(np.float32), np.full(subjects, -2.0, np.float32))


def averages(f: Features, embeddings: np.ndarray) -> np.ndarray:
    """The average embedding of each sentence; zeros for one without words."""
    out = np.zeros((f.bounds.size - 1, embeddings.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(f.bounds))
    if full.size:
        out[full] = np.add.reduceat(embeddings[f.rows] * f.weights[:, None], f.bounds[full], axis=0)
    return out


def logits(f: Features, m: Model) -> np.ndarray:
    """Each sentence's value for each subject."""
    return averages(f, m.embeddings) @ m.outputs + m.bias


def gradient(f: Features, m: Model, targets: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(touched rows, their gradient, the outputs' and the biases' gradient, loss), summed over the sentences."""
    h = averages(f, m.embeddings)
    z = h @ m.outputs + m.bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d = ((p - targets) * importance[:, None]).astype(np.float32)
    loss = float(-(importance[:, None] * (targets * np.log(p + 1e-9) + (1 - targets) * np.log(1 - p + 1e-9))).sum())
    dh = d @ m.outputs.T
    rows = np.add.reduceat(dh[f.sentence_by_row] * f.weight_by_row[:, None], f.first, axis=0) if f.touched.size else np.zeros((0, m.embeddings.shape[1]), np.float32)
    return f.touched, rows.astype(np.float32), (h.T @ d).astype(np.float32), d.sum(0), loss


class Adam:
    """Adam over the three parts of the model, with gradients already summed over all partitions."""

    def __init__(self, m: Model, rate: float = 0.05) -> None:
        self.model, self.rate, self.t = m, rate, 0
        self.first = [np.zeros_like(x) for x in m]
        self.second = [np.zeros_like(x) for x in m]

    def step(self, gradients: list[np.ndarray]) -> Model:
        self.t += 1
        out = []
        for x, g, a, b in zip(self.model, gradients, self.first, self.second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            out.append(x - self.rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.99**self.t)) + 1e-8))
        self.model = Model(*(x.astype(np.float32) for x in out))
        return self.model


#: Target of the formal output before anything is known of where subjects are treated.
FORMAL_PRIOR = 0.1


def outside(z: np.ndarray, documents: np.ndarray, own: np.ndarray) -> np.ndarray:
    """1 for each sentence before the first or after the last one of its document that surely treats one of its subjects, else 0."""
    sure = np.flatnonzero(np.where(own > 0, z, -1.0).max(1, initial=-1.0) > 0)
    count = int(documents[-1]) + 1 if documents.size else 0
    first, last = np.full(count, documents.size), np.full(count, -1)
    np.minimum.at(first, documents[sure], sure)
    np.maximum.at(last, documents[sure], sure)
    at = np.arange(documents.size)
    return ((at < first[documents]) | (at > last[documents])).astype(np.float32)


def assign(z: np.ndarray, documents: np.ndarray, labels: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Targets (subjects, then formal) and importance of each sentence given its document's subjects; ``z`` has the subjects' values.

    At first every sentence takes its document's subjects in equal shares.  Later a sentence takes the one of them that
    the model finds likeliest in it, and is formal if it stands outside; one in which another subject is likelier by far
    is left out.
    """
    own = labels[documents]
    if first:
        share = own / np.maximum(own.sum(1, keepdims=True), 1)
        return np.hstack([share, np.full((len(z), 1), FORMAL_PRIOR)]).astype(np.float32), np.ones(len(z), np.float32)
    inside = np.where(own > 0, z, -np.inf)
    targets = np.zeros((len(z), own.shape[1] + 1), dtype=np.float32)
    targets[np.arange(len(z)), inside.argmax(1)] = own.max(1) > 0
    targets[:, -1] = outside(z, documents, own)
    other = np.where(own > 0, -np.inf, z).max(1)
    importance = np.where((other > inside.max(1) + 1) & (other > 0), 0.0, 1.0)
    return targets, importance.astype(np.float32)


class Scorer:
    """Scores whole documents; per-word sums are kept, so a repeated word costs one look-up."""

    KEPT_WORDS = 300_000

    def __init__(self, m: Model, threshold: float) -> None:
        self.table = m.embeddings @ m.outputs  # buckets x subjects: an average of embeddings times outputs is an average of these
        self.bias, self.threshold = m.bias, threshold
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []
        self.values: list[np.ndarray] = []
        self._packed: tuple[np.ndarray, np.ndarray] | None = None

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.KEPT_WORDS:
            self._reset()
        for w in words:
            h, rows = word_rows(w)
            self.known[w] = len(self.hashes)
            self.hashes.append(h)
            self.values.append(self.table[list(rows)].mean(0))
        self._packed = None

    def document_logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(value of each sentence for each subject, number of sentences of each text)."""
        find = _WORD.findall
        per_text = np.fromiter(map(len, texts), np.int64, len(texts))
        words = [find(s) for t in texts for s in t]
        if not words:
            return np.zeros((0, self.bias.size), np.float32), per_text
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        new = [w for w in set(flat) if w not in self.known]
        if new:
            self._learn(new)
            missing = [w for w in set(flat) if w not in self.known]
            if missing:
                self._learn(missing)
        if self._packed is None:
            self._packed = np.array(self.hashes, np.int64), np.array(self.values, np.float32).reshape(-1, self.bias.size)
        hashes, values = self._packed
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        pairs, first = pair_rows(hashes[ids], bounds)
        each = values[ids]
        each[first] += self.table[pairs]
        full = np.flatnonzero(lengths)
        total = np.zeros((lengths.size, self.bias.size), np.float32)
        if full.size:
            total[full] = np.add.reduceat(each, bounds[full], axis=0)
        count = np.maximum(2 * lengths - 1, 1)
        return total / count[:, None] + self.bias, per_text

    def subjects(self, texts: list[list[str]], share: float = 0.25) -> list[list[int]]:
        """The subjects that at least ``share`` of each text's sentences chiefly treat, formal sentences apart."""
        z, counts = self.document_logits(texts)
        count = self.bias.size - 1
        best, most = z[:, :count].argmax(1), z[:, :count].max(1)
        plain = (z[:, count] <= 0) | (most > z[:, count])
        sure = most > self.threshold
        out, at = [], 0
        for n in counts.tolist():
            keep = plain[at : at + n]
            b, s = best[at : at + n][keep], sure[at : at + n][keep]
            at += n
            if not s.any():
                out.append([])
                continue
            place = np.maximum.accumulate(np.where(s, np.arange(s.size), -1))  # a sentence of no subject goes on with the one before
            place[place < 0] = s.argmax()  # sentences before the first sure one belong to it
            out.append(np.flatnonzero(np.bincount(b[place], minlength=count) >= share * s.size - 1e-9).tolist())
        return out
