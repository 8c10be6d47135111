"""Bring text that looks alike to one form: a compiled longest-match transducer over grapheme clusters.

The mapping has a key for each way to write a letter: a base of any width, style or script with its accents in any order
and any degree of composition.  It is built once from rules, checked for conflicts, and compiled into a trie in which
invisible characters loop.  A value runs through the trie once; each cluster writes to two tapes, one on which letters of
other scripts stay and one on which they are Latin.  A word takes the second tape only if it is Vietnamese there, so real
foreign words and symbols stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations, permutations, product
from typing import NamedTuple

from docweave.functions.viet import LETTERS, is_syllable

# Letters of other scripts that look like Latin ones.
CYRILLIC_UPPER = dict(zip("АВЕКМНОРСТУХІЈЅԚԜҮӀЗЬ", "ABEKMHOPCTYXIJSQWYI3b", strict=True))
CYRILLIC_LOWER = dict(zip("асеорухіјѕһԁԛԝвкмнтпгшёїԍү", "aceopyxijshdqwbkmhtnrwëïgy", strict=True))
GREEK_UPPER = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True))
GREEK_LOWER = dict(zip("αεικνορτυχγηω", "aeikvoptuxynw", strict=True))
LATIN_LIKE = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ɑ": "a", "ı": "i", "ɡ": "g", "ⅼ": "l", "Ɩ": "I", "ȷ": "j", "ℊ": "g", "ʋ": "v", "ո": "n", "օ": "o", "һ": "h", "ս": "u", "Օ": "O", "Տ": "S"}

#: Letters that are only look-alikes inside a word that becomes Vietnamese.
LOOK_ALIKE = {**CYRILLIC_UPPER, **CYRILLIC_LOWER, **GREEK_UPPER, **GREEK_LOWER, **LATIN_LIKE}
#: Look-alikes that change even as a word of their own letters only, if the outcome is a Vietnamese word or an ordinal.
CLOSE = {**CYRILLIC_UPPER, **CYRILLIC_LOWER, **GREEK_UPPER, **LATIN_LIKE}
_ALWAYS = {"Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ"}

_KEEP = frozenset("’‘“”„‚«»‹›–—‐‑‒―…·•²³¹¼½¾°º§©®™№±×÷")


def _always_map() -> dict[str, str]:
    """The part of the mapping that needs no context, from rules over the code points."""
    out: dict[str, str] = {}

    def put(ch: str, to: str) -> None:
        if out.setdefault(ch, to) != to:
            raise ValueError(f"conflict at {ch!r}: {out[ch]!r} and {to!r}")

    for code in (*range(0x80, 0x3400), *range(0xA640, 0xA6A0), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        ch = chr(code)
        if ch in _KEEP:
            continue
        category = unicodedata.category(ch)
        compat = unicodedata.decomposition(ch).partition(">")[0].strip("<")
        if category == "Zs" or ch in "  ":
            put(ch, " ")
        elif category == "Cf" and not 0x600 <= code < 0x900 and not 0xFFF9 <= code <= 0xFFFB or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            put(ch, "")
        elif compat in ("wide", "narrow", "small") or compat == "font" and 0x1D400 <= code or 0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06:
            put(ch, unicodedata.normalize("NFKC", ch))
    for ch, to in _ALWAYS.items():
        put(ch, to)
    # Combining marks that look like the Vietnamese ones.
    for ch, to in {"̀": "̀", "́": "́", "͂": "̃"}.items():
        put(ch, to)
    return out


def compile_mapping() -> dict[str, str]:
    """The context-free mapping, checked: no key is an outcome, no outcome depends on the order of the rules."""
    mapping = _always_map()
    for ch, to in mapping.items():
        if any(c in mapping for c in to):
            raise ValueError(f"{ch!r} maps to {to!r}, which maps on")
        if ch in LETTERS:
            raise ValueError(f"{ch!r} is a Vietnamese letter")
    clash = {c for c in LOOK_ALIKE if c in mapping and mapping[c] != LOOK_ALIKE[c]}
    if clash:
        raise ValueError(f"two outcomes for {sorted(clash)}")
    return mapping


MAPPING = compile_mapping()
INVISIBLE = frozenset(c for c, to in MAPPING.items() if not to)


class Outcome(NamedTuple):
    """What a cluster writes: with letters of other scripts as they are, and with look-alikes as Latin letters."""

    plain: str
    latin: str


def outcome(cluster: str) -> Outcome:
    """The outcome of one cluster by the rules."""
    plain = unicodedata.normalize("NFC", "".join(MAPPING.get(c, c) for c in cluster))
    return Outcome(plain, unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", plain))))


def _spellings(letter: str) -> set[tuple[str, tuple[str, ...]]]:
    """(first character, marks) of every way to write a letter: some marks composed, the others after it in any order."""
    base, *marks = unicodedata.normalize("NFD", letter)
    out = set()
    for some in chain.from_iterable(combinations(marks, n) for n in range(len(marks) + 1)):
        first = unicodedata.normalize("NFC", base + "".join(some))
        if len(first) == 1:
            rest = list(marks)
            for m in some:
                rest.remove(m)
            out |= {(first, order) for order in permutations(rest)}
    return out


def compile_clusters() -> dict[str, Outcome]:
    """The table of clusters, checked: one outcome a key, and outcomes that are stable.

    Keys are Vietnamese letters in every spelling, on every base that is written like the letter's; letters of other
    alphabets in their decomposed spelling; and single characters that map.
    """
    table: dict[str, Outcome] = {}

    def put(key: str) -> None:
        got = outcome(key)
        if table.setdefault(key, got) != got:
            raise ValueError(f"conflict at {key!r}")
        if len(key) == 1 and key == got.plain == got.latin:
            del table[key]

    like: dict[str, set[str]] = {}  # a Latin letter: the characters that stand for it
    for ch in (*MAPPING, *LOOK_ALIKE, *map(chr, range(0x370, 0x530))):
        if (latin := outcome(ch).latin) != ch and latin in LETTERS:
            like.setdefault(latin, set()).add(ch)
    marks: dict[str, set[str]] = {}
    for ch, to in MAPPING.items():
        if len(to) == 1 and unicodedata.combining(to):
            marks.setdefault(to, {to}).add(ch)
    for letter in LETTERS:
        for first, order in _spellings(letter):
            for variant in {first} | like.get(first, set()):
                for written in product(*(marks.get(m, {m}) for m in order)):
                    put(variant + "".join(written))
    for code in (*range(0xC0, 0x370), *range(0x400, 0x530), *range(0x1E00, 0x1F00)):
        parts = unicodedata.decomposition(chr(code))
        if parts and not parts.startswith("<"):
            put("".join(chr(int(x, 16)) for x in parts.split()))
            put(unicodedata.normalize("NFD", chr(code)))
    for ch in (*MAPPING, *LOOK_ALIKE):
        put(ch)
    unstable = [k for k, o in table.items() if outcome(o.plain).plain != o.plain or outcome(o.latin).latin != o.latin]
    if unstable:
        raise ValueError(f"outcomes that change again: {unstable[:5]}")
    return table


class State(NamedTuple):
    """A state of the transducer: where each character leads, and what is written if the match ends here."""

    after: dict[str, State]
    written: list[Outcome]


def compile_transducer(table: dict[str, Outcome]) -> State:
    """The table as a trie."""
    root = State({}, [])
    for key, to in table.items():
        state = root
        for ch in key:
            state = state.after.setdefault(ch, State({}, []))
        state.written.append(to)
    return root


CLUSTERS = compile_clusters()
START = compile_transducer(CLUSTERS)
_MARKS = "\u0300-\u036f"


def _char_class(chars: object) -> str:
    codes, out, k = sorted(map(ord, chars)), [], 0  # type: ignore[call-overload]
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[k])) + (f"-{re.escape(chr(codes[j]))}" if j > k else ""))
        k = j + 1
    return "".join(out)


_SUSPECT = re.compile(f"[{_char_class(MAPPING)}{_char_class(LOOK_ALIKE)}{_MARKS}]")
_ROMAN = re.compile("(?=.)X{0,3}(IX|IV|V?I{0,3})")
_CLEAN = re.compile("[\x00-\x7f" + _char_class(c for c in LETTERS if c > "\x7f") + "]*")


def _is_foreign(ch: str) -> bool:
    return ch.isalpha() and ch not in LETTERS


def _joins(ch: str) -> bool:
    """Whether a character belongs to the cluster before it."""
    return unicodedata.combining(ch) > 0 or "\u1160" <= ch <= "\u11ff"


def clusters(text: str) -> Iterator[tuple[bool, Outcome]]:
    """(whether it is part of a word, outcome) of each cluster of a text, by longest match.

    A cluster that the table does not list (marks of other alphabets) has the outcome of the rules; a character that
    does not map writes itself.
    """
    at, size = 0, len(text)
    while at < size:
        state, j, end, written = START, at, at, None
        while j < size:
            ch = text[j]
            if ch in INVISIBLE and j > at:
                j += 1
                continue
            nxt = state.after.get(ch)
            if nxt is None:
                break
            state, j = nxt, j + 1
            if state.written:
                end, written = j, state.written[0]
        if written is None:
            end, written = at + 1, Outcome(text[at], text[at])
        tail = end
        while tail < size and (text[tail] in INVISIBLE or _joins(text[tail])):
            tail += 1
        if any(_joins(c) for c in text[end:tail]):  # marks beyond the table
            end, written = tail, outcome(text[at:tail])
        elif not text[at].isascii() and end == at + 1 and text[at] not in CLUSTERS:
            written = outcome(text[at])
        yield text[at].isalnum() or text[at] in INVISIBLE or _joins(text[at]), written
        at = end


def _chosen(plain: str, latin: str, near_foreign: bool, alone: bool) -> str:
    """A word's tape: the Latin one if the word has look-alikes and is Vietnamese or an ordinal there."""
    foreign = [c for c in unicodedata.normalize("NFD", plain) if _is_foreign(c) and not unicodedata.combining(c)]
    if not foreign or any(map(_is_foreign, latin)):
        return plain
    good = is_syllable(latin) or bool(_ROMAN.fullmatch(latin)) or len(latin) == 1
    if any(c in LETTERS for c in unicodedata.normalize("NFD", plain)):
        return latin if good or all(c in CLOSE for c in foreign) else plain
    if near_foreign or not all(c in CLOSE for c in foreign):
        return plain
    if len(latin) == 1:
        return latin if alone or foreign[0] in CYRILLIC_LOWER or foreign[0] in CYRILLIC_UPPER else plain
    return latin if good else plain


@lru_cache(maxsize=100_000)
def consistent(text: str | None, marker: bool = False) -> str | None:
    """The consistent form of one value; null stays null and empty text stays empty.

    ``marker`` says that the value is an ordinal marker, where a single letter of another script stands for its Latin twin.
    """
    if not text or _CLEAN.fullmatch(text) or not _SUSPECT.search(text) and unicodedata.is_normalized("NFC", text):
        return text
    pieces: list[tuple[bool, str, str]] = []  # (word, plain tape, Latin tape)
    for word, written in clusters(text):
        if word and pieces and pieces[-1][0]:
            pieces[-1] = (True, pieces[-1][1] + written.plain, pieces[-1][2] + written.latin)
        else:
            pieces.append((word, *written))
    real = [k for k, (word, plain, _) in enumerate(pieces) if word and any(map(str.isalpha, plain))]
    genuine = {k: any(_is_foreign(c) and c not in LOOK_ALIKE for c in unicodedata.normalize("NFD", pieces[k][1])) for k in real}
    for i, k in enumerate(real):
        near = any(genuine[j] for j in (*real[max(0, i - 1) : i], *real[i + 1 : i + 2]))
        pieces[k] = (True, _chosen(*pieces[k][1:], near, marker), "")
    return "".join(plain for _, plain, _ in pieces)
