"""Find and undo text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, a byte-structure automaton finds the maximal
well-formed multibyte spans, and only those spans are decoded; everything else stays as it was.  A reading counts only
if the words it yields are better Vietnamese than the words it replaces, so genuine foreign words and symbols stay.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from docweave.functions.viet import LETTERS, SPECIAL, is_syllable

REPLACEMENT = "�"
#: Encodings a reader may have used by mistake for UTF-8 bytes, the more usual first.
SINGLE_BYTE = (
    "cp1252 latin_1 cp1250 cp1251 mac_roman cp437 cp850 cp1258 cp1254 cp1253 cp1257 cp1255 cp1256 cp874 iso8859_2 iso8859_5 "
    "iso8859_7 iso8859_9 iso8859_15 iso8859_16 koi8_r koi8_u mac_latin2 mac_cyrillic cp852 cp855 cp866 cp775 cp858"
).split()
MULTI_BYTE = "gb18030 big5hkscs cp932 cp949".split()

# The TCVN3 (ABC) code page, byte to letter.
TCVN3 = {
    0xA1: "Ă", 0xA2: "Â", 0xA3: "Ê", 0xA4: "Ô", 0xA5: "Ơ", 0xA6: "Ư", 0xA7: "Đ", 0xA8: "ă", 0xA9: "â", 0xAA: "ê", 0xAB: "ô", 0xAC: "ơ", 0xAD: "ư", 0xAE: "đ",
    0xB5: "à", 0xB6: "ả", 0xB7: "ã", 0xB8: "á", 0xB9: "ạ", 0xBB: "ằ", 0xBC: "ẳ", 0xBD: "ẵ", 0xBE: "ắ",
    0xC6: "ặ", 0xC7: "ầ", 0xC8: "ẩ", 0xC9: "ẫ", 0xCA: "ấ", 0xCB: "ậ", 0xCC: "è", 0xCE: "ẻ", 0xCF: "ẽ", 0xD0: "é", 0xD1: "ẹ", 0xD2: "ề", 0xD3: "ể", 0xD4: "ễ",
    0xD5: "ế", 0xD6: "ệ", 0xD7: "ì", 0xD8: "ỉ", 0xDC: "ĩ", 0xDD: "í", 0xDE: "ị", 0xDF: "ò", 0xE1: "ỏ", 0xE2: "õ", 0xE3: "ó", 0xE4: "ọ", 0xE5: "ồ", 0xE6: "ổ",
    0xE7: "ỗ", 0xE8: "ố", 0xE9: "ộ", 0xEA: "ờ", 0xEB: "ở", 0xEC: "ỡ", 0xED: "ớ", 0xEE: "ợ", 0xEF: "ù", 0xF1: "ủ", 0xF2: "ũ", 0xF3: "ú", 0xF4: "ụ", 0xF5: "ừ",
    0xF6: "ử", 0xF7: "ữ", 0xF8: "ứ", 0xF9: "ự", 0xFA: "ỳ", 0xFB: "ỷ", 0xFC: "ỹ", 0xFD: "ý", 0xFE: "ỵ",
}
TCVN3_CHARS = {chr(b): letter for b, letter in TCVN3.items()}

#: Signs and letters that may stand beside Vietnamese text and so may come out of a decoded span.
PLAUSIBLE = SPECIAL | frozenset(
    " ­¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿×÷ßØøÅåÆæÇçÑñÖöÜüÄäËëÏïÎîÛûŒœŠšŽžŸÿÞþÐðƉ"
    "–—‘’‚“”„†‡•…‰‹›€™​‌‍⁠﻿  №≈≠≤≥∞√∑∏∫∆ΩαβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΚΛΜΝΞΟΠΡΣΤΥΦΧΨ"
) | frozenset(map(chr, range(0x400, 0x460)))


class Repair(NamedTuple):
    """What became of one value: the text after repair, the encodings undone, and whether some of it is lost."""

    text: str
    steps: tuple[str, ...]
    lossy: bool


# ---------------------------------------------------------------- the automaton
#: Byte structure of UTF-8's multibyte sequences, compiled: a match is a maximal run of well-formed ones.
_AUTOMATON = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


def well_formed_spans(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of well-formed multibyte UTF-8 sequences, as (start, end)."""
    return [m.span() for m in _AUTOMATON.finditer(data)]


# ---------------------------------------------------------------- characters back to bytes
def _single_byte_table(encoding: str) -> dict[str, bytes]:
    table = {chr(b): bytes([b]) for b in range(0x80, 0xA0)}  # undefined places are often let through as controls
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = bytes([b])
        except UnicodeDecodeError:
            pass
    return table


_TABLES = {e: _single_byte_table(e) for e in SINGLE_BYTE}
#: A text decoded wrongly twice comes out of the first step as Western characters, controls included.
PLAUSIBLE |= frozenset(_TABLES["cp1252"])
#: For str.translate: each character's byte as the character of that number, "?" where the encoding has none.
_BYTES = {e: {b: "?" for b in range(0x80, 0x100)} | {ord(c): chr(b[0]) for c, b in t.items()} for e, t in _TABLES.items()}


def _opening(encoding: str) -> re.Pattern[str]:
    """What a multibyte span of this encoding must begin with: a lead byte's character and a continuation's."""
    lead, cont = ("".join(map(re.escape, sorted(c for c, b in _TABLES[encoding].items() if low <= b[0] <= high))) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"([{lead}])([{cont}])")


_OPENINGS = {e: _opening(e) for e in SINGLE_BYTE}
_FULL_WIDTH = range(0xFF00, 0xFFF0)


@lru_cache(maxsize=50_000)
def _multi_bytes(ch: str, encoding: str) -> bytes | None:
    if ord(ch) in _FULL_WIDTH:
        return None
    try:
        data = ch.encode(encoding)
    except UnicodeEncodeError:
        return None
    return data if len(data) in (1, 2) else None


def _to_bytes(ch: str, encoding: str) -> bytes | None:
    if ch < "\x80":
        return ch.encode()
    return _multi_bytes(ch, encoding)


def _decode(text: str, encoding: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with the well-formed spans decoded, and each span's (start, end) in the old and in the new text."""
    out: list[str] = []
    cuts: list[tuple[int, int, int, int]] = []
    length = 0
    if encoding in _BYTES:  # one byte a character: the places in the bytes are those in the text
        data, at = text.translate(_BYTES[encoding]).encode("latin_1", "replace"), 0
        for a, z in well_formed_spans(data):
            piece = data[a:z].decode()
            out += [text[at:a], piece]
            length += a - at
            cuts.append((a, z, length, length + len(piece)))
            length += len(piece)
            at = z
        out.append(text[at:])
        return "".join(out), cuts
    i, n = 0, len(text)
    while i < n:
        pieces, starts, j = [], [], i
        while j < n and (b := _to_bytes(text[j], encoding)) is not None:
            starts.append(j)
            pieces.append(b)
            j += 1
        if not pieces:
            out.append(text[i])
            length += 1
            i += 1
            continue
        data = b"".join(pieces)
        owner = [k for k, b in zip(starts, pieces, strict=True) for _ in b]
        widths = {k: len(b) for k, b in zip(starts, pieces, strict=True)}
        at = 0
        for a, z in [*well_formed_spans(data), (len(data), len(data))]:
            while at < a:  # bytes outside spans: a whole character stays, half of one is only worth its ASCII byte
                whole = at + widths[owner[at]] <= a and (at == 0 or owner[at - 1] != owner[at])
                piece = text[owner[at]] if whole else chr(data[at]) if data[at] < 0x80 else REPLACEMENT
                out.append(piece)
                length += 1
                at += widths[owner[at]] if whole else 1
            if z > a:
                piece = data[a:z].decode()
                out.append(piece)
                cuts.append((owner[a], owner[z - 1] + 1, length, length + len(piece)))
                length += len(piece)
                at = z
        i = j
    return "".join(out), cuts


# ---------------------------------------------------------------- judging a reading
_WORD = re.compile(r"[^\W\d_]+")


def _word_around(text: str, start: int, end: int) -> str:
    while start > 0 and (text[start - 1].isalpha()):
        start -= 1
    while end < len(text) and (text[end].isalpha()):
        end += 1
    return text[start:end]


def _one_case(word: str) -> bool:
    return word in (word.lower(), word.upper(), word.capitalize())


def _span_value(old: str, new: str, cut: tuple[int, int, int, int]) -> int:
    """2: the span makes Vietnamese of what was none; 4: a foreign word of a broken one; 1: plausible; 3: plausible beside others only; 0: not to be believed."""
    before, after = old[cut[0] : cut[1]], new[cut[2] : cut[3]]
    if any(c not in PLAUSIBLE and not "\u3040" <= c <= "\u9fff" for c in after):
        return 0
    if all(c in LETTERS or c in "\xa0\xad" for c in before):  # a capital before a non-breaking space or a soft hyphen reads like two bytes
        was = _WORD.findall(_word_around(old, cut[0], cut[1]))
        apart = before[-1] == "\xa0" and old[cut[1] : cut[1] + 1] in ("", " ")
        if was and not apart and all(is_syllable(w) and _one_case(w) for w in was):
            return 3
    words = _WORD.findall(_word_around(new, cut[2], cut[3]))
    if any(not c.isalnum() and not c.isspace() for c in before) and after.isalpha() and len(words) == 1 and len(words[0]) > len(after) and not any("\u0370" <= c <= "\u1cff" for c in words[0]):
        return 2 if is_syllable(words[0]) else 4  # a sign in the middle of what becomes one word
    return 2 if any(c in SPECIAL for c in after) and words and all(map(is_syllable, words)) else 1


#: Two-character and three-character signatures of UTF-8 read as Western text: such a span is believed without a word.
_SIGNATURE = re.compile("[ÂÃ][\u0080-¿]|[Ää][\u0080-¿‘’“”•–—˜™š›œžŸƒ„…†‡ˆ‰Š‹Œ]|â[\u0080€][\u0080-¿‘’“”•–—˜™š›œžŸƒ„…†‡ˆ‰Š‹Œ¦¢]|Ï[\u0080-¿†‰€]|Î[\u0080-¿©]|[ÐÑ][\u0080-¿]")


def _read(text: str, encoding: str) -> tuple[int, int, str] | None:
    """(worth, spans believed, text) of one reading, or None if it gives nothing."""
    if encoding in _OPENINGS and not _OPENINGS[encoding].search(text):
        return None
    new, cuts = _decode(text, encoding)
    if not cuts:
        return None
    values = [_span_value(text, new, c) for c in cuts]
    strong = values.count(2)
    western = encoding in ("cp1252", "latin_1")
    believed = [v in (2, 4) or v in (1, 3) and strong > 0 or v == 1 and western and bool(_SIGNATURE.search(text[c[0] : c[1]])) for v, c in zip(values, cuts, strict=True)]
    if not any(believed):
        return None
    out, at = [], 0
    for ok, (a, b, p, q) in zip(believed, cuts, strict=True):
        if ok:
            out += [text[at:a], new[p:q]]
            at = b
    out.append(text[at:])
    result = "".join(out)
    if len(encoding) > 4 and encoding in MULTI_BYTE:  # characters that straddle a span only come right as a whole
        result = new if all(believed) else result
    worth = 4 * strong + sum(believed) - sum(v == 0 for v in values) - _oddity(result)
    return worth, sum(believed), result


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _oddity(text: str) -> int:
    return sum(c not in LETTERS and ord(c) > 127 for c in text)


# ---------------------------------------------------------------- TCVN3
_TOKEN = re.compile(r"[^\W\d_\u0300-\u036f]*(?:[¡-¿×÷\u0300-\u036f]+[^\W\d_\u0300-\u036f]*)*")
_NOT_PLAIN = re.compile(r"[A-Za-z]*[à-ýÀ-Ý][^\W\d_]*")
_UNITS = {"µm", "µg", "µs", "µA", "µF", "µV", "µl", "mµ"}
_TCVN3_KEY = re.compile("[" + "".join(sorted(TCVN3_CHARS)) + "]")


def _tcvn3(text: str) -> str | None:
    """The text with TCVN3 words read rightly, or None if it isn't TCVN3."""
    if _CLEAN.fullmatch(text) and sum(not is_syllable(w) for w in _NOT_PLAIN.findall(text)) < 2 or not _TCVN3_KEY.search(text):
        return None
    gained = lost = marked = 0
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        if len(word) < 2 or word in _UNITS or not _TCVN3_KEY.search(word) or not all(c < "\u0250" for c in word):
            continue
        read = "".join(TCVN3_CHARS.get(c, c) for c in word)
        ok, was = is_syllable(read), is_syllable(word)
        if ok and not was:
            gained += 1
            marked += any(c not in LETTERS for c in word)
        elif was and not ok:
            lost += 1
        if ok:
            out += [text[at : m.start()], read]
            at = m.end()
    if not gained or lost >= gained:
        return None
    inner = gained - marked  # words whose letters are all Vietnamese as they stand
    if marked == 0 and inner < 2:
        return None
    out.append(text[at:])
    return "".join(out)


# ---------------------------------------------------------------- whole values
_CLEAN = re.compile("[\x00-\x7f" + "".join(sorted(SPECIAL)) + "]*")
_LEFT_OVER = re.compile("�|[\x80-\x84\x86-\x9f]")


def _candidates(text: str) -> list[str]:
    """Encodings under which a span opens in the text, however few; none is left out for another's sake."""
    some = [e for e, pattern in _OPENINGS.items() if any(not (a in LETTERS and z in LETTERS) for a, z in pattern.findall(text))]
    return [*some, *MULTI_BYTE] if any("\u2e80" <= c for c in text) else some


@lru_cache(maxsize=100_000)
def repair(text: str | None) -> Repair | None:
    """The repair of one value, or None if it holds nothing garbled.

    Steps are taken until none makes the text shorter in UTF-8, so text garbled any number of times, or in several
    encodings, comes back; the shrinking length bounds their number.  Null and empty text is never garbled.  Text that has lost bytes (U+FFFD) is garbled beyond repair: what can be
    restored is, the rest stays and ``lossy`` says so.
    """
    if not text or text.isascii():
        return None
    current, steps = text, []
    while True:
        if _CLEAN.fullmatch(current):
            break
        best: tuple[int, int, str] | None = None
        name = ""
        for encoding in _candidates(current):
            got = _read(current, encoding)
            if got and (best is None or got[0] > best[0]):
                best, name = got, encoding
                if _CLEAN.fullmatch(got[2]):
                    break
        if best is None or _bytes(best[2]) >= _bytes(current):
            break
        current = best[2]
        steps.append(name)
    if not steps and (read := _tcvn3(text)) is not None:
        current = read
        steps.append("tcvn3")
    lossy = bool(_LEFT_OVER.search(current))
    return Repair(current, tuple(steps), lossy) if steps or lossy else None
