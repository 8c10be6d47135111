"""Vietnamese letters and the shape of a Vietnamese syllable (plain Python, used inside UDFs).

A written Vietnamese syllable is an optional onset, a rime and one of six tones; rimes that end in a stop
(c, ch, p, t) carry only the sharp or the heavy tone.  ``is_syllable`` decides membership, which gives the text
operators a language test that needs no word list.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Vietnamese orthography.
VOWELS = "aăâeêioôơuưy"
TONES = {"": 0, "́": 1, "̀": 2, "̉": 3, "̃": 4, "̣": 5}
ONSETS = "b c ch d đ g gh gi h k kh l m n ng ngh nh p ph q qu r s t th tr v x".split()
RIMES = (
    "a ac ach ai am an ang anh ao ap at au ay ăc ăm ăn ăng ăp ăt âc âm ân âng âp ât âu ây "
    "e ec em en eng eo ep et ê êch êm ên ênh êp êt êu i ia ich im in inh ip it iu "
    "iêc iêm iên iêng iêp iêt iêu y yêm yên yêng yêt yêu ych ynh yt ya yn ym "
    "o oa oac oach oai oam oan oang oanh oao oap oat oay oăc oăm oăn oăng oăt oc oe oen oeo oet oi om on ong ooc oong op ot "
    "ô ôc ôi ôm ôn ông ôp ôt ơ ơi ơm ơn ơp ơt ơc ơng "
    "u ua uân uâng uât uây uc uê uêch uênh uên ui um un ung uô uôc uôi uôm uôn uông uôt uơ up ut uy uya uych uyên uyêt uynh uyt uyu uynh uyn uyp "
    "ua uai uao uang uan uay uăng uăn uât uen uet ueo "
    "ư ưa ưc ưi ưm ưn ưng ưt ưu ươ ươc ươi ươm ươn ương ươp ươt ươu"
).split()

_STOPS = ("c", "ch", "p", "t")
_TONE_MARKS = frozenset(t for t in TONES if t)


def vietnamese_letters() -> frozenset[str]:
    """Every precomposed Vietnamese letter, both cases, ASCII letters included."""
    plain = set("abcdefghijklmnopqrstuvwxyz") | {"đ"}
    for vowel in VOWELS:
        for tone in TONES:
            plain.add(unicodedata.normalize("NFC", vowel + tone))
    return frozenset(plain | {c.upper() for c in plain})


LETTERS = vietnamese_letters()
SPECIAL = frozenset(c for c in LETTERS if ord(c) > 127)


def split_tone(word: str) -> tuple[str, int, int]:
    """(word without tone marks, the tone's number, how many tone marks it carried)."""
    out, tone, marks = [], 0, 0
    for ch in unicodedata.normalize("NFD", word):
        if ch in _TONE_MARKS:
            tone, marks = TONES[ch], marks + 1
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)), tone, marks


_RIME_SET = frozenset(RIMES)
_BASES = frozenset([*RIMES, *(o + r for o in ONSETS for r in RIMES), "gi", "gin"])


@lru_cache(maxsize=200_000)
def is_syllable(word: str) -> bool:
    """True for one written Vietnamese syllable in any letter case; empty text is none.

    >>> is_syllable("Nghiễm"), is_syllable("mốc"), is_syllable("môc"), is_syllable("Bayes")
    (True, True, False, False)
    """
    if not word or len(word) > 8:
        return False
    base, tone, marks = split_tone(word.lower())
    if marks > 1 or base not in _BASES:
        return False
    return not base.endswith(_STOPS) or tone in (1, 5)
