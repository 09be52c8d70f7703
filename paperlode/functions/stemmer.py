"""The English stemmer of the Snowball family (Porter 2), from its published description."""

from __future__ import annotations

import functools
import re

VOWELS = "aeiouy"
VOWEL, VOWEL_THEN_NOT = re.compile(f"[{VOWELS}]"), re.compile(f"[{VOWELS}][^{VOWELS}]")
SHORT_END, CONSONANT_Y = re.compile(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$"), re.compile(f"(^|(?<=[{VOWELS}]))y")
SPECIAL, GENITIVE = re.compile("gener|commun|arsen"), re.compile("('s'|'s|')$")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
WHOLE = {
    **{"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"},
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


#: (length, the endings of that length), the longest first.
Endings = tuple[tuple[int, frozenset[str]], ...]


def by_length(*endings: str) -> Endings:
    return tuple((n, frozenset(e for e in endings if len(e) == n)) for n in sorted({*map(len, endings)}, reverse=True))


ENDS_1A, ENDS_1B = by_length("sses", "ied", "ies", "us", "ss", "s"), by_length("eed", "eedly", "ed", "edly", "ing", "ingly")
ENDS_2, ENDS_3, ENDS_4 = by_length(*STEP_2, "ogi", "li"), by_length(*STEP_3, "ative"), by_length(*STEP_4, "ion")


def region(word: str, start: int = 0) -> int:
    """Where what follows the first consonant after a vowel begins."""
    m = VOWEL_THEN_NOT.search(word[start:])
    return start + m.end() if m else len(word)


def ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return bool(SHORT_END.search(word))


def ending(word: str, endings: Endings) -> str:
    """The longest of the endings that the word has."""
    for n, own in endings:
        if word[-n:] in own:
            return word[-n:]
    return ""


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = CONSONANT_Y.sub("Y", w)
    special = SPECIAL.match(w)
    r1 = special.end() if special else region(w)
    r2 = region(w, r1)
    w = GENITIVE.sub("", w)
    # step 1a
    if e := ending(w, ENDS_1A):
        if e == "sses":
            w = w[:-2]
        elif e in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif e == "s" and VOWEL.search(w[:-2]):
            w = w[:-1]
    if w in AFTER_1A:
        return w
    # step 1b
    e = ending(w, ENDS_1B)
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif ends_short(w) and r1 >= len(w):
            w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # step 2
    e = ending(w, ENDS_2)
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(e)] + STEP_2[e]
    # step 3
    e = ending(w, ENDS_3)
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + STEP_3[e]
    # step 4
    e = ending(w, ENDS_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    # step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
