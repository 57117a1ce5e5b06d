"""The Snowball stemmer for English ("Porter2"), for single words."""

from __future__ import annotations

import re

# Fixed values of the algorithm: exceptional forms, words that stop after the first step, and suffix tables.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STARTS = ("gener", "commun", "arsen")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
VOWELS, DOUBLES, LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def english(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    w = word.replace("’", "'").lstrip("'") if word[:1] in ("'", "’") else word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(rf"(^|[{VOWELS}])y", lambda m: m[1] + "Y", w)  # a y that counts as a consonant
    head = next((h for h in STARTS if w.startswith(h)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w.lower()
    # 1b: past and present participles
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c: a y after a consonant that isn't the first letter
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2 and 3: suffixes put together
    end = _longest(w, (*STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if end in STEP2:
            w = base + STEP2[end]
        elif end == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif base[-1:] in LI:
            w = base if base else w
    end = _longest(w, (*STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end in STEP3:
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    # 4: suffixes taken off
    end = _longest(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    # 5: last e or l
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
