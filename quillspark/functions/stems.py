"""Search terms of a text: words without case, accents and, in English, endings. One function for texts and for requests."""

from __future__ import annotations

import re
import unicodedata

#: Rules of the Porter stemmer by step, ending to replacement, the longest ending first.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
RESTORED = {"at": "ate", "bl": "ble", "iz": "ize"}
DERIVED = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al",
    "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "ator": "ate", "logi": "log", "eli": "e", "bli": "ble",
}
ADJECTIVES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
CUT = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")
#: Bytes of a word that is stemmed, at least and at most.
SHORTEST, LONGEST = 3, 64
#: A letter or digit, then those and combining marks.
_word = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")
_measure = re.compile("v+c")


def shape(word: str) -> str:
    """v or c for each letter; y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """Number of times that a consonant follows a vowel."""
    return len(_measure.findall(shape(stem)))


def has_vowel(stem: str) -> bool:
    return "v" in shape(stem)


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel and a consonant other than w, x and y at the end."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, rules: dict[str, str], least: int) -> str:
    """word with its longest ending of the rules replaced, if what is before it has the measure."""
    for ending, other in rules.items():
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + other if measure(stem) >= least else word
    return word


def without_participle(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for ending in ("ed", "ing"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and has_vowel(stem):
            if stem[-2:] in RESTORED:
                return stem[:-2] + RESTORED[stem[-2:]]
            if doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and short_end(stem) else stem
    return word


def without_suffix(word: str) -> str:
    for ending in CUT:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            fits = measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else word
    return word


def tidied(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """A folded word without English endings, by the Porter stemmer; very short and very long ones stay."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    word = without_participle(replaced(word, PLURALS, 0))
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return tidied(without_suffix(replaced(replaced(word, DERIVED, 1), ADJECTIVES, 1)))


def folded(word: str) -> str:
    """Small letters without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn"))


class Terms:
    """Terms of texts; each distinct word is folded and stemmed once, up to `most` of them, then the memory starts anew."""

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.known = most, {}

    def of(self, text: str) -> list[str]:
        get, out = self.known.get, []
        for word in _word.findall(text):
            if (term := get(word)) is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = term = stem(folded(word))
            out.append(term)
        return out
