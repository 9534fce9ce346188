"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that no mark can be taken from, and what they fold to; the marks that are taken off.
SPECIAL = {"ø": "o", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ł": "l", "ß": "ss"}
MARKS = ("\u0300", "\u036f")


def _bare(letter: str) -> str:
    """A letter without its marks, in lower case, by the character data that Unicode publishes."""
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not MARKS[0] <= c <= MARKS[1]).lower()


#: Letters that are one letter once their marks are off, and which.
BARE = {c: b for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and len(b := _bare(c)) == 1 and b != c.lower() and (b.isascii() or b in SPECIAL)}
#: First years of the periods after the first, and all their names in order.
PERIOD_STARTS, PERIODS = (500, 1450, 1650, 1800, 1900), ("antiquity", "medieval", "renaissance", "enlightenment", "nineteenth", "modern")


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether they are marks of their own or part of a letter; runs of anything but letters
    and digits become one space."""
    plain = F.regexp_replace(text, f"[{MARKS[0]}-{MARKS[1]}]", "")
    folded = F.lower(F.translate(plain, "".join(BARE), "".join(BARE.values())))
    for letter, other in SPECIAL.items():
        folded = F.replace(folded, F.lit(letter), F.lit(other))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def prompt_norm(text: Column) -> Column:
    """A question as a cache key: lower case, single spaces, no closing punctuation."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " ")), "[.!?…]+$", ""))


def text_hash(text: Column) -> Column:
    """Fingerprint that guards references to a passage: the first 16 hexadecimal digits of SHA-256."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def letters_key(text: Column) -> Column:
    """Letters and digits of a text, 120 characters of them; empty where there are none. Java makes two characters of a small
    dotted I, others one."""
    small = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.substring(F.trim(F.regexp_replace(small, "[^a-z0-9]+", " ")), 1, 120)


def dedupe_key(text: Column) -> Column:
    """Key of near-equal passages: that of their letters, or a hash where there are none, so that those aren't all one."""
    key = letters_key(text)
    return F.when(key == "", F.concat(F.lit("#"), text_hash(text))).otherwise(key)


def period_of(year: Column) -> Column:
    """Period of a year; half-open, null for an unknown year."""
    named = F.lit(PERIODS[-1])
    for start, name in reversed(list(zip(PERIOD_STARTS, PERIODS))):
        named = F.when(year < start, name).otherwise(named)
    return F.when(year.isNotNull(), named)


def tolerance(term: Column) -> Column:
    return F.when(F.length(term) < 5, 0).when(F.length(term) < 8, 1).otherwise(2)


def fuzzy_match(text: Column, terms: list[str]) -> Column:
    """All terms occur in the folded text, or begin one of its words up to one edit (5 letters on) or two (8 on)."""
    found = F.lit(True)
    for term in terms:
        t = F.lit(term)
        slack = 0 if len(term) < 5 else 1 if len(term) < 8 else 2
        close = F.exists(F.split(text, " "), lambda w: F.levenshtein(t, F.left(w, F.lit(len(term) + slack)), slack) >= 0)
        found = found & (F.contains(text, t) | (close if slack else F.lit(False)))
    return found


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def first_tag(xml: Column, tag: str) -> Column:
    """Content of the first element with this name; null if there is none."""
    return F.nullif(F.regexp_extract(xml, rf"(?is)<{tag}(?:[ \t\r\n][^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.substring(F.replace(fold(text), F.lit(" "), F.lit("-")), 1, 60), "-+$", "")


def tags_of(csv: Column) -> Column:
    """Tags of a comma-joined string: trimmed, of 40 characters at most, the first spelling of each, ten at most."""
    named = F.filter(F.transform(F.split(csv, ","), lambda t: F.substring(F.trim(t), 1, 40)), lambda t: t != "")
    first = F.filter(named, lambda t, i: ~F.exists(F.slice(named, F.lit(1), i), lambda e: F.lower(e) == F.lower(t)))
    return F.slice(first, 1, 10)


def context(text: Column, start: Column, end: Column, radius: int) -> dict[str, Column]:
    """A half-open span with the text before and after it, from and to the paragraph breaks within the radius, and whether
    the text begins or ends within it."""
    left, gap = F.greatest(F.lit(0), start - radius), F.lit("\n\n")
    before, after = F.substring(text, left + 1, start - left), F.substring(text, end + 1, F.lit(radius))
    return {
        "before": F.when(F.contains(before, gap), F.substring(before, F.locate("\n\n", before) + 2, F.length(before))).otherwise(before),
        "passage": F.substring(text, start + 1, end - start),
        "after": F.when(F.contains(after, gap), F.left(after, F.length(after) - F.length(F.substring_index(after, "\n\n", -1)) - 2)).otherwise(after), "at_start": left == 0, "at_end": F.length(text) <= end + radius,
    }


def bibtex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, whatever the element type."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Hosts of sources that the queries allow.
HOSTS = ("example.com", "example.org", "example.net", "test", "org")


def host(url: Column) -> Column:
    """The host of a web address, in small letters; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a web address is one of these hosts' or of a host below one; no other scheme than http and https."""
    found = F.lit(False)
    for h in hosts:
        found = found | (host(url) == h) | F.endswith(host(url), F.lit("." + h))
    return F.coalesce(url.rlike("(?i)^https?://") & found, F.lit(False))
