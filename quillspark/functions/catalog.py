"""Functions for building a catalogue: names, titles, rights and their reasons, money, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import fold

#: Latest imprint that may be free at all, and years after which age alone, or the author's death, frees a text.
LATEST_IMPRINT, AGE, AFTER_DEATH = 1950, 100, 70
LEAST_QUALITY = 75
#: Cost of tokens read from and written to a cache, relative to fresh ones.
CACHE_READ, CACHE_WRITE = 0.1, 1.25
NUMERAL = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
_VOLUME = r"(?i)[,:;]? *(?:vol(?:ume)?\.?|part|book) +([0-9]+)"


def attribution(names: Column) -> Column:
    """Struct of authors, translator (the first) and dubious, from names joined by `;` with a role in brackets."""
    parts = F.filter(F.transform(F.split(names, ";"), lambda p: F.trim(p)), lambda p: p != "")

    def role(p: Column) -> Column:
        return F.lower(F.regexp_extract(p, r"\[([^\]]*)\]", 1))

    def bare(of: Column) -> Column:
        return F.transform(of, lambda p: F.trim(F.regexp_replace(p, r" *\[[^\]]*\]", "")))

    authors = bare(F.filter(parts, lambda p: role(p).isin("", "author", "dubious author")))
    translators = bare(F.filter(parts, lambda p: role(p) == "translator"))
    return F.struct(authors.alias("authors"), F.get(translators, F.lit(0)).alias("translator"), F.exists(parts, lambda p: F.contains(role(p), F.lit("dubious"))).alias("dubious"))


def lifespan(name: Column) -> Column:
    """Struct of born and died in a name's `born-died`; years BCE are negative, unknown ones null."""
    pattern = r"([0-9]+)\??( BCE)?-([0-9]+)\??( BCE)?"

    def year(at: int) -> Column:
        number = F.regexp_extract(name, pattern, at).try_cast("int")
        return F.when(F.regexp_extract(name, pattern, at + 1) != "", -number).otherwise(number)

    return F.struct(year(1).alias("born"), year(3).alias("died"))


#: Fixed value: what stands behind a name in a catalogue and isn't shown.
HONORIFIC = r"(?i)^(saint|st\.?|jr\.?|sir|dame|lord|lady|baron|baronne|freiherr( von)?|kniaz|marquis( de)?|comte( de)?|graf|von|de|d'|emperor of rome|of hippo|active .*|approximately .*)$"


def display_name(name: Column, overrides: dict[str, str] | None = None) -> Column:
    """`Surname, F. (Forename), epithet, years` as `Forename Surname, epithet`; a name without a comma stays as it is.

    Years and honorifics aren't shown. overrides: names for catalogue names that begin with these; the first of them counts.
    """
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    second = F.get(parts, F.lit(1))
    spelled = F.regexp_extract(second, r"\(([^)]+)\)", 1)
    dated = second.rlike("^[0-9?]")
    bare = F.when(dated, F.get(parts, F.lit(0))).otherwise(F.concat_ws(" ", F.when(spelled != "", spelled).otherwise(second), F.get(parts, F.lit(0))))
    epithets = F.filter(F.slice(parts, F.when(dated, 2).otherwise(3), F.lit(99)), lambda p: ~p.rlike("^[0-9?]") & ~p.rlike(HONORIFIC))
    both = F.concat_ws(", ", F.trim(F.regexp_replace(bare, r"\s+", " ")), F.nullif(F.array_join(epithets, ", "), F.lit("")))
    found = F.when(F.size(parts) < 2, F.coalesce(F.get(parts, F.lit(0)), name)).otherwise(both)
    for start, shown in reversed((overrides or {}).items()):
        found = F.when(F.startswith(name, F.lit(start)), shown).otherwise(found)
    return found


def overridden(column: Column, key: Column, overrides: dict[str, str]) -> Column:
    """The value that a key is given by hand, or else the column's; an unknown key changes nothing."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]), key), column) if overrides else column


def volume_of(title: Column) -> Column:
    return F.regexp_extract(title, _VOLUME, 1).try_cast("int")


def base_title(title: Column) -> Column:
    """A title without its volume and what stands in brackets after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, _VOLUME + ".*$", ""), r" *[(\[].*$", ""))


def title_key(title: Column) -> Column:
    """Key under which editions of one work meet."""
    return F.regexp_replace(fold(base_title(title)), "^(the|a|an) ", "")


def is_numeral(word: Column) -> Column:
    return (word != "") & F.upper(word).rlike(NUMERAL)


def source_link(source: Column, source_id: Column, templates: dict[str, str]) -> Column:
    """Address of a work at its source; `{}` in a template stands for its id, unknown sources have none."""
    link = F.lit(None).cast("string")
    for name, template in templates.items():
        before, _, after = template.partition("{}")
        link = F.when(source == name, F.concat(F.lit(before), source_id.cast("string"), F.lit(after))).otherwise(link)
    return link


def rights_ground(imprint: Column, licence: Column, as_of_year: int, free: str = r"(?i)\bcc(0|[ -]by)|public domain") -> Column:
    """Why a text may be used: age, licence or none. An unknown or late imprint frees nothing."""
    out_of_reach = imprint.isNull() | (imprint > LATEST_IMPRINT)
    return F.when(out_of_reach, "none").when(imprint <= as_of_year - AGE, "age").when(licence.rlike(free), "licence").otherwise("none")


def rejection(died: Column, translator: Column, quality: Column, as_of_year: int) -> Column:
    """Why a work isn't taken, empty if it is. A quality that is unknown is no reason."""
    return (
        F.when(died.isNull(), "death unknown").when(died + AFTER_DEATH >= as_of_year, "protected").when(translator.isNotNull(), "translated")
        .when(quality < LEAST_QUALITY, "low quality").otherwise("")
    )


def years(text: Column) -> Column:
    """Four-digit years from 1400 to 2099, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])(1[4-9][0-9][0-9]|20[0-9][0-9])(?:$|[^0-9])"), 1), lambda y: y.cast("int"))


def per_thousand_words(n: Column, text: Column) -> Column:
    """How many of something there are for each thousand words; 0 in a text without words."""
    return F.coalesce(n * 1000 / F.nullif(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)), F.lit(0.0))


def line_cost(tokens: Column, per_million: Column, kind: Column) -> Column:
    """Cost of a line of tokens, which are fresh or read from or written to a cache."""
    factor = F.when(kind == "cache read", CACHE_READ).when(kind == "cache write", CACHE_WRITE).otherwise(1.0)
    return tokens * per_million * factor / 1e6


def fixed(x: Column, digits: int, lang: str = "en") -> Column:
    """A number with so many decimals as a language writes it: Swedish has a comma and blanks that don't break."""
    shown = F.format_number(x, digits)
    return F.translate(shown, ",.", "\u00a0,") if lang == "sv" else shown


def usd_shown(cost: Column, lang: str = "en") -> Column:
    """A cost in dollars with four decimals; what is less than the last of them is told so."""
    return F.when(cost <= 0, "$0").when(cost < 0.0001, F.concat(F.lit("<$"), fixed(F.lit(0.0001), 4, lang))).otherwise(F.concat(F.lit("$"), fixed(cost, 4, lang)))


def sek_shown(cost: Column, lang: str = "en") -> Column:
    """A cost in kronor with two decimals, three below ten öre."""
    unit = F.lit(" kr" if lang == "sv" else " SEK")
    small = F.when(cost < 0.1, fixed(cost, 3, lang)).otherwise(fixed(cost, 2, lang))
    return F.concat(F.when(cost <= 0, "0").when(cost < 0.001, F.concat(F.lit("<"), fixed(F.lit(0.001), 3, lang))).otherwise(small), unit)


def tokens_shown(n: Column) -> Column:
    """A number of tokens, from a thousand on in thousands with one decimal, cut off."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.floor(n % 1000 / 100).cast("string"), F.lit("k")))


def duration_shown(ms: Column) -> Column:
    """A measured time in seconds or minutes and seconds; null for 0, which means it wasn't measured."""
    s = F.floor(ms / 1000)
    short, long = F.concat(s.cast("string"), F.lit(" s")), F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))
    return F.when(ms > 0, F.when(s < 60, short).otherwise(long))


def year_shown(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))).when(year > 0, year.cast("string"))
