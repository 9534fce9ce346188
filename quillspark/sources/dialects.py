"""Archives that publish TEI, each in its own dialect: rules by archive, one reader for all, texts with heading lines.

A document's tags mean what its archive's table says. Reading gives segments, paragraphs with the path of citation steps that
they stand in, and counts of gaps; heading lines, texts and verdicts are Columns over these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import clean as C
from quillspark.functions import headings as H
from quillspark.functions.text import fold
from quillspark.sources.tei import tokens


def _names(text: str) -> frozenset[str]:
    return frozenset(text.lower().split())


#: Characters that a citation level has at least on average to be a reference's, and levels at most.
LEVEL, DEEPEST = 900, 3
#: Characters of a heading line at most, and of one that is cut short.
LINE, SHORT_LINE = 88, 85
#: Extents of gaps that lose a word or more; lost words in a thousand at most.
LOST, MOST_LOST = "word|line|page|para|span", 4.0
#: The last year of imprints that a licence frees, and how old one is that is free by its age.
MODERN, AGED = 1950, 100
#: What an archive's licence line says of a free text.
LICENCES = {
    "epidoc": r"(?i)creativecommons\.org/licenses|creative commons",
    "tcp": r"(?i)creativecommons\.org/publicdomain/zero|creative commons 0 1\.0|cc0 1\.0 public domain",
    "dta": r"(?i)creativecommons\.org/licenses|creative commons|\bcc[ -]?(by|0)\b|gemeinfrei|namensnennung|public domain|project gutenberg license",
    "articles": r"(?i)copyleft\s*:[^;]*creative commons|translat\w*\s*:[^;]*\bfor (?:mia|the marxists internet archive|marxists\.org)\b",
    "editions": r"(?i)^cc",
}
#: Characters of a text at least, by archive; chunks of its own text at least.
FLOORS, CHUNKS = {"tcp": 10_000}, 10
FLOOR = 12_000


@dataclass(frozen=True)
class Rules:
    """What tags mean. dropped: they and all in them are no text. blocks: they begin and end a paragraph. lines: their end is a
    line's end within one. marks: tags of emphasis, with the attribute and the pattern of its values that mean it. units: of
    milestones that are citation steps. aside: attribute of a division and values for which it is no text of the work.
    cited: types of divisions that are steps, counted where they have no number; None: all are. gaps: are seen and counted.
    breaks: line breaks join words and lines."""

    dropped: frozenset[str]
    blocks: frozenset[str]
    lines: frozenset[str]
    marks: dict[str, tuple[str, str]]
    aside: tuple[str, frozenset[str]] = ("n", frozenset())
    units: frozenset[str] = frozenset()
    cited: frozenset[str] | None = None
    numbered: bool = False
    gaps: bool = False
    breaks: bool = False
    meaning: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        tables = {"line": self.lines, "block": self.blocks, "drop": self.dropped, "mark": frozenset(self.marks)}
        self.meaning.update({tag: kind for kind, tags in tables.items() for tag in tags if kind != "block" or tag not in self.lines})
        self.meaning.update({"head": "heading", "div": "div", **{f"div{i}": "div" for i in range(8) if self.cited is not None}})
        self.meaning.update({"milestone": "milestone"} if self.units else {})
        self.meaning.update({"gap": "gap"} if self.gaps else {})
        self.meaning.update({"lb": "wrap"} if self.breaks else {})


#: The tables of the archives.
RULES = {
    "epidoc": Rules(
        dropped=_names("note bibl ref figure graphic gap orig reg del teiHeader pb cb lb space witDetail app rdg"),
        blocks=_names("p l lg ab sp speaker stage quote cit list item label trailer closer opener salute signed argument table row cell"),
        lines=_names("l speaker stage"), marks={"hi": ("rend", "ital|emph"), "emph": ("rend", "ital|emph"), "foreign": ("", ""), "title": ("", "")},
        aside=("n", _names("front praef praefatio dedication introduction")), units=_names("book chapter section letter poem oration speech part fragment entry verse"),
    ),
    "tcp": Rules(
        dropped=_names("note figure figDesc fw teiHeader desc ref bibl"),
        blocks=_names("p ab lg sp speaker stage item label list trailer closer opener salute signed argument table row cell q quote epigraph byline docTitle titlePart"),
        lines=_names("l speaker stage"), marks={"hi": ("", ""), "emph": ("", "")},
        aside=("type", _names(
            "title_page engraved_title_page coat_of_arms frontispiece table_of_contents errata colophon bookplate blank advertisement publishers_advertisement index imprimatur license subscribers"
        )), cited=_names("book part chapter section canto act scene letter sermon dialogue"), gaps=True,
    ),
    "dta": Rules(
        dropped=_names("fw note figure figDesc teiHeader gap sic orig abbr bibl ref formula"),
        blocks=_names("p ab lg sp speaker stage item list label trailer closer opener salute signed argument table row cell quote cit epigraph"),
        lines=_names("l speaker stage"), marks={"hi": ("rendition", "#g|#i|#b|#k"), "emph": ("rendition", "#g|#i|#b|#k")}, numbered=True, breaks=True,
    ),
}
#: Types of divisions that wrap an edition and are no step.
WRAPPERS = _names("translation edition version")
Step = tuple[str, str]
#: Runs of blanks that aren't one space already.
_blanks = re.compile(r"[ \t]{2,}|\t")
_lost = re.compile(LOST, re.I)


class Reader:
    """Takes a document's events in order; the paragraphs are in `segments`."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.segments: list[tuple[tuple[Step, ...], str, str]] = []
        self.gaps = self.lost = 0
        self.divisions: list[tuple[Step, ...] | None] = []  # of each open one its steps; None: it is aside
        self.marks: dict[str, str] = {}  # milestones in force, in the order of their units
        self.order: list[str] = []  # units by when they came first
        self.seen: Counter = Counter()
        self.text: list[str] = []
        self.head = ""
        self.below: list[str] = []  # open tags of an element that is dropped
        self.meant: list[bool] = []  # open tags that may be emphasis
        self.broken = False

    def take(self, kind: str, name: str, attributes: dict[str, str]) -> None:
        if self.below:
            if name == self.below[0] and kind != "text":
                {"open": lambda: self.below.append(name), "close": self.below.pop, "alone": lambda: None}[kind]()
        elif kind == "text":
            self.say(name.lstrip(" \t\r\n") if self.broken else name)
            self.broken = False
        elif meant := self.rules.meaning.get(name):
            getattr(self, meant)(kind, name, attributes)

    def say(self, text: str) -> None:
        if None not in self.divisions:
            self.text.append(text)

    def path(self) -> tuple[Step, ...]:
        return (*(s for steps in self.divisions if steps for s in steps), *self.marks.items())

    def paragraph(self) -> None:
        if not self.text:
            return
        lines = [_blanks.sub(" ", x).strip() for x in "".join(self.text).split("\n")]
        text = "\n".join(x for x in lines if x)
        self.text.clear()
        if text:
            self.segments.append((self.path(), self.head, text))
            self.head = ""

    def drop(self, kind: str, name: str, _: dict[str, str]) -> None:
        if kind == "open":
            self.below.append(name)

    def mark(self, kind: str, name: str, attributes: dict[str, str]) -> None:
        """What an opening tag means holds for its end, too."""
        if kind == "open":
            key, pattern = self.rules.marks[name]
            value = attributes.get(key, "")
            self.meant.append(not value or bool(re.search(pattern, value, re.I)))
        if kind != "alone" and self.meant and (self.meant[-1] if kind == "open" else self.meant.pop()):
            self.say("_")

    def block(self, *_) -> None:
        self.paragraph()

    def line(self, kind: str, name: str, _: dict[str, str]) -> None:
        if kind == "close":
            self.say("\n")
        elif name in self.rules.blocks:
            self.paragraph()

    def gap(self, kind: str, name: str, attributes: dict[str, str]) -> None:
        if kind != "close":
            self.gaps += 1
            self.lost += bool(_lost.search(attributes.get("extent", "")))
            self.say("…")
            self.drop(kind, name, attributes)

    def wrap(self, *_) -> None:
        said = "".join(self.text).rstrip()
        if said.endswith(("-", "¬", "\xad")):
            self.text = [said[:-1]]
        else:
            self.say(" ")
        self.broken = True

    def milestone(self, kind: str, _: str, attributes: dict[str, str]) -> None:
        unit, n = attributes.get("unit", ""), attributes.get("n", "")
        if kind == "close" or None in self.divisions or not n or unit.lower() not in self.rules.units:
            return
        if self.marks.get(unit) != n:
            self.paragraph()
        if unit in self.order:
            for deeper in self.order[self.order.index(unit) + 1 :]:
                self.marks.pop(deeper, None)
        else:
            self.order.append(unit)
        self.marks[unit] = n
        self.marks = {u: self.marks[u] for u in self.order if u in self.marks}

    def div(self, kind: str, _: str, attributes: dict[str, str]) -> None:
        if kind == "alone":
            return
        self.paragraph()
        if kind == "close":
            if self.divisions:
                self.divisions.pop()
            return
        key, names = self.rules.aside
        steps = None if None in self.divisions or attributes.get(key, "").lower() in names else self.steps(attributes)
        if steps or (steps == () and self.rules.units and not self.wraps(attributes)):
            self.marks, self.order = {}, []  # milestones belong to the division they stand in
        self.divisions.append(steps)

    def wraps(self, attributes: dict[str, str]) -> bool:
        return attributes.get("type", "").lower() in WRAPPERS or attributes.get("n", "").lower().startswith("urn:")

    def steps(self, attributes: dict[str, str]) -> tuple[Step, ...]:
        """A division's citation steps: one, none, or more where its number names several ('book=5:letter=7')."""
        n, kind = attributes.get("n", ""), attributes.get("type", "")
        if self.rules.numbered:
            return (("", n),) if n else ()
        if self.rules.cited is not None:
            if kind.lower() not in self.rules.cited:
                return ()
            place = (tuple(s for d in self.divisions if d for s in d), kind.lower())
            self.seen[place] += 1
            return ((kind, n or str(self.seen[place])),)
        if self.wraps(attributes):
            return ()
        unit = attributes.get("subtype") or kind
        packed = tuple((a.strip(), b.strip()) for a, eq, b in (p.partition("=") for p in n.split(":")) if eq and a)
        return packed or (((unit or "part", n),) if n else ((unit, ""),) if unit else ())

    def heading(self, kind: str, *_) -> None:
        if kind == "open":
            self.paragraph()
        elif kind == "close":
            head = " ".join("".join(self.text).split())
            self.text.clear()
            if None not in self.divisions:
                self.head = head


def read(xml: str, rules: Rules) -> Reader:
    """The body of a document; one without a body has no segments."""
    begin, end = re.search(r"<body\b[^>]*>", xml, re.I), xml.rfind("</body>")
    own = Reader(rules)
    if begin and end > 0:
        for kind, name, attributes in tokens(xml[begin.end() : end]):
            own.take(kind, name if kind == "text" else name.lower(), attributes)
        own.paragraph()
    return own


def level(segments: list[tuple[tuple[Step, ...], str, str]]) -> int:
    """The deepest citation level, up to DEEPEST, of which and above which a division has LEVEL characters on average."""
    chosen = 1
    for depth in range(1, DEEPEST + 1):
        sizes: Counter = Counter()
        for path, _, text in segments:
            if len(path) >= depth:
                sizes[path[:depth]] += len(text)
        if not sizes or sum(sizes.values()) < LEVEL * len(sizes):
            break
        chosen = depth
    return chosen


SEGMENTS = "segments array<struct<path: array<struct<unit: string, n: string>>, head: string, text: string>>, gaps long, lost long"


def read_documents(works: DataFrame) -> DataFrame:
    """The works' columns but xml, and segments, gaps, lost of the bodies of (archive, xml, ...). Paths go as deep as references
    do. A null document, or one of no known archive, has no segments; each is read within its own row."""
    own = [c for c in works.columns if c != "xml"]
    kind = pa.list_(pa.struct([("path", pa.list_(pa.struct([("unit", pa.string()), ("n", pa.string())]))), ("head", pa.string()), ("text", pa.string())]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 16):
                part = batch.slice(lo, 16)
                rows = []
                for archive, xml in zip(part.column("_archive").to_pylist(), part.column("xml").to_pylist()):
                    found = read(xml or "", RULES[archive]) if archive in RULES else Reader(RULES["tcp"])
                    deep = level(found.segments) if archive == "epidoc" else None
                    rows.append(([{"path": [{"unit": u, "n": n} for u, n in path[:deep]], "head": head, "text": text} for path, head, text in found.segments], found.gaps, found.lost))
                new = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *new], [*own, "segments", "gaps", "lost"])

    given = works.select(*own, F.col("archive").alias("_archive"), "xml")
    return given.mapInArrow(told, T.StructType([*[works.schema[c] for c in own], *T.StructType.fromDDL(SEGMENTS).fields]))


def tag_text(xml: Column, tag: str) -> Column:
    """Text of the first element of this name on one line, entities decoded; null if there is none."""
    inner = F.regexp_extract(xml, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 0)
    bare = C.decode_entities(F.regexp_replace(inner, "<[^>]*>", " "))
    return F.when(inner != "", F.trim(F.regexp_replace(bare, r"\s+", " ")))


def header(xml: Column, archive: Column) -> dict[str, Column]:
    """title, author, year and licence that a document states of itself: the year is that of the printed source, the earliest
    one where several are named; of tcp that of the edition."""
    head = F.substring_index(xml, "</teiHeader>", 1)
    source, edition = (F.regexp_extract(head, rf"(?is)<{t}\b.*?</{t}>", 0) for t in ("sourceDesc", "editionStmt"))
    years = F.array_min(F.transform(F.regexp_extract_all(source, F.lit(r"(?is)<date\b[^>]*>\s*\[?(\d{4})"), 1), lambda y: y.try_cast("int")))
    stated = F.coalesce(F.nullif(F.regexp_extract(edition, r"(?is)<date\b[^>]*>\s*(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(head, r'(?is)<date\b[^>]*when="(\d{4})', 1), F.lit(""))).try_cast("int")
    by = F.regexp_extract(head, r"(?is)<author\b.*?</author>", 0)
    surname, forename = tag_text(by, "surname"), tag_text(by, "forename")
    author = F.when((archive == "dta") & surname.isNotNull(), F.concat_ws(", ", surname, forename)).otherwise(tag_text(head, "author"))
    target = F.nullif(F.regexp_extract(head, r'(?is)<licence[^>]*target="([^"]+)"', 1), F.lit(""))
    licence = F.when(archive == "tcp", tag_text(head, "availability")).otherwise(F.coalesce(tag_text(head, "licence"), target))
    return {"title": tag_text(head, "title"), "author": author, "year": F.when(archive == "tcp", stated).otherwise(years), "licence": licence}


def rights(archive: Column, licence: Column, year: Column, this_year: Column) -> Column:
    """On what ground a text is free: 'age' or 'licence'; null if on none. Of epidoc the printed source counts: one of a
    hundred years is free, a later one up to MODERN if it is licensed; an unknown year is none. Elsewhere the licence alone."""
    stated = F.lit(None).cast("boolean")
    for name, pattern in LICENCES.items():
        stated = F.when(archive == name, licence.rlike(pattern)).otherwise(stated)
    by_licence = F.when(F.coalesce(stated, F.lit(False)), "licence")
    printed = F.when(year <= F.least(F.lit(MODERN), this_year - AGED), "age").when(year <= MODERN, by_licence)
    return F.when(archive == "epidoc", printed).otherwise(by_licence)


def heading_lines(segments: Column, archive: Column) -> Column:
    """The heading line of each segment, null where none stands: a reference in capitals where it changes, with what the
    heading adds to it."""

    def shortened(line: Column) -> Column:
        return F.when(F.length(line) <= LINE, line).otherwise(F.concat(F.regexp_replace(F.left(line, F.lit(SHORT_LINE)), r"\s\S*$", ""), F.lit("…")))

    def line(s: Column, i: Column) -> Column:
        fresh = (F.size(s["path"]) > 0) & ~s["path"].eqNullSafe(F.get(segments, i - 1)["path"])
        own = F.when(s["head"] == "", "").otherwise(F.upper(H.own_part(s["head"])))
        # Bound as elements of arrays, so that capitals, which are slow, are made once and where a reference may stand.
        known = F.transform(F.array(F.struct(s["head"].alias("head"), fresh.alias("fresh"), own.alias("own"))), lambda x: F.struct(x["head"].alias("head"), x["fresh"].alias("fresh"), x["own"].alias("own"), cited(s, x).alias("cite")))
        return F.get(F.transform(F.transform(known, written), lambda x: F.nullif(x, F.lit(""))), F.lit(0))

    def cited(s: Column, x: Column) -> Column:
        return F.when(x["fresh"] | (x["own"] != ""), F.array_join(F.transform(s["path"], lambda p: H.unit_label(p["unit"], p["n"])), ", "))

    def written(x: Column) -> Column:
        head, fresh, own, cite = x["head"], x["fresh"], x["own"], x["cite"]
        bare = F.trim(F.replace(head, F.lit("_"), F.lit("")))
        both = F.concat(cite, F.lit(" — "), F.upper(head))
        epidoc = F.when(fresh, F.when((head != "") & H.adds_something(head) & (F.length(both) <= LINE), both).otherwise(cite))
        joined = F.when((cite != "") & (own != ""), F.concat(cite, F.lit(" — "), own)).when(cite != "", cite).otherwise(H.first_words(own))
        tcp = F.when(fresh | (own != ""), shortened(joined))
        german = F.when(H.mentions(bare, F.lit("de"), {"en": H.BODY["de"]}, r"(?iu)^({})\b"), bare).otherwise(H.first_words(bare))
        dta = F.when(bare != "", F.left(F.upper(german), F.lit(LINE)))
        return F.when(archive == "epidoc", epidoc).when(archive == "tcp", tcp).otherwise(dta)

    return F.transform(segments, line)


def whole_text(segments: Column, archive: Column) -> Column:
    """The text that is chunked: paragraphs between blank lines, each behind its heading line, letters as they are written
    today; empty where there is no body."""
    parts = F.zip_with(segments, heading_lines(segments, archive), lambda s, h: F.concat_ws("\n\n", h, s["text"]))
    joined = F.array_join(parts, "\n\n")
    modern = F.when(archive.isin("tcp", "dta"), C.todays_letters(joined)).otherwise(joined)
    return F.trim(F.regexp_replace(modern, r"\n{3,}", "\n\n"))


def editions(works: DataFrame) -> DataFrame:
    """The works' columns but xml, and title, author, year, licence, text, gaps, lost, words of (archive, xml, ...)."""
    stated = works.select("*", *[c.alias(n) for n, c in header(F.col("xml"), F.col("archive")).items()])
    read_ = read_documents(stated).withColumn("text", whole_text(F.col("segments"), F.col("archive"))).drop("segments")
    return read_.withColumn("words", F.regexp_count("text", F.lit("[A-Za-z']+")))


def judged(editions: DataFrame, chunk_counts: DataFrame, this_year: int) -> DataFrame:
    """editions (id, archive, wanted_title, wanted_author, title, author, year, licence, text, lost, words) with lost_per_1000,
    ground, chunks and reason: why an edition isn't taken, empty if it is.

    chunk_counts (id, chunks): chunks of the works' own text. What is checked first is told first: a body, rights, the title
    and author that were wanted (a null wish is none), lost words, length, chunks. Nothing is filtered out.
    """
    return _verdicts(editions.join(chunk_counts, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))), this_year)


def _verdicts(editions: DataFrame, this_year: int) -> DataFrame:
    """As judged(), of editions that have chunks."""
    rows = editions.withColumn("lost_per_1000", F.round(F.coalesce(F.try_divide(F.col("lost") * 1000, "words"), F.lit(0.0)), 4))
    rows = rows.withColumn("ground", rights(F.col("archive"), F.col("licence"), F.col("year"), F.lit(this_year)))
    floor = F.lit(FLOOR)
    for name, least in FLOORS.items():
        floor = F.when(F.col("archive") == name, least).otherwise(floor)
    lacks = lambda own, wish: ~F.coalesce(F.contains(fold(F.coalesce(own, F.lit(""))), fold(wish)), F.lit(True))
    reason = (
        F.when(F.coalesce("text", F.lit("")) == "", "no body").when(F.col("ground").isNull(), "rights").when(lacks(F.col("title"), F.col("wanted_title")), "title")
        .when(lacks(F.col("author"), F.col("wanted_author")), "author").when((F.col("archive") == "tcp") & (F.col("lost_per_1000") > MOST_LOST), "lost words")
        .when(F.length("text") < floor, "too short").when(F.col("chunks") < CHUNKS, "few chunks").otherwise("")
    )
    return rows.withColumn("reason", reason)


def evaluated(works: DataFrame, this_year: int) -> DataFrame:
    """One flow from documents (id, archive, lang, xml, wanted_title, wanted_author) to verdicts: read, chunked and judged where
    each document is, so that none is read twice or moved; those with null or repeated ids are judged each by its own text."""
    from quillspark.operators.structure import with_chunk_counts

    return _verdicts(with_chunk_counts(editions(works)), this_year)
