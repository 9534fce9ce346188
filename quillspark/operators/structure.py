"""The structure of works: paragraphs with their offsets, real headings, front matter, scripture, and chunks by it.

Each work stays in its row. Columns tell of each of its paragraphs what kind of line it is; what depends on the order of a
work's paragraphs is worked out from these marks where the row is, so that nothing is shuffled and no id need be unique.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import headings as H

#: Characters at which a chunk may end, that it should not pass, that it must not pass; of a chunk at least.
ENOUGH, TARGET, HARD, LEAST = 900, 1400, 1800, 120
#: Headings in a row that are a table of contents; headings that make a structure; verses of a scripture.
CONTENTS, STRUCTURE, VERSES = 3, 3, 500
#: Fixed value: what a sentence begins with.
OPENING = "A-ZÅÄÖÜÉÈÀÇ“\"'(«"
BLANKS = " \t\n\x0b\f\r"
GAP = rf"\n[{BLANKS}]*\n"
_gap, _sentence = re.compile(GAP), re.compile(rf"(?<=[.!?])\s+(?=[{OPENING}])")


def marks(text: Column, lang: Column) -> Column:
    """What the paragraphs of a text, empty ones included, are taken by themselves: an array of structs.

    candidate, body, apparatus, name: a line that may be a heading, its kinds, and its name in references. verse: the chapter
    of a numbered verse. Of works with enough verses also first (verse 1:1), divider, title and book.
    """
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    read = F.transform(parts, lambda p: F.struct(p.alias("p"), H.looks_like_heading(p, lang).alias("candidate"), F.nullif(F.regexp_extract(p, r"^(\d+):\d+\s", 1), F.lit("")).alias("verse")))

    def counted(rows: Column) -> Column:
        return F.struct(rows.alias("rows"), (F.size(F.filter(rows, lambda x: x["verse"].isNotNull())) >= VERSES).alias("bible"))

    def told(work: Column) -> Column:
        def one(x: Column) -> Column:
            p, heading, bible = x["p"], x["candidate"], work["bible"]
            line = H.one_line(p)
            brief, letters, testament = F.length(p) <= H.MOST, p.rlike(r"\p{L}"), p.rlike(r"(?i)\btestament\b")
            title = brief & ~F.contains(p, F.lit("\n")) & ~p.rlike("[.!?]$") & letters & ~testament
            return F.struct(
                heading.alias("candidate"), F.when(heading, H.mentions(line, lang, H.BODY)).alias("body"), F.when(heading, H.mentions(line, lang, H.APPARATUS)).alias("apparatus"),
                F.when(heading, H.heading_name(p)).alias("name"), x["verse"].alias("verse"), F.when(bible, p.rlike(r"^1:1\s")).alias("first"),
                F.when(bible, ~letters | (brief & testament)).alias("divider"), F.when(bible, title).alias("title"), F.when(bible & title, H.book_name(p)).alias("book"),
            )

        return F.transform(work["rows"], one)

    # Each step is bound as an element of an array: verses are counted once for a work, not for each of its paragraphs.
    return F.get(F.transform(F.transform(F.array(read), counted), told), F.lit(0))


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each paragraph without the blanks around it; of an empty one both are the same."""
    edges = [0, *(x for m in _gap.finditer(text) for x in m.span()), len(text)]
    for a, b in zip(edges[::2], edges[1::2]):
        part = text[a:b]
        inner = part.strip(BLANKS)
        start = a + len(part) - len(part.lstrip(BLANKS)) if inner else a
        yield start, start + len(inner)


def outline(marks: list[dict]) -> list[tuple[bool, str | None, bool]]:
    """(heading, locator, front) of each paragraph.

    Candidates in a row, three or more, are a table of contents. The work's own text goes from its first heading of a part to
    its last; what stands before is front matter, behind it what has no heading or stands under apparatus. A work without
    headings of parts has as front matter what stands under apparatus before its last other heading.
    """
    heading: list[bool] = []
    for candidate, run in groupby(m["candidate"] for m in marks):
        n = len(list(run))
        heading += [candidate and n < CONTENTS] * n
    proper = [i for i, m in enumerate(marks) if heading[i] and not m["apparatus"]]
    parts = [i for i in proper if marks[i]["body"]]
    # The heading that each paragraph stands under, itself included.
    under = list(accumulate((i if h else None for i, h in enumerate(heading)), lambda last, own: last if own is None else own))
    out = []
    for i, at in enumerate(under):
        aside = at is not None and bool(marks[at]["apparatus"])
        if sum(heading) < STRUCTURE:
            front = False
        elif parts:
            front = i < parts[0] or (i > parts[-1] and (at is None or aside))
        else:
            front = aside and bool(proper) and i < proper[-1]
        out.append((heading[i], None if at is None else marks[at]["name"], front))
    return out


def scripture(marks: list[dict]) -> list[tuple[bool, str | None, bool]] | None:
    """(skip, locator, front) of each paragraph of a work whose text is numbered verses; None for other works.

    A verse 1:1 begins a book if a title stands in the unbroken run of titles and dividers before it; the first title names
    it, and the run is skipped, as it is before any other 1:1. References are the book and the last verse's chapter.
    """
    verses = sum(m["verse"] is not None for m in marks)
    if verses < VERSES or verses * 2 <= len(marks):
        return None
    between = [m["verse"] is None and (m["title"] or m["divider"]) for m in marks]
    out: list[tuple[bool, str | None]] = []
    book = chapter = opens = None
    titles: list[int] = []
    for loose, run in groupby(range(len(marks)), key=between.__getitem__):
        block = list(run)
        if loose:
            after = block[-1] + 1
            skip, titles = after < len(marks) and bool(marks[after]["first"]), [i for i in block if marks[i]["title"]]
        elif titles and marks[block[0]]["first"]:
            book = marks[titles[0]]["book"]
            opens = len(out) - before if opens is None else opens
        for i in block:
            chapter = marks[i]["verse"] or chapter
            out.append((loose and skip, None if book is None else " ".join(x for x in (book, chapter) if x)))
        before = len(block)
    return None if opens is None else [(skip, locator, i < opens) for i, (skip, locator) in enumerate(out)]


def pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A paragraph's pieces: itself, or where it is too long, sentences as far as they fit together; a piece that is still
    too long is cut at the last blank of its second half, or in mid-word."""
    if end - start <= HARD:
        yield start, end
        return
    stops = [x for m in _sentence.finditer(text[start:end]) for x in m.span()]
    sentences = list(zip([0, *stops[1::2]], [*stops[::2], end - start]))
    a = 0
    while a < len(sentences):
        begin = sentences[a][0]
        b = max(a + 1, bisect_right(sentences, begin + TARGET, key=lambda s: s[1]))
        at, stop = start + begin, start + sentences[b - 1][1]
        while stop - at > HARD:
            blank = text.rfind(" ", at + HARD // 2 + 1, at + HARD)
            yield at, at + HARD if blank < 0 else blank
            at = at + HARD if blank < 0 else blank + 1
        if stop > at:
            yield at, stop
        a = b


def section_chunks(section: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of a section's pieces. A run ends where it is long enough, or before the piece that would make it too
    long. The next one begins with the last piece again if that is short, unless both together must not be one."""
    size = [b - a for a, b in section]
    upto = [0, *accumulate(size)]
    a = fresh = 0
    while fresh < len(section):
        if a < fresh and size[a] + size[fresh] > HARD:
            a = fresh
        long_enough, too_long = bisect_left(upto, upto[a] + ENOUGH), bisect_right(upto, upto[a] + TARGET) - 1
        b = min(len(section), max(fresh + 1, min(long_enough, too_long)))
        yield a, b
        a, fresh = (b - 1 if size[b - 1] < TARGET // 2 else b), b


def chunked(text: str, marks: list[dict]) -> Iterator[tuple[str | None, bool, int, int, str]]:
    """(locator, front, start, end, text) of a work's chunks; marks: of its paragraphs that aren't empty. Chunks never run over a heading or a scripture's chapter; one of
    up to LEAST characters, or equal to the one before, is left out."""
    told = scripture(marks)
    places = [(a, b) for a, b in spans(text) if b > a]
    placed = [(a, b, *m) for (a, b), m in zip(places, told or outline(marks))]
    last, number, key, before = None, 0, [], None
    for _, _, breaks, locator, _ in placed:  # sections: what stands between breaks, or has one reference
        number += breaks or (told is not None and locator != before)
        before = locator
        key.append(number)
    for _, rows in groupby(zip(key, placed), key=lambda x: x[0]):
        own = [p for _, p in rows if not p[2]]
        section = [(a, b, i) for i, p in enumerate(own) for a, b in pieces(text, p[0], p[1])]
        for a, b in section_chunks([x[:2] for x in section]):
            joined = "\n\n".join(text[x:y] for x, y, _ in section[a:b])
            if len(joined) > LEAST and joined != last:
                _, _, _, locator, front = own[section[a][2]]
                yield locator, front, section[a][0], section[b - 1][1], joined
            last = joined


def _listed(marks: pa.Array) -> list[list[dict] | None]:
    """As to_pylist() of an array of lists of structs, column by column; of a null there is None."""
    flat = marks.flatten()
    names = [f.name for f in flat.type]
    columns = [c.to_pylist() for c in flat.flatten()]
    rows = [dict(zip(names, r)) for r in zip(*columns)]
    sizes = pc.list_value_length(marks).to_pylist()
    ends = list(accumulate(n or 0 for n in sizes))
    return [None if n is None else rows[end - n : end] for n, end in zip(sizes, ends)]


def _by_work(works: DataFrame, tell, schema: str) -> DataFrame:
    """Rows that tell(text, marks) gives for each work, after its own columns but text and lang. Works that are null have none."""
    own = [c for c in works.columns if c not in ("text", "lang")]
    marked = works.where("text IS NOT NULL").select(*own, "lang", "text", marks(F.col("text"), F.col("lang")).alias("_marks"))
    added = T.StructType.fromDDL(schema)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                at, rows = [], []
                for i, (text, told) in enumerate(zip(part.column("text").to_pylist(), _listed(part.column("_marks")))):
                    found = list(tell(text, told))
                    at += [i] * len(found)
                    rows += found
                kept = [part.column(c).take(pa.array(at, pa.int32())) for c in (*own, "lang")]
                new = [pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*own, "lang", *added.names])

    return marked.mapInArrow(read, T.StructType([*[marked.schema[c] for c in (*own, "lang")], *added.fields]))


def _paragraph_rows(text: str, marks: list[dict]) -> Iterator[tuple]:
    for i, ((a, b), (heading, locator, front)) in enumerate(_some(text, marks, outline)):
        yield i, a, b, text[a:b], heading, locator, front


def _some(text: str, marks: list[dict], of) -> list[tuple]:
    """Places and what is told of the paragraphs that aren't empty."""
    places = [(p, m) for p, m in zip(spans(text), marks) if p[1] > p[0]]
    told = of([m for _, m in places])
    return [(p, t) for (p, _), t in zip(places, told or [])]


def marked(works: DataFrame) -> DataFrame:
    """The works' own columns, lang, i (from 0), start, end, text, heading, locator and front of each paragraph of (lang, text).

    start and end cut the paragraph, without the blanks around it, out of the text; blank lines end one. Null texts have
    none, a null lang goes by the English rules; ids may be null or repeated, for rows are read one by one.
    """
    return _by_work(works, _paragraph_rows, "i long, start long, end long, text string, heading boolean, locator string, front boolean")


def paragraphs(works: DataFrame) -> DataFrame:
    return marked(works).drop("heading", "locator", "front")


def verses(works: DataFrame) -> DataFrame:
    """As marked(), of scriptures alone: skip (a title or divider before a book), locator, front."""
    schema = "i long, start long, end long, text string, skip boolean, locator string, front boolean"
    return _by_work(works, lambda text, marks: [(i, a, b, text[a:b], *told) for i, ((a, b), told) in enumerate(_some(text, marks, scripture))], schema)


def with_chunk_counts(works: DataFrame) -> DataFrame:
    """works (lang, text, ...) with chunks: how many of a row's chunks aren't front matter. Rows stay, each with its own count,
    whatever their ids; a null text has 0."""
    given = works.withColumn("_marks", F.when(F.col("text").isNotNull(), marks(F.col("text"), F.col("lang"))))
    own = works.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                counts = []
                for text, told in zip(part.column("text").to_pylist(), _listed(part.column("_marks"))):
                    some = [m for (a, b), m in zip(spans(text), told) if b > a] if text else []
                    counts.append(sum(not front for _, front, *_ in chunked(text, some)) if some else 0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array(counts, pa.int64())], [*own, "chunks"])

    return given.mapInArrow(read, T.StructType([*works.schema, T.StructField("chunks", T.LongType())]))


def chunks(works: DataFrame) -> DataFrame:
    """The works' own columns (ids and what else there is), ordinal, locator, front, char_start, char_end, text of the chunks of
    (lang, text, ...). Rows with null or repeated ids are works of their own; a null text has no chunks."""

    def told(text: str, marks: list[dict]) -> Iterator[tuple]:
        some = [m for (a, b), m in zip(spans(text), marks) if b > a]
        for i, chunk in enumerate(chunked(text, some)):
            yield (i, *chunk)

    return _by_work(works, told, "ordinal long, locator string, front boolean, char_start long, char_end long, text string").drop("lang")
