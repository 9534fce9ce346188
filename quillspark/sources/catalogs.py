"""Catalogues of sources: identifiers, lists and trees as Column expressions over what has landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.clean import decode_entities, html_to_text, without_blocks

#: Fixed values, formats of the outside: an edition's URN, and its file in a repository's tree, whose name has those of its
#: folders again.
URN = r"^urn:cts:([A-Za-z]+):([^.\s]+)\.([^.\s]+)\.([^.\s:]+)$"
EDITION_FILE = r"^data/([^/]+)/([^/]+)/\1\.\2\.([^/]+)\.xml$"


def urn_path(urn: Column, repositories: dict[str, str]) -> Column:
    """(repository, file) of one edition's URN; null if it is none, or of an unknown namespace."""
    space, group, work, edition = (F.regexp_extract(F.trim(urn), URN, i) for i in range(1, 5))
    repository = F.try_element_at(F.create_map(*[F.lit(x) for pair in repositories.items() for x in pair]), space)
    file = F.concat(F.lit("data/"), group, F.lit("/"), work, F.lit("/"), group, F.lit("."), work, F.lit("."), edition, F.lit(".xml"))
    return F.when((edition != "") & repository.isNotNull(), F.struct(repository.alias("repository"), file.alias("file")))


def editions(tree: DataFrame, namespace: str, lang: str) -> DataFrame:
    """urn, group, work of the editions in a language among a tree's paths (path)."""
    group, work, edition = (F.regexp_extract("path", EDITION_FILE, i) for i in range(1, 4))
    rows = tree.select(group.alias("group"), work.alias("work"), edition.alias("edition")).where(F.col("edition").rlike(rf"-{lang}\d*$"))
    return rows.select(F.concat(F.lit(f"urn:cts:{namespace}:"), "group", F.lit("."), "work", F.lit("."), "edition").alias("urn"), "group", "work")


def cts_field(xml: Column, tag: str) -> Column:
    """Text of a catalogue's field on one line; null if there is none."""
    inner = F.regexp_extract(xml, rf"(?is)<ti:{tag}(?:\s[^>]*)?>(.*?)</ti:{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def listed(html: Column, path: str = "/book/show/") -> Column:
    """Entries (id, author, title) of a list page whose anchors read 'author: title'; brackets around an author go."""
    anchors = F.regexp_extract_all(html, F.lit(rf'(?is)<a href="[^"]*{path}[^"]+"[^>]*>.*?</a>'), 0)

    def entry(a: Column) -> Column:
        label = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(a, "<[^>]*>", " ")), r"\s+", " "))
        author = F.regexp_replace(F.trim(F.substring_index(label, ":", 1)), r"^\[(.*)\]$", "$1")
        title = F.trim(F.substring(label, F.length(F.substring_index(label, ":", 1)) + 2, F.length(label)))
        return F.struct(F.regexp_extract(a, rf'(?i)href="[^"]*{path}([^"]+)"', 1).alias("id"), author.alias("author"), title.alias("title"), F.contains(label, F.lit(":")).alias("named"))

    return F.transform(F.filter(F.transform(anchors, entry), lambda e: e["named"]), lambda e: e.dropFields("named"))


def sub_pages(html: Column, title: Column, path: str = "/wiki/") -> Column:
    """Titles of the pages below one, in the order of their first links."""
    links = F.transform(F.regexp_extract_all(html, F.lit(rf'href="{path}([^"#]+)"'), 1), lambda x: F.coalesce(F.try_url_decode(x), x))
    own = F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit("/"))
    return F.array_distinct(F.transform(F.filter(links, lambda x: F.startswith(x, own)), lambda x: F.replace(x, F.lit("_"), F.lit(" "))))


def best_quality(categories: Column) -> Column:
    """The highest of the categories that are percentages; null if none is."""
    numbers = F.transform(categories, lambda c: F.nullif(F.regexp_extract(c, "^([0-9]{2,3})%$", 1), F.lit("")).cast("int"))
    return F.array_max(numbers)


def wiki_pages(raw: DataFrame) -> DataFrame:
    """title, html, quality of landed answers (json) of a wiki's parse call; answers that are broken or errors drop out."""
    schema = "parse struct<title: string, text: struct<`*`: string>, categories: array<struct<`*`: string>>>"
    rows = raw.select(F.from_json("json", schema).alias("x")).where("x.parse.title is not null")
    return rows.select("x.parse.title", F.col("x.parse.text.`*`").alias("html"), best_quality(F.transform("x.parse.categories", lambda c: c["*"])).alias("quality"))


#: Attributes of a page's facts, and how far behind one its name may stand; classes of an article's paragraphs
#: that are none of its text, and of the one that says where it is from.
FACT, NAMED, FAR = 'itemprop="{}"', 'itemprop="name"', 400
ASIDE, ORIGIN = ("title", "information", "footer", "skip", "updat"), "information"


def one_line(html: Column) -> Column:
    """Text of a piece of a page, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def item_property(html: Column, name: str) -> Column:
    """The name that a page's fact has; null if there is none."""
    behind = F.substring(html, F.nullif(F.instr(html, FACT.format(name)), F.lit(0)) + len(FACT.format(name)), FAR + len(NAMED) + 400)
    at = F.instr(behind, NAMED)
    value = F.regexp_extract(F.substring(behind, at + len(NAMED), FAR), "(?s)^[^>]*>(.*?)</span>", 1)
    return F.when(at.between(1, FAR + 1), F.nullif(one_line(value), F.lit("")))


def wiki_text(html: Column) -> Column:
    """Text of a wiki page without blocks that aren't exported, page numbers and edit links."""
    body = without_blocks("div", "ws-noexport")(html)
    for cls in ("pagenum", "mw-editsection"):
        body = F.regexp_replace(body, rf'(?is)<span[^>]*class="[^"]*\b{cls}\b[^"]*"[^>]*>.*?</span>', "")
    return html_to_text(body)


def article(html: Column, licensed: str) -> dict[str, Column]:
    """title, provenance, licensed, text of a page that holds one article.

    The page's paragraphs and headings are elements of an array; the first heading is the title, the first paragraph of the
    class for it the provenance. Headings, and paragraphs of classes that stand aside, aren't text.
    """
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-4]|p|title)\b[^>]*>.*?</(?:h[1-4]|p|title)>"), 0)
    heading = lambda e: e.rlike("(?i)^<h[1-4]")
    of_class = lambda e, names: F.regexp_extract(e, '(?i)^<p class="([^"]*)"', 1).isin(*names)
    first = lambda kind: F.coalesce(one_line(F.get(F.filter(found, kind), F.lit(0))), F.lit(""))
    title = F.coalesce(F.nullif(first(heading), F.lit("")), first(lambda e: e.rlike("(?i)^<title>")))
    provenance = first(lambda e: of_class(e, [ORIGIN]))
    body = F.when(F.instr(F.lower(html), "</head>") > 0, F.substring(html, F.instr(F.lower(html), "</head>") + len("</head>"), F.length(html))).otherwise(html)
    aside = F.filter(found, lambda e: heading(e) | of_class(e, ASIDE))
    return {"title": title, "provenance": provenance, "licensed": provenance.rlike(licensed), "text": html_to_text(F.aggregate(aside, body, lambda text, e: F.replace(text, e, F.lit(""))))}


def landed_texts(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """id, text, kind of each work: its landed text (id, text), or else what its landed page (id, html) says."""
    both = texts.select("id", F.col("text").alias("_text")).join(pages.select("id", "html"), "id", "full")
    kind = F.when(F.col("_text").isNotNull(), "text").otherwise("page")
    return both.select("id", F.coalesce("_text", html_to_text(F.col("html"))).alias("text"), kind.alias("kind"))


def edition_fault(title: Column, author: Column, wanted_title: Column, wanted_author: Column) -> Column:
    """Why a landed edition isn't the one that was wanted; empty if it is. Names are compared folded."""
    from quillspark.functions.text import fold

    return F.when(~F.contains(F.lower(title), F.lower(wanted_title)), "title").when(~F.contains(fold(author), fold(wanted_author)), "author").otherwise("")


#: The least size of a text in characters, words, chunks and parts by kind of source.
FLOORS = {"characters": 12_000, "archive characters": 10_000, "chunks": 10, "words": 2_500, "parts": 12, "short text": 200, "page text": 5_000}


def too_small(sizes: dict[str, Column]) -> Column:
    """The first floor that a work doesn't reach, empty if it reaches all; sizes: those that are known, by FLOORS' names."""
    found = F.lit("")
    for name in reversed(FLOORS):
        if name in sizes:
            found = F.when(sizes[name] < FLOORS[name], name).otherwise(found)
    return found


def admitted(works: DataFrame, denied_titles: str, allowed: DataFrame, denied: DataFrame) -> DataFrame:
    """works (id, title, ...) that a title doesn't rule out, or that the allow list names all the same; what the deny list
    names is out whatever else. The lists (id) are joined, not collected."""
    named = works.join(allowed.select("id").distinct().withColumn("_allowed", F.lit(True)), "id", "left").join(denied.select("id").distinct(), "id", "left_anti")
    return named.where(F.col("_allowed").isNotNull() | ~F.coalesce(F.col("title"), F.lit("")).rlike(denied_titles)).drop("_allowed")


def from_parts(works: DataFrame, pages: DataFrame, licensed: str) -> DataFrame:
    """id, text, skipped of works (id, parts: an array of names) put together from the articles of their pages (part, html).

    Parts stand in their order, each under its title in capitals. A part without a licence is skipped and counted, as is one
    that hasn't landed; a short one is left out. A work without any part has a null text.
    """
    told = article(F.col("html"), licensed)
    read_ = pages.select("part", told["title"].alias("title"), told["licensed"].alias("licensed"), told["text"].alias("text"))
    rows = works.select("id", F.posexplode_outer("parts").alias("n", "part")).join(read_, "part", "left")
    kept = F.col("licensed") & (F.length("text") >= FLOORS["short text"])
    section = F.struct("n", F.concat(F.upper("title"), F.lit("\n\n"), F.col("text")).alias("s"))
    by = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(kept, section))).alias("x"), F.count_if(F.col("part").isNotNull() & ~F.coalesce("licensed", F.lit(False))).alias("skipped"))
    return by.select("id", F.nullif(F.array_join(F.transform("x", lambda s: s["s"]), "\n\n"), F.lit("")).alias("text"), "skipped")
