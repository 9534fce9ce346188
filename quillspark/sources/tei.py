"""Bodies of TEI documents as segments: paragraphs in order, each with the path of divisions it stands in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the work, that mark emphasis, and that end a paragraph.
DROPPED = frozenset("note bibl fw figure figDesc teiHeader ref del sic".split())
EMPHASIS = frozenset("hi emph foreign title".split())
BLOCKS = frozenset("p l lg sp ab quote list item salute signed closer opener trailer stage speaker argument".split())
_token = re.compile(r"<!--.*?-->|<\?.*?\?>|<(?P<close>/?)(?P<name>[\w:.-]+)(?P<attributes>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<alone>/?)>|(?P<text>[^<]+)|<", re.S)
_attribute = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_broken = re.compile(r"(\w)[-¬⸗]\s*\x00\s*([a-zß-ÿ])")


def tokens(xml: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): open, close, alone or text, in order. Comments and instructions are left out."""
    for m in _token.finditer(xml):
        if m["text"] is not None:
            yield "text", unescape(m["text"]), {}
        elif name := m["name"]:
            said = m["attributes"]
            found = {k.rpartition(":")[2]: a or b for k, a, b in _attribute.findall(said)} if said else {}
            yield "close" if m["close"] else "alone" if m["alone"] else "open", name.rpartition(":")[2], found


def label(unit: str, n: str) -> str:
    return f"{unit.replace('_', ' ').replace('-', ' ').upper()} {n.upper()}".strip()


def segments(xml: str) -> Iterator[tuple[str, str, str]]:
    """(path, head, text) of each paragraph of the body, in order.

    Divisions are counted among their siblings of one kind where they have no number; a milestone holds until the next of
    its unit or the end of its division. Emphasis becomes underscores, a word broken at a line's end is put together.
    """
    stack: list[dict] = []
    held: list[str] = []
    head: list[str] | None = None
    dropped, inside, marks = 0, "<body" not in xml, []

    def path() -> str:
        return ", ".join(x for d in stack for x in (d["label"], *d["milestones"].values()) if x)

    def paragraph() -> Iterator[tuple[str, str, str]]:
        raw = _broken.sub(r"\1\2", "".join(held))
        text = re.sub(r" *\x00 *", "\n", re.sub(r"[ \t\r\n]+", " ", raw)).strip()
        held.clear()
        if text.strip("_ \n"):
            yield path(), next((d["head"] for d in reversed(stack) if d["head"]), ""), text

    for kind, name, attributes in tokens(xml):
        if name == "body" and kind in ("open", "close"):
            inside = kind == "open"
            yield from paragraph()
        elif not inside:
            continue
        elif kind == "text":
            if not dropped:
                (held if head is None else head).append(name)
        elif name in DROPPED:
            dropped = max(0, dropped + {"open": 1, "close": -1}.get(kind, 0))
        elif dropped:
            continue
        elif re.fullmatch(r"div\d?", name):
            yield from paragraph()
            if kind == "close" and stack:
                stack.pop()
            elif kind == "open":
                unit = attributes.get("subtype") or attributes.get("type") or ""
                unit = "" if unit in ("edition", "translation", "textpart") else unit
                siblings = stack[-1]["siblings"] if stack else marks_of(marks)
                siblings[unit] += 1
                stack.append({"label": label(unit, attributes.get("n") or str(siblings[unit])) if unit else "", "head": "", "milestones": {}, "siblings": Counter()})
        elif name == "milestone" and stack:
            yield from paragraph()
            stack[-1]["milestones"][attributes.get("unit", "")] = label(attributes.get("unit", ""), attributes.get("n", ""))
        elif name == "head":
            if kind == "open":
                yield from paragraph()
                head = []
            elif kind == "close" and head is not None:
                if stack and not stack[-1]["head"]:
                    stack[-1]["head"] = re.sub(r"[\s\x00]+", " ", "".join(head)).strip()
                head = None
        elif name == "lb":
            (held if head is None else head).append("\x00")
        elif name in EMPHASIS and kind != "alone":
            (held if head is None else head).append("_")
        elif name in BLOCKS:
            yield from paragraph()
    yield from paragraph()


def marks_of(marks: list) -> Counter:
    """The siblings at the top, made when first asked for."""
    if not marks:
        marks.append(Counter())
    return marks[0]


def tei_segments(works: DataFrame) -> DataFrame:
    """work_id, i, path, head, text of the bodies of (work_id, xml); one document is read within its own row.

    Mixed content in its order is what no reader of rows gives, so this is a small parser over a document's tokens. A null
    document has no rows; broken tags are skipped.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(segments(xml)) for xml in batch.column("xml").to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            told = list(zip(*[(i, *s) for rows in found for i, s in enumerate(rows)])) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("work_id").take(at), *[pa.array(c, kind) for c, kind in zip(told, kinds)]], ["work_id", "i", "path", "head", "text"])

    return works.where("xml is not null").select(F.col("work_id").cast("long").alias("work_id"), "xml").mapInArrow(read, "work_id long, i long, path string, head string, text string")
