"""What a request brings, checked and brought into a normal form on the driver: questions, selections, plans, settings."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Characters of a question at most, characters around a passage as asked by default and at most.
QUESTION, RADIUS, MOST_RADIUS = 1_000, 3_000, 40_000
#: Parts of a plan at most.
HYPOTHESES, KEYWORDS, MENTIONS = 9, 96, 12


class Invalid(ValueError):
    """A request that can't be served, with what is wrong with it."""


def question(text: object) -> str:
    if not isinstance(text, str) or not text.strip():
        raise Invalid("a question is needed")
    if len(text) > QUESTION:
        raise Invalid(f"a question has {QUESTION} characters at most")
    return text.strip()


def positive_id(value: object) -> int:
    if not re.fullmatch(r"[1-9][0-9]{0,17}", str(value).strip()):
        raise Invalid("an id is a positive whole number")
    return int(str(value))


def radius(value: object) -> int:
    """Characters to show around a passage: the default where the value is no number, never less than 0 or more than the most."""
    try:
        n = float(str(value))
    except ValueError:
        return RADIUS
    return min(MOST_RADIUS, max(0, int(n))) if math.isfinite(n) else RADIUS


def number(name: str, fallback: float, environ: dict[str, str] | None = None) -> float:
    """A number from the environment; empty, missing and broken values are the fallback, 0 is 0."""
    value = (os.environ if environ is None else environ).get(name, "").strip()
    try:
        return float(value) if value and math.isfinite(float(value)) else fallback
    except ValueError:
        return fallback


def selection(chosen: Iterable[object] | None, known: tuple[str, ...]) -> tuple[str, ...]:
    """The known values among those chosen, each once, in the order of `known`. All of them, or none, is no restriction: ()."""
    asked = set(map(str, chosen or ()))
    kept = tuple(k for k in known if k in asked)
    return () if len(kept) == len(known) else kept


def selection_key(axes: dict[str, tuple[str, ...]]) -> str:
    """Normal form of a filter as a cache key: axes by name, their values in a fixed order; no restriction is empty."""
    return json.dumps({a: sorted(v) for a, v in sorted(axes.items()) if v}, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Plan:
    """hypotheses: phrasings by language. keywords and mentions: of the keyword and the mention branch."""

    question: str
    hypotheses: list[tuple[str, str]] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    mentions: list[str] = field(default_factory=list)


def offline_plan(text: str, lang: str = "en") -> Plan:
    """A plan without a model: the question itself, its words of four letters on as keywords, capitalised ones as mentions."""
    words = re.findall(r"[^\W_]+", text)
    return Plan(text, [(lang, text)], list(dict.fromkeys(w.lower() for w in words if len(w) >= 4))[:KEYWORDS], list(dict.fromkeys(w for w in words if len(w) >= 4 and w[0].isupper()))[:MENTIONS])


def _strings(value: object, most: int) -> list[str]:
    found = [v.strip() for v in value if isinstance(v, str) and v.strip()] if isinstance(value, list) else []
    return list(dict.fromkeys(found))[:most]


def _object(answer: str) -> dict:
    """The first JSON object in a model's answer, which may have prose or a fence around it."""
    start, end = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[start : end + 1])
    except ValueError:
        raise Invalid("the answer holds no object") from None
    if not isinstance(found, dict):
        raise Invalid("the answer holds no object")
    return found


def parse_plan(answer: str, text: str, lang: str = "en") -> Plan:
    """The plan in a model's answer. What is missing or of a wrong kind has a default; an answer without any phrasing of the
    question can't be used."""
    found = _object(answer)
    said = found.get("hypotheses")
    pairs = [(str(h.get("lang") or lang), h["text"].strip()) for h in said if isinstance(h, dict) and isinstance(h.get("text"), str) and h["text"].strip()] if isinstance(said, list) else []
    if not pairs:
        raise Invalid("the plan has no phrasing of the question")
    return Plan(text, list(dict.fromkeys(pairs))[:HYPOTHESES], _strings(found.get("keywords"), KEYWORDS), _strings(found.get("mentions"), MENTIONS))


def parse_choice(answer: str, candidates: int) -> list[tuple[int, str]]:
    """(candidate number from 1, reason) of the choice in a model's answer, in its order. Numbers of no candidate, repeated
    ones and choices without a reason are left out."""
    said = _object(answer).get("choices")
    found: dict[int, str] = {}
    for c in said if isinstance(said, list) else []:
        n, why = (c.get("n"), c.get("reason")) if isinstance(c, dict) else (None, None)
        if isinstance(n, int) and not isinstance(n, bool) and 1 <= n <= candidates and n not in found and isinstance(why, str) and why.strip():
            found[n] = why.strip()
    return list(found.items())


def progress(steps: Iterable[tuple[str, object]]) -> Iterable[tuple[str, object]]:
    """Events of a search in order: each step's, then one 'done', or one 'failed' with what went wrong; nothing after it."""
    try:
        yield from steps
    except Exception as e:
        yield "failed", f"{type(e).__name__}: {e}"
        return
    yield "done", None
