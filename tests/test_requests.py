import pytest

from quillspark.plans import requests as Q


def test_validation():
    assert Q.question("  why? ") == "why?" and Q.positive_id("12") == 12
    for bad in (None, "", "  ", "x" * 1001, 5):
        with pytest.raises(Q.Invalid):
            Q.question(bad)
    for bad in ("0", "-1", "1.5", "x", None):
        with pytest.raises(Q.Invalid):
            Q.positive_id(bad)
    assert [Q.radius(x) for x in (None, "", "abc", "nan", "-5", "100", 1e9)] == [3000, 3000, 3000, 3000, 0, 100, 40000]
    assert [Q.number("N", 7, {"N": x}) for x in ("", " ", "x", "0", "2.5", "inf")] == [7, 7, 7, 0, 2.5, 7] and Q.number("N", 7, {}) == 7


def test_selection():
    known = ("drama", "letters", "verse")
    assert Q.selection(["verse", "drama", "verse", "none"], known) == ("drama", "verse")
    assert Q.selection(known, known) == Q.selection([], known) == Q.selection(None, known) == ()
    assert Q.selection_key({"era": (), "genre": ("verse", "drama")}) == Q.selection_key({"genre": ("drama", "verse")}) == '{"genre":["drama","verse"]}' and Q.selection_key({}) == "{}"


def test_plan():
    answer = 'Here: ```json\n{"hypotheses": [{"lang": "fr", "text": " le moi "}, {"text": "the self"}, {"text": ""}, 4], "keywords": ["self", "self", 3, " moi "], "mentions": "none"}\n``` done'
    plan = Q.parse_plan(answer, "What is the self?")
    assert plan.hypotheses == [("fr", "le moi"), ("en", "the self")] and plan.keywords == ["self", "moi"] and plan.mentions == []
    for bad in ("", "no object", "[1]", '{"hypotheses": []}', '{"keywords": ["a"]}', "{broken"):
        with pytest.raises(Q.Invalid):
            Q.parse_plan(bad, "x")
    own = Q.offline_plan("What did Seneca write of anger?")
    assert own.hypotheses == [("en", "What did Seneca write of anger?")] and "anger" in own.keywords and own.mentions == ["What", "Seneca"]


def test_choice():
    answer = '{"choices": [{"n": 3, "reason": "fits"}, {"n": 1, "reason": " "}, {"n": 3, "reason": "again"}, {"n": 9, "reason": "x"}, {"n": true, "reason": "x"}, {"n": 2, "reason": "also"}, 7]}'
    assert Q.parse_choice(answer, 4) == [(3, "fits"), (2, "also")] and Q.parse_choice("{}", 4) == []


def test_progress():
    def broken():
        yield "plan", 1
        raise ValueError("no")

    assert list(Q.progress([("plan", 1), ("found", 2)])) == [("plan", 1), ("found", 2), ("done", None)]
    assert list(Q.progress(broken())) == [("plan", 1), ("failed", "ValueError: no")]
