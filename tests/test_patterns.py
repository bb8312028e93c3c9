import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.functions import patterns as p
from lexigrid.plans.query import CorpusQuery, Slot, clamp_distances


def like(pattern, text):
    """LIKE by recursion, apart from the code under test."""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if not text:
        return False
    if pattern[0] == "\\":
        return pattern[1] == text[0] and like(pattern[2:], text[1:])
    return (pattern[0] == "_" or pattern[0] == text[0]) and like(pattern[1:], text[1:])


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?%_\\—", max_size=7), st.text("ab%_\\—", max_size=7))
def test_glob_is_like(glob, text):
    assert like(p.glob_to_like(glob), text) == p.glob_matches(glob, text)


def test_glob_edges():
    assert p.glob_to_like("a**") == "a%"
    assert p.glob_matches("a**", "a") and p.glob_matches("?", "😀") and not p.glob_matches("?", "")


def test_tags():
    assert p.tags_to_like("<sg>,<n>") == "%<n>%<sg>%"
    assert p.tags_to_like(",,") is None
    assert not like(p.tags_to_like("<adj>,<cop>"), "+и<cop>,<adj>") and like(p.tags_to_like("<cop>"), "+и<cop>,<adj>")


def test_regular_expressions():
    assert p.anchored("a|b") == "^a|b$" and p.anchored("^a$") == "^a$" and p.anchored(r"a\$") == r"^a\$"
    assert p.to_java("[[:alpha:]]+") == r"(?U)[\p{IsAlphabetic}]+" and p.to_java("a", True) == "(?iuU)a"
    for bad in ("(", "a)", "[a", "*a", "a\\", "[[:nothing:]]"):
        with pytest.raises(ValueError):
            p.to_java(bad)


def test_distances():
    assert clamp_distances(5, 2) == (2, 5) and clamp_distances(0, 0) == (1, 1) and clamp_distances(-1, 3) == (3, 1000) and clamp_distances(1, 5000) == (1, 1000)


def test_request():
    q = CorpusQuery.from_json(json.dumps({"word": ["", "b"], "dist_from": [3], "dist_to": [2], "return": 0, "last_pos": "12x7", "odd": 1}))
    assert len(q.slots) == 2 and q.slots[0].empty and q.distances == ((2, 3),) and q.returned == 100 and q.cursor == 12 and q.unknown == ("odd",)
    assert q.prefix == ()
    assert CorpusQuery.from_json('{"extend":5,"extend_range":10}').extend_range == 2
    assert CorpusQuery.from_json('{"word":["a"],"last_pos":"0"}').cursor == -1
    for bad in ("{}", "[]", '{"word":["a","b","c","d","e","f","g"]}', '{"tags":[",,"]}'):
        with pytest.raises(ValueError):
            CorpusQuery.from_json(bad)
    with pytest.raises(ValueError):
        CorpusQuery.of(Slot(word="a"), boundary="loose")


def test_prefix_stops_at_a_gap():
    q = CorpusQuery.of(Slot(word="a"), Slot(), Slot(word="b"))
    assert len(q.slots) == 3 and len(q.prefix) == 1
