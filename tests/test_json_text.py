"""Damaged JSON of known value, and texts that are none."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions import json_text

TEXTS = st.text("ab'\" ,:[]{}\\\n\té日", max_size=8)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(-1e6, 1e6) | TEXTS, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc_", min_size=1, max_size=4), x, max_size=4), max_leaves=12)
BOXES = st.lists(VALUES, min_size=1, max_size=4) | st.dictionaries(st.text("abc_", min_size=1, max_size=4), VALUES, min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(value=BOXES, before=st.sampled_from(["", "Answer: ", "```json\n"]), after=st.sampled_from(["", "\n```", " done."]))
def test_whole_json_in_a_text(value, before, after):
    assert json.loads(json_text.repaired(before + json.dumps(value) + after)) == value


def damaged(value, rng):
    """JSON with bare keys, Python's names, commas too many, and blanks."""
    gap = lambda: rng.choice(["", " ", "\n"])
    if isinstance(value, dict):
        inside = [f"{gap()}{rng.choice([k, json.dumps(k), chr(39) + k + chr(39)])}{gap()}:{damaged(v, rng)}{gap()}" for k, v in value.items()]
        return "{" + rng.choice([",", ",,"]).join(inside) + rng.choice(["", ",", " ,\n"]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(gap() + damaged(v, rng) + gap() for v in value) + rng.choice(["", ",", ",,"]) + "]"
    return json.dumps(value) if rng.random() < 0.5 or isinstance(value, str | float | int) and not isinstance(value, bool) else repr(value)


@settings(max_examples=300, deadline=None)
@given(value=BOXES, seed=st.integers(0, 1000))
def test_damaged_json_keeps_its_value(value, seed):
    assert json.loads(json_text.repaired("x " + damaged(value, random.Random(seed)) + " y")) == value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{'it': 'it's ok', 'b': 'say \"x\"'}", {"it": "it's ok", "b": 'say "x"'}),
        ('{"a": [1, 2', {"a": [1, 2]}),
        ('{"a": "no end', {"a": "no end"}),
        ('{"a": {"b":', {"a": {"b": None}}),
        ("[not json] {'a': 1}", {"a": 1}),
        ('[{"a": 1} and more]', {"a": 1}),
        ('[1} [2]', [2]),
        ("{a: True, b: None, c-d: 1e3}", {"a": True, "b": None, "c-d": 1000.0}),
        ('{"a": "\\x"}', {"a": "\\x"}),
        ("[" + "1" * 5000 + ",]", ["1" * 5000]),
        ("[,]", []),
        ("7", 7),
    ],
)
def test_described_damage(text, want):
    assert json.loads(json_text.repaired(text)) == want


@pytest.mark.parametrize("text", ["", "none", "see [", "{", "}{", "[x", "]" * 50, None, "{:}", "'"])
def test_no_json(text):
    assert json_text.repaired(text) is None


@settings(max_examples=300, deadline=None)
@given(st.text("[]{}\"'\\,: a1\n", max_size=40))
def test_any_text_ends(text):
    out = json_text.repaired(text)
    assert out is None or json.loads(out) is not None


@pytest.mark.parametrize("part", ["[", "[1,", '{"a":', "[x", "['", "[' ", "[1 ", '"[', "{a:1 ", "[\\'", "[]", "' ,["])
def test_time_is_linear(part):
    began = time.time()
    out = json_text.repaired(part * (300_000 // len(part)))
    assert out is None or out[0] in "[{"
    assert time.time() - began < 15
