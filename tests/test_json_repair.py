import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import json_repair as J

CASES = [
    ('{"a": 1}', {"a": 1}),
    ('  {"a": {"b": "}"}}  ', {"a": {"b": "}"}}),
    ('```json\n{"a": "x"}\n```', {"a": "x"}),
    ('Here it is: {"a": 1} and a longer one {"b": "two \\" } {"} done.', {"b": 'two " } {'}),
    ('text { not json } {"a": 1}', {"a": 1}),
    ('an open { brace, then {"a": "b"}', {"a": "b"}),
    ("{'a': 'it''s', 'b': True}", {"a": "its", "b": True}),
    ("{'a': 'it's', 'b': [1, 2,], }", {"a": "it's", "b": [1, 2]}),
    ('{"a": "line\nbreak", "b": None,}', {"a": "line\nbreak", "b": None}),
    ("{„a“: „b“}", {"a": "b"}),
    ('{"a": "say "hi" now", "b": 2}', {"a": 'say "hi" now', "b": 2}),
    ('{"a": "cut off', None),
    ("[1, 2]", None),
    ("plain words", None),
    ("", None),
    (None, None),
    ("{}", {}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_shapes(text, want):
    assert J.parsed(text) == want


def test_column_gives_json_or_null(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["j"] for r in rows.select("i", J.robust_json(rows.t).alias("j")).collect()}
    assert [None if got[i] is None else json.loads(got[i]) for i in range(len(CASES))] == [w for _, w in CASES]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=8), x, max_size=4), max_leaves=12)


@given(st.dictionaries(st.text(max_size=8), values, max_size=5), st.text(alphabet="ab .\n", max_size=20), st.text(alphabet="ab .\n", max_size=20))
@settings(max_examples=200, deadline=None)
def test_an_object_among_words_is_found(value, before, after):
    said = json.dumps(value)
    assert J.parsed(before + said + after) == value


plain = st.text(alphabet="abč ,:", max_size=8)


@given(st.dictionaries(plain, st.none() | st.booleans() | st.integers() | plain | st.lists(plain, max_size=3), max_size=5), st.text(alphabet="ab .\n", max_size=20))
@settings(max_examples=200, deadline=None)
def test_what_python_writes_is_found(value, around):
    assert J.parsed(around + repr(value) + around) == value


@given(st.text(alphabet="{}[]\"'\\:, aTrueNone1\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_nothing_makes_it_fail(text):
    assert J.parsed(text) is None or isinstance(J.parsed(text), dict)
