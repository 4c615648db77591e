"""The structural index against a plain parser."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.functions.jsonindex import index, walk
from pairloom.operators.nested import PLACE_PATHS, flatten

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", 'q"', "é"]), x, max_size=3), max_leaves=10)


def plain_walk(value, path):
    """(positions, value) by recursion."""
    found = [((), value)]
    for step in path:
        nxt = []
        for taken, v in found:
            if step == "[]":
                items = v if isinstance(v, list) else [] if v is None else [v]
                nxt += [((*taken, i), x) for i, x in enumerate(items)]
            elif isinstance(v, dict) and step in v:
                nxt.append((taken, v[step]))
        found = nxt
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=4), st.booleans())
def test_walk_equals_recursion(docs, spaced):
    texts = [json.dumps(d, ensure_ascii=spaced, indent=1 if spaced else None) for d in docs]
    texts = [t for t in texts if not t.startswith('"')]
    docs = [json.loads(t) for t in texts]
    for path in (["[]"], ["a", "[]"], ["[]", "b", "[]"], ["a", "b"], ['q"', "[]", "é"]):
        values = index(texts)
        found, taken = walk(values, path)
        got = sorted((int(values.doc[v]), tuple(map(int, t)), values.text(v)) for v, t in zip(found, taken, strict=True) if values.kind[v] >= 6)
        want = sorted((i, t, x if isinstance(x, str) else None if x is None else json.dumps(x)) for i, d in enumerate(docs) for t, x in plain_walk(d, path) if not isinstance(x, (dict, list)))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [c for *_, c in got] == [c for *_, c in want]


def test_broken_texts_hold_nothing():
    good = '{"a": [1, 2]}'
    for bad in ('{"a": [1, 2', '{"a": [1, 2]', '{"a" [1]}', '{"a": 1,}', "[1 2]", '{"a": tru}', '["x]', "[}", "{]", "]", ",", "", None, '{"a": 01}', '"{\\"a\\": 1'):
        values = index([bad, good])
        assert set(values.doc.tolist()) == {1}, bad


def test_flatten_links_and_clean(spark):
    rows = [
        ("p", '[{"lineage":{"revisions":[null,{"rev":"r1"},{"rev":null}]}},{"lineage":{"revisions":{"rev":"r2"}}}]', None, None), ("p", '[{"lineage":{"revisions":[null,{"rev":"r1"},{"rev":null}]}},{"lineage":{"revisions":{"rev":"r2"}}}]', None, None),
        ("q", None, '{"rules":{"perspectives":{"countries":"DE"}}}', '{"alternate":["x",{"taxonomy":{"path":["food",null,"caf\\u00e9"]}}]}'), (None, '{"lineage":{"revisions":{"rev":"r"}}}', None, None), ("s", '[{"lineage":{"revisions":[{"rev":"r', "", "[]"),
        ("u", '{"line\\u0061ge":{"revisions":[{"rev":"z"}]}}', None, None),
    ]
    df = spark.createDataFrame(rows, "id string, sources string, names string, categories string").withColumnRenamed("id", "id")
    got = sorted(map(tuple, flatten(df, "id", PLACE_PATHS).collect()))
    assert got == [("p", "sources", 0, 1, "r1"), ("p", "sources", 1, 0, "r2"), ("q", "categories", 1, 0, "food"), ("q", "categories", 1, 2, "café"), ("q", "names", 0, 0, "DE"), ("u", "sources", 0, 0, "z")]
    assert flatten(df.limit(0), "id", PLACE_PATHS).count() == 0
