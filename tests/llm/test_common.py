from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from evalsieve.llm.common import Spans, chunks, gaps

SPAN = st.tuples(st.integers(0, 30), st.integers(1, 9)).map(lambda x: (x[0], x[0] + x[1]))


@given(st.lists(SPAN), SPAN)
def test_touching_spans(spans, own):
    a, b = own
    assert Spans(spans).touch(a, b) == any(s < b and a < e for s, e in spans)


@given(st.lists(SPAN), st.integers(0, 50))
def test_gaps_are_what_no_span_covers(spans, length):
    inside = [(a, min(b, length)) for a, b in spans if a < length]
    left = {k for a, b in gaps(length, sorted(inside)) for k in range(a, b)}
    assert left == {k for k in range(length) if not any(a <= k < b for a, b in inside)}


@given(st.lists(st.text(max_size=9)), st.integers(1, 20))
def test_chunks_make_up_the_list(texts, most):
    found = list(chunks(texts, most))
    assert [t for a, b in found for t in texts[a:b]] == texts
    assert all(sum(map(bool, texts[a:b])) <= 1 or sum(map(len, texts[a:b])) <= most for a, b in found)
