import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moderata.llm import pieces
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


def test_round_trip_of_any_text(vocab):
    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.integers(-5, 5))
    def check(text, key):
        assert pieces.decode_ids(vocab, pieces.encode_texts(pieces.Arena(vocab), [key], [text])[0]) == text
    check()


def test_samples_follow_the_lattice():
    toy = [(b"", -1.0)] + [(p, float(k)) for k, p in enumerate([b"a", b"b", b"ab", b"ba", b"aba"])]
    vocab = pieces.Vocabulary(toy, [0] * 256)
    weight = {p: (r + pieces.ZIPF_SHIFT) ** -pieces.ALPHA for p, r in toy[1:]}
    text, ways = "ababa", Counter()
    for cuts in itertools.product([0, 1], repeat=4):
        parts, last = [], 0
        for k, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(text[last:k].encode())
                last = k
        if all(p in weight for p in parts):
            ways[tuple(parts)] = float(np.prod([weight[p] for p in parts]))
    n = 20_000
    seen = Counter(tuple(vocab.raw[i] for i in x)
                   for x in pieces.encode_texts(pieces.Arena(vocab), list(range(n)), [text] * n))
    assert set(seen) <= set(ways)
    for way, w in ways.items():
        share = w / sum(ways.values())
        assert abs(seen[way] / n - share) < 4 * (share / n) ** 0.5 + 1e-3


def test_same_ids_whatever_the_batch(vocab):
    texts = [prose(k, 40) for k in range(40)] + ["", None, "▁ 日", prose(0, 400_000)]
    whole = pieces.encode_texts(pieces.Arena(vocab), list(range(len(texts))), texts)
    arena = pieces.Arena(vocab, limit=500)
    for k in reversed(range(len(texts))):
        one = pieces.encode_texts(arena, [k], [texts[k]])[0]
        assert (one is None and whole[k] is None) or one.tolist() == whole[k].tolist()
    assert pieces.decode_ids(vocab, whole[-1]) == texts[-1]


def test_odd_rows_and_columns(odd_docs, no_docs):
    rows = pieces.round_trip(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(x.lossless for x in rows)
    assert [x.ids for x in rows if x.doc_id == 3] == [None] and [x.ids for x in rows if x.doc_id == 4] == [[]]
    a, b = [x.ids for x in rows if x.doc_id == 2]
    assert a == b
    vocab = pieces.load()
    back = pieces.encoded(odd_docs, vocab).select("text", pieces.decoder(vocab)("ids").alias("again")).collect()
    assert all(x.text == x.again for x in back)
    assert pieces.round_trip(no_docs).count() == 0


def test_memory_of_a_long_text_is_bounded():
    """The lattice of a part of the text is held at a time, whatever the length of the text."""
    import random
    import tracemalloc

    r = random.Random(6)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(160_000))
    arena = pieces.Arena(pieces.load())
    tracemalloc.start()
    try:
        ids = pieces.encode_texts(arena, [7], [text])[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pieces.decode_ids(arena.vocab, ids) == text and len(text) > 1_000_000
    assert peak < 150e6, peak
