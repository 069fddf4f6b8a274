import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_every_item_is_packed_once(counts):
    h = np.zeros(65, np.int64)
    for n, c in counts.items():
        h[n] = c
    used = np.zeros(65, np.int64)
    for lengths, times in P.pack_histogram(h, 64):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == h).all()


def test_fit_is_tight():
    r = np.random.default_rng(0)
    h = np.bincount(np.clip(r.exponential(300, 20_000).astype(int) + 1, 1, 1024), minlength=1025)
    patterns = P.pack_histogram(h)
    n = sum(t for _, t in patterns)
    assert (h * np.arange(1025)).sum() / (n * 1024) > 0.995


def test_least_squares_reproduces_an_exact_histogram():
    combos = P.combinations(np.arange(1, 17), 16)
    h = np.zeros(17, np.int64)
    h[8], h[4] = 20, 40
    x = P.repeat_counts(combos, h)
    made = sum(x[i] * np.bincount(c, minlength=17) for i, c in enumerate(combos))
    assert abs(made[8] - 20) < 3 and (made[[1, 2, 3, 5, 6, 7]] < 1).all()


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer files")
def test_containers(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "word " * 3000), (5, "word " * 1024), *[(10 + i, "a b c " * 50) for i in range(100)], (500, "<|endoftext|>")]
    out = P.containers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tok = P.tokenizer(P.TOKENIZER)
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= 1024 and r.token_from == 1024 * r.piece_no
    assert total == {d: len(tok.encode_ordinary(t or "")) for d, t in rows}
    filled = {}
    for r in out:
        if r.container_id is None:
            assert r.doc_id in (1, 2)
        else:
            filled.setdefault(r.container_id, []).append(r)
    assert all(sum(r.n_tokens for r in c) == c[0].container_tokens <= 1024 for c in filled.values())
    assert all(len([r for r in out if r.doc_id == d]) == 1 for d in range(10, 110))
    one = P.fill(P.containers(spark.createDataFrame(rows, "doc_id long, text string"))).first()
    assert one.n_containers == len(filled) and sorted(filled) == list(range(len(filled)))
    assert P.fill(P.containers(spark.createDataFrame(rows[:2], "doc_id long, text string"))).first().fill is None
