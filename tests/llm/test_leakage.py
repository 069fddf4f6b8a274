import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import leakage as F


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 5))
def test_index_finds_every_occurrence(seq, k):
    seq = np.array(seq)
    index = F.FMIndex(seq, 6)
    text = np.append(seq, 0).tolist()
    assert F.suffix_array(np.append(seq, 0)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    phrases = np.array([[1 + (i * 7 + j * j) % 4 for j in range(k)] for i in range(12)] + [seq[i : i + k].tolist() for i in range(len(seq) - k + 1)])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases.tolist(), lo, hi):
        want = [i for i in range(len(seq) - k + 1) if seq[i : i + k].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(F, "SHARD_SYMBOLS", 200)
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    item = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(1, item(30)), (2, item(12)), (3, item(11)), (5, item(20))]
    items = [(i, " ".join(w)) for i, w in items] + [(4, None), (6, ""), (7, "")]
    items.append((8, items[0][1].upper()))
    docs = []
    for d in range(60):
        parts = [r.choice(["zz", "w1", "W2", "other"]) for _ in range(r.randrange(5, 40))]
        if d % 4 == 0:
            w = items[r.randrange(4)][1].split()
            n = r.randrange(9, 16)
            at = r.randrange(max(1, len(w) - n))
            parts[2:2] = w[at : at + n]
        docs.append((d, ", ".join(parts) + "."))
    docs += [(100, None), (101, ""), (102, "word " * 100_000 + items[1][1]), (103, "-".join(items[0][1].split()))]

    def shingles(t):
        w = F.words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs for i, q in items if shingles(t) & shingles(q)}
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in F.leaked_documents(left, right).collect()} == want and want
    spans = F.leaks(left, right).where("doc_id = 103 AND item_id = 1").collect()
    assert [(s.word_from, s.word_to) for s in spans] == [(0, 30)]
    monkeypatch.setattr(F, "ITEMS_AT_ONCE", 2)
    assert {tuple(x) for x in F.leaked_documents(left, right).collect()} == want
    assert F.leaked_documents(left, right.limit(0)).count() == 0 and F.leaked_documents(left.limit(0), right).count() == 0
