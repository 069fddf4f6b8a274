import itertools
import random

import pytest

from textloom.llm import shared_spans as S


def texts():
    r = random.Random(3)
    rand = lambda n: "".join(r.choice("abcdefghij klmno\n") for _ in range(n))
    span, other = rand(420), rand(305)
    rows = [(1, rand(500) + span + rand(100)), (2, span + rand(700)), (3, rand(200) + other), (4, other + rand(300)), (5, rand(900)), (6, span[:299]), (7, span[:300]), (8, None), (9, ""), (10, "x" * 1000), (11, "x" * 350), (12, rand(500) + "é日" * 200)]
    rows += [(13, rows[4][1]), (14, rows[4][1]), (15, "é日" * 151), (16, "short"), (17, "short")]
    return rows


def brute(rows):
    windows = {d: {t[i : i + 300] for i in range(len(t) - 299)} for d, t in rows if t and len(t) >= 300}
    return {(a, b) for a, b in itertools.combinations(sorted(windows), 2) if windows[a] & windows[b]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [1000, 1])
def test_pairs_and_shares(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = texts()
    got = {tuple(r) for r in S.sharing_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows) and (5, 13) in got and (10, 11) in got
    shares = {r.doc_id: r.shared_chars for r in S.shared_shares(frame(spark, rows)).collect()}
    want = {}
    all_windows = {d: [t[i : i + 300] for i in range(len(t) - 299)] for d, t in rows if t and len(t) >= 300}
    for d, ws in all_windows.items():
        others = {w for e, v in all_windows.items() if e != d for w in v}
        covered = set()
        for i, w in enumerate(ws):
            if w in others:
                covered |= set(range(i, i + 300))
        if covered:
            want[d] = len(covered)
    assert shares == want


def test_pieces_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 1000)
    r = random.Random(5)
    span = "".join(r.choice("abcdefgh") for _ in range(1500))
    rows = [(1, "".join(r.choice("abcdefgh") for _ in range(700)) + span), (2, span), (3, "".join(r.choice("abcdefgh") for _ in range(2500)))]
    assert {tuple(x) for x in S.sharing_pairs(frame(spark, rows)).collect()} == {(1, 2)}
    assert {x.doc_id: x.shared_chars for x in S.shared_shares(frame(spark, rows)).collect()} == {1: 1500, 2: 1500}


def test_empty(spark):
    assert S.sharing_pairs(frame(spark, [])).count() == 0
    assert S.shared_shares(frame(spark, [(1, None), (2, "x")])).count() == 0


def test_extra_columns(spark):
    df = frame(spark, texts()).selectExpr("*", "1 AS h", "2 AS start", "3 AS rep")
    assert {tuple(r) for r in S.sharing_pairs(df).collect()} == brute(texts())


def planted(n=400, seed=11):
    """Texts of which every fourth shares a span of 300 to 600 characters with an earlier one."""
    r = random.Random(seed)
    rand = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz .\n") for _ in range(k))
    rows = []
    for i in range(n):
        t = rand(r.randrange(200, 2500))
        if i % 4 == 3:
            other = r.choice(rows)[1]
            if len(other) > 320:
                at = r.randrange(0, len(other) - 310)
                t = t[: len(t) // 2] + other[at : at + r.randrange(300, 600)] + t[len(t) // 2 :]
        rows.append((i, t))
    return rows


def test_joins_turned_into_broadcasts_while_running(spark, monkeypatch):
    """Buckets stay whole when the session re-plans joins at run time."""
    monkeypatch.setattr(S, "HOT", 2)
    rows = planted()
    rows += [(len(rows) + i, "%d" % i * 50 + rows[0][1] + rows[1][1]) for i in range(3)]
    df = frame(spark, rows).repartition(8)
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "100m", "adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0", "adaptive.coalescePartitions.enabled": "false"}
    conf = {f"spark.sql.{k}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert {tuple(r) for r in S.sharing_pairs(df).collect()} == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_classes(spark):
    rows = texts()
    pairs, text = brute(rows), dict(rows)
    want = {}
    for d in {x for p in pairs for x in p}:
        partners = {a if b == d else b for a, b in pairs if d in (a, b)}
        want[d] = (min(x for x in partners | {d} if text[x] == text[d]), len({text[x] for x in partners} - {text[d]}))
    assert {r.doc_id: (r.class_id, r.links) for r in S.span_classes(frame(spark, rows)).collect()} == want
    assert S.span_classes(frame(spark, [])).count() == 0


def test_buckets_are_placed_by_their_own_exchange(spark, monkeypatch):
    seen = []
    place = S.placed
    monkeypatch.setattr(S, "placed", lambda df: seen.append(place(df)) or seen[-1])
    S.shared_runs(frame(spark, texts()))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan
