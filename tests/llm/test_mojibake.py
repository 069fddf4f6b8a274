from textloom.llm import mojibake as M

SOUND = [
    "La fenêtre révèle le thème et l'été dernier, le musée protège la tâche à côté du port.", "Die Straße am Fluß führt über die Brücke, der Übersetzer kürzt jede Zeile gemäß der Größe.", "O órgão não altera a seção, já então põe as ações e a maçã do avô à direita.",
    "El niño guardó la última versión con atención después del otoño.", "Wędrowiec chroni różne słowa, żąda części i późną nocą łączy ślady.", "Тихий берег сжимает новые ссылки как обычно, читатель открывает чужие данные.",
    "Ο κατάλογος χωρίζει τη σειρά και το αρχείο βρίσκει τα κλειδιά χωρίς λάθη.", "図書館は夜明け前に順番を保存する。新しい頁は必要なら空の欄を分ける。",
]
SCHEMA = "doc_id long, text string, title string"


def run(spark, extra):
    rows = [(i, " ".join(SOUND[i % 8 : i % 8 + 1] * 6), SOUND[(i * 3) % 8][:30]) for i in range(2400)]
    out = M.garbled(spark.createDataFrame(rows + extra, SCHEMA)).collect()
    return {(r.doc_id, r.field): r for r in out}


def test_restores_whole_texts_and_stretches(spark):
    bad = {
        9000: (SOUND[0], SOUND[0].encode().decode("latin-1")), 9001: (SOUND[1], SOUND[1].encode().decode("cp1252")), 9002: (SOUND[3], SOUND[3].encode().decode("latin-1").encode().decode("latin-1")),
        9003: (SOUND[5], SOUND[5].encode("cp1251").decode("latin-1")), 9004: (SOUND[0] + " " + SOUND[3], SOUND[0] + " " + SOUND[3].encode().decode("latin-1")), 9005: (SOUND[2], SOUND[2].encode("cp1252").decode("cp850")),
    }
    got = run(spark, [(d, b, None) for d, (_, b) in bad.items()])
    assert {d for d, f in got if f == "text"} == set(bad)
    for d, (good, _) in bad.items():
        assert got[d, "text"].restored == good, d


def test_lost_bytes_and_titles(spark):
    got = run(spark, [(9001, "Ein m��der W��chter", None), (9002, None, SOUND[1].encode().decode("cp1252"))])
    assert set(got) == {(9001, "text"), (9002, "title")}
    assert got[9001, "text"].n_restored == 0 and got[9002, "title"].restored == SOUND[1]


def test_sound_texts(spark):
    quoted = [(1, "If you read “Ã©” where “é” was meant, the bytes were taken for another set.", "The sign “�” stands for an unreadable byte"), (2, None, None), (3, "", ""), (4, "O CORAÇÃO NÃO ALTERA OS CÃES", "LA FAÇADE ÉCOUTE LE THÈME »"), (5, "plain " * 50_000, "x")]
    assert run(spark, quoted) == {}


def test_empty_table_and_clashing_columns(spark):
    assert M.garbled(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "x", "y")], SCHEMA).selectExpr("*", "1 AS field", "2 AS slot", "3 AS n", "4 AS t")
    assert M.garbled_fields(df).count() == 0


def test_maximal_segments():
    assert M.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert M.maximal_segments([]) == [] and M.maximal_segments([-1, -2]) == []


def test_frequent_garbling_is_not_normal(spark):
    import random

    def outcome(every):
        r, rows = random.Random(3), {}
        for i in range(1200):
            words = SOUND[i % 5].split()
            r.shuffle(words)
            text, title = " ".join(words * 3), " ".join(words[:6])
            rows[i] = (text, title)
        bad = {i for i in rows if i % every == 0}
        wrong = lambda t: t.encode().decode("latin-1")
        df = spark.createDataFrame([(i, *map(wrong, x)) if i in bad else (i, *x) for i, x in rows.items()], SCHEMA)
        got = {(r.doc_id, r.field): r.restored for r in M.garbled(df).collect()}
        return got, {(i, f): x[k] for i, x in rows.items() for k, f in enumerate(("text", "title")) if i in bad and not x[k].isascii()}

    for every in (3, 1):
        got, true = outcome(every)
        assert set(got) == set(true), every
        assert sum(got[k] == v for k, v in true.items()) >= 0.95 * len(true)
