import random

from textloom.llm import main_body as B
from textloom.llm import residue as R

DOC = "doc_id long, url string, source string, title string, text string"
PARSED = "response_id long, title string, body_text string, links array<string>"
RESPONSE = "response_id long, url string, status_code int, body string, final_url string, content_type string"


def prose(seed):
    r = random.Random(seed)
    return "The " + " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 9))) for _ in range(14)) + "."




def tables(spark, extra=(), parsed=(), responses=()):
    docs = []
    for i in range(60):
        host = ("one", "two", "tre")[i % 3]
        body = prose(i)
        head = f"Home | News | Help\nBy Writer {'ABC'[i % 3]}mith, staff desk\nStory {chr(97 + i % 26)}{i}\n" if i % 2 else "Home | News | Help\n"
        tail = "\nShare this page with friends\nRead next: Another story of {0}\nAll rights reserved by {1} Press.".format(i, host)
        docs.append((i, f"http://{host}.test/{i}", None, f"Story {chr(97 + i % 26)}{i}", head + body + tail))
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return make([*docs, *extra], DOC), make(parsed, PARSED), make(responses, RESPONSE)


def test_furniture(spark):
    parsed = [(1, "T", "Home | News | Help\nMain words stand here, and they end.\nShare this page with friends", None)] * 2 + [(2, None, None, None)]
    t = tables(spark, [(900, None, None, None, None), (901, "http://one.test/x", None, "x", "\n\n"), (902, "http://new.test/x", None, None, "Plain words of a new host, at some length.\nShare this page with friends")], parsed, [(1, "http://one.test/p", 200, None, None, "text/html")] * 2)
    got = {tuple(r) for r in B.furniture_lines(*t).collect()}
    docs = {r.doc_id: r.text for r in t[0].collect()}
    for i in range(60):
        lines = docs[i].split("\n")
        keep = {k for k, x in enumerate(lines) if x.startswith(("The ", "Story"))}
        assert {n for o, d, n in got if o == "documents" and d == i} == set(range(len(lines))) - keep
    assert {n for o, d, n in got if o == "parsed_documents" and d == 1} == {0, 2}
    assert {n for o, d, n in got if o == "documents" and d >= 900} == {1}
    bodies = {(r.origin, r.record_id): r.body for r in B.main_bodies(*t).collect()}
    assert bodies["parsed_documents", 1] == "Main words stand here, and they end." and bodies["documents", 901] is None


def test_empty_tables(spark):
    t = tables(spark)
    assert B.furniture_lines(t[0].limit(0), t[1], t[2]).count() == 0
    assert R.residue_documents(t[0].limit(0), t[1], t[2]).count() == 0


def test_residue(spark):
    page = lambda d, text, title="t": (d, f"http://one.test/{d}", None, title, "Home | News | Help\n" + text + "\nAll rights reserved by one Press.")
    long = prose(7000)
    cases = [
        page(200, "Not Found. The page /a/b-1 has moved or never existed."), page(201, "502 Bad Gateway. Upstream node ab12 closed the connection."), page(202, "Please enable JavaScript to view this page."),
        page(203, "Lorem ipsum dolor amet sint. Fugiat animo magnum venit lorem."), page(204, long + " Dear {{ first_name }}, hello."), page(205, "Hello undefined, you have NaN new messages."), page(206, long, "undefined"), page(207, long, "Read ${BODY_TEXT} online"),
    ]
    sound = [
        page(300, long + " In the engine the marker {{ sandbox }} is replaced at render time."), page(301, long + " A handler that answers 404 for a missing page should log it.", "Why a page answers 404"), page(302, long, "Reading without JavaScript: a guide"),
        page(303, long, "Filling {{ slots }} in the widget: a guide"), (304, "http://one.test/q", None, "Error", None), (305, "http://one.test/q", None, None, ""), page(306, long, "Notes [A] and {b}"),
    ]
    got = {r.doc_id for r in R.residue_documents(*tables(spark, [*cases, *sound])).collect()}
    assert got == {c[0] for c in cases}
    kept = {r.doc_id for r in R.without_residue(*tables(spark, [*cases, *sound])).collect()}
    assert kept & {c[0] for c in cases} == set() and {s[0] for s in sound} <= kept


def test_labels_spread_through_components(spark):
    base = "this listing was taken down by its owner on request of the office and will not come back soon friends of the house"
    words = base.split()
    texts = {1: base, 2: " ".join([*words, "today"]), 3: " ".join([*words, "today", "again"]), 4: "entirely different words stand in this other sentence of the corpus"}
    keys = list(texts)
    sims = R.simhashes([texts[k] for k in keys]).tolist()
    sims[1], sims[2] = sims[0] ^ 1, sims[0] ^ 1 ^ (1 << 20)
    units = spark.createDataFrame([(k, s, k == 1) for k, s in zip(keys, sims)], "key long, simhash long, trusted boolean")
    masked = spark.createDataFrame(list(texts.items()), "key long, masked string")
    assert {r.key for r in R.spread_labels(units, masked).collect()} == {1, 2, 3}


def test_simhash_of_equal_and_near_texts():
    a, b, c = R.simhashes(["one two three four five six seven eight", "one two three four five six seven eight", "nine ten"]).tolist()
    assert a == b != c
    many = [f"w{i} x{i % 7} y" for i in range(9000)]
    assert R.simhashes(many).tolist() == [R.simhashes([t]).tolist()[0] for t in many[:50]] + R.simhashes(many[50:]).tolist()


def test_labels_spread_to_every_near_duplicate(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(6))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    texts, near = {}, set()
    for n in (13, 20, 30, 50, 80):
        for _ in range(60):
            a = [word() for _ in range(n)]
            b = list(a)
            b[r.choice((0, 1, 2, n - 1, n - 2, n // 2))] = word()
            key = len(texts)
            texts[key], texts[key + 1] = " ".join(a), " ".join(b)
            if jaccard(shingles(a), shingles(b)) >= 0.8:
                near.add(key + 1)
    keys = sorted(texts)
    sims = R.simhashes([texts[k] for k in keys]).tolist()
    trusted = {k - 1 for k in near}
    units = spark.createDataFrame([(k, s, k in trusted) for k, s in zip(keys, sims)], "key long, simhash long, trusted boolean")
    masked = spark.createDataFrame(list(texts.items()), "key long, masked string")
    assert len(near) >= 150
    assert {x.key for x in R.spread_labels(units, masked).collect()} == trusted | near


def test_long_notices_are_furniture(spark):
    notice = " ".join(["We and our partners store and read information on your device to measure how the pages are used"] * 3) + "."
    assert len(notice) > B.SHORT
    pages = [(900 + i, f"http://one.test/n{i}", None, f"T{i}", f"{prose(400 + i)}\n{notice}") for i in range(12)]
    got = {tuple(r) for r in B.furniture_lines(*tables(spark, pages)).collect()}
    assert {(d, n) for o, d, n in got if d >= 900} == {(900 + i, 1) for i in range(12)}


def notice(i, words=1):
    """A long notice with words of its own on every page."""
    r = random.Random(9000 + i)
    word = " ".join("".join(r.choice("nopqrstuvw") for _ in range(7)) for _ in range(words))
    return f"We and our {300 + i} partners store and read information on your device to measure how {word} uses the pages, choose what is shown beside them and keep {word} safe, unless you object in the settings of the publisher."


def test_long_notices_with_differing_words_are_furniture(spark, monkeypatch):
    pages = [(900 + i, f"http://one.test/n{i}", None, f"T{i}", f"{prose(400 + i)}\n{notice(i)}") for i in range(12)]
    pages += [(920 + i, f"http://two.test/n{i}", None, f"T{i}", f"{prose(420 + i)}\n{notice(20 + i)}") for i in range(12)]
    pages.append((940, "http://new.test/n", None, "T", f"{prose(440)}\n{notice(40)}"))  # as on the other hosts
    assert all(len(p[4].split("\n")[1]) > B.SHORT for p in pages)
    for group in (B.GROUP, 1000):  # a site in one group, then in several
        monkeypatch.setattr(B, "GROUP", group)
        got = {tuple(r) for r in B.furniture_lines(*tables(spark, pages)).collect()}
        assert {(d, n) for o, d, n in got if d >= 900} == {(p[0], 1) for p in pages}


def test_notices_around_the_limit_of_long_lines(spark):
    """One long line among shorter ones of its template."""
    short = "Our office may store what you read on this device to measure how {0} uses these pages and to keep them safe for all readers of the {1}"
    lines = [short.format(chr(110 + i) * 5, "letter" if i else "weekly letter, and of every other paper that our house has printed") for i in range(12)]
    assert len(lines[0]) > B.SHORT > max(map(len, lines[1:])) > B.WIDE
    rows = [("documents", i, 1, i, len(x) <= B.SHORT, B.normal(x)) for i, x in enumerate(lines)]
    table = spark.createDataFrame(rows, "origin string, record_id long, site long, key long, short boolean, line string")
    assert {r.key for r in B._template_coverage(table).where("covered >= 0.6").collect()} == set(range(12))


def test_phrases_of_articles_are_no_template(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(6))
    phrases = [[f"{word()} {word()} {word()}" for _ in range(12)] for _ in range(3)]
    pages = [(900 + i, f"http://one.test/n{i}", None, f"T{i}", " ".join(" ".join(r.choice(p) for p in phrases).capitalize() + "." for _ in range(5))) for i in range(40)]
    got = {tuple(r) for r in B.furniture_lines(*tables(spark, pages)).collect()}
    assert {d for o, d, n in got if d >= 900} == set()


def line_table(spark, rows):
    return spark.createDataFrame([("documents", d, s, k, True, x) for d, s, k, x in rows], "origin string, record_id long, site long, key long, short boolean, line string")


def test_even_counts_do_not_cancel(spark):
    rows = [(d, 1, d, f"{'alpha' if d < 4 else 'beta'} p{d}") for d in range(8) for _ in range(2)]
    assert B._template_coverage(line_table(spark, rows)).count() == 0
    sums = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (-(2**63),), (-5,)], "v long").agg(B._wrapping_sum("v").alias("s")).first().s
    assert (sums - (2 * (2**63 - 1) - 2**63 - 5)) % 2**64 == 0


def test_share_of_exact_pages(spark):
    rows = [(d, s, d if d >= 40 else -1 - s, f"u{s}x{d}" if d >= 40 else f"t{s}") for s in range(10) for d in range(1000)]
    got = {(r.site, r.key) for r in B._template_coverage(line_table(spark, rows)).collect()}
    assert got == {(s, -1 - s) for s in range(10)}
    assert B._template_coverage(line_table(spark, [*rows, *[(1000, s, 1000, f"u{s}x1000") for s in range(10)]])).count() == 0


def test_labels_pass_from_page_to_page(spark):
    """A message no pattern knows is found where hosts show it beside a known one, on its own pages too."""
    import re

    page = lambda d, host, text: (d, f"http://{host}.test/{d}", None, f"Story {d}", "Home | News | Help\n" + text + "\nAll rights reserved.")
    known, unknown, third = "Not found.", "Our gardeners moved this leaf elsewhere.", "Ask Mekel Wiki for the old map."
    hosts = ("one", "two", "tre", "fou")
    pages = [page(400 + i, h, f"{known} {unknown}") for i, h in enumerate(hosts)] + [page(410 + i, h, f"{unknown} {third.replace('Mekel', 'Kam' + h)}") for i, h in enumerate(hosts)]
    alone = [page(420, "fiv", unknown), page(421, "six", third.replace("Mekel", "Zor"))]
    article = " ".join(prose(50 + i) for i in range(6))
    sound = [page(430 + i, h, f"{article} {known}") for i, h in enumerate(hosts)] + [page(440, "one", f"{known} {prose(90)}"), page(441, "two", prose(91))]
    t = tables(spark, [*pages, *alone, *sound])
    got = {r.doc_id for r in R.residue_documents(*t, pattern=re.compile("^not found", re.I)).collect()}
    assert got == {r[0] for r in [*pages, *alone]}


def test_patterns_are_tried_wherever_they_can_match():
    import re

    units = ["Error 404 - gone", "403 Forbidden", "Sorry, page NOT FOUND here", "Loading...", "ray 12ab", "You lack TypeError 'x' today", "Text text text.", "Nothing of that kind", "İ not found", "access denied", "No existe o fue movida", "retry in two minutes"]
    text = "\n".join(units)
    got = R.Tries(R.TRUSTED).hits(text, [(text.index(u), u) for u in units])
    assert got == {i for i, u in enumerate(units) if R.TRUSTED.search(u)}
    for source in (r"a+b", r"(?:xyz|abcd)e?", r"x|long word", r"[ab]cd", r"(?:ab)?cdef", r"q\d+(?:tail|toes)"):
        pattern = re.compile(source, re.I)
        units = ["aab", "XYZ", "abcde", "a long word", "bcd", "cdef", "abcdef", "q12tail", "q1toes", "x", "none"]
        assert R.Tries(pattern).hits("\n".join(units), [("\n".join(units).index(u), u) for u in units]) == {i for i, u in enumerate(units) if pattern.search(u)}


def test_units_come_with_their_prefixes(spark, monkeypatch):
    """The texts are not read a second time for them."""
    texts = [f"{prose(i)} Not found. … -- !\n\n{prose(i)} {prose(i + 1)}" for i in range(40)]
    docs = spark.createDataFrame([(i, None, x) for i, x in enumerate(texts)], "doc_id long, title string, text string").toArrow()
    rows = [r for b in R.unit_reader(R.TRUSTED)(iter(docs.to_batches())) for r in b.to_pylist()]
    firsts = [r for r in rows if r["masked"] is not None]
    owner, v = R.prefixes([r["masked"] for r in firsts])
    assert [r["prefix"] for r in firsts] == [v[owner == i].tolist() for i in range(len(firsts))] and len(v) > len(firsts) / 2
    assert not any(r["prefix"] for r in rows if r["masked"] is None)

    def again(batches):
        raise AssertionError("texts read again")

    monkeypatch.setattr(R, "read_prefixes", again)
    units, labels = R.residue_units(spark.createDataFrame([(1, None, "Not found.")], "doc_id long, title string, text string"))
    assert labels.count() == 1


def test_words_are_masked_as_in_the_whole_text():
    r = random.Random(8)
    masks = R._Masks()
    for _ in range(3000):
        text = "".join(r.choice("aB1_/.- \t\x1c,;'Σßİ́日٣²…！") for _ in range(r.randrange(50)))
        whole = R._OTHER.sub(" ", R._CODE.sub("0", text.lower()))
        assert R.masked(text, masks) == " ".join(whole.split())


def test_roles_are_pairs_of_tokens():
    import re

    r = random.Random(9)
    lines = [B.normal("".join(r.choice("abAB1_/.- \t\x03\x1c,;'Σßİ́日٣²…！😀") for _ in range(r.randrange(12)))) for _ in range(3000)]
    roles, sizes = B.roles_of(lines)
    tokens = [[*re.findall(r"\w+|[^\w\s]", x), "\x03"] for x in lines]
    pairs = [p for t in tokens for p in zip(["\x03", *t], t)]
    assert sizes.tolist() == [len(t) for t in tokens]
    assert len(pairs) == len(roles) and len(set(pairs)) == len(set(roles.tolist())) == len(set(zip(pairs, roles.tolist())))
