"""Near-duplicates, repeated lines, encodings, bodies, residue and spam on small cases."""

import random
import re

import numpy as np
import pytest

from weftline.llm import body, encoding, neardup, pages, repeats, residue, spam

ROW = "ord bigint, main_text string, url string, ord_a string, words int"


def brute(rows, k, t, least):
    sets = []
    for i, x, *_ in rows:
        w = re.findall(r"\w+", (x or "").lower())
        if i is not None and len(w) >= max(least, k):
            sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if a != b and len(x & y) >= t * len(x | y)}


@pytest.mark.parametrize("t", [0.6, 0.8, 1.0])
def test_near_duplicates_equal_brute_force(spark, t):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["naïve", "日本", "a_b", "7"]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(20, 60))
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = rng.choice(words)
            if rng.random() < 0.2:
                x = x[10:] + x[:10]
            rows.append((len(rows), rng.choice([" ", "\n", ", "]).join(x), "u", "c", 1))
    rows += [(500 + i, "Exactly The same " * 3 + " ".join(words[:30]), "u", "c", 1) for i in range(12)]
    rows += [(600, None, None, None, None), (601, "", None, None, None), (602, "too few words", None, None, None), (None, rows[0][1], None, None, None), (603, "one " * 400, None, None, None), (604, "one " * 300, None, None, None)]
    near = neardup.NearDuplicates(spark.createDataFrame(rows, ROW), threshold=t)
    got = [(r.a, r.b) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, t, 25)
    groups = {r.id: r for r in near.groups().collect()}
    linked = {x for p in got for x in p}
    assert set(groups) == linked
    for a, b in got:
        assert groups[a].grp == groups[b].grp
    assert len({groups[500 + i].rep for i in range(12)}) == 1


def test_groups_need_no_pairs_of_a_group(spark, monkeypatch):
    """Variants of one page in a ring of edits: the comparisons grow with their number alone."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    compared = {}
    plain_verify = neardup.verify

    def counted(pairs, signed, t):
        compared[n] = compared.get(n, 0) + pairs.count()
        return plain_verify(pairs, signed, t)

    monkeypatch.setattr(neardup, "verify", counted)
    for n in (60, 240):
        rows = []
        for i in range(n):
            x = list(base)
            x[rng.randrange(120)], x[rng.randrange(120)] = f"a{i}", f"b{i}"
            rows.append((i, " ".join(x), "u", "c", 1))
        rows += [(10_000 + i, " ".join(rng.choices([f"v{k}" for k in range(900)], k=60)), "u", "c", 1) for i in range(20)]
        got = neardup.NearDuplicates(spark.createDataFrame(rows, ROW)).groups().collect()
        assert sorted(r.id for r in got) == list(range(n)) and {r.grp for r in got} == {0}
    assert compared[240] < 6 * compared[60], compared


def test_near_duplicates_of_nothing(spark):
    near = neardup.NearDuplicates(spark.createDataFrame([], ROW))
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i + 100, i + 101) for i in range(30)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.key: r.block for r in repeats.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_repeated_lines(spark):
    page = [(i, f"http://WWW.Site.example:80/p{i}" if i % 2 else None, f"https://site.example/p{i}") for i in range(10)]
    page += page[:3] + [(99, "http://other.example/", "x")]
    records = [(i, f"http://ignored/{i}", f"Legal  Notice {i}\n\nOwn text {chr(97 + i)}\nlegal notice 7\nShare me\n") for i in range(9)]
    records += [(9, "u", None), (99, "u", "Legal notice 1\nShare me"), (50, "http://site.example/no-page-row", "share\tme"), (51, None, "share me")]
    df = spark.createDataFrame(records, "ord bigint, url string, main_text string").selectExpr("*", "1 as line_no", "'k' as key")
    pg = spark.createDataFrame(page, "ord bigint, final_url string, url string").selectExpr("*", "'s' as site")
    got = {(r.ord, r.line_no) for r in repeats.found_lines(df, pg).collect()}
    assert got == {(i, n) for i in range(9) for n in (1, 4, 5)} | {(50, 1)}
    blocks = {r.block for r in repeats.found_lines(df, pg).where("ord = 0").collect()}
    assert len(blocks) == 1, "neighbouring lines are one block"
    clean = {r.ord: r.clean for r in repeats.remove_lines(df, pg).collect()}
    assert clean[0] == "\nOwn text a\n" and clean[9] is None and clean[99] == "Legal notice 1\nShare me" and clean[50] == ""
    assert repeats.found_lines(df.limit(0), pg).count() == 0
    hot = {(r.ord, r.line_no, r.block) for r in repeats.found_lines(df, pg, hot=3).collect()}
    assert hot == {(r.ord, r.line_no, r.block) for r in repeats.found_lines(df, pg).collect()}, "hot lines are dealt, not dropped"
    assert {(r.site, r.line, r.support, r.block) for r in repeats.site_blocks(df, pg).collect()} == {("site.example", "legal notice 0", 9, "legal notice 0"), ("site.example", "share me", 10, "legal notice 0")}
    # Without page rows each record counts for the host of its own address.
    assert {r.ord for r in repeats.found_lines(df, pg.limit(0)).collect()} == set(range(9))


PROSE = {
    "fr": "Après le café, le célèbre élève répète la leçon très près du château. Où était-il à Noël ? Voilà déjà l’été.",
    "de": "Über den Fußweg läuft der große Bär, während die Mädchen schöne Äpfel für das Gespräch wählen.",
    "ru": "Вчера старый сервер снова описал каждый узел, и никто не знает, почему город потерял этот порядок.",
    "pl": "Później żółty żółw przyszedł tu, więc Łukasz wciąż odrzucił część książek i źródeł w mieście.",
    "ja": "小さな検索が索引を数える。毎朝、地図は倉庫を保存する。担当者は古い記録だけを確認する。",
}


@pytest.fixture(scope="module")
def pair_model():
    rng = random.Random(3)
    lines = []
    for lang, text in PROSE.items():
        w = text.split() if lang != "ja" else text.split("。")
        for _ in range(300):
            lines.append((" " if lang != "ja" else "。").join(rng.sample(w, min(len(w), 9))))
    lines += ["At 12 °C it doesn’t move ½ µm.", "Élan©, Dal® and 3 × 4 µm »ok«", "SÃO MAÇÃ ÂNGULO", "“page not found”"] * 10
    codes, n = np.unique(encoding.pair_codes("\n".join(lines))[1], return_counts=True)
    return encoding.PairModel(codes, n)


DAMAGE = [
    ("fr", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("de", "utf-8", "cp437"), ("de", "utf-8", "mac-roman"), ("ru", "utf-8", "latin-1"), ("pl", "cp1250", "latin-1"),
    ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "cp1252"), ("fr", "cp1252", "cp1250"), ("pl", "iso8859-2", "cp1252"), ("ja", "euc-jp", "latin-1"), ("de", "cp1252", "cp437"),
]


@pytest.mark.parametrize("lang, right, wrong", DAMAGE)
def test_damage_is_found_and_undone(pair_model, lang, right, wrong):
    text = PROSE[lang].replace("’", "'")
    broken = text.encode(right).decode(wrong)
    assert broken != text
    got, damaged, whole = encoding.repair_texts([f"plain\n{broken}\nplain"], pair_model)[0][1]
    assert damaged and got == text and whole


def test_damage_that_cannot_be_undone(pair_model):
    lost = PROSE["fr"].encode("cp1252").decode("utf-8", "replace")
    got = encoding.repair_texts([lost, "x\x9fy", "fine"], pair_model)
    assert got[0][0][1:] == (True, False) and got[1][0][1] and got[2][0] == ("fine", False, True)


def test_twice_damaged(pair_model):
    twice = PROSE["de"].encode().decode("cp1252").encode().decode("cp1252")
    got, damaged, whole = encoding.repair_texts([twice], pair_model)[0][0]
    assert damaged and whole and got == PROSE["de"]


def test_sound_text_is_left_alone(pair_model):
    sound = [*PROSE.values(), "At 35 °C it doesn’t move ½ µm.", "SÃO MAÇÃ ÂNGULO", "“page not found”", "", "x" * 50000]
    assert all(x == (t, False, True) for t, d in zip(sound, encoding.repair_texts(sound, pair_model)) for x in d)


def test_max_flow_is_a_minimum_cut():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def energy(lab):
            return sum((-c if c < 0 else 0) if f else (c if c > 0 else 0) for c, f in zip(cost, lab)) + sum(w for a, b, w in edges if lab[a] != lab[b])

        best = min(energy([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert abs(energy(body.cut_page(cost, edges)) - best) < 1e-6


def site(rng, n):
    """Pages of a few sites with furniture around sentences of a small grammar."""
    nouns = [f"noun{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = []
    for i in range(n):
        s = rng.choice(["alpha", "beta", "gamma", "delta"])
        sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} sees a {rng.choice(nouns)} and after that it was with the {rng.choice(nouns)} for {rng.randint(2, 99)} days."
        own = [f"How {rng.choice(nouns)} meets {rng.choice(nouns)}"] + [" ".join(sentence() for _ in range(3)) for _ in range(4)]
        top = ["Home | News | Contact | About us", f"We use cookies to make {s.title()} work. Accept all | Settings"]
        foot = [f"© {rng.randint(2010, 2026)} {s.title()}. All rights reserved.", "Back to top"]
        share = [f"{rng.randint(2, 40)} people shared this. Be the next!"]
        rows.append((i, f"http://{s}.example/{i}", own[0], top, own, share, foot))
    return rows


def test_main_body(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for i, url, title, top, own, share, foot in site(rng, 160):
        lines = top + own[:3] + share + own[3:] + [""] + foot
        rows.append((i, url, title, "\n".join(lines)))
        want |= {(i, n) for n, l in enumerate(lines, 1) if l and l not in own}
    df = spark.createDataFrame(rows + [(900, "http://x/", None, None), (901, None, None, ""), (902, "http://x/", None, "\n \n"), (None, rows[0][1], None, rows[0][3]), rows[0]], "ord bigint, url string, title string, text string").selectExpr("*", "1 as line_no")
    each = [(r.ord, r.line_no) for r in pages.dropped_lines(df).collect()]
    got = set(each)
    assert len(each) == len(got) and None not in {o for o, _ in got}
    assert len(got & want) > 0.97 * len(want) and len(got - want) < 0.02 * len(want)
    assert pages.dropped_lines(df.limit(0)).count() == 0


def test_residue_and_spam(spark):
    rng = random.Random(2)
    rows = []
    for i, url, title, top, own, share, foot in site(rng, 160):
        rows.append((i, url, title, "\n".join(top + own + foot), "\n".join(own + foot), False))
    add = lambda i, text, empty=False: rows.append((i, "http://alpha.example/x", None, text, text, empty))
    filler = " ".join(rng.choices(residue.LATIN, k=60)).capitalize() + "."
    bad = {1000: filler, 1001: "Please enable JavaScript to view this site.", 1002: "404 Not Found\nGo back", 1003: "{{ a.b }}\nname: {{ c.d }}", 1004: "XError: a b was null\n    at c.d.E.f(G.java:12)\n    at h.i.J.k(L.java:33)"}
    nouns = [f"noun{a}{b}" for a in "abcdef" for b in "ghijkl"]
    stuffed = {1100: " ".join(f"{a} {b} days" for a in nouns[:9] for b in nouns[:9]), 1101: " | ".join(f"{a} {b}" for a in nouns for b in nouns[:3]), 1102: " ".join(f"#{a}{b}" for a in nouns for b in nouns[:3])}
    for i, t in {**bad, **stuffed}.items():
        add(i, t)
    add(1200, "", True), add(1201, None, True), add(1202, None, False), add(1203, "... !!", True)
    df = spark.createDataFrame(rows, "ord bigint, url string, title string, text string, main_text string, empty_app_root boolean")
    got = {r.ord for r in residue.found(pages.Judge(df, "main_text")).collect()}
    assert got == set(bad) | {1200, 1201, 1203}
    assert {r.ord for r in spam.found(pages.Judge(df, "main_text")).collect()} == set(stuffed)


def test_judges_of_nothing(spark):
    df = spark.createDataFrame([], "ord bigint, url string, title string, text string, main_text string, empty_app_root boolean")
    judge = pages.Judge(df, "main_text")
    assert residue.found(judge).count() == 0 and spam.found(judge).count() == 0 and pages.damaged_records(df).count() == 0


def test_portions():
    import pyarrow as pa

    col = pa.array(["a" * 5, None, "b" * 20, "", "c"] + ["d"] * 7)
    got = list(encoding.portions(col, most=6, rows=4))
    assert got[0] == (0, 2) and got[1] == (2, 3) and got[-1][1] == 12 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and max(b - a for a, b in got) <= 4
    assert list(encoding.portions(pa.array([], pa.string()))) == []


def test_very_long_texts_are_judged_whole(spark):
    rng = random.Random(4)
    rows = [(i, url, title, "\n".join(top + own + foot)) for i, url, title, top, own, share, foot in site(rng, 60)]
    i, url, title, top, own, share, foot = site(rng, 1)[0]
    long = top + own * 800 + foot
    df = spark.createDataFrame(rows + [(999, url, title, "\n".join(long))], "ord bigint, url string, title string, text string")
    got = {r.line_no for r in pages.dropped_lines(df).where("ord = 999").collect()}
    want = {n for n, l in enumerate(long, 1) if l not in own}
    assert want <= got and len(got - want) < 0.02 * len(long)
