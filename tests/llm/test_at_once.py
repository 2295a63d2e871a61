"""What is done for many lines or texts at once gives what each of them gives alone."""

import re

import numpy as np
import pyarrow as pa

from weftline.llm import body, encoding, spam, templates

LINES = [
    "", "\x01", "a \x01 b", "Short line, 12 words.", "a1b2 " * 20 + "x\x1fy\x0bz" + "_" * 9, "x" * 70 + "\t(y)", "12" * 40 + "ab",
    "日本語のテスト、です。" * 9 + " 12 ab", "\U0001d400\U0001d401 text \U0001f600 İSTANBUL ΑΣ ²³ Ⅷ" * 3, "naïve\xa0café www.x.y · • http: https: #|<>,;/",
    "{{ a.b }} and %NAME% or <WORD> [your text here] __NAME__ #{q}", "ÅÄÖ öl " * 20,
]


def test_lines_are_packed_at_once_as_they_are_alone(monkeypatch):
    monkeypatch.setattr(body, "_PACKED_AT_ONCE", 100)
    lines = [x.strip() for x in LINES * 3]
    assert body.pack_lines(lines) == [body.pack_line(x) if x else "" for x in lines]


def test_words_of_lines_found_at_once():
    one = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
    assert spam.words_in(LINES) == [one.findall(x.replace("_", " ")) for x in LINES]
    marks = (*"#|<>,;/·•", "www.", "http:", "https:")
    assert [spam._marks(x) for x in LINES] == [sum(map(x.count, marks)) for x in LINES]


def test_words_are_counted_by_text_and_site(monkeypatch):
    texts, sites = ["The the End 12 \x01\nEnd", "end Paris", "Paris Paris A", "Paris ΑΣ"], ["a", "b", "b", None]
    counts = templates._WordCounts()
    for k in range(4):  # in parts, and words come up that were not there before
        counts.add(sites[k : k + 1], texts[k : k + 1])
    got = {(t, s): (n, p) for t, s, n, p in zip(*(c.to_pylist() for c in counts.counted().columns))}
    assert got == {
        ("the", None): (1, 1), ("end", None): (2, 1), ("paris", None): (3, 0), ("a", None): (1, 0), ("ας", None): (1, 0),
        ("end", "a"): (1, 0), ("paris", "b"): (2, 0),
    }


def test_equal_texts_are_scored_once(monkeypatch):
    at, codes = encoding.pair_codes("née über née")
    model, asked, whole = encoding.PairModel(*np.unique(codes, return_counts=True)), [], encoding.pair_codes
    want = [encoding._bits([x], model) for x in ("née", "über", "née")]
    monkeypatch.setattr(encoding, "pair_codes", lambda text: asked.append(text) or whole(text))
    got = encoding._bits(["née", "über", "née"], model)
    assert asked == ["née\nüber"] and [list(x) for x in got] == [[float(w[k][0]) for w in want] for k in range(3)]


def test_short_lines_are_remembered():
    numbers = body.Numbers({"read": 2, "more": 3})
    first = body.keyed("a.example", None, body.pack("Read more 12\nRead more 12"), numbers)
    assert list(numbers._lines) == ["read more 12"] and first.codes == [(2, 3, 1)] * 2
    assert first.within == body.site_keys("a.example", [["read", "more", "7"]] * 2) and pa.array(first.cross).type == pa.int64()
