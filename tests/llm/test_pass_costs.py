"""What a pass over all lines does besides reading them: the same sums, with less work."""

import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import body, encoding, residue, spam, weights

LINES = [
    ["The quick brown fox jumps over 17 lazy dogs, and nobody counts them any more today.", "Home", "Read more (2)", ""],
    ["Съешь ещё этих мягких французских булок, да выпей чаю.", "日本語の文章です。", "{{ user.name }} at a.b(c) /usr/lib/x.py", "100 % of 3² and __X__"],
]


def _packed(rng, words, lines):
    """A batch of labelled lines of both kinds, and the lines."""
    rows, each = [], []
    for kind in (0, 1):
        for _ in range(3):
            n = rng.integers(1, 40, lines)
            flat = rng.integers(0, words, n.sum())
            form, top = rng.integers(0, 64, lines), rng.random(lines).astype("f4")
            every = top + rng.random(lines).astype("f4")
            rows.append((kind, flat.astype("u2").tobytes(), n.astype("i4").tobytes(), form.astype("u1").tobytes(), top.tobytes(), every.tobytes()))
            each += [(kind, f, *x) for f, *x in zip(np.split(flat, np.cumsum(n)[:-1]), form.tolist(), top.tolist(), every.tolist())]
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=weights._NAMES), each


def _added(monkeypatch, words, w, batch):
    """The gradient of one batch."""
    class Now:
        value = w

    def sums(lines, size, add, kind):
        total = np.zeros(size)
        add(total, batch)
        return total

    monkeypatch.setattr(weights, "sums", sums)
    return weights._gradient(None, Now, "u2", words)


def test_gradient_is_that_of_each_line_by_itself(monkeypatch):
    rng, words, slots = np.random.default_rng(3), 50, body._SLOTS
    batch, each = _packed(rng, words, 200)
    w = rng.normal(size=(2, slots)).astype("f4")
    want = np.zeros((2, slots))
    for kind, flat, form, top, every in each:
        mix = lambda a, b, k: np.atleast_1d(body._mix(np.asarray(a, "i8"), np.asarray(b, "i8"), k))
        own = np.concatenate([mix(flat, 0, 1), mix(flat[:-1], flat[1:], 2), mix(flat[:1], 0, 3), mix(flat[-1:], 0, 4), mix(form, 0, 5), mix(form >> 3, 0, 6)])
        norm = 3 / np.sqrt(len(own))
        error = (every / (1 + np.exp(-norm * w[kind][own].astype("f8").sum())) - top) * norm
        np.add.at(want[kind], own, error)
    for at_once in (100, 1 << 20):
        monkeypatch.setattr(weights, "AT_ONCE", at_once, raising=False)
        assert np.allclose(_added(monkeypatch, words, w, batch), want, atol=1e-4)


def test_portions_of_lines_are_added_without_a_vector_of_all_slots_each(monkeypatch):
    rng, words, slots = np.random.default_rng(4), 50, body._SLOTS
    batch, _ = _packed(rng, words, 300)
    monkeypatch.setattr(weights, "AT_ONCE", 200, raising=False)
    monkeypatch.setattr(weights, "ROWS", 1, raising=False)
    made, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: made.append(max([k.get("minlength", 0), *a[2:3]])) or count(*a, **k))
    _added(monkeypatch, words, np.zeros((2, slots), "f4"), batch)
    assert sum(n >= slots for n in made) == 2 * 5  # for each kind the slots of words, ends, forms and sizes, once a batch


def test_keys_of_lines_with_and_without_digits():
    words = {"the": 2, "fox": 3, "page": 4}
    for page in LINES:
        one = body.keyed("a.example", None, body.pack("\n".join(page)), words)
        same = body.keyed("a.example", None, body.pack("\n".join(page)), body.Numbers(words))
        assert vars(one) == vars(same) and one.within == body.site_keys("a.example", one.toks)
        assert one.codes == [tuple(words.get(t) or int(t[0].isdigit()) for t in l) for l in one.toks]


def test_sentences_of_ascii_lines_are_told_without_their_tokens(monkeypatch):
    lines = [x for page in LINES for x in page] + ["a " * 13 + "b", "a1 " * 14, "one, " * 14, "\x1c".join("abcdefghijklmno"), "x_y " * 9]
    want = [residue.is_sentence(residue.tokens(x)) for x in lines]
    asked = []
    real = residue.tokens
    monkeypatch.setattr(residue, "tokens", lambda x: asked.append(x) or real(x))
    assert [residue.is_running(x) for x in lines] == want and any(want) and not any(map(str.isascii, asked))


def test_windows_gather_both_kinds_at_once():
    rng = np.random.default_rng(5)
    model = residue.ResidueModel([[rng.normal(size=residue._SLOTS).astype("f4") for _ in residue._ORDERS] for _ in range(2)])
    assert all(t.ndim == 1 and len(t) == residue._SLOTS for t in model.both)
    for page in LINES:
        best, edge = model.windows(page)
        text = residue.joined(page)
        score = np.sum([[t[s] for t, s in zip(kind, residue.hashes(text))] for kind in model.tables], axis=1)
        at = 0
        for i, line in enumerate(residue.joined([x]) for x in page):
            starts = [m.start() for m in re.finditer(r"[぀-ヿ㐀-龥]|[^\W_぀-ヿ㐀-龥]+", line)]
            assert len(starts) == edge[i + 1] - edge[i]
            stops = [*starts[1:], len(line)]
            for k in range(len(starts)):
                lo, hi = max(k - residue.REACH, 0), min(k + residue.REACH, len(starts) - 1)
                a, b = (1 if lo == 0 else starts[lo]), stops[hi]
                assert best[edge[i] + k] == pytest.approx(score[:, at + a : at + b].sum(1).max() / (b - a), abs=1e-5)
            at += len(line) + 1


def test_texts_are_tried_in_several_bytes_once():
    encoding._may_be_multibyte.cache_clear()
    assert encoding._may_be_multibyte("Ã©tÃ©", False) and encoding._may_be_multibyte("Ã©tÃ©", False)
    assert encoding._may_be_multibyte.cache_info().hits == 1


def test_running_words_without_numbers():
    page = ["In 2024 the fox and the dog ran on and on over 3 hills until it was dark and cold.", "Too short."]
    assert spam.running(page)["and"] == 3 and not any(w.isdigit() for w in spam.running(page))
