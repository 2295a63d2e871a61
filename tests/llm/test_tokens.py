"""Encoding, lexicon, pieces and mixtures against the tokenizer library and brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import lexicon as lx
from weftline.llm import mixture, pieces, tokens

ALPHABET = ["a", "b", "the ", " ", "  ", "\n", "\t", "é", "日本", "'s", "'", "12", "½", "\xa0", "　", "\x1c", "\x85", "😀", "́", ".", ",", "_", "<|endoftext|>", "\x00"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(n)]


def test_encoder_is_exact_with_any_lexicon(tmp_path):
    enc = lx.encoding("byte_bpe_50k")
    words = sorted({w for t in texts(300) for w in lx._words(t)})[::2]
    file = tmp_path / "lexicon.bin"
    file.write_bytes(lx.compile_lexicon({w.encode(): enc._encode_single_piece(w.encode()) for w in words}))
    lexicon = lx.Lexicon(str(file))
    for w in words:
        assert lexicon.get(w.encode()) == tuple(enc._encode_single_piece(w.encode()))
    assert lexicon.get(b"no such word") is None and lexicon.get(b"") is None
    own = lx.Encoder("byte_bpe_50k", lexicon)
    for t in texts(3000):
        assert list(own.encode(t)) == enc.encode_ordinary(t) and own.count(t) == len(enc.encode_ordinary(t))


def test_empty_lexicon(tmp_path):
    file = tmp_path / "empty.bin"
    file.write_bytes(lx.compile_lexicon({}))
    assert lx.Lexicon(str(file)).get(b"a") is None


def test_automaton_shares_suffixes(tmp_path):
    whole = lx.compile_lexicon({(a + "tions").encode(): [1] for a in ("na", "sta", "ra", "po")})
    assert len(whole) < 4 * 4 * 4 * 8  # far fewer states than letters


def test_encode_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(200))] + [(900, None, "x"), (901, "", "x"), (1, "again", "x"), (902, "a" * 20000, "x"), (903, "é" * 5000 + " end", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    enc = lx.encoding("byte_bpe_50k")
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode(df).collect())
    assert got == sorted((i, tuple(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = {i: enc.decode(list(ids)) for i, ids in got if i >= 902}
    assert back[902] == "a" * 20000
    assert tokens.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit, overlap", [(64, 8), (50, 0), (40, 19)])
def test_pieces(spark, limit, overlap):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma.", "日本語。", "x1", "naïve", "end!"])
    docs = [("\n\n".join("\n".join(" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))) for _ in range(40)]
    docs += ["z" * 3000, "日" * 800, "😀" * 300, "", None, "short"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    enc = lx.encoding("byte_bpe_50k")
    got = defaultdict(list)
    for r in pieces.pieces(df, limit=limit, overlap=overlap).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(docs):
        ids = enc.encode_ordinary(t or "")
        assert (i in got) == (len(ids) > limit)
        if i not in got:
            continue
        p = sorted(got[i], key=lambda r: r.piece_no)
        assert [r.piece_no for r in p] == list(range(1, len(p) + 1)) and p[0].start_token == 0 and p[-1].end_token == len(ids)
        assert all(r.n_tokens == r.end_token - r.start_token <= limit for r in p)
        assert all(b.start_token == a.end_token - overlap for a, b in zip(p, p[1:]))
        assert all(len(enc.encode_ordinary(r.piece)) <= limit for r in p)
        raw = [enc.decode_bytes(ids[r.start_token : r.end_token]).decode(errors="ignore") for r in p]
        assert all(x in r.piece or r.piece in x or not x for x, r in zip(raw, p))


def test_pieces_are_cut_at_paragraphs(spark):
    text = "\n\n".join(f"Paragraph {i} has some words in it and ends here." for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = sorted(pieces.pieces(df, limit=200, overlap=0).collect(), key=lambda r: r.piece_no)
    assert "".join(r.piece for r in got) == text and all(r.piece.endswith("\n\n") for r in got[:-1])


def test_split_tree_is_exact():
    rng = np.random.default_rng(1)
    q = mixture.split_tree(np.array([100, 7, 0, 1]), 6, rng)
    assert q.sum(0).tolist() == [100, 7, 0, 1] and (q >= 0).all() and max(q.sum(1)) - min(q.sum(1)) <= 3


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["one", "two", "three"], k=rng.randint(1, 40))), s) for i, s in enumerate(["big"] * 600 + ["small"] * 60 + ["unnamed"] * 20)]
    docs += [(9001, None, "big"), (9002, "", "small"), (9003, "x", None), (0, docs[0][1], "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumnRenamed("doc_id", "doc_id")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.2, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(df, goal, shards=4)
    got = m.taken().collect()
    enc = lx.encoding("byte_bpe_50k")
    size = {(i, s): len(enc.encode_ordinary(t or "")) for i, t, s in docs}
    assert {r.source for r in got} == {"big", "small"} and all(r.n_tokens == size[r.doc_id, r.source] > 0 for r in got)
    copies = defaultdict(set)
    for r in got:
        copies[r.doc_id, r.source].add(r.copy)
    assert max(max(c) for c in copies.values()) <= 3 and max(r.copy for r in got if r.source == "big") == 1
    total = sum(r.n_tokens for r in got)
    share = {s: sum(r.n_tokens for r in got if r.source == s) / total for s in ("big", "small")}
    assert abs(share["big"] - 0.6 / 0.9) < 0.02 and abs(share["small"] - 0.3 / 0.9) < 0.02
    told = {r.source: r for r in m.shares().collect()}
    assert told["absent"].tokens_taken == 0 and abs(told["small"].actual_share - share["small"]) < 1e-5 and told["big"].documents == sum(r.source == "big" for r in got)
    again = mixture.Mixture(df, goal, shards=4).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again)), "the same seed gives the same mixture"
    assert {r.shard for r in got} == {0, 1, 2, 3}


def test_empty_mixture(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(df, goal)
    assert m.taken().count() == 0 and m.shares().first().tokens_taken == 0
