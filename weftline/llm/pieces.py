"""Splitting oversized texts at natural boundaries.

A text above the limit gets the smallest number of pieces that can hold it with the overlap; equal
targets are set, each target is snapped to the strongest boundary near it (end of a paragraph, line,
sentence, word), and where a piece still breaks the limit the text gets one piece more and new
targets. A text of no more bytes than the limit has tokens cannot be too long, so only longer ones
are encoded. Each text is handled alone, in one pass, without any shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx
from .tokens import _encoder

#: Boundaries by strength: what must stand right before the cut.
BOUNDARIES = (
    (4, re.compile(r"\n[^\S\n]*\n\s*")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?…][\"'»”’)\]]*(?=\s)|[。！？][」』）]*")),
    (1, re.compile(r"(?<=\S)(?=\s)")),
)
#: A target may move by this share of the limit to reach a boundary.
WINDOW = 0.125


def boundaries(text: str) -> dict[int, int]:
    """Character position after each boundary -> strength; the strongest holds."""
    out: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            out[m.end()] = strength
    return out


def cut_points(n: int, at: np.ndarray, strength: np.ndarray, k: int, overlap: int, window: int) -> list[int]:
    """k - 1 cuts between tokens: equal targets, each snapped to the strongest boundary nearby.

    ``at`` are the boundaries' token positions in order. Ties go to the nearer, then the earlier.
    """
    # The pieces' lengths with overlap are equal: the first is longer by the overlap without it.
    length = (n + (k - 1) * overlap) / k
    cuts, last = [], 0
    for i in range(1, k):
        target = round(i * (length - overlap) + overlap)
        first, end = max(last + 1, overlap), n - (k - i)
        lo, hi = np.searchsorted(at, [max(first, target - window), min(end, target + window) + 1])
        if lo < hi:
            near = np.lexsort((at[lo:hi], abs(at[lo:hi] - target), -strength[lo:hi]))[0]
            target = int(at[lo + near])
        target = min(max(target, first), end)
        cuts.append(target)
        last = target
    return cuts


def split(text: str, encoder: lx.Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start token, end token, start char, end char) of each piece; one piece if nothing is to cut.

    Each piece but the first starts ``overlap`` tokens before the end of the one before it. Where
    that is inside a character of several tokens, the characters start with that character.
    """
    ids = encoder.encode(text)
    n = len(ids)
    if n <= limit:
        return [(0, n, 0, len(text))]
    widths = _widths(encoder)[np.frombuffer(ids, "i4")]
    byte_at = np.concatenate([[0], np.cumsum(widths)])
    lead = np.fromiter((len(c.encode()) for c in text), "i4", len(text)) if not text.isascii() else np.ones(len(text), "i4")
    char_byte = np.concatenate([[0], np.cumsum(lead)])
    char_of = lambda tok: int(np.searchsorted(char_byte, byte_at[tok], "right")) - 1
    found = boundaries(text)
    # Positions between tokens that are also between characters; those at no boundary have strength 0.
    inside = np.searchsorted(char_byte, byte_at)
    whole = np.flatnonzero(char_byte[np.minimum(inside, len(char_byte) - 1)] == byte_at)
    strength = np.fromiter((found.get(int(inside[t]), 0) for t in whole), "i4", len(whole))
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        cuts = [0, *cut_points(n, whole, strength, k, overlap, int(limit * WINDOW)), n]
        out = []
        for i in range(k):
            a, b = max(0, cuts[i] - overlap * (i > 0)), cuts[i + 1]
            out.append((a, b, char_of(a), char_of(b)))
        if all(b - a <= limit and (b - a < limit // 2 or encoder.count(text[c:d]) <= limit) for a, b, c, d in out):
            return out
        k += 1


_WIDTHS: dict[int, np.ndarray] = {}


def _widths(encoder: lx.Encoder) -> np.ndarray:
    """Bytes of each token id."""
    merge = encoder.merge
    if id(merge) not in _WIDTHS:
        _WIDTHS[id(merge)] = np.array(
            [len(merge.decode_single_token_bytes(i)) for i in range(merge.n_vocab)], "i4"
        )
    return _WIDTHS[id(merge)]


def pieces(
    texts: DataFrame, key: str = "doc_id", column: str = "text", limit: int = 4096, overlap: int = 128,
    name: str = "byte_bpe_50k", folder: str = lx.TOKENIZERS, with_text: bool = True,
) -> DataFrame:
    """(key, piece_no, n_pieces, start_token, end_token, n_tokens, piece): the pieces of long texts.

    Only texts with more than ``limit`` tokens have rows; null, empty and short texts have none. A
    text without any boundary is cut between tokens. Other columns are ignored, repeated rows are
    cut each. ``with_text=False`` leaves ``piece`` null.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        own = _encoder(name, folder, None)
        for b in batches:
            for k, text in zip(b.column(0), b.column(1).to_pylist()):
                got = split(text, own, limit, overlap)
                if len(got) < 2:
                    continue
                a, e, c, d = map(list, zip(*got))
                m = len(got)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.as_py()] * m, b.column(0).type), pa.array(range(1, m + 1), pa.int32()), pa.array([m] * m, pa.int32()),
                        pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array([y - x for x, y in zip(a, e)], pa.int64()),
                        pa.array([text[x:y] if with_text else None for x, y in zip(c, d)], pa.string()),
                    ],
                    names=[key, "piece_no", "n_pieces", "start_token", "end_token", "n_tokens", "piece"],
                )

    long = texts.where(F.octet_length(column) > limit).select(key, column)
    return long.mapInArrow(
        run, f"`{key}` {kind}, piece_no int, n_pieces int, start_token bigint, end_token bigint, n_tokens bigint, piece string"
    )
