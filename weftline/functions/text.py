"""Text scalars: search terms, duplicate-detection words, hashes, shingles, fingerprints, n-grams.

Each is a native expression; where a native one cannot be exact for all of Unicode, an Arrow
function of the same name with the suffix ``_exact`` is there too.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType

TERM = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
WORD = "[\\p{L}\\p{N}_]+"
LONGEST_TERM = 64
SHINGLE = 4
BANDS = 8


def fold(text: Column) -> Column:
    """Lower case with sharp s folded; equal to NFKC and case folding on ordinary text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@arrow_udf(StringType())
def fold_exact(text: pa.Array) -> pa.Array:
    """NFKC and full case folding."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in text.to_pylist()], pa.string())


_term = re.compile(r"[^\W_]+(?:['’][^\W_]+)*").findall


def term_list(text: str | None) -> list[str]:
    """Search terms in order under NFKC and full case folding, without those over 64 characters."""
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    out = _term(text.casefold())
    return out if max(map(len, out), default=0) <= LONGEST_TERM else [t for t in out if len(t) <= LONGEST_TERM]


def lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists from Python's."""
    ends = np.cumsum([0, *map(len, rows)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], kind))


@arrow_udf(ArrayType(StringType()))
def terms_exact(text: pa.Array) -> pa.Array:
    return lists([term_list(t) for t in text.to_pylist()], pa.string())


class Grams(dict):
    """The character n-grams of terms, between boundary marks, remembered while they fit."""

    def __init__(self, n: int = 3, most: int = 200_000):
        self.n, self.most = n, most

    def __missing__(self, term: str) -> list[str]:
        p = f"^{term}$"
        if len(self) >= self.most:
            self.clear()
        self[term] = out = [p[i : i + self.n] for i in range(len(p) - self.n + 1)] if len(p) > self.n else [p]
        return out


def gram_counts(terms: list[str], grams: Grams) -> Counter:
    """How often each n-gram stands in the terms."""
    out: Counter = Counter()
    for term, k in Counter(terms).items():
        for g in grams[term]:
            out[g] += k
    return out


def terms(text: Column, folded: bool = False) -> Column:
    """Search terms in order; those of more than 64 characters are dropped; null gives none."""
    source = F.coalesce(text if folded else fold(text), F.lit(""))
    return F.filter(F.regexp_extract_all(source, F.lit(TERM), F.lit(0)), lambda t: F.char_length(t) <= LONGEST_TERM)


def words(text: Column) -> Column:
    """Words for duplicate detection: letters, numbers and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def squeezed(text: Column) -> Column:
    """The text with each run of white space made one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the squeezed text: equal for texts that differ in white space alone."""
    return F.sha2(squeezed(text), 256)


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """All runs of k words in order, repeats included; fewer words are one shingle, none give none."""
    n = F.size(tokens)
    m = F.greatest(n - F.lit(k - 1), F.lit(0))
    # Shifted copies side by side: the words would be derived again for each index inside a lambda.
    side = F.arrays_zip(*[F.slice(tokens, i + 1, m) for i in range(k)])
    runs = F.transform(side, lambda x: F.concat_ws(" ", *[x[str(i)] for i in range(k)]))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(F.array_join(tokens, " "))).otherwise(runs)


def hash64(text: Column) -> Column:
    """The first 64 bits of MD5, as a signed number."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of 64-bit hashes; a bit is set where it leads; null if empty.

    One pass over the hashes: per-bit votes are counted in an array that the aggregate carries.
    """
    zero = F.array_repeat(F.lit(0), 64)
    bits = F.sequence(F.lit(0), F.lit(63))
    votes = F.aggregate(
        hashes, zero, lambda acc, h: F.zip_with(acc, bits, lambda v, b: v + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
    )
    print_ = F.aggregate(
        F.zip_with(votes, bits, lambda v, b: F.struct(v.alias("v"), b.alias("b"))), F.lit(0).cast("bigint"),
        lambda acc, x: F.when(x["v"] > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["b"]))).otherwise(acc),
    )
    return F.when(F.size(hashes) > 0, print_)


_word = re.compile(r"\w+").findall


def word_runs(text: str | None) -> tuple[int, list[str]]:
    """(number of words, all runs of SHINGLE words in order) of the lower-cased text."""
    w = _word(text.lower()) if text else []
    return len(w), [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []


def fingerprints(runs: list[list[str]], digest) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, whether there is none) of the runs of each record, repeats counted.

    The hashes of a batch are unpacked to bits once, and summed by record.
    """
    n = np.array([len(r) for r in runs], "i8")
    out = np.zeros(len(runs), ">u8")
    some = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[some])])
    step = max(1, int(len(some) * 200_000 // max(1, int(starts[-1]))))
    for k in range(0, len(some), step):  # bits of some hundred thousand hashes at a time
        part = some[k : k + step]
        own = b"".join([digest(r.encode("utf-8", "replace")) for i in part for r in runs[i]])
        bits = np.unpackbits(np.frombuffer(own, "u1").reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts[k : k + len(part)] - starts[k], axis=0, dtype="i8")
        out[part] = np.packbits(2 * ones > n[part, None], axis=1).view(">u8")[:, 0]
    return out.astype("u8").view("i8"), n == 0


def _md5(raw: bytes) -> bytes:
    return hashlib.md5(raw, usedforsecurity=False).digest()[:8]


def _blake(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=8).digest()


@arrow_udf(LongType())
def simhash_exact(text: pa.Array) -> pa.Array:
    """64-bit fingerprint by BLAKE2b over 4-word shingles of the lower-cased words; null if none."""
    out, none = fingerprints([word_runs(t)[1] for t in text.to_pylist()], _blake)
    return pa.array(out, pa.int64(), mask=none)


MEASURES = pa.struct([("n_words", pa.int32()), ("n_shingles", pa.int32()), ("fp", pa.int64())])


@arrow_udf(from_arrow_type(MEASURES))
def measures(text: pa.Array) -> pa.Array:
    """(words, distinct shingles, 64-bit fingerprint by MD5 over all shingles; null if none), in one pass."""
    n, runs = zip(*map(word_runs, text.to_pylist())) if len(text) else ((), ())
    fp, none = fingerprints(list(runs), _md5)
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int32()), pa.array([len(set(r)) for r in runs], pa.int32()), pa.array(fp, pa.int64(), mask=none)], fields=list(MEASURES)
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(fingerprint: Column) -> Column:
    """The eight bytes of a fingerprint, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.call_function("shiftrightunsigned", fingerprint, i * 8).bitwiseAND(F.lit(255)).cast("int"))


def grams(term: Column, n: int = 3) -> Column:
    """Character n-grams of a term between boundary marks; a short one is its own gram."""
    padded = F.concat(F.lit("^"), term, F.lit("$"))
    size = F.char_length(padded)
    return F.when(size <= n, F.array(padded)).otherwise(
        F.transform(F.sequence(F.lit(1), size - F.lit(n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
    )
