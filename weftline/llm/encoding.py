"""Garbled text from wrong character encodings: detection and restoration.

Every pair of adjacent characters with one beyond ASCII is counted over the whole corpus. A pair's
score is the logarithm of its share in the corpus's mutual information between neighbours: how
often it stands there, times how much more often than by chance. Pairs of garbled text score low,
as each kind of damage is far rarer than the text it came from. Runs of low-scoring pairs are
isolated as maximum-scoring segments, widened to whole words, and inverse mappings are tested inside
the runs of a line alone: their characters are encoded with the encoding that may have been used
wrongly and decoded with the right one. A mapping holds if the pairs it gives score clearly better.
It is tried again on its result until none holds, for text that was damaged several times. What
holds for a line's runs is then applied to those of its other words, and of the record's other
lines, that it makes more probable. Lines with control or replacement characters are damaged whether a mapping holds or not.

The scores of all pairs, rare ones too, are one sorted file that every task maps into memory.
"""

from __future__ import annotations

import codecs
import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import put_file

#: A text's lines as (restored, damaged, whole).
Lines = list[tuple[str, bool, bool]]

#: Encodings by the text they serve, and for each family of right encodings the
#: wrong ones that its bytes are read with by mistake.
_WESTERN, _CENTRAL = ("cp1252", "iso8859-15"), ("cp1250", "iso8859-2")
_CYRILLIC, _JAPANESE = ("cp1251", "koi8-r", "cp866", "iso8859-5"), ("cp932", "euc-jp")
_OLD = ("mac-roman", "cp437", "cp850")
MISREAD = (
    (("utf-8",), (*_WESTERN, "latin-1", *_CENTRAL, *_CYRILLIC, *_OLD, *_JAPANESE, "gbk")),
    (_WESTERN, ("latin-1", *_CENTRAL, *_CYRILLIC, *_OLD)),
    (_CENTRAL, (*_WESTERN, "latin-1", *_CENTRAL, *_CYRILLIC, *_OLD)),
    (_CYRILLIC, (*_WESTERN, "latin-1", *_CENTRAL, *_CYRILLIC, *_OLD)),
    (_OLD, (*_WESTERN, "latin-1", *_CENTRAL, *_CYRILLIC, *_OLD)),
    (_JAPANESE, (*_WESTERN, "latin-1", *_OLD, *_JAPANESE)),
)
#: wrong encoding -> right ones to test.
TESTS: dict[str, list[str]] = {}
for _rights, _wrongs in MISREAD:
    for _w in _wrongs:
        TESTS.setdefault(_w, []).extend(r for r in _rights if r != _w)
_MULTI = frozenset(("utf-8", "cp932", "euc-jp", "gbk"))

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
_PRIVATE = re.compile("[\ue000-\uf8ff]")
_BEYOND = re.compile("[^\x00-\x7e]+")


def pair_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of the adjacent pairs with a character beyond ASCII, none across lines."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    x, y = a[:-1], a[1:]
    at = np.flatnonzero(((x > 127) | (y > 127)) & (x != 10) & (y != 10))
    return at, (x[at].astype("u8") << np.uint64(21)) | y[at]


class PairModel:
    """Scores of character pairs, from counts over a corpus. ``file`` names the file of the scores
    among those every task has; without it they travel with the model."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, file: str | None = None):
        order = np.argsort(codes)
        self.codes, n = codes[order].astype("u8"), counts[order].astype("f8")
        total = max(n.sum(), 1.0)
        left, ia = np.unique(self.codes >> np.uint64(21), return_inverse=True)
        right, ib = np.unique(self.codes & np.uint64(0x1FFFFF), return_inverse=True)
        pa_, pb = np.bincount(ia, n, len(left)) / total, np.bincount(ib, n, len(right)) / total
        p = n / total
        pmi = np.log2(p / (pa_[ia] * pb[ib])) if len(n) else n
        self.score = (np.log2(p) + np.log2(np.maximum(pmi, 0.1))).astype("f4") if len(n) else n.astype("f4")
        self.unseen = np.float32(np.log2(0.5 / total) - 3.4)
        # Levels below which these shares of all pairs in the corpus lie.
        by = np.argsort(self.score)
        self.level, self.wide = (float(self.score[by][np.searchsorted(np.cumsum(n[by]), q * total)]) if len(n) else 0.0 for q in IMPROBABLE)
        self.file = file

    def to_bytes(self) -> bytes:
        return self.codes.tobytes() + self.score.tobytes()

    def __getstate__(self):
        state = dict(self.__dict__)
        if self.file:
            state["codes"], state["score"] = len(self.codes), None
        return state

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.file:
            n, at = state["codes"], SparkFiles.get(self.file)
            self.codes = np.memmap(at, "u8", "r", 0, (n,)) if n else np.zeros(0, "u8")
            self.score = np.memmap(at, "f4", "r", 8 * n, (n,)) if n else np.zeros(0, "f4")

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), self.unseen)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.score[at], self.unseen)

    def cost(self, text: str) -> float:
        """Bits by which the text's pairs lie below a frequent pair; 0 for ASCII."""
        _, codes = pair_codes(text)
        return float((-self.of(codes)).sum()) if len(codes) else 0.0


#: Bytes of text that are worked on at once in a task.
PORTION = 4 << 20


def portions(column: pa.Array, most: int = PORTION, rows: int = 500):
    """(start, stop) of stretches of a text column of at most ``most`` bytes, or of one text."""
    size = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype("f8"))
    start, held = 0, 0.0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > most or i - start >= rows):
            yield start, i
            start, held = i, 0.0
        held += n
    if start < len(size):
        yield start, len(size)


def count_pairs(texts: DataFrame, column: str) -> tuple[PairModel, int]:
    """(the model of all texts of a column, the number of texts); counting is a sum with partial sums
    in each batch."""

    def run(batches):
        for b in batches:
            for start, stop in portions(b.column(0), rows=5000):
                own = [t for t in b.column(0).slice(start, stop - start).to_pylist() if t]
                codes, n = np.unique(pair_codes("\n".join(own))[1], return_counts=True)
                # -1 stands for the texts themselves.
                codes, n = np.append(codes.astype("i8"), -1), np.append(n.astype("i8"), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])

    counts = texts.select(column).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # As many rows as there are pairs of characters in use, whatever the number of texts.
    got = counts.toArrow()
    pair, n = got["pair"].to_numpy(), got["n"].to_numpy()
    model = PairModel(pair[pair >= 0].astype("u8"), n[pair >= 0], f"pairs-{os.urandom(6).hex()}.bin")
    spark = texts.sparkSession
    spark.sparkContext.addFile(put_file(spark, model.to_bytes(), model.file))
    return model, int(n[pair < 0].sum())


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of ``counts`` with the greatest ``n``: as many whole steps of frequency as fit in ``most``.

    The steps (eighths of an octave) are counted first, so no task sends candidates of its own.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 8)
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.s)
    left, low = most, None
    for r in steps:  # at most 8 times 64 rows
        if r.k > left:
            break
        left, low = left - r.k, r.s
    return counts.where(F.lit(False) if low is None else step >= low)


@functools.lru_cache(maxsize=64)
def _table(name: str):
    """The map of a single-byte encoding; bytes it leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return codecs.charmap_build("".join(chars))


def _encode(run: str, name: str) -> bytes | None:
    try:
        return run.encode(name) if name in _MULTI else codecs.charmap_encode(run, "strict", _table(name))[0]
    except UnicodeEncodeError:
        return None


@functools.lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For each test between single-byte encodings, code point -> code point; 0 where there is none."""
    out = []
    for wrong, rights in TESTS.items():
        for right in rights:
            if wrong in _MULTI or right in _MULTI:
                continue
            shift = np.zeros(0x10000, "u4")
            for b in range(256):
                c = _decode(bytes([b]), wrong, False) or chr(b)
                d = _decode(bytes([b]), right, False)
                if d is not None and ord(c) < 0x10000:
                    shift[ord(c)] = ord(d)
            shift[:128] = np.arange(128)
            out.append(shift)
    return out


def _screen(codes: np.ndarray, own: np.ndarray, lines: np.ndarray, n: int, model: PairModel) -> np.ndarray:
    """For each of n lines, whether some test between single-byte encodings saves enough bits.

    codes: all pairs of these lines, own: their scores, lines: the line of each. One pass over all
    lines for each test; what passes is tested again by itself.
    """
    a, b = (codes >> np.uint64(21)).astype("i8"), (codes & np.uint64(0x1FFFFF)).astype("i8")
    high = (a > 0xFFFF) | (b > 0xFFFF)
    a, b = np.minimum(a, 0xFFFF), np.minimum(b, 0xFFFF)
    passed = np.zeros(n, bool)
    for shift in _shifts():
        x, y = shift[a], shift[b]
        fails = np.bincount(lines, (x == 0) | (y == 0) | high, n) > 0
        here = ~(fails | passed)[lines]
        if here.any():
            new = (x[here].astype("u8") << np.uint64(21)) | y[here]
            same = new == codes[here]
            gain = np.where(same, 0, model.of(new) - own[here])
            passed |= np.bincount(lines[here], gain, n) > LEAST_TOTAL
    return passed


@functools.lru_cache(maxsize=4096)
def _may_be_multibyte(runs: str, deep: bool) -> bool:
    """Whether the runs' bytes under some single-byte encoding are valid in one of several bytes."""
    dense = deep and 3 * sum(c > "\x7e" for c in runs) > len(runs)
    for wrong, rights in TESTS.items():
        raw = _encode(runs, wrong)
        if raw is None or raw.isascii():
            continue
        for right in rights:
            if right == "utf-8" or (dense and right in _MULTI):
                try:
                    raw.decode(right)
                    return True
                except UnicodeDecodeError:
                    pass
    return False


@functools.lru_cache(maxsize=64)
def _chars_of(name: str) -> str:
    return "".join(bytes([b]).decode(name, "replace") for b in range(256))


def _decode(raw: bytes, name: str, loose: bool) -> str | None:
    if name in _MULTI:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return raw.decode(name, "ignore") if loose else None
    out = raw.decode("latin-1").translate(_chars_of(name))
    return None if "�" in out else out


def segments(score: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Maximum-scoring segments: (first, last) positions of runs whose scores sum to ``least``.

    ``at`` are the pairs' positions; a gap between them (ASCII) costs a little.
    """
    out, total, best, start, stop, last = [], 0.0, 0.0, 0, 0, None
    for s, p in zip(score.tolist(), at.tolist()):
        if last is not None:
            total -= 0.25 * min(p - last - 1, 40)
        last = p
        if total <= 0 or best - total > least:
            if best >= least:
                out.append((start, stop))
            total, best, start = 0.0, 0.0, p
        total += s
        if total > best:
            best, stop = total, p
    if best >= least:
        out.append((start, stop))
    return out


#: Shares of the corpus's pairs that count as improbable: for all mappings, and for those to UTF-8
#: alone, whose sequences prove themselves.
IMPROBABLE = (0.10, 0.25)
#: Sum of scores that makes a run suspicious; bits that a mapping to UTF-8 must save, and that
#: another must save in all and per pair.
LEAST_RUN, LEAST_UTF8, LEAST_TOTAL, LEAST_GAIN = 5.0, 6.0, 14.0, 1.0
#: Bits it must save in a text of which another line was damaged in the same way.
LEAST_AGAIN = 4.0
#: A pair is rare if it lies so many bits below the level of improbable pairs.
RARE = 7.0


def _best_runs(score: np.ndarray, at: np.ndarray, line_of: np.ndarray, n: int) -> np.ndarray:
    """The sum of the best segment of each of n lines, all lines at once."""
    best = np.zeros(n)
    if not len(score):
        return best
    same = line_of[1:] == line_of[:-1]
    gap = np.where(same, 0.25 * np.minimum(at[1:] - at[:-1] - 1, 40), 0.0)
    rise = np.cumsum(score - np.concatenate([[0.0], gap]))
    # Each line starts far below the one before, so the running minimum starts anew with it.
    rise -= line_of * 1e7
    before = np.concatenate([[rise[0] - score[0]], np.where(same, rise[:-1], rise[1:] - score[1:])])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    best[line_of[start]] = np.maximum.reduceat(rise - np.minimum.accumulate(before), start)
    return best


def whole_words(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, stop) widened to the ASCII white space around them; those that meet are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        while a > 0 and text[a - 1] not in " \t\r":
            a -= 1
        while b < len(text) and text[b] not in " \t\r":
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(text: str, spans: list[tuple[int, int]]) -> str:
    """The runs as lines of one string, with a space for white space beside them; all encodings
    leave both as they are."""
    return "\n".join(" " * (a > 0) + text[a:b] + " " * (b < len(text)) for a, b in spans)


def _put_back(text: str, spans: list[tuple[int, int]], runs: str) -> str:
    n = len(text)
    for (a, b), run in zip(reversed(spans), reversed(runs.split("\n"))):
        text = text[:a] + run[int(a > 0) : len(run) - int(b < n)] + text[b:]
    return text


def mappings(run: str, model: PairModel, single: bool = True, only: str | None = None) -> tuple[str, str, str] | None:
    """(restored, wrong, right) by the best mapping of the runs of a line, None if none holds.

    A mapping holds if it saves enough bits and makes hardly any rare pair; one between encodings
    of single bytes, which never fails by itself, must also save enough per pair and is tried with
    ``single`` alone.
    """
    clean = run.replace("\ufffd", "")
    lossy = len(clean) < len(run)
    (q,), (n,), _ = _bits([clean], model)
    if not n:
        return None
    raws = {w: raw for w in TESTS if (raw := _encode(clean, w)) is not None and not raw.isascii()}
    lines = clean.count("\n")

    read: dict[tuple[bytes, str], str | None] = {}

    def decoded(raw: bytes, right: str) -> str | None:
        if (raw, right) not in read:  # wrong encodings are alike in most characters
            read[raw, right] = _decode(raw, right, lossy)
        return read[raw, right]

    def tried(ways):
        got = [(decoded(raws[w], r), w, r) for w, r in ways]
        return [x for x in got if x[0] is not None and x[0] != clean and x[0].count("\n") == lines and not _PRIVATE.search(x[0])]

    found = tried((w, "utf-8") for w in raws)
    if found:
        # Valid sequences of bytes hardly come by chance: a bit for each byte that proves itself.
        gain = _bits([x[0] for x in found], model)[0] - q + [len(clean) - len(x[0]) for x in found]
        if gain.max() > LEAST_UTF8:
            return found[int(gain.argmax())]
    if only == "utf-8":
        return None
    bad = bool(_BAD.search(run))
    found = tried((w, r) for w in raws for r in TESTS[w] if r != "utf-8" and (single or bad or r in _MULTI))
    found = [x for x in found if bad or not _BAD.search(x[0])]
    if not found:
        return None
    bits, size, rare = _bits([x[0] for x in found], model)
    size = np.maximum(size, 1)
    gain = bits - q
    fits = (bits / size >= q / n + LEAST_GAIN) & (rare <= 0.15 * size)
    for i, (out, wrong, right) in enumerate(found):
        if bad and wrong == "latin-1" and right == "cp1252" and not _BAD.search(out):
            gain[i], fits[i] = max(gain[i], LEAST_TOTAL) + 1, True  # what it does is turn controls into signs
    gain = np.where(fits, gain, -np.inf)
    return found[int(gain.argmax())] if gain.max() > LEAST_TOTAL else None


def _bits(texts: list[str], model: PairModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the scores, number, number of rare ones) of each text's pairs, all texts at once."""
    if len(place := {t: k for k, t in enumerate(dict.fromkeys(texts))}) < len(texts):
        of = [place[t] for t in texts]
        return tuple(x[of] for x in _bits(list(place), model))
    at, codes = pair_codes("\n".join(texts))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, "right")
    score = model.of(codes)
    return np.bincount(of, score, len(texts)), np.bincount(of, minlength=len(texts)), np.bincount(of, score < model.level - RARE, len(texts))


def _restore(run: str, model: PairModel, single: bool, only: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The runs restored as often as a mapping holds, and the mappings; each saves bits, so it ends."""
    used: list[tuple[str, str]] = []
    while (hit := mappings(run, model, single, only)) is not None:
        run = hit[0]
        used.append(hit[1:])
        at, codes = pair_codes(run)
        if not _BAD.search(run) and not segments(np.clip(model.wide - model.of(codes), -4, 4), at, LEAST_RUN):
            break
    return run, used


def _again(text: str, ways: list[list[tuple[str, str]]], model: PairModel, least: float) -> str | None:
    """The text with its words beyond ASCII restored by one of the ways that held for other runs, if
    that saves ``least`` bits; a way is the mappings of one text, one after the other.

    Each word is restored or left by itself: damage that is as frequent as sound text makes no run.
    """
    spans = whole_words(text, [m.span() for m in _BEYOND.finditer(text)])
    words = [_joined(text, [x]) for x in spans]
    before = _bits(words, model)[0]
    best, gain = None, least
    for way in ways:
        got = list(words)
        for wrong, right in way:
            for i, w in enumerate(got):
                raw = _encode(w, wrong) if w is not None else None
                got[i] = _decode(raw, right, False) if raw is not None else None
        fits = [g if g is not None and "\n" not in g and not _PRIVATE.search(g) else w for g, w in zip(got, words)]
        saved = _bits(fits, model)[0] - before
        # In another line than the damaged one, words that are made worse speak against the way.
        total = float(saved.sum() if least > 0 else saved[saved > 0].sum())
        if total > gain:
            kept = "\n".join(g if s > 0 else w for g, w, s in zip(fits, words, saved.tolist()))
            if (model.of(pair_codes(kept)[1]) < model.level - RARE).mean() <= 0.15:
                best, gain = kept, total
    return None if best is None else _put_back(text, spans, best)


def repair_line(line: str, model: PairModel, spans: list[tuple[int, int]], single: bool, only: str | None, used: list | None = None) -> tuple[str, bool, bool]:
    """(text, damaged, whole): the line restored as far as it can be; whole if nothing is lost.

    One mistake damages all of a line, so its runs are mapped together first; where no mapping
    serves them all, each is mapped alone, but only to UTF-8, whose sequences prove themselves.
    """
    spans = whole_words(line, spans + [m.span() for m in _BAD.finditer(line)])
    got, seen = line, False
    if spans:
        runs, ways = _restore(_joined(line, spans), model, single, only)
        if ways:
            got, seen = _put_back(line, spans, runs), True
            if used is not None:
                used += ways
            got = _again(got, [ways], model, 0.0) or got
        else:
            for span in reversed(spans) if len(spans) > 1 else ():
                runs, ways = _restore(_joined(got, [span]), model, False, "utf-8")
                if ways:
                    got, seen = _put_back(got, [span], runs), True
    damaged = seen or bool(_BAD.search(line))
    return got, damaged, not damaged or (seen and "\ufffd" not in line and not _BAD.search(got))


def repair_texts(texts: list[str], model: PairModel) -> list[Lines]:
    """For each text, its lines as (restored, damaged, whole)."""
    out = [[(x, False, True) for x in t.split("\n")] for t in texts]
    joined = "\n".join(texts)
    if joined.isascii() and not _BAD.search(joined):
        return out
    at, codes = pair_codes(joined)
    found = model.of(codes)
    wide, score = np.clip(model.wide - found, -4, 4), np.clip(model.level - found, -4, 4)
    ends = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4") == 10)
    line_of = np.searchsorted(ends, at)
    n_lines = len(ends) + 1
    start_of = np.cumsum([0, *map(len, out)])
    suspects = np.flatnonzero(_best_runs(wide, at, line_of, n_lines) >= LEAST_RUN)
    is_deep = _best_runs(score, at, line_of, n_lines)[suspects] >= LEAST_RUN
    first = np.searchsorted(line_of, suspects)
    last = np.searchsorted(line_of, suspects, "right")
    passed = np.zeros(len(suspects), bool)
    deep = np.flatnonzero(is_deep)
    if len(deep):
        pick = np.concatenate([np.arange(first[k], last[k]) for k in deep])
        of = np.repeat(np.arange(len(deep)), last[deep] - first[deep])
        passed[deep] = _screen(codes[pick], found[pick], of, len(deep), model)
    ways: dict[int, list] = {}
    text_of = np.searchsorted(start_of, suspects, "right") - 1
    for k, (n, i) in enumerate(zip(suspects.tolist(), text_of.tolist())):
        j = n - int(start_of[i])
        line = out[i][j][0]
        base, own = (int(ends[n - 1]) + 1 if n else 0), slice(first[k], last[k])
        spans = [(a - base, b - base + 2) for a, b in segments(wide[own], at[own], LEAST_RUN)]
        if not passed[k]:
            whole = whole_words(line, spans)
            if not (_may_be_multibyte(_joined(line, whole), bool(is_deep[k])) or (len(whole) > 1 and any(_may_be_multibyte(_joined(line, [s]), False) for s in whole))):
                continue
        out[i][j] = repair_line(line, model, spans, bool(passed[k]), None if is_deep[k] else "utf-8", used := [])
        if used and not any(x in _MULTI for way in used for x in way) and used not in ways.setdefault(i, []):
            ways[i].append(used)
    # What damaged one line of a text may have damaged single characters of the others.
    for i, known in ways.items():
        for j, (x, d, _) in enumerate(out[i]):
            if not d and not x.isascii() and (got := _again(x, known, model, LEAST_AGAIN)) is not None:
                out[i][j] = (got, True, not _BAD.search(got))
    if _BAD.search(joined):
        for t in out:
            for j, (x, d, w) in enumerate(t):
                if not d and w and _BAD.search(x):
                    t[j] = repair_line(x, model, [], True, None)
    return out
