"""Template residue, filler, error pages and demands for scripts, by character n-gram models.

Three models are fitted at run time: filler, notices (errors, blocks, loading and script demands,
instructions, unfilled templates, traces), and natural prose. Filler and the forms of placeholders
begin with the seeds below, notices with a handful of them and with the corpus itself: short pages
are parted into notices and others by their words, with a hint of each (an error status, an empty
root, a demand for scripts) that is wrong as often as not, by expectation and maximisation
(``Parting``). Prose comes from the other pages. Words and n-grams are counted over all records, in
tables of a fixed size (``sums``). Each character's log-likelihood ratio is averaged in a window of
words; windows above the threshold localise residue, and a record is excluded if they cover at least
half of its content's words.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, sweep
from . import encoding
from .body import tokens

_SLOTS = 1 << 18
_ORDERS = (3, 4, 6)
#: Words on each side that a word's window takes in, and the mean ratio that makes it residue.
REACH, THRESHOLD, COVERAGE = 5, -0.9, 0.5
#: Strength of smoothing; mean ratios below which a longer and a short page serve as prose.
SMOOTH, UNLIKE, PROSE = 300.0, 0.5, -0.2
_HOLE = re.compile(
    r"(\{\{|\$\{|#\{|\[\[|<%=?|\{)\s*[\w.-]+\s*(\}\}|\}|\]\]|%>)|%[A-Z][A-Z_]+%|__[A-Z][A-Z_]+__|<[A-Z][A-Z_]{2,}>|\[(?:insert )?[\w-]+ here\]|\[insert [\w ]+\]"
)


_CALL = re.compile(r"[\w-]+(?:\.[\w$-]+)+\(")
_FILE = re.compile(r"\([\w$-]+\.(java|py|js|rb|go|cs|php):")
_PATH = re.compile(r"(?<![\w/])(?:/[\w.-]+){2,}")


def _mark(m: re.Match) -> str:
    t = m.group()
    return f"{m[1]}w{m[2]}" if m[1] else "[w here]" if t[0] == "[" else f"{t[:2]}w{t[-2:]}" if t[0] == "_" else f"{t[0]}w{t[-1]}"


def plain(line: str) -> str:
    """The line in lower case; names that may be any word, in placeholders, paths and calls, are ``w``."""
    if "{" in line or "%" in line or "<" in line or "[" in line or "__" in line:
        line = _HOLE.sub(_mark, line)
    if "(" in line and "." in line:
        line = _CALL.sub("w.w(", _FILE.sub(r"(w.\1:", line))
    if "/" in line:
        line = _PATH.sub("/w/w", line)
    return line.lower()

#: Words of the usual filler texts.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
DUMMY = (
    "asdf qwerty foo bar baz qux foobar blah blabla xxx aaa bbb test dummy sample placeholder copy text words headline insert here "
    "bacon brisket ribeye shank pork loin ham hock jowl sirloin pastrami kielbasa"
).split()

#: Seeds of notices, one for each kind. W stands for a word, N for a name, P for a path, 0 for a number.
NOTICES = """Error 404: page not found
Access forbidden
Internal server error
Service unavailable, try again later
JavaScript must be turned on
Loading, please wait
Under maintenance
Put your text here
TODO W
Unhandled NError: W in W.js
  File "P/W.py", line 0, in W
    at W.W(N.java:0)
Warning: W in P/W.php on line 0""".split("\n")

#: Forms of unfilled placeholders; V is the word in capitals.
HOLES = ("{{ W.W }}", "{{W}}", "{{ W }}", "${W}", "[[W]]", "[W here]", "[insert W]", "%V%", "__V__", "<V>", "{0}", "{W}", "<%= W.W %>", "#{W}")


def hashes(text: str) -> list[np.ndarray]:
    """Slot of the n-gram that ends at each character, for each order; digits are all ``0``.

    Grams across a line's end share slot 0, which scores nothing.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    a = np.where((a >= 48) & (a <= 57), 48, a)
    out = []
    starts = np.concatenate([[-1], np.flatnonzero(a == 10)])
    h, each, k = np.zeros(len(a), "u8"), np.empty(len(a), "u8"), 0
    for n in _ORDERS:  # a longer gram goes on from the shorter one
        while k < min(n, len(a)):
            h[k:] += np.multiply(a[: len(a) - k], np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)), out=each[k:])
            k += 1
        x = h >> np.uint64(29)
        x ^= h
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(46)
        for j in range(n):  # grams that begin before the line
            at = starts + j
            x[at[(at >= 0) & (at < len(x))]] = 0
        out.append(x.view("i8"))
    return out


def joined(lines: list[str]) -> str:
    return "\n".join([f" {plain(x)} " for x in lines])


def _counts(lines: list[str]) -> list[np.ndarray]:
    slots = hashes(joined(lines))
    out = [np.bincount(s, minlength=_SLOTS).astype("f8") for s in slots]
    for n in out:
        n[0] = 0
    return out


def seeds(words: list[str], prose: list[str], rng: random.Random) -> tuple[list[str], list[str]]:
    """(filler, notices): training lines, with slots and broken sentences from the corpus's words."""
    words = words or ["page"]

    def fill(t: str) -> str:
        t = re.sub(r"\b0\b", lambda _: str(rng.randint(2, 9999)), t)
        t = re.sub(r"V", lambda _: rng.choice(words).upper(), t) if re.search(r"%V|_V|<V", t) else t
        t = re.sub(r"(?<![A-Za-z])W(?![a-z])", lambda _: rng.choice(words), t)
        t = re.sub(r"(?<![A-Za-z])N(?=Exception|Error|[^A-Za-z]|$)", lambda _: "".join(rng.choice(words)[:4] for _ in range(2)).title(), t)
        return re.sub(r"(?<![A-Za-z])P(?![A-Za-z])", lambda _: f"/{rng.choice(words)}/{rng.choice(words)}", t)

    filler = []
    for bag in (LATIN, DUMMY):
        for _ in range(120):
            filler.append(" ".join(rng.choice(bag) for _ in range(rng.randint(5, 20))).capitalize() + ".")
    filler += ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."] * 8
    notices = []
    for t in NOTICES:
        notices += [fill(t) for _ in range(10)]
    for hole in HOLES:
        for _ in range(14):
            notices.append(fill(hole))
            notices.append(f"{rng.choice(words)}: {fill(hole)}")
        for _ in range(6 if prose else 0):
            notices.append(" ".join(fill(hole) if rng.random() < 0.4 else w for w in rng.choice(prose).split()))
    return filler, notices


def is_sentence(toks: list[str]) -> bool:
    """Long, and words rather than signs."""
    return len(toks) >= 14 and sum(map(str.isalpha, toks)) >= 0.75 * len(toks)


_LETTERS, _FIGURES = (bytes(c if chr(c).isalpha() == alpha and chr(c).isalnum() else 32 for c in range(128)) + bytes(128) for alpha in (True, False))
_NO_SIGNS = bytes(c for c in range(128) if chr(c).isalnum() or chr(c).isspace())


def is_running(line: str) -> bool:
    """``is_sentence`` of a line's tokens; those of ASCII lines are only counted."""
    if not line.isascii():
        return is_sentence(tokens(line))
    raw = line.encode()
    words = len(raw.translate(_LETTERS).split())
    every = words + len(raw.translate(_FIGURES).split()) + len(raw.translate(None, _NO_SIGNS))
    return every >= 14 and words >= 0.75 * every


#: Rounds of the parting; prior share of notices among short pages with and without a hint; and the
#: probability from which on a page's lines are learned.
ROUNDS, PRIOR, LEARNED = 12, (0.9, 0.15), 0.9


def notices_of(pages: list[tuple[bool, list[str]]]) -> list[str]:
    """The lines of those short pages (hint, lines) that are notices by their words and the hint.

    Both classes have a probability for each word to stand on a page and for the hint to be given;
    pages and probabilities are estimated in turn. Without any hint nothing is learned.
    """
    docs = [{"0" if t[0].isdigit() else t for x in lines for t in tokens(plain(x))} for _, lines in pages]
    hint = np.array([bool(h) for h, _ in pages])
    if not hint.any() or hint.all():
        return []
    words = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    holds = np.zeros((len(docs), len(words)), "f4")
    for i, d in enumerate(docs):
        holds[i, [words[w] for w in d]] = 1
    root = np.sqrt(np.maximum(holds.sum(1), 1))  # words of a page are not independent
    p = np.where(hint, *PRIOR)
    for _ in range(ROUNDS):
        a, b = ((w @ holds + 0.3) / (w.sum() + 0.6) for w in (p, 1 - p))
        ha, hb = ((w @ hint + 1) / (w.sum() + 2) for w in (p, 1 - p))
        share = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        told = np.where(hint, np.log(ha / hb), np.log((1 - ha) / (1 - hb))) + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(holds @ np.log(a / b) / root + told, -30, 30)))
    return [x for (_, lines), v in zip(pages, p) if v > LEARNED for x in lines]


#: Numbers of a vector that go in one row; bytes of all tasks' vectors up to which they are added up
#: where they are collected.
_CHUNK, _DIRECT = 4096, 16 << 20
#: Rows of a file that a task reads at once.
_READ = 16


_SUMS = "k bigint, at binary, v binary"


def _sent(total: np.ndarray, kind: str) -> pa.RecordBatch:
    """The parts of a vector that hold anything: all of their numbers, or the places (``at``) and numbers
    of those that are not 0 if that is shorter."""
    ks, ats, vs = [], [], []
    for k in range(0, len(total), _CHUNK):
        part = total[k : k + _CHUNK]
        hit = np.flatnonzero(part)
        if not len(hit):
            continue
        v = part.astype(kind)
        few = len(hit) * (2 + v.itemsize) < v.nbytes
        ks.append(k)
        ats.append(hit.astype("u2").tobytes() if few else None)
        vs.append((v[hit] if few else v).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ats, pa.binary()), pa.array(vs, pa.binary())], names=["k", "at", "v"])


def _put(out: np.ndarray, k: int, at: bytes | None, v: bytes, kind: str) -> None:
    """Adds one part that was sent."""
    v = np.frombuffer(v, kind)
    if at is None:
        out[k : k + len(v)] += v
    else:
        out[k + np.frombuffer(at, "u2").astype("i8")] += v


def sums(rows: DataFrame, size: int, add, kind: str = "f8", files: Broadcast | None = None) -> np.ndarray:
    """The sum of a vector over all rows: ``add(total, batch)`` adds a batch to a task's own; there are
    no more tasks than cores. kind: of the numbers that tasks send. files: the files of the rows
    (``dealt_files``), which tasks then read by themselves, so that no row goes through the JVM."""
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for own in [b] if files is None else (x for k in b.column(0).to_pylist() for f in files.value[k] for x in pq.ParquetFile(f).iter_batches(_READ, use_threads=False)):
                add(total, own)
        yield _sent(total, kind)

    def both(table):
        k = table.column("k")[0].as_py()
        v = np.zeros(min(_CHUNK, size - k))
        for at, x in zip(table.column("at").to_pylist(), table.column("v").to_pylist()):
            _put(v, 0, at, x, kind)
        return pa.table({"k": table.column("k")[:1], "at": pa.array([None], pa.binary()), "v": pa.array([v.astype(kind).tobytes()], pa.binary())})

    given = rows.coalesce(tasks) if files is None else spark.range(0, len(files.value), 1, tasks)
    got = given.mapInArrow(run, _SUMS)
    shuffled = tasks * size * np.dtype(kind).itemsize > _DIRECT
    if shuffled:
        got = got.groupBy("k").applyInArrow(both, _SUMS)
    out = np.zeros(size)
    for part in got.toArrow().to_batches():  # not as rows, which are pickled one by one
        for k, at, v in zip(*(c.to_pylist() for c in part.columns)):
            _put(out, k, at, v, kind)
    if shuffled:
        got._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return out


class Parting:
    """Short pages parted into notices and others as ``notices_of`` does, words by their hash."""

    def __init__(self, ratio: np.ndarray, told: tuple[float, float]):
        self.ratio, self.told = ratio, told

    @staticmethod
    def slots(lines: list[str]) -> np.ndarray:
        words = {"0" if t[0].isdigit() else t for x in lines for t in tokens(plain(x))}
        return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) % _SLOTS for w in words), "i4", len(words)))

    def notices(self, hint: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
        """The probability of each page to be a notice."""
        n = np.fromiter(map(len, pages), "i8", len(pages))
        flat = np.concatenate([*pages, np.zeros(0, "i4")]).astype("i8")
        z = np.bincount(np.repeat(np.arange(len(n)), n), self.ratio[flat], len(n)) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(z + np.where(hint, *self.told), -30, 30)))

    @staticmethod
    def fit(content: DataFrame) -> "Parting | None":
        """From all short pages; None without any hint, or if all have one."""

        def packed(batches):
            for b in batches:
                slots = [Parting.slots(x.split("\n")).tobytes() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.binary())], names=["hint", "slots"])

        pages = cut(content.where(F.col("short") & (F.col("own") != "")).select("hint", "own").mapInArrow(packed, "hint boolean, slots binary"))
        if len(pages.select("hint").distinct().limit(2).collect()) < 2:
            return None
        parting, spark = None, content.sparkSession
        for k in range(ROUNDS):
            if k % 4 == 0:
                sweep(spark)
            now = spark.sparkContext.broadcast(parting)

            def add(total, b, now=now):
                hint = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
                own = [np.frombuffer(x, "i4") for x in b.column(1).to_pylist()]
                p = np.where(hint, *PRIOR) if now.value is None else now.value.notices(hint, own)
                flat, each = np.concatenate([*own, np.zeros(0, "i4")]), np.repeat(p, [len(x) for x in own])
                total[:_SLOTS] += np.bincount(flat, each, _SLOTS)
                total[_SLOTS : 2 * _SLOTS] += np.bincount(flat, 1 - each, _SLOTS)
                total[2 * _SLOTS :] += [p.sum(), (1 - p).sum(), p[hint].sum(), (1 - p[hint]).sum()]

            got = sums(pages, 2 * _SLOTS + 4, add, "f4")
            now.destroy()
            p, q, hp, hq = got[2 * _SLOTS :]
            ratio = np.log((got[:_SLOTS] + 0.3) / (p + 0.6)) - np.log((got[_SLOTS : 2 * _SLOTS] + 0.3) / (q + 0.6))
            ha, hb, share = (hp + 1) / (p + 2), (hq + 1) / (q + 2), np.clip(p / (p + q), 1e-3, 1 - 1e-3)
            base = np.log(share / (1 - share))
            parting = Parting(ratio, (np.log(ha / hb) + base, np.log((1 - ha) / (1 - hb)) + base))
        return parting


#: Pages whose sentences carry the seeds' placeholders; how many times the seeds' lines the learned ones
#: count at most; characters of texts that are scored at once.
CARRIERS, SEEDED, AT_ONCE = 300, 3, 200_000


def natural(page: list[str], scores: np.ndarray) -> bool:
    """Whether a page's words show no residue, by their ratios under a first model."""
    if not len(scores):
        return False
    holes = sum(len(_HOLE.findall(x)) for x in page if "{" in x or "%" in x or "<" in x or "[" in x or "__" in x)
    return bool((scores.mean() < UNLIKE and 12 * holes < len(scores)) if len(scores) >= 40 else (scores.mean() < PROSE and not holes))


def portions(pages):
    """Lists of pages with about ``AT_ONCE`` characters each."""
    held, size = [], 0
    for page in pages:
        held.append(page)
        size += sum(map(len, page))
        if size > AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


class ResidueModel:
    """Log-likelihood ratios of n-grams against prose, one table per order and kind of residue."""

    def __init__(self, tables: list[list[np.ndarray]]):
        self.tables = tables
        #: One table per order with the two kinds side by side, as one number that is gathered and added
        #: up at once.
        self.both = [np.stack(kinds, axis=1).astype("f4").view("c8").ravel() for kinds in zip(*tables)]

    @staticmethod
    def fit(prose: list[str], learned: list[str] = (), seed: int = 5) -> "ResidueModel":
        """From prose and the lines of residue that the corpus showed, beside the seeds."""
        rng = random.Random(seed)
        seen: dict[str, int] = {}
        for line in prose:
            for w in re.findall(r"[a-z]{3,}", line):
                seen[w] = seen.get(w, 0) + 1
        words = sorted(w for w, n in seen.items() if n >= 3)
        ascii_prose = [p for p in prose if p.isascii()]
        filler, notices = seeds(words, ascii_prose, rng)
        notices = notices + list(learned) * max(1, len(notices) // max(len(learned), 1))
        return ResidueModel.of_counts([_counts(filler), _counts(notices)], [_counts(part) for part in (ascii_prose, [p for p in prose if not p.isascii()]) if part])

    @staticmethod
    def of_counts(residue: list[list[np.ndarray]], natural: list[list[np.ndarray]]) -> "ResidueModel":
        # Prose by alphabet: a gram is as natural as in the text of the kind where it is most at home.
        natural = natural or [_counts(["."])]
        tables = []
        for own in residue:
            table = []
            for r, *kinds in zip(own, *natural):
                m = r.sum()
                p = np.max([k / max(k.sum(), 1) for k in kinds], axis=0)
                n = max(k.sum() for k in kinds)
                both = (r / m + p) / 2
                a, b = (r + SMOOTH * both) / (m + SMOOTH), (p * n + 8 * SMOOTH * both) / (n + 8 * SMOOTH)
                ratio = np.clip(np.log(a + 1e-8) - np.log(b + 1e-8), -4, 4).astype("f4")
                ratio[0] = 0
                table.append(ratio)
            tables.append(table)
        return ResidueModel(tables)

    @staticmethod
    def fit_twice(pages: list[list[str]], learned: list[str] = ()) -> "ResidueModel":
        """A first model takes long lines for prose; the second all pages without signs of residue.

        Longer pages may be unlike prose (lists, keywords) if they are far from the seeds and hold
        few placeholders; short ones must be prose.
        """
        told = set(learned)
        long = [x for page in pages for x in page if len(x) >= 36 and x not in told and is_running(x)]
        first = ResidueModel.fit(long, learned)
        clean = []
        for page, s in zip(pages, first.page_scores(pages)):
            if natural(page, s):
                clean += page
        return ResidueModel.fit(clean or long, learned)

    @staticmethod
    def fit_whole(judge) -> "ResidueModel":
        """As ``fit_twice``, with notices, prose and clean pages counted over all records of a ``pages.Judge``."""
        content, context = judge.content.where("own <> ''").select("own", "short", "hint"), judge.records.sparkSession.sparkContext
        parting = context.broadcast(Parting.fit(judge.content))
        few = [x for r in judge.content.where("own <> ''").orderBy(F.xxhash64("key", "own"), "own").limit(CARRIERS).collect() for x in r.own.split("\n")]
        words = sorted(w for w in judge.body.words if re.fullmatch("[a-z]{3,}", w))
        filler, notices = seeds(words, [x for x in few if x.isascii() and len(x) >= 36 and is_running(x)], random.Random(5))
        size = 3 * _SLOTS  # of the counts of one kind: ASCII lines, others, notices

        def put(total, kind, lines):
            if lines:
                for k, x in enumerate(hashes(joined(lines))):
                    own = np.bincount(x, minlength=_SLOTS)
                    own[0] = 0
                    total[kind * size + k * _SLOTS : kind * size + (k + 1) * _SLOTS] += own

        def first(total, batch):
            for start, stop in encoding.portions(batch.column(0), 4 * AT_ONCE):
                count(total, batch.slice(start, stop - start))

        def count(total, b):
            pages = [x.split("\n") for x in b.column(0).to_pylist()]
            told = [False] * len(pages)
            if parting.value is not None:
                at = np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False))
                hint = b.column(2).to_numpy(zero_copy_only=False).astype(bool)[at]
                for i, p in zip(at.tolist(), parting.value.notices(hint, [Parting.slots(pages[i]) for i in at.tolist()]).tolist()):
                    told[i] = p > LEARNED
            learned = [x for page, t in zip(pages, told) if t for x in page]
            known = set(learned)
            long = [x for page, t in zip(pages, told) if not t for x in page if len(x) >= 36 and x not in known and is_running(x)]
            put(total, 0, [x for x in long if x.isascii()])
            put(total, 1, [x for x in long if not x.isascii()])
            put(total, 2, learned)
            total[3 * size] += len(learned)

        sweep(judge.records.sparkSession)
        got = sums(content, 3 * size + 1, first)
        counted = lambda v: [v[k : k + _SLOTS] for k in range(0, size, _SLOTS)]
        n = got[3 * size]
        weight = max(1, len(notices) // max(n, 1)) if n <= SEEDED * len(notices) else SEEDED * len(notices) / n
        kinds_ = [_counts(filler), [a + weight * b for a, b in zip(_counts(notices), counted(got[2 * size : 3 * size]))]]
        prose = lambda v: [counted(x) for x in (v[:size], v[size : 2 * size]) if x.any()]
        model = context.broadcast(ResidueModel.of_counts(kinds_, prose(got)))

        def second(total, b):
            for pages in portions(x.split("\n") for x in b.column(0).to_pylist()):
                lines = [x for page in pages for x in page]
                text = joined(lines)
                slots = hashes(text)
                best, edge = model.value.windows(lines, text, slots)
                ends = np.cumsum([0, *map(len, pages)])
                keep = np.zeros(len(lines), bool)
                for page, i, j in zip(pages, ends, ends[1:]):
                    keep[i:j] = natural(page, best[edge[i] : edge[j]])
                ascii_ = np.fromiter(map(str.isascii, lines), bool, len(lines))
                line = np.repeat(np.arange(len(lines)), np.diff(np.concatenate([[-1], np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4") == 10), [len(text)]]))) if lines else ascii_
                line = line[: len(text)]
                for kind, use in enumerate((keep & ascii_, keep & ~ascii_)):
                    if use.any():
                        here = use[line]
                        for k, x in enumerate(slots):
                            own = np.bincount(x if here.all() else x[here], minlength=_SLOTS)
                            own[0] = 0
                            total[kind * size + k * _SLOTS : kind * size + (k + 1) * _SLOTS] += own

        sweep(judge.records.sparkSession)
        clean = sums(content.select("own"), 2 * size, second)
        return ResidueModel.of_counts(kinds_, prose(clean if clean.any() else got[: 2 * size]))

    def word_scores(self, lines: list[str]) -> list[np.ndarray]:
        """For each line, each word's ratio in its window: the larger of filler and notices."""
        best, edge = self.windows(lines)
        return [best[edge[i] : edge[i + 1]] for i in range(len(lines))]

    def page_scores(self, pages: list[list[str]]):
        """Each page's words' ratios, for some pages at a time."""
        for start in range(0, len(pages), 64):
            part = pages[start : start + 64]
            best, edge = self.windows([x for page in part for x in page])
            ends = edge[np.cumsum([0, *map(len, part)])]
            yield from (best[a:b] for a, b in zip(ends[:-1], ends[1:]))

    def windows(self, lines: list[str], text: str | None = None, slots: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(each word's ratio in its window, the words of all lines in a row; where each line starts).
        text and slots: the lines ``joined`` and their ``hashes``, if they are known."""
        text = joined(lines) if text is None else text
        score = None
        for table, slot in zip(self.both, hashes(text) if slots is None else slots):
            own = table.take(slot)
            score = own if score is None else np.add(score, own, out=score)
        sums = np.zeros(len(score) + 1, "c16")
        np.cumsum(score, dtype="c16", out=sums[1:])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
        kind = kinds()[np.minimum(chars, 0xFFFF)]
        before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
        # A word starts where letters or digits begin; each kana or ideograph is one.
        start = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
        ends = np.flatnonzero(chars == 10)
        line = np.searchsorted(ends, start)
        edge = np.searchsorted(line, np.arange(len(lines) + 1))
        if not len(start):
            return np.zeros(0), np.zeros(len(lines) + 1, "i8")
        # A word's stretch runs to the start of the next one, so that signs count with it; a line's
        # first one takes in what stands before it.
        open_ = np.concatenate([[0], ends + 1])[line]
        stop = np.concatenate([ends, [len(text)]])[line]
        first = np.concatenate([[True], line[1:] != line[:-1]])
        a = np.where(first, open_ + 1, start)
        b = np.where(np.concatenate([first[1:], [True]]), stop, np.concatenate([start[1:], [0]]))
        at = np.arange(len(start))
        lo, hi = np.maximum(at - REACH, edge[line]), np.minimum(at + REACH, edge[line + 1] - 1)
        till, since = b[hi], a[lo]
        both = sums[till] - sums[since]
        return np.maximum(both.real, both.imag) / np.maximum(till - since, 1), edge


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Of each character: 0 sign, 1 letter or digit, 2 kana or ideograph."""
    out = np.fromiter((chr(c).isalnum() for c in range(0x10000)), "i1", 0x10000)
    out[0xD800:0xE000] = 0
    out[0x3040:0x3100], out[0x3400:0xA000] = 2, 2
    return out


def coverage(lines: list[str], model: ResidueModel) -> tuple[int, int]:
    """(words in residue windows, all words) of content lines."""
    return coverages([lines], model)[0]


def coverages(pages: list[list[str]], model: ResidueModel) -> list[tuple[int, int]]:
    """``coverage`` of each of several pages."""
    out: list[tuple[int, int]] = []
    for held in portions(pages):
        best, edge = model.windows([x for page in held for x in page])
        above = np.concatenate([[0], np.cumsum(best > THRESHOLD)])
        ends = edge[np.cumsum([0, *map(len, held)])]
        out.extend(zip((above[ends[1:]] - above[ends[:-1]]).tolist(), (ends[1:] - ends[:-1]).tolist()))
    return out


def found(judge, empty_root: str = "empty_app_root") -> DataFrame:
    """(ord): records of which residue covers at least half of the content's words.

    ``judge`` is a ``pages.Judge`` of the text. Where all lines are furniture, all of them are
    judged. Records without any word (null and empty texts too) are found if ``empty_root`` is
    true; repeated rows are found once.
    """
    records, key, text = judge.records, judge.key, judge.text
    model = records.sparkSession.sparkContext.broadcast(ResidueModel.fit_whole(judge))

    def run(batches):
        for b in batches:
            keys, own, every = (c.to_pylist() for c in b.columns)
            out = []
            for k, e, (hit, n) in zip(keys, every, coverages([x.split("\n") for x in own], model.value)):
                if not n and e:
                    hit, n = coverage(e.split("\n"), model.value)
                if n and hit >= COVERAGE * n:
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=[key])

    wordless = records.where(F.col(empty_root) & ~F.coalesce(F.col(text), F.lit("")).rlike("[\\p{L}\\p{N}]")).select(key)
    return judge.content.select("key", "own", "every").mapInArrow(run, f"{key} bigint").unionByName(wordless).where(F.col(key).isNotNull()).distinct()
