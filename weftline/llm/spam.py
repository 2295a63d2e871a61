"""Keyword-stuffed and link-list pages by robust Mahalanobis distance in spam's directions.

Languages are learned from the corpus: all pages with running text are grouped by the words they
hold (``Languages.fit``), and the function words of a group are its most frequent words, as many as make
up ``FUNCTION_MASS`` of its running text. A page of which too few words are known to the corpus is
of no group: its function words are not known, so what rests on them gives no verdict.

A page's content is cut into blocks: each long line is one, short lines in a row are one together,
and short lines that stand alone are one per page. Each block has features of density, entropy,
repetition and function words. For each language a robust centre and covariance of all blocks are
found by concentration steps (medians first, then means and covariances of the nearer blocks, again
and again); a block of few words has a variance that grows as they become fewer. A block is an
outlier if its distance is large after all components that do not point in spam's direction are set
to the centre: fewer function words and sentence ends, more repetition, less entropy, more
separators. A page is spam if outlying blocks hold more than half of its content's words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, small, staging, sweep
from . import residue
from .encoding import portions
from .residue import sums

#: Names of the features, and the sign of spam's direction in each.
FEATURES = (("function", -1), ("ends", -1), ("entropy", -1), ("repeats", 1), ("top", 1), ("marks", 1), ("labels", 1))
SIGNS = np.array([s for _, s in FEATURES], "f8")


_GAPS = bytes(c if chr(c).isalnum() or c == 10 else 32 for c in range(128)) + bytes(128)
#: Marks that end a sentence, by script; some need no space after them.
_END = re.compile(r"[.!?。！？؟։۔](?=[\s\"”’»)]|$)|[。！？।॥።၊။]")
#: What parts entries of lists, and addresses.
_MARKS, _MORE_MARKS, _ADDRESSES = b"#|<>,;/", "·•", ("www.", "http:", "https:")

#: Words a sentence of running text has at most, on average.
SENTENCE = 60
#: Share of a language's running text that its function words make up; share of a page's words that
#: the corpus must know for the page to be of a language; words of a line of running text, and of a
#: page that takes part in the grouping; records and share of those pages that a group needs.
FUNCTION_MASS, KNOWN, RUNNING, LEAST_WORDS, LEAST_GROUP, GROUP_SHARE = 0.45, 0.55, 12, 40, 8, 0.004
#: Similarity of two groups' words above which they are one; evenness below which a group is no
#: language: keywords are common in few of its pages each.
ALIKE, EVEN = 0.6, 0.5
UNKNOWN = "?"


_STOPS = (".", "!", "?")
_ASCII_ENDS = tuple(a + b for a in _STOPS for b in ' ")')


def _ends(line: str) -> int:
    """How many sentences end in a line."""
    if not line.isascii() or "\t" in line:
        return len(_END.findall(line))
    return sum(map(line.count, _ASCII_ENDS)) + (line[-1:] in _STOPS)


def _marks(line: str) -> int:
    """How many marks part a line's entries."""
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw) - len(raw.translate(None, _MARKS))
    if len(raw) > len(line):
        n += sum(map(line.count, _MORE_MARKS))
    return n + sum(map(line.count, _ADDRESSES)) if "www." in line or "http" in line else n


def words_in(lines: list[str]) -> list[list[str]]:
    """The words of each line: letters and digits in a row; each kana or ideograph is one. All lines at once."""
    out: list[list[str]] = [[]] * len(lines)
    plain = [i for i, x in enumerate(lines) if x.isascii()]
    if plain:
        text = "\n".join([lines[i] for i in plain]).encode().translate(_GAPS).decode()
        for i, x in zip(plain, text.split("\n")):
            out[i] = x.split()
    other = [i for i, x in enumerate(lines) if not x.isascii()]
    if other:
        for i, x in zip(other, _spaced("\n".join([lines[i] for i in other])).split("\n")):
            out[i] = x.split()
    return out


def _spaced(text: str) -> str:
    """A text with white space between its words in place of all other signs; lines stay."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4").copy()
    kind = residue.kinds()[np.minimum(a, 0xFFFF)]
    far = np.flatnonzero(a > 0xFFFE)
    kind[far] = [chr(c).isalnum() for c in a[far].tolist()]
    kind[a == 10] = 1
    a[kind == 0] = 32
    single = kind == 2
    if single.any():
        place = np.cumsum(1 + 2 * single) - 1 - single
        every = np.full(int(place[-1]) + 1 + int(single[-1]), 32, "u4")
        every[place] = a
        a = every
    return a.tobytes().decode("utf-32-le", "surrogatepass")


def running(page: list[str]) -> Counter:
    """The words of a page's running text."""
    return _running_of([page])[0]


def _running_of(pages: list[list[str]]) -> list[Counter]:
    """``running`` of each page."""
    lines = [x for page in pages for x in page]
    found, at, out = words_in("\n".join(lines).lower().split("\n") if lines else []), 0, []
    for page in pages:
        own: Counter = Counter()
        for x, ws in zip(page, found[at : at + len(page)]):
            if len(ws) < RUNNING:
                continue
            if any(map(str.isdigit, ws)):
                ws = [w for w in ws if not w.isdigit()]
            if len(ws) >= RUNNING and _ends(x) * SENTENCE >= len(ws):
                own.update(ws)
        at += len(page)
        out.append(own)
    return out


def _heavy(total: int) -> float:
    """How often a heavy word stands in a text of so many words."""
    return max(2, 0.02 * total)


def heavy_words(text: Counter) -> set[str]:
    least = _heavy(text.total())
    return {w for w, n in text.items() if n >= least}


def _running(batches):
    """(words, n) of each text with enough running text: its words and how often each stands there."""
    for b in batches:
        for start, stop in portions(b.column(0)):
            held = [c for c in _running_of([t.split("\n") for t in b.column(0).slice(start, stop - start).to_pylist() if t]) if c.total() >= LEAST_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(c) for c in held], pa.string()), pa.array([list(c.values()) for c in held], pa.list_(pa.int32()))], names=["words", "n"])


def _coded(batches, words: dict[str, int]):
    """(codes, heavy): of each text (words, n) the numbers of those in ``words``, and of the heavy ones."""
    for b in batches:
        rows, get = [], words.get
        edge = np.concatenate([[0], np.cumsum([len(n) for n in b.column(1)])]) if b.num_rows else [0]
        every = b.column(1).flatten().to_numpy(zero_copy_only=False)
        for t, i, j in zip(b.column(0).to_pylist(), edge, edge[1:]):
            n = every[i:j]
            codes = np.fromiter([get(w, -1) for w in t.split(" ")], "i4", j - i)
            has = codes >= 0
            rows.append([codes[has].tobytes(), codes[has & (n >= _heavy(n.sum()))].tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in (zip(*rows) if rows else ((), ()))], names=["codes", "heavy"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, the row of each) of a column of packed numbers."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), "i4").astype("i8"), np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])


class _ByTops:
    """The group of texts by the first of some words that is a heavy one; -1: none is."""

    def __init__(self, tops: list[int]):
        self.tops = tops

    def __call__(self, page: np.ndarray, codes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = np.full(n, len(self.tops), "i8")
        for k, top in enumerate(self.tops):
            at = heavy[1][heavy[0] == top]
            out[at] = np.minimum(out[at], k)
        return np.where(out == len(self.tops), -1, out)


def _add_heavy(total: np.ndarray, b: pa.RecordBatch, rule: _ByTops) -> None:
    """Counts the heavy words of the texts that are in no group."""
    heavy = _flat(b.column(1))
    left = rule(None, None, heavy, b.num_rows) < 0
    total += np.bincount(heavy[0][left[heavy[1]]], minlength=len(total))


class _ByWeights:
    """The group of texts by the words they hold."""

    def __init__(self, weight: np.ndarray, base: np.ndarray):
        self.weight, self.base = weight, base

    def __call__(self, page: np.ndarray, codes: np.ndarray, heavy, n: int) -> np.ndarray:
        if not len(self.weight):
            return np.full(n, -1)
        return np.stack([np.bincount(page, w[codes], n) + b for w, b in zip(self.weight, self.base)], axis=1).argmax(1)


def _function_words(counted: DataFrame, sizes: list[int]) -> list[tuple[int, frozenset, float]]:
    """(texts, function words, evenness) of each group, as ``Languages._commonest`` has them. counted: (g,
    w, n, k), how often each word stands in the group, and in how many of its texts."""
    often: dict[int, list] = {}
    for r in counted.groupBy("g", "n").agg(F.count(F.lit(1)).alias("words")).collect():
        often.setdefault(r.g, []).append((r.n, r.words))
    total = {g: sum(n * c for n, c in v) for g, v in often.items()}
    least = {}
    for g, v in often.items():
        mass = 0
        for n, c in sorted(v, reverse=True):
            if mass >= FUNCTION_MASS * total[g]:
                break
            mass, least[g] = mass + n * c, n
    want = F.lit(False)
    for g, n in least.items():
        want = want | ((F.col("g") == g) & (F.col("n") >= n))
    found: dict[int, list] = {}
    for r in counted.where(want).collect():
        found.setdefault(r.g, []).append((-r.n, r.w, r.k))
    out = []
    for g, size in enumerate(sizes):
        own, mass, even = [], 0, 0
        for n, w, k in sorted(found.get(g, ())):
            if mass >= FUNCTION_MASS * total[g]:
                break
            own.append(w)
            mass, even = mass - n, even - n * k
        out.append((size, frozenset(own), even / max(mass * size, 1)))
    return out


class Languages:
    """Groups of pages by the words they hold, and the function words of each.

    Pages are first grouped by their commonest words, the commonest group first; then each page
    goes to the group whose words it holds, by the probability of each word to stand in a page of
    the group, and groups of like words become one, until nothing changes much.
    """

    def __init__(self, pages: list[list[str]], known: dict[str, int], rounds: int = 6):
        texts = []
        for page in pages:
            c = running(page)
            if c.total() >= LEAST_WORDS:
                texts.append(c)
        least = max(LEAST_GROUP, GROUP_SHARE * len(texts))
        heavy = [heavy_words(c) for c in texts]
        group = np.full(len(texts), -1)
        left, count = set(range(len(texts))), 0
        while left:
            top = max(Counter(w for i in left for w in heavy[i]).items(), key=lambda x: (x[1], x[0]), default=(None, 0))
            if top[1] < least:
                break
            members = [i for i in left if top[0] in heavy[i]]
            group[members] = count
            left.difference_update(members)
            count += 1
        df = Counter(w for c in texts for w in c)
        self.words = {w: k for k, w in enumerate(sorted(w for w, n in df.items() if n >= least / 2))}
        #: Place of each word in the weights, -1 for words that the corpus knows beside those.
        self.place = dict.fromkeys(known, -1)
        holds = np.zeros((len(texts), len(self.words)), "f4")
        for i, c in enumerate(texts):
            holds[i, [self.words[w] for w in c if w in self.words]] = 1
        for _ in range(rounds if count else 0):
            names = [g for g in range(count) if (group == g).sum() >= least]
            share = np.array([holds[group == g].mean(0) for g in names]).reshape(len(names), len(self.words))
            share = self._merged(share, np.array([(group == g).sum() for g in names], "f8"))
            self._weigh(share)
            group, count = self._of(holds), len(share)
        if not count:
            self._weigh(np.zeros((0, len(self.words))))
        own = [[texts[i] for i in np.flatnonzero(group == g)] for g in range(count)]
        self._keep([(len(o), *self._commonest(o)) for o in own], least, known)

    def _keep(self, groups: list[tuple[int, frozenset, float]], least: float, known: dict[str, int]) -> None:
        """The groups (texts, function words, evenness) that are languages, and no others."""
        kept = [g for g, (n, _, even) in enumerate(groups) if n >= least and even >= EVEN]
        #: Function words of each group, by its number as a name.
        self.function: dict[str, frozenset] = {str(k): groups[g][1] for k, g in enumerate(kept)}
        # What running text holds is known if the corpus knows it.
        self.place.update((w, k) for w, k in self.words.items() if w in known)
        self.weight, self.base, self.holding = self.weight[kept], self.base[kept], self.holding[kept]

    @classmethod
    def fit(cls, content: DataFrame, known: dict[str, int], rounds: int = 6) -> "Languages":
        """The same from all texts of a column of content lines, by passes that add up fixed numbers of
        counts: of the words that stand in ``least / 2`` texts, and of those for each group."""
        context = content.sparkSession.sparkContext
        with staging(content.mapInArrow(_running, "words string, n array<int>")) as texts:
            total = texts.count()
            out = cls([], known)
            if not total:
                return out
            least = max(LEAST_GROUP, GROUP_SHARE * total)
            df = texts.select(F.explode(F.split("words", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            names = sorted(r.w for r in df.where(F.col("n") >= least / 2).collect())
            out.words = {w: k for k, w in enumerate(names)}
            words = context.broadcast(out.words)
            with staging(texts.mapInArrow(lambda batches: _coded(batches, words.value), "codes binary, heavy binary")) as coded:
                out._group(coded, least, rounds)
            group, size = out._rule, out._sizes
            rule = context.broadcast(group)

            def grouped(batches):
                for b in batches:
                    codes = [np.fromiter((k for w in t.split(" ") if (k := words.value.get(w, -1)) >= 0), "i8") for t in b.column(0).to_pylist()]
                    page = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
                    g = rule.value(page, np.concatenate([*codes, np.zeros(0, "i8")]), None, len(codes))
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), *b.columns], names=["g", "words", "n"])

            each = texts.mapInArrow(grouped, "g bigint, words string, n array<int>").where("g >= 0").select("g", F.explode(F.arrays_zip(F.split("words", " ").alias("w"), F.col("n").alias("n"))).alias("x"))
            tf = each.groupBy("g", F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("k"))
            with staging(tf) as counted:
                out._keep(_function_words(counted, size), least, known)
        del out._rule, out._sizes
        return out

    def _group(self, coded: DataFrame, least: float, rounds: int) -> None:
        """The groups' weights; ``_rule`` gives the group of texts, ``_sizes`` the texts of each."""
        context, n = coded.sparkSession.sparkContext, len(self.words)
        tops: list[int] = []
        while n:  # the commonest heavy word of the texts that are in no group yet, the last of several
            now = context.broadcast(_ByTops(tops))
            left = sums(coded, n, lambda total, b, now=now: _add_heavy(total, b, now.value))
            now.destroy()
            if left.max() < least:
                break
            tops.append(int(np.flatnonzero(left == left.max())[-1]))
        rule, count = _ByTops(tops), len(tops)
        for _ in range(rounds if count else 0):
            got = self._added(coded, rule, count)
            size = got[:, n]
            many = size >= least
            self._weigh(self._merged(got[many, :n] / size[many, None], size[many].copy()))
            rule, count = _ByWeights(self.weight, self.base), len(self.weight)
        if not count:
            self._weigh(np.zeros((0, n)))
        self._rule, self._sizes = rule, self._added(coded, rule, count)[:, n].astype("i8").tolist() if count else []

    def _added(self, coded: DataFrame, rule, count: int) -> np.ndarray:
        """For each group how many of its texts hold each word, and how many texts it has."""
        now, n = coded.sparkSession.sparkContext.broadcast(rule), len(self.words)

        def add(total, b):
            codes, page = _flat(b.column(0))
            heavy = _flat(b.column(1)) if isinstance(now.value, _ByTops) else None
            g = now.value(page, codes, heavy, b.num_rows)
            use = g[page] >= 0
            total += np.bincount(g[page[use]] * (n + 1) + codes[use], minlength=count * (n + 1))
            total[n :: n + 1] += np.bincount(g[g >= 0], minlength=count)

        got = sums(coded, count * (n + 1), add).reshape(count, n + 1)
        now.destroy()
        return got

    @staticmethod
    def _commonest(texts: list[Counter]) -> tuple[frozenset, float]:
        """(words, evenness): the most frequent words of FUNCTION_MASS of the texts, and the share of
        the texts that holds such a word, on average over their occurrences."""
        tf: Counter = Counter()
        for c in texts:
            tf.update(c)
        own, mass, total = [], 0, tf.total()
        for w, n in sorted(tf.items(), key=lambda x: (-x[1], x[0])):
            if mass >= FUNCTION_MASS * total:
                break
            mass += n
            own.append(w)
        even = sum(tf[w] * sum(w in c for c in texts) for w in own)
        return frozenset(own), even / max(mass * len(texts), 1)

    @staticmethod
    def _merged(share: np.ndarray, size: np.ndarray) -> np.ndarray:
        while len(share) > 1:
            unit = share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-9)
            near = unit @ unit.T - 2 * np.eye(len(share))
            a, b = np.unravel_index(near.argmax(), near.shape)
            if near[a, b] < ALIKE:
                break
            share[a] = (share[a] * size[a] + share[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            share, size = np.delete(share, b, 0), np.delete(size, b)
        return share

    def _weigh(self, share: np.ndarray) -> None:
        p = np.clip(share, 0.002, 0.998)
        self.weight, self.base = np.log(p / (1 - p)).astype("f4"), np.log(1 - p).sum(1).astype("f4")
        self.holding = np.log(p).astype("f4")

    def _of(self, holds: np.ndarray) -> np.ndarray:
        return (holds @ self.weight.T + self.base).argmax(1) if len(self.weight) else np.full(len(holds), -1)

    def of(self, words: list[str]) -> str:
        """The group of a page by its words as they are written; UNKNOWN if the corpus knows too few
        of them. Names are not asked after, unless there is hardly anything else."""
        one = Measure(self)
        return one.languages(np.zeros(len(words), "i8"), one.codes.array(words), 1)[0]


class Codes(dict):
    """Words as they are written by number, and what is known of each: whether it is in lower case,
    a number, a single character, and the number of its lower case."""

    def __init__(self):
        self.words: list[str] = []
        self.facts: list[tuple[int, bool, bool, bool]] = []
        self._table = np.zeros((0, 4), "i8")

    def __missing__(self, w: str) -> int:
        low = w.lower()
        k = self[w] = len(self.facts)
        self.words.append(w)
        self.facts.append((k, True, w.isdigit(), len(w) == 1))
        if low != w:
            self.facts[k] = (self[low], False, w.isdigit(), len(low) == 1)
        return k

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "i8", len(words))

    @property
    def table(self) -> np.ndarray:
        """(lower case, is lower case, is number, is single) of each number."""
        if len(self._table) < len(self.facts):
            self._table = np.concatenate([self._table, np.array(self.facts[len(self._table) :], "i8")])
        return self._table


def block_of_lines(sizes: list[int]) -> list[int]:
    """The block of each line of a page by its number of words: long lines are one each, short ones in
    a row one together, and what stays below ``POOLED`` words is one for the page."""
    out, count, held = [], [], None
    for n in sizes:
        if n >= RUNNING or held is None:
            out.append(len(count))
            held = None if n >= RUNNING else len(count)
            count.append(n)
        else:
            out.append(held)
            count[held] += n
    alone = [b for b, n in enumerate(count) if n < POOLED]
    first = alone[0] if alone else -1
    return [first if count[b] < POOLED else b for b in out]


class Measure:
    """Language and block features of pages, many at once."""

    def __init__(self, languages: Languages):
        self.known = languages
        self._new()

    def _new(self) -> None:
        self.codes = Codes()
        self.places = np.zeros(0, "i8")

    def _placed(self) -> np.ndarray:
        """The place of each number's lower case in the languages' weights: -1 for words that are
        only known, -2 for others."""
        n = len(self.codes.facts)
        if len(self.places) < n:
            get, words, facts = self.known.place.get, self.codes.words, self.codes.facts
            self.places = np.concatenate([self.places, np.array([get(words[facts[k][0]], -2) for k in range(len(self.places), n)], "i8")])
        return self.places

    def languages(self, page: np.ndarray, code: np.ndarray, n: int) -> list[str]:
        """The language of each of n pages; page: of each word, code: its number."""
        if not len(self.known.weight) or not len(code):
            return [UNKNOWN] * n
        table, place = self.codes.table, self._placed()
        real = table[code, 2] == 0
        total = np.bincount(page, minlength=n)
        plain = real & (table[code, 1] == 1)
        known = place[code] >= -1
        sums = lambda use: np.bincount(page[use], minlength=n)
        asked, had = sums(plain), sums(plain & known)
        few = 4 * asked < total
        asked, had = np.where(few, sums(real), asked), np.where(few, sums(real & known), had)
        at = np.unique(page * (len(self.known.words) + 1) + place[code], return_index=True)[1]
        at = at[place[code[at]] >= 0]
        score = np.stack([np.bincount(page[at], h[place[code[at]]], n) for h in self.known.holding], axis=1)
        sure = (asked > 0) & (np.bincount(page[at], minlength=n) > 0) & (had >= KNOWN * asked)
        return [str(g) if s else UNKNOWN for g, s in zip(score.argmax(1).tolist(), sure.tolist())]

    def blocks(self, pages: list[list[str]]):
        """(page, language, words, features) of each block, page by page; features that rest on function
        words are NaN where these are not known."""
        if len(self.codes.facts) > 500_000:
            self._new()
        flat: list[str] = []
        block_of, page_of_line, sizes, ends, marks, first = [], [], [], [], [], 0
        page_of_block: list[int] = []
        words, at = words_in([x for lines in pages for x in lines]), 0
        for p, lines in enumerate(pages):
            found = words[at : at + len(lines)]
            at += len(lines)
            n = [len(ws) for ws in found]
            own = block_of_lines(n)
            for ws in found:
                flat += ws
            sizes += n
            block_of += [first + b for b in own]
            page_of_line += [p] * len(lines)
            page_of_block += [p] * (max(own, default=-1) + 1)
            first = len(page_of_block)
            ends += [_ends(x) for x in lines]
            marks += map(_marks, lines)
        m = len(page_of_block)
        if not m or not flat:
            return [], [], np.zeros(0, "i8"), np.zeros((0, len(FEATURES)))
        sizes_, lines_ = np.array(sizes), np.array(block_of)
        code = self.codes.array(flat)
        langs = self.languages(np.repeat(page_of_line, sizes_), code, len(pages))
        table = self.codes.table
        block, low = np.repeat(lines_, sizes_), table[code, 0]
        order = np.argsort(block.astype("u2") if m <= 1 << 16 else block, kind="stable")  # small numbers are sorted by counting
        block, low = block[order], low[order]
        n = np.bincount(block, minlength=m)
        size = np.maximum(n, 1)
        function, told = np.zeros(len(low), bool), np.zeros(m, bool)
        lang_of_block = np.array(langs, object)[np.array(page_of_block)]
        for g in dict.fromkeys(langs):
            if g != UNKNOWN:
                mine = lang_of_block == g
                told |= mine
                words = self.codes.array(sorted(self.known.function[g]))
                function |= mine[block] & np.isin(low, words)
        table = self.codes.table
        content = ~function & (table[low, 2] == 0)
        pair, at, c = np.unique(block * len(table) + low, return_index=True, return_counts=True)
        of = block[at]
        h = np.bincount(of, c * np.log(c), m)
        top = np.zeros(m, "i8")
        np.maximum.at(top, of, np.where(content[at], c, 0))
        three = np.flatnonzero(block[2:] == block[:-2]) if len(block) > 2 else np.zeros(0, "i8")
        mix = low.astype("u8")
        gram = mix[three] * np.uint64(0x9E3779B97F4A7C15) + mix[three + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix[three + 2] * np.uint64(0x165667B19E3779F9) + block[three].astype("u8") * np.uint64(0xD6E8FEB86659FD93)
        kinds = np.bincount(block[three][np.unique(gram, return_index=True)[1]], minlength=m) if len(three) else np.zeros(m)
        by = lambda v: np.bincount(block, v, m) / size
        line_sum = lambda v: np.bincount(lines_, v, m) / size
        nan = np.where(told, 1.0, np.nan)
        x = np.stack([
            by(function) * nan,
            np.minimum(line_sum(ends), 0.15) * 5,
            np.where(n > 2, 1 - h / np.maximum(n * np.log(np.maximum(n, 2)), 1e-9), 1.0),
            np.where(n > 2, 1 - kinds / np.maximum(n - 2, 1), 0.0),
            np.maximum(top - 1, 0) / size * nan,
            np.minimum(line_sum(marks), 1.0),
            by(content & (table[low, 3] == 0)) * nan,
        ], axis=1)
        keep = np.flatnonzero(n)
        return np.array(page_of_block)[keep].tolist(), lang_of_block[keep].tolist(), n[keep], x[keep]


def page_blocks(lines: list[str], languages: Languages):
    """(language, words, features) of each block of a page's content."""
    _, langs, n, x = Measure(languages).blocks([lines])
    return list(zip(langs, n.tolist(), x.tolist()))


class Centre:
    """Centre and covariance of a language; the inverse for each number of words a block may have."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        self.mean, self.cov = mean, cov
        self.inverse = np.stack([np.linalg.inv(cov + np.diag(SAMPLING) * (1 / n - 1 / ENOUGH)) for n in range(1, ENOUGH + 1)])

    def distances(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Squared distances with every component that does not point to spam set to the centre."""
        d = x - self.mean
        d = np.where(d * SIGNS > 0, d, 0.0)  # what is not known does not point to spam
        return np.einsum("ij,ijk,ik->i", d, self.inverse[np.minimum(n, ENOUGH) - 1], d)


#: Words below which a line that stands alone is measured together with the page's others; squared
#: distance of an outlier; share of a page's words in outlying blocks; blocks a language needs for
#: its own centre.
POOLED, OUTLIER, SHARE, LEAST_LANGUAGE = 8, 50.0, 0.5, 60
#: Words from which on a block's features have the spread of all blocks, and the variance that one
#: word more or less gives each feature below that.
ENOUGH, SAMPLING = 25, np.array([0.25, 1.5, 0.04, 0.02, 0.04, 0.1, 0.25])
_BINS = 250
_ALL = "*"


def measured(judge, languages) -> DataFrame:
    """(ord, lang, n, x): of each page the words and features of its content's blocks, packed.

    Damaged lines that are not restored are left out.
    """

    key = judge.key

    def run(batches):
        measure = Measure(languages.value)
        for b in batches:
            for start, stop in portions(b.column(1)):
                keys, texts = (c.to_pylist() for c in b.slice(start, stop - start).columns)
                page, lang, n, x = measure.blocks([t.split("\n") if t else [] for t in texts])
                first = np.flatnonzero(np.diff(page, prepend=-1))
                rows = [(keys[page[a]], lang[a], n[a:b_].astype("i4").tobytes(), x[a:b_].tobytes()) for a, b_ in zip(first.tolist(), [*first[1:].tolist(), len(page)])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=[key, "lang", "n", "x"])

    return judge.content.select("key", F.coalesce("sound", "own").alias("t")).mapInArrow(run, f"{key} bigint, lang string, n binary, x binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, words, features) of each block of a batch of packed pages (lang, n, x)."""
    sizes = batch.column("n").to_pylist()
    n = np.frombuffer(b"".join(sizes), "i4")
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "f8").reshape(len(n), len(FEATURES))
    return np.repeat(np.arange(batch.num_rows), [len(s) // 4 for s in sizes]), n, x


class Centres:
    """Robust centre and inverse covariance for each language, from all measured blocks.

    Every step is a pass over the features that adds up counts by language; what reaches the driver
    is a fixed number of sums for each of the languages.
    """

    def __init__(self, blocks_: DataFrame, steps: int = 4, keep: float = 0.75):
        # Blocks of a known language with enough words; the others are measured against these.
        self.rows = blocks_.where(F.col("lang") != UNKNOWN).select("lang", "n", "x")
        self.stats: dict = {}
        m = len(FEATURES)
        edges = np.linspace(0, 1, _BINS + 1)
        mid = (edges[1:] + edges[:-1]) / 2

        def histogram(values: np.ndarray) -> np.ndarray:
            at = np.clip((values * _BINS).astype("i8"), 0, _BINS - 1)
            return np.concatenate([np.bincount(at[:, j], minlength=_BINS) for j in range(values.shape[1])]).astype("f8")

        def median(h: np.ndarray) -> np.ndarray:
            c = np.cumsum(h.reshape(-1, _BINS), axis=1)
            return np.array([mid[np.searchsorted(r, r[-1] / 2)] for r in c])

        counts = self._sum(histogram)
        if not counts:
            return
        centre = {k: median(h) for k, h in counts.items()}
        spread = self._sum(lambda x, c: histogram(abs(x - c)), centre)
        self.stats = {
            k: (centre[k], np.diag(1 / np.maximum(1.4826 * median(h), FLOOR) ** 2)) for k, h in spread.items()
        }
        logs = np.linspace(-12, 12, 481)
        for _ in range(steps):
            dist = lambda x, c, inv: np.log2(np.maximum(np.einsum("ij,jk,ik->i", x - c, inv, x - c), 2**-12))
            seen = self._sum(lambda x, c, inv: np.histogram(np.clip(dist(x, c, inv), -11.99, 11.99), logs)[0].astype("f8"), self.stats)
            limit = {k: logs[1 + np.searchsorted(np.cumsum(h), keep * h.sum())] for k, h in seen.items()}

            def moments(x, c, inv, top):
                x = x[dist(x, c, inv) <= top]
                return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

            sums = self._sum(moments, {k: (*self.stats[k], limit[k]) for k in limit})
            for k, s in sums.items():
                if s[0] > 2 * m:
                    mean = s[1 : m + 1] / s[0]
                    cov = (s[m + 1 :].reshape(m, m) / s[0] - np.outer(mean, mean)) * SPREAD + np.eye(m) * FLOOR**2
                    self.stats[k] = (mean, np.linalg.inv(cov))
        total = {k: h[:_BINS].sum() for k, h in counts.items()}
        self.stats = {k: Centre(m_, np.linalg.inv(v)) for k, (m_, v) in self.stats.items() if k == _ALL or total[k] >= LEAST_LANGUAGE}

    def _sum(self, f, given: dict | None = None) -> dict[str, np.ndarray]:
        """Sums of ``f(features, *given)`` over all blocks, for each language and for all together."""

        def run(batches):
            for b in batches:
                page, n, x = _unpacked(b)
                enough = n >= POOLED
                lang, x = b.column(0).to_numpy(zero_copy_only=False)[page[enough]], x[enough]
                for k in [*dict.fromkeys(lang), _ALL]:
                    if given is not None and k not in given:
                        continue
                    own = x if k == _ALL else x[lang == k]
                    args = () if given is None else given[k] if isinstance(given[k], tuple) else (given[k],)
                    v = f(own, *args)
                    hit = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(v[hit], pa.float64())], names=["k", "i", "v"])
                    size[0] = len(v)
                if len(lang):  # tells the length of the vectors
                    yield pa.RecordBatch.from_arrays([pa.array([_ALL]), pa.array([size[0] - 1], pa.int32()), pa.array([0.0])], names=["k", "i", "v"])

        size = [1]
        got = self.rows.mapInArrow(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
        n = max((r.i for r in got), default=-1) + 1
        out: dict[str, np.ndarray] = {}
        for r in got:
            out.setdefault(r.k, np.zeros(n))[r.i] = r.v
        return out


#: Least spread of a feature, and the factor that makes the nearer part's covariance that of all.
FLOOR, SPREAD = 0.02, 1.6


def found(judge) -> DataFrame:
    """(ord): pages of which outlying blocks hold more than half of the content's words.

    Null and empty texts are no case; repeated rows of one key are judged as one page; pages of any
    length are judged. A language with few blocks is measured against all blocks, and so is a page
    of no known language, by what does not rest on function words. Of the pages found so, those of
    residue are left to their own operator.
    """
    spark = judge.records.sparkSession
    languages = Languages.fit(judge.content.select(F.coalesce("sound", "own").alias("t")), judge.body.words)
    sweep(spark)
    own = cut(measured(judge, spark.sparkContext.broadcast(languages)))
    stats = spark.sparkContext.broadcast(Centres(own).stats)

    def run(batches):
        for b in batches:
            page, n, x = _unpacked(b)
            out = np.zeros(len(n), bool)
            lang = b.column("lang").to_numpy(zero_copy_only=False)[page]
            for k in dict.fromkeys(lang):
                at = np.flatnonzero(lang == k)
                use = stats.value.get(k) or stats.value.get(_ALL)
                if use:
                    out[at] = use.distances(x[at], n[at]) > OUTLIER
            sums = [np.bincount(page, v, b.num_rows).astype("i8") for v in (n, n * out)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums)], names=[judge_key, "n", "spam"])

    judge_key = judge.key
    words = own.mapInArrow(run, f"{judge_key} bigint, n bigint, spam bigint").groupBy(judge_key).agg(F.sum("n").alias("n"), F.sum("spam").alias("spam"))
    hits = cut(words.where(F.col("spam") > SHARE * F.col("n")).select(judge_key))
    model = spark.sparkContext.broadcast(residue.ResidueModel.fit_whole(judge))

    def sound(batches):
        for b in batches:
            keys, texts = (c.to_pylist() for c in b.columns)
            covered = residue.coverages([t.split("\n") for t in texts], model.value)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, (hit, n) in zip(keys, covered) if n and hit < residue.COVERAGE * n], pa.int64())], names=[judge_key])

    hit = judge.content.select("key", F.coalesce("sound", "own").alias("t")).join(small(hits.select(F.col(judge_key).alias("key"))), "key", "left_semi")
    return hit.mapInArrow(sound, f"{judge_key} bigint").distinct()
