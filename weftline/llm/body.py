"""Main body of a page: lines of its own content against lines of its furniture, by minimum cuts.

A classifier gives each line a cost for either label. The lines of a page are the nodes of a graph:
terminal edges carry the costs, lines next to each other and lines that hang on the same heading are
tied by smoothness edges, and a maximum flow separates content from furniture.

The classifier's weights are fitted at run time on the lines of all records (``weights``), without
labels from outside. The labels come from what all records show (``templates``):

* a line's template (digits and rare words masked) that stands in many records, most of which hold
  long text besides, is furniture; one that mostly stands alone on its page (an error message) is
  content;
* long lines whose template does not recur are content, so are short ones between them, and so is
  the line that repeats the record's title; what stands above that line is furniture;
* a furniture line that is mostly followed by a few short lines and then by furniture again, below
  the text, is a heading of a sidebar, and the lines after it belong to it.

Damaged text is restored before it is judged, so furniture is found in any encoding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import xxhash

from .encoding import Lines

#: Nothing rests on a sample any more: the test that varies its size shows it.
SAMPLE = 3000
#: The least number of records for "many".
MANY, MANY_SHARE = 4, 0.0015
#: Share of records a word must stand in to be kept in templates, at least 3 records.
KNOWN_SHARE = 0.002
#: Share of a template's records that must hold long text for it to be furniture.
HOSTED = 0.72
_SLOTS = 1 << 18
_CJK = "぀-ヿ㐀-鿿ｦ-ﾝ"
_any_tokens = re.compile(rf"[^\W\d_{_CJK}]+|\d+|[^\w\s]|_|[{_CJK}]").findall
_ascii_tokens = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]").findall
_STOPS, _CLOSERS = frozenset(".!?。！？…:;"), "\"'”’»)]"


def ends(line: str) -> bool:
    """Whether a line ends like a sentence, before closing marks."""
    return line.rstrip().rstrip(_CLOSERS)[-1:] in _STOPS


def tokens(line: str) -> list[str]:
    line = line.lower()
    return _ascii_tokens(line) if line.isascii() else _any_tokens(line)


@dataclass
class BodyModel:
    """Weights of the two line classifiers and the words they know."""

    words: dict[str, int] = field(default_factory=dict)
    furniture: np.ndarray = field(default_factory=lambda: np.zeros(_SLOTS, "f4"))
    heading: np.ndarray = field(default_factory=lambda: np.zeros(_SLOTS, "f4"))


def _numbered(lines: list[list[str]], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of the words of all lines in a row, how many each line has)."""
    n = np.fromiter(map(len, lines), "i8", len(lines))
    every = list(chain.from_iterable(lines))
    flat = np.fromiter(map(words.get, every, repeat(0)), "i8", len(every))
    unknown = np.flatnonzero(flat == 0)
    flat[unknown] = np.fromiter((every[i][0].isdigit() for i in unknown.tolist()), "i8", len(unknown))
    return flat, n


def _features(lines: list[list[str]], ends: list[bool], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, line of each) of lines by their tokens."""
    return features(*_numbered(lines, words), np.array(ends, "i8"))


def _mix(a, b, k: int):
    """The slot of a feature of the given kind."""
    return (((a * 0x9E3779B1 + b * 0x85EBCA77 + k * 0xC2B2AE3D) & 0x7FFFFFFFFFFF) >> 7) & (_SLOTS - 1)


def _size(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([2, 3, 4, 6, 9, 14, 24], n, "right")


def forms(n: np.ndarray, rare: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A line's form, less than 64: how many words, the share of unknown ones, its end."""
    return _size(n) * 8 + np.minimum((rare * 4).astype("i8"), 3) * 2 + ends


def features(flat: np.ndarray, n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, line of each): masked words, their pairs, and the line's form. flat: the numbers
    of the words of all lines in a row (0: unknown, 1: digits), n: how many each line has."""
    row = np.repeat(np.arange(len(n)), n)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[start[n > 0]] = True
    last[(start + n - 1)[n > 0]] = True
    pair = np.flatnonzero(~last)
    rare = np.bincount(row, flat == 0, len(n)) / np.maximum(n, 1)
    size = _size(n)
    form = forms(n, rare, ends)
    slots = np.concatenate([
        _mix(flat, 0, 1), _mix(flat[pair], flat[pair + 1], 2) if len(pair) else np.zeros(0, "i8"),
        _mix(flat[first], 0, 3), _mix(flat[last], 0, 4), _mix(form, 0, 5), _mix(size, 0, 6),
    ])
    rows = np.concatenate([row, row[pair], row[first], row[last], np.arange(len(n)), np.arange(len(n))])
    return slots, rows


def _scores(slots: np.ndarray, rows: np.ndarray, n: int, *weights: np.ndarray) -> list[np.ndarray]:
    # A long line has many features; the root keeps their sum comparable with a short line's.
    norm = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    return [3 * np.bincount(rows, w[slots], n) / norm for w in weights]


#: Steps of the furniture's and of the headings' weights.
STEPS = (60, 40)


def _fit(slots, rows, y, weight, steps: int = STEPS[0]) -> np.ndarray:
    """Logistic regression by AdaGrad over all rows at once; weights are per slot."""
    out = np.zeros(_SLOTS, "f4")
    n = len(y)
    if not len(slots):
        return out
    used, at = np.unique(slots, return_inverse=True)  # the weights of all others stay 0
    order = np.argsort(rows, kind="stable")
    at, rows = at[order], rows[order]
    lines, first, size = np.unique(rows, return_index=True, return_counts=True)
    norm, y, weight = 3 / np.sqrt(size), y[lines], weight[lines]
    place = np.repeat(np.arange(len(lines)), size)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-3)
    for _ in range(steps):
        z = norm * np.add.reduceat(w[at], first)
        err = weight * (1 / (1 + np.exp(-z)) - y) * norm
        step(w, g2, np.bincount(at, err[place], len(used)) / n)
    out[used] = w
    return out


def step(w: np.ndarray, g2: np.ndarray, gradient: np.ndarray) -> None:
    """One step of AdaGrad, in place."""
    g = gradient + 2e-7 * w
    g2 += (g * 1e3) ** 2
    w -= 0.5 * g * 1e3 / np.sqrt(g2)


def is_long(toks: list[str], line: str) -> bool:
    return len(toks) >= 14 and len(line) >= WIDE


#: Characters of a long line, and what stands after the tokens of a packed line that has as many.
WIDE, _WIDE_MARK = 36, "\x01"


class _Packs(dict):
    """Packed short lines, remembered: furniture comes again and again."""

    def __missing__(self, line: str) -> str:
        if len(self) >= 50_000:
            self.clear()
        out = self[line] = _pack_line(line)
        return out


_packs = _Packs()


def pack_line(line: str) -> str:
    """A line's tokens as they are written, with spaces between."""
    return _packs[line] if len(line) < 64 else _pack_line(line)


#: Of each byte of an ASCII line: 0 white space, 1 letter, 2 digit, 3 sign.
_KINDS = np.array([0 if chr(c).isspace() else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)], "u1")
#: Characters of lines that are packed at once.
_PACKED_AT_ONCE = 1 << 20


def pack_lines(lines: list[str]) -> list[str]:
    """``pack_line`` of each line; long ASCII lines are packed many at once."""
    out, held, size = list(lines), [], 0
    for i, x in enumerate(lines):
        if len(x) < 64:
            out[i] = _packs[x] if x else ""
        elif not x.isascii():
            out[i] = _pack_line(x)
        else:
            held.append(i)
            size += len(x)
            if size > _PACKED_AT_ONCE:
                _pack_ascii(out, held)
                held, size = [], 0
    if held:
        _pack_ascii(out, held)
    return out


def _pack_ascii(out: list[str], at: list[int]) -> None:
    """Packs those long ASCII lines of a list that stand at some places."""
    a = np.frombuffer("\n".join([out[i] for i in at]).encode(), "u1")
    kind = _KINDS[a]
    end = a == 10
    keep = np.flatnonzero((kind > 0) | end)
    a, kind, end = a[keep], kind[keep], end[keep]
    apart = (np.diff(keep) > 1) | (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    apart &= ~(end[1:] | end[:-1])
    place = np.arange(len(a), dtype="i4")
    place[1:] += np.cumsum(apart, dtype="i4")
    packed = np.full(int(place[-1]) + 1 if len(a) else 0, 32, "u1")
    packed[place] = a
    for i, x in zip(at, packed.tobytes().decode().split("\n")):
        out[i] = f"{x} {_WIDE_MARK}"


def _pack_line(line: str) -> str:
    out = " ".join(_ascii_tokens(line) if line.isascii() else _any_tokens(line))
    return f"{out} {_WIDE_MARK}" if len(line) >= WIDE else out


def pack(text: str) -> str:
    """The non-blank lines of a text, packed: tokens are found once and then only split."""
    return "\n".join([pack_line(x) for l in text.split("\n") if (x := l.strip())])


class Spellings(dict):
    """The number of each word as it is written; ``words`` has them by number, ``low`` the number of each
    one's lower case (-1 for what is no word: digits, the mark of wide lines, nothing), ``long`` whether it
    has more than one character."""

    def __init__(self):
        self.words: list[str] = []
        self.low: list[int] = []
        self.long: list[bool] = []

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self.words)
        self.words.append(w)
        self.long.append(len(w) > 1)
        self.low.append(-1)
        if w and not w[0].isdigit() and w != _WIDE_MARK:
            low = w.lower()
            self.low[k] = k if low == w else self[low]
        return k

    def pages(self, packed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, words, whether the word stands there in lower case) of packed texts, each word of a text
        once; words are numbers of lower case."""
        seen = [set(x.replace("\n", " ").split(" ")) for x in packed]
        n = np.fromiter(map(len, seen), "i8", len(seen))
        code = np.fromiter(map(self.__getitem__, chain.from_iterable(seen)), "i8", n.sum())
        at, low = np.repeat(np.arange(len(seen)), n) * len(self.words), np.array(self.low, "i8")[code]
        key = np.sort((2 * (at + low) + (low != code))[low >= 0])  # a word as it is in lower case stands first
        key = key[np.flatnonzero(np.diff(key >> 1, prepend=-1))]
        once = key >> 1
        return once // max(len(self.words), 1), once % max(len(self.words), 1), key & 1 == 0


@dataclass
class Keyed:
    """The lines of one page: ``cross`` and ``within`` are the keys of their templates, across sites
    and within one; ``counts`` and ``own`` tell which of them count."""

    toks: list[list[str]]
    cross: list[int]
    within: list[int]
    counts: list[bool]
    own: list[bool]
    long: list[bool]
    hosted: int
    after: int | None
    start: int | None
    #: The numbers of each line's words.
    codes: list[tuple[int, ...]]

    @property
    def longest(self) -> int | None:
        """The key of the line with the most tokens, the first of them."""
        return self.within[max(range(len(self.toks)), key=lambda i: len(self.toks[i]))] if self.toks else None


_digits = re.compile(r"\d+").sub


class Numbers(dict):
    """The numbers of words: of those that templates keep, 1 for digits, 0 for all others."""

    def __init__(self, *words):
        super().__init__(*words)
        self._lines: dict[str, tuple] = {}

    def __missing__(self, word: str) -> int:
        return int(word[0].isdigit())

    def line(self, packed: str) -> tuple:
        """(tokens, their numbers, key across sites, whether that counts, whether a word begins with a letter,
        whether it is long, the line with digits masked) of a packed line in lower case. What stands
        for a short line is remembered."""
        if len(packed) >= 64:
            return self._line(packed)
        out = self._lines.get(packed)
        if out is None:
            if len(self._lines) >= 50_000:
                self._lines.clear()
            out = self._lines[packed] = self._line(packed)
        return out

    def _line(self, packed: str) -> tuple:
        toks = packed.split(" ")
        wide = toks[-1] == _WIDE_MARK
        if wide:
            toks.pop()
            packed = packed[:-2]
        k = tuple(map(self.__getitem__, toks))
        counts = (len(k) - k.count(0)) * 2 >= len(k) and max(k, default=0) >= 2
        return toks, k, hash(k), counts, any(t[0].isalpha() for t in toks), wide and len(toks) >= 14, _digits("0", packed) if 1 in k else packed


def site_keys(site: str | None, toks: list[list[str]], digits: list[bool] | None = None) -> list[int]:
    """The keys of lines within their site: their tokens with digits masked. digits: whether each line has
    any, if that is known."""
    lines = [" ".join(t) for t in toks]
    return _site_keys(site, [_digits("0", x) if digits is None or digits[i] else x for i, x in enumerate(lines)])


def _site_keys(site: str | None, masked: list[str]) -> list[int]:
    head = f"{site}\n"
    return [xxhash.xxh3_64_intdigest((head + x).encode("utf-8", "replace")) - (1 << 63) for x in masked]


def keyed(site: str | None, title: str | None, packed: str, words: dict[str, int]) -> Keyed:
    """The keys of a restored and packed text's lines; ``words`` are those that templates keep."""
    lines = packed.split("\n") if packed else []
    number = words if isinstance(words, Numbers) else Numbers(words)
    toks, keys, cross, counts, own, long, masked = map(list, zip(*map(number.line, packed.lower().split("\n")))) if packed else ([] for _ in range(7))
    # long text besides the line itself
    hosted = int(sum(len(t) for t, lg in zip(toks, long) if lg) >= 60)
    title = pack_line(title.strip()) if title else None
    after = lines.index(title) + 1 if title and title in lines else None
    start = hash(keys[after][:2]) if after is not None and after < len(lines) and max(keys[after][:2], default=0) > 1 else None
    return Keyed(
        toks, cross, _site_keys(site, masked), counts, [site is not None and x for x in own], long, hosted, after, start, keys,
    )


def sidebar_runs(state: list[int], long: list[bool], size: list[int]):
    """(line, end) of each possible heading below the text: the end of its run of short lines, or 0.

    A run ends at the next furniture or at the end of the page; one that meets long text, or that
    has no line, is none.
    """
    seen_long = False
    for i in range(len(state)):
        if long[i]:
            seen_long = True
        if state[i] == 1 and seen_long and size[i] <= 13:
            j = i + 1
            while j < len(state) and state[j] == 0 and not long[j]:
                j += 1
            yield i, j if j - i > 1 and (j == len(state) or state[j] == 1) else 0


@dataclass
class Corpus:
    """Statistics of all records (``templates.count``), for the lines of some of them.

    ``cross`` and ``within`` hold 1 for furniture and -1 for content by template key.
    """

    words: dict[str, int]
    cross: dict[int, int]
    within: dict[int, int]
    heads: set[int]
    starts: set[int]
    #: The pages, if their keys are known already.
    docs: list[Keyed] | None = None


def labels(after: int | None, start: int | None, state: list[int], head: list[bool], long: list[bool], size: list[int], starts: set[int]) -> list[int]:
    """1 for each line of a page that is furniture by what all records show, -1 for content, 0 for others.

    state: 1 and -1 for lines whose template is furniture or content; head: whether it is a heading
    of sidebars; long: whether the line is; size: its tokens.
    """
    long = [lg and s != 1 for lg, s in zip(long, state)]
    y = [0] * len(state)
    for i, j in sidebar_runs(state, long, size):
        if j and head[i]:
            y[i + 1 : j] = [1] * (j - i - 1)
    top = after - 1 if after is not None else None
    between = None
    for i, s in enumerate(state):
        if s:
            y[i] = s
            if s == 1:
                between = None
        elif i == top:
            y[i] = -1
            between = None
        elif long[i]:
            y[i] = -1
            if between is not None:
                y[between:i] = [-1] * (i - between)
            between = i + 1
        elif top is not None and i < top:
            y[i] = 1
        elif i == after and start in starts:
            y[i] = 1
    return y


#: Tokens from which on a line weighs half: long lines are many and easy, what is short decides.
EASY = 14


def fit(records: list[tuple[str | None, str | None, str]], corpus: Corpus) -> BodyModel:
    """The model from (site, title, text) of some pages, texts already restored, and what the whole
    corpus shows of their lines; ``weights.fit`` takes those of all records. Empty: no furniture."""
    if not records:
        return BodyModel()
    docs = corpus.docs if corpus.docs is not None else [keyed(site, title, pack(text), corpus.words) for site, title, text in records]
    state = [[corpus.cross.get(c) or corpus.within.get(f, 0) for c, f in zip(d.cross, d.within)] for d in docs]
    heads = [[(c if c in corpus.cross else f) in corpus.heads for c, f in zip(d.cross, d.within)] for d in docs]
    label = np.array([v for d, st, hd in zip(docs, state, heads) for v in labels(d.after, d.start, st, hd, d.long, [len(t) for t in d.toks], corpus.starts)])
    lines = [t for d in docs for t in d.toks]
    slots, rows = _features(lines, [ends(l) for _, _, text in records for l in text.split("\n") if l.strip()], corpus.words)
    weight = np.where(label != 0, 1.0, 0.0)
    weight = np.where(np.fromiter(map(len, lines), "i8", len(lines)) >= EASY, 0.5 * weight, weight)
    model = BodyModel(corpus.words)
    model.furniture = _fit(*_only(slots, rows, weight > 0), (label > 0).astype("f8"), weight)
    known_ = np.array([s for row in state for s in row]) == 1
    model.heading = _fit(*_only(slots, rows, known_), np.array([h for row in heads for h in row], "f8"), known_.astype("f8"), STEPS[1])
    return model


def _only(slots: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the lines that are kept."""
    here = keep[rows]
    return slots[here], rows[here]


#: Weights: tie to the neighbour of the same form, to another neighbour, to a sidebar's heading;
#: cost that content has by itself, and of the line that repeats the title.
SAME, OTHER, HANG, BIAS, TITLE = 1.5, 0.35, 4.2, 0.2, 4.0
#: A line of such a cost is certain, and the cost it then has besides.
SURE, FIX = 2.0, 50.0
#: Cost below which a line may be a title that no field names.
UNSURE = 3.2


def _max_flow(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut of a small graph: True for nodes on the source's side. Shortest augmenting paths."""
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in range(n):
        if source[v] > 0:
            add(s, v, source[v], 0.0)
        if sink[v] > 0:
            add(v, t, sink[v], 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in out[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path, v = [], s
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(out[v]):
                path.append(out[v][at[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1
            else:
                break


def cut_page(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a line is furniture; cost > 0 speaks for furniture.

    A node whose cost exceeds the sum of its edges keeps its label in every minimum cut; only the
    connected rest is left to the flow.
    """
    n = len(cost)
    tie = [0.0] * n
    for a, b, w in edges:
        tie[a] += w
        tie[b] += w
    label = [c > 0 if abs(c) > t else None for c, t in zip(cost, tie)]
    if None not in label:
        return label
    open_ = [i for i in range(n) if label[i] is None]
    place = {v: k for k, v in enumerate(open_)}
    src, snk, inner = [max(cost[v], 0.0) for v in open_], [max(-cost[v], 0.0) for v in open_], []
    for a, b, w in edges:
        x, y = place.get(a), place.get(b)
        if x is not None and y is not None:
            inner.append((x, y, w))
        elif x is not None or y is not None:
            k, other = (x, b) if x is not None else (y, a)
            (src if label[other] else snk)[k] += w
    for v, side in zip(open_, _max_flow(len(open_), src, snk, inner)):
        label[v] = side
    return label


#: What a line that recurs within its site, beside long text, has more of furniture.
SITE = 2.0


def label_lines(docs: list[Lines], titles: list[str | None], model: BodyModel, support: list[tuple[str | None, set[int]]] | None = None, packed: list[str] | None = None) -> list[list[tuple[str, bool, bool, bool]]]:
    """For each text its lines as (restored, damaged, whole, furniture); blank lines are content.

    ``support`` holds for each text its site and the keys of lines that are the site's own
    furniture by count, ``packed`` the packed text, if they are known.
    """
    out = [[(*x, False) for x in doc] for doc in docs]
    lines, stops, where = [], [], []
    for d, doc in enumerate(docs):
        for i, (l, _, _) in enumerate(doc):
            if l and not l.isspace():
                if packed is None:
                    lines.append(tokens(l))
                stops.append(ends(l))
                where.append((d, i))
    if packed is not None:
        lines = [t[:-1] if t[-1] == _WIDE_MARK else t for p in packed if p for t in [l.split(" ") for l in p.lower().split("\n")]]
    if not where:
        return out
    flat, n = _numbered(lines, model.words)
    slots, rows = features(flat, n, np.array(stops, "i8"))
    digits = np.bincount(np.repeat(np.arange(len(n)), n)[flat == 1], minlength=len(n)) > 0
    furn, head = _scores(slots, rows, len(lines), model.furniture, model.heading)
    furn, head = np.clip(furn, -7, 7).tolist(), head.tolist()
    k = 0
    while k < len(where):
        d = where[k][0]
        e = k
        while e < len(where) and where[e][0] == d:
            e += 1
        own = [docs[d][i][0].strip() for _, i in where[k:e]]
        size = [len(l) for l in lines[k:e]]
        title = titles[d].strip() if titles[d] else None
        cost = [f - BIAS for f in furn[k:e]]
        top = own.index(title) if title in own else -1
        if top < 0:  # no title is known: the first line above the text that isn't clearly furniture
            for i in range(len(own)):
                if size[i] >= 14 or head[k + i] > 1:
                    break
                if cost[i] < UNSURE and size[i] >= 3:
                    top = i
                    break
        if support is not None and support[d][1]:
            site, known = support[d]
            open_ = [i for i in range(len(own)) if cost[i] <= SURE]
            for i, key in zip(open_, site_keys(site, [lines[k + i] for i in open_], digits[[k + i for i in open_]])):
                if key in known:
                    cost[i] += SITE
        if top >= 0:
            cost[top] -= TITLE
        # What is certain is not bent by its neighbours.
        cost = [c + FIX if c > SURE else c - FIX if c < -SURE - 4 else c for c in cost]
        edges = []
        m = len(own)
        for i in range(m - 1):
            short = size[i] < 14 and size[i + 1] < 14 and top not in (i, i + 1)
            same = short and stops[k + i] == stops[k + i + 1] and abs(size[i] - size[i + 1]) <= 4
            if short:
                edges.append((i, i + 1, SAME if same and cost[i] < 2.5 and cost[i + 1] < 2.5 else OTHER))
        hang = None  # the heading above, until the next furniture or long line
        for i in range(m):
            if head[k + i] > 1 and cost[i] > 0:
                hang = i
            elif size[i] >= 14 or i == top or head[k + i] > 1 or cost[i] > FIX:
                hang = None
            elif hang is not None:
                edges.append((hang, i, HANG))
        for (_, i), furniture in zip(where[k:e], cut_page(cost, edges)):
            out[d][i] = (*docs[d][i], furniture)
        k = e
    return out
