"""A lexicon of frequent words as a minimal acyclic transducer, and exact encoding with it.

Words (byte strings) are compiled, in sorted order, into the smallest automaton that shares both
prefixes and suffixes. Each arc carries the number of words that sort before it among those through
its state; the sum along a word's path is the word's number, and that number leads to its token
ids. The automaton is one file of flat arrays, which workers map into memory and share.

Words that are not in it are merged exactly by the tokenizer's own ranks, so the lexicon changes
the speed and never the ids.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from itertools import chain

import numpy as np
import regex
import tiktoken

#: Where the public vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"

#: The public pattern that splits a text before merging, with white space spelled out.
_WS = r"\t\n\x0b\f\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

_words = regex.compile(PATTERN).findall
#: A space between two characters that are no white space always starts a word of PATTERN, whatever
#: stands around it, so a text may be split there first.
split_chunks = re.compile(r"(?<=\S) (?=\S)").split


@functools.lru_cache(maxsize=4)
def encoding(name: str, folder: str = TOKENIZERS) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN_FOR_ENGINE, mergeable_ranks=ranks, special_tokens={})


#: The same pattern in the tokenizer engine's own notation.
PATTERN_FOR_ENGINE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``entries`` (word -> ids) as the bytes of its file."""
    words = sorted(entries)
    # A state under construction is [final, {byte: state}]; finished ones are shared by signature.
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, {}]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(sorted(arcs.items())))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1][last[len(path) - 1]] = register[key]

    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        for _ in w[k:]:
            path.append([False, {}])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], tuple(sorted(path[0][1].items()))))
    below = [0] * len(states)
    first, label, target, skip, final = [0], [], [], [], []
    for n, (end, arcs) in enumerate(states):  # an arc's target always has a lower number
        seen = int(end)
        final.append(int(end))
        for b, to in arcs:
            label.append(b)
            target.append(to)
            skip.append(seen)
            seen += below[to]
        below[n] = seen
        first.append(len(label))
    ids = [entries[w] for w in words]
    parts = [
        np.array(first, "<i4"), np.array(target, "<i4"), np.array(skip, "<i4"),
        np.cumsum([0] + [len(x) for x in ids]).astype("<i4"), np.fromiter(chain.from_iterable(ids), "<i4"),
        np.array(label, "<u1"), np.array(final, "<u1"),
    ]
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, file: str):
        sizes = np.fromfile(file, "<i8", 7)
        raw, at, parts = np.memmap(file, "u1", "r"), 56, []
        for n, kind in zip(sizes, ("<i4",) * 5 + ("<u1",) * 2):
            width = np.dtype(kind).itemsize * int(n)
            parts.append(memoryview(raw[at : at + width]).cast("B" if kind == "<u1" else "i"))
            at += width
        self.first, self.target, self.skip, self.start, self.ids, self.label, self.final = parts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        first, label, target = self.first, self.label, self.target
        state, number = len(first) - 2, 0
        for b in word:
            lo, hi = first[state], first[state + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[state + 1] or label[lo] != b:
                return None
            number += self.skip[lo]
            state = target[lo]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.start[number] : self.start[number + 1]])


class Encoder(dict):
    """Token ids of texts; keeps the ids of short chunks it has met, up to ``KEEP`` of them."""

    KEEP, SHORT = 400_000, 48

    def __init__(self, name: str, lexicon: Lexicon | None = None, folder: str = TOKENIZERS):
        self.merge = encoding(name, folder)
        self.lexicon = lexicon
        self.words: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        got = self.words.get(w)
        if got is None:
            raw = w.encode()
            got = self.lexicon.get(raw) if self.lexicon is not None else None
            if got is None:
                got = tuple(self.merge._encode_single_piece(raw))
            if len(w) <= self.SHORT:
                if len(self.words) >= self.KEEP:
                    self.words.clear()
                self.words[w] = got
        return got

    def chunk(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.word, _words(text))))

    def __missing__(self, c: str) -> tuple[int, ...]:
        """Ids of a chunk that follows a space."""
        got = self.chunk(" " + c)
        if len(c) <= self.SHORT:
            if len(self) >= self.KEEP:
                self.clear()
            self[c] = got
        return got

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            first, *rest = split_chunks(text)
            out.extend(self.chunk(first))
            out.extend(chain.from_iterable(map(self.__getitem__, rest)))
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = split_chunks(text)
        return len(self.chunk(first)) + sum(map(len, map(self.__getitem__, rest)))


def word_counts(texts, flush: int = 300_000):
    """Batches of (word, count) over an iterable of texts; at most ``flush`` chunks are held."""
    from collections import Counter

    def words(counts: Counter) -> Counter:
        out: Counter = Counter()
        for c, n in counts.items():
            for w in _words(c):
                out[w] += n
        return out

    held: Counter = Counter()
    for text in texts:
        if text:
            first, *rest = split_chunks(text)
            held[first] += 1
            held.update([" " + c for c in rest])
            if len(held) > flush:
                yield words(held)
                held = Counter()
    if held:
        yield words(held)
