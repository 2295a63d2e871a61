"""Weights of the line classifiers, fitted on the labelled lines of all records.

Lines that look alike to the classifiers (the same numbered words, the same end) are counted
together and kept as the numbers of their words. Those of some lines at a time have their different
pairs of neighbouring words listed once, so that a word costs a pass no more than a look into that list.
Every step of the fit is a pass over them that adds up the gradient; what reaches the driver is a vector
of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import dealt_files, few, small, staging, sweep
from . import body, templates
from .residue import sums

#: Steps after which the driver's garbage is collected.
SWEEP = 6
#: Words of the pages whose lines are compared, of the lines in a row, and of those whose pairs are
#: listed and added up at once, about.
WORDS, ROW, AT_ONCE = 600_000, 1000, 260_000
_NAMES = ["kind", "codes", "sizes", "forms", "furniture", "weight"]
_PAIRED = "kind int, word binary, pair binary, place binary, sizes binary, forms binary, furniture binary, weight binary"
_SIZES, _FORMS = 8, 64


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Bytes of the stretches of an array."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype("i4")), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """What ``_packed`` packed."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "u1")[at[0] : at[-1]].view(kind) if len(column) and at[-1] > at[0] else np.zeros(0, kind)


def _alike(flat: np.ndarray, n: np.ndarray, ends: np.ndarray, y: np.ndarray, state: np.ndarray, head: np.ndarray, code: str):
    """Rows of lines with the sums of their labels and weights; kind 0 is for furniture, 1 for headings."""
    weight = np.where(y != 0, np.where(n >= body.EASY, 0.5, 1.0), 0.0)
    use = np.flatnonzero((weight > 0) | (state == 1))
    if not len(use):
        return
    start = np.cumsum(n) - n
    place = np.arange(len(flat)) - np.repeat(start, n)
    mixed = (flat.astype("u8") + np.uint64(1)) * (place.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), start) * np.uint64(2) + ends.astype("u8")
    rare = np.add.reduceat((flat == 0).astype("i8"), start) / n
    form = body.forms(n, rare, ends.astype("i8"))
    _, first, which = np.unique(key[use], return_index=True, return_inverse=True)
    first = use[first]
    count = lambda v: np.bincount(which, v[use], len(first))
    known = (state == 1).astype("f8")
    for kind, top, every in ((0, count(weight * (y > 0)), count(weight)), (1, count(known * head), count(known))):
        keep = every > 0
        lines = first[keep]
        if not len(lines):
            continue
        size = n[lines]
        stop = np.cumsum(size)
        words = flat[np.repeat(start[lines] - (stop - size), size) + np.arange(stop[-1])]
        edge = np.concatenate([np.flatnonzero(np.diff((stop - size) // ROW, prepend=-1)), [len(lines)]])
        each = [words.astype(code), size.astype("i4"), form[lines].astype("u1"), top[keep].astype("f4"), every[keep].astype("f4")]
        at = [np.concatenate([[0], stop])[edge], *[edge] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge) - 1, kind, "i4")), *map(_packed, each, at)], names=_NAMES)


def _paired(b: pa.RecordBatch, code: str) -> pa.RecordBatch:
    """Rows of lines with their pairs: each different word and next word once, as the word and the pair's slot
    (a slot of its own at a line's end), and for each word of the lines the place of its pair among them."""
    kinds, out = b.column(0).to_numpy(zero_copy_only=False), []
    for kind in np.unique(kinds).tolist():
        own = b.filter(pa.array(kinds == kind))
        flat, n, *rest = (_unpacked(own.column(k), t) for k, t in enumerate((code, "i4", "u1", "f4", "f4"), 1))
        stop = np.cumsum(n, dtype="i8")
        edge = [0, *(np.flatnonzero(np.diff(stop // AT_ONCE)) + 1).tolist(), len(n)]
        half, key_ = (16, "u4") if code == "u2" else (32, "u8")
        for i, j in zip(edge, edge[1:]):
            words = flat[stop[i] - n[i] : stop[j - 1]].astype(key_)
            key = words << half
            key[:-1] |= words[1:] + 1
            key[stop[i:j] - stop[i] + n[i] - 1] &= ~np.array((1 << half) - 1, key_)
            each, place = np.unique(key, return_inverse=True)
            word, after = (each >> half).astype("i8"), (each & np.array((1 << half) - 1, key_)).astype("i8")
            pair = np.where(after > 0, body._mix(word, after - 1, 2), body._SLOTS)
            row = [word.astype(code), pair.astype("u4"), place.astype("u2" if len(each) <= 1 << 16 else "u4"), n[i:j], *(v[i:j] for v in rest)]
            out.append((kind, *(v.tobytes() for v in row)))
    names = [c.split()[0] for c in _PAIRED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*out))], names=names)


def labelled(counts: templates.Counts) -> DataFrame:
    """The labelled lines of all records."""
    code, starts = templates.code_kind(counts.words), counts.starts
    every = counts.judged.sparkSession.sparkContext.broadcast(frozenset(counts.heads.toArrow()["key"].to_pylist()) if few(counts.heads) else None)

    def run(batches):
        for b in batches:
            codes, ends, after, start, heads = (b.column(c).to_pylist() for c in ("codes", "ends", "after", "start", "heads"))
            edge, (keys, sizes, longs, states) = templates.flat_lines(b.column("lines"), "key", "n", "long", "s")
            y, head, done, held = [], [], 0, 0
            for p in range(b.num_rows):
                own, known = slice(edge[p], edge[p + 1]), set(heads[p] or ()) if every.value is None else every.value
                mine = [k in known for k in keys[own]] if known else [False] * (edge[p + 1] - edge[p])
                y += body.labels(after[p], start[p], states[own], mine, longs[own], sizes[own], starts)
                head += mine
                held += len(codes[p])
                if held >= WORDS * np.dtype(code).itemsize or p == b.num_rows - 1:
                    part = slice(edge[done], edge[p + 1])
                    flat = np.frombuffer(b"".join(codes[done : p + 1]), code).astype("i8")
                    stops = np.frombuffer(b"".join(ends[done : p + 1]), "u1")
                    for lines in _alike(flat, np.array(sizes[part], "i8"), stops, np.array(y, "i8"), np.array(states[part], "i8"), np.array(head, "f8"), code):
                        yield _paired(lines, code)
                    y, head, done, held = [], [], p + 1, 0

    if every.value is None:
        furniture = counts.judged.select("row", F.explode(F.filter("lines", lambda x: x["s"] == 1)).alias("l")).select("row", "l.key")
        heads = furniture.join(small(counts.heads), "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("heads"))
        pages = counts.judged.join(heads, "row", "left")
    else:
        pages = counts.judged.withColumn("heads", F.lit(None).cast("array<bigint>"))
    return pages.select("codes", "ends", "after", "start", "lines", "heads").mapInArrow(run, _PAIRED)


class _Slots:
    """The slots of the features of words, forms and sizes. Arrays of the size of some lines' words are kept
    and used again."""

    def __init__(self, words: int):
        every = np.arange(words)
        self.word, self.first, self.last = (body._mix(every, 0, k) for k in (1, 3, 4))
        self.form, self.size = body._mix(np.arange(_FORMS), 0, 5), body._mix(np.arange(_SIZES), 0, 6)
        self.room: dict[str, np.ndarray] = {}

    def array(self, name: str, n: int, kind: str) -> np.ndarray:
        held = self.room.get(name)
        if held is None or len(held) < n:
            held = self.room[name] = np.empty(max(n, 2 * AT_ONCE), kind)
        return held[:n]


def _add_lines(sums_: dict, pairs: np.ndarray, places: _Slots, table: dict, w: np.ndarray, word, pair, place, n, form, top, every) -> None:
    """Adds the gradient of a row of lines to the sums by word, form and size and to those by slot of pairs."""
    at, ratio = places.array("at", len(place), "intp"), places.array("ratio", len(place), "f4")
    np.copyto(at, place)
    both = table["word"].take(word)
    both += w.take(pair)
    both.take(at, mode="clip", out=ratio)
    stop = np.cumsum(n)
    begin, end, size = stop - n, stop - 1, form >> 3
    z = np.add.reduceat(ratio, begin, dtype="f8")
    first, last = word[at[begin]], word[at[end]]
    z += table["first"][first] + table["last"][last] + table["form"][form] + table["size"][size]
    norm = 3 / np.sqrt(2 * n + 3)
    error = (every / (1 + np.exp(-norm * z)) - top) * norm
    each = np.bincount(at, np.repeat(error, n), len(word))
    np.add.at(pairs, pair, each)
    for k, of, e in (("word", word, each), ("first", first, error), ("last", last, error), ("form", form, error), ("size", size, error)):
        sums_[k] += np.bincount(of, e, len(table[k]))


def _gradient(lines: DataFrame, now, code: str, words: int, open_: tuple[int, ...] = (0, 1), files=None) -> np.ndarray:
    """The gradients of the classifiers in ``open_`` at the weights ``now``, summed over all lines; files: as
    ``sums`` takes them."""
    slots = body._SLOTS

    def add(total, b):
        places = _places(words)
        if b.schema.names == _NAMES:
            b = _paired(b, code)
        kinds = b.column(0).to_pylist()
        for kind in sorted({*kinds} & {*open_}):
            w = np.append(now.value[kind], np.float32(0))
            table = {k: w[v] for k, v in (("word", places.word), ("first", places.first), ("last", places.last), ("form", places.form), ("size", places.size))}
            sums_ = {k: np.zeros(len(v)) for k, v in table.items()}
            pairs = np.zeros(slots + 1)
            for i in (i for i, k in enumerate(kinds) if k == kind):
                word, pair, place, n, form, top, every = (c[i].as_buffer() for c in b.columns[1:])
                n, form = np.frombuffer(n, "i4"), np.frombuffer(form, "u1")
                place = np.frombuffer(place, f"u{place.size // int(n.sum())}")
                own = np.frombuffer(word, code), np.frombuffer(pair, "u4"), place, n, form, np.frombuffer(top, "f4"), np.frombuffer(every, "f4")
                _add_lines(sums_, pairs, places, table, w, *own)
            mine = total[kind * slots : (kind + 1) * slots]
            mine += pairs[:slots]
            for k, v in sums_.items():
                mine += np.bincount(getattr(places, k), v, slots)

    return sums(lines, 2 * slots, add, "f4", *(() if files is None else (files,))).reshape(2, slots)


_made: dict[int, _Slots] = {}


def _places(words: int) -> _Slots:
    if words not in _made:
        _made.clear()
        _made[words] = _Slots(words)
    return _made[words]


def fit(counts: templates.Counts) -> body.BodyModel:
    """The model of all records' lines; the same as ``body.fit`` gives for all of them at once."""
    model, code = body.BodyModel(counts.words), templates.code_kind(counts.words)
    context, n = counts.lines.sparkSession.sparkContext, body._SLOTS
    lines = counts.lines.agg(F.sum(F.size("lines")).alias("n")).first().n
    if not lines:
        return model
    w, g2 = np.zeros((2, n)), np.full((2, n), 1e-3)
    with staging(labelled(counts), "uncompressed") as all_:
        dealt = dealt_files(all_, context.defaultParallelism)
        files = context.broadcast(dealt) if dealt else None
        for k in range(max(body.STEPS)):
            if k % SWEEP == 0:
                sweep(all_.sparkSession)
            now = context.broadcast(w.astype("f4"))
            open_ = tuple(kind for kind, steps in enumerate(body.STEPS) if k < steps)
            gradient = _gradient(all_.where(F.col("kind").isin(*open_)), now, code, len(counts.words) + 2, open_, files) / lines
            now.destroy()
            for kind in open_:
                body.step(w[kind], g2[kind], gradient[kind])
    model.furniture, model.heading = w.astype("f4")
    return model
