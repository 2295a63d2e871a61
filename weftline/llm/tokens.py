"""Encoding of a whole corpus with a public tokenizer, and token counts."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, put_file
from . import lexicon as lx
from .encoding import most_frequent

#: Words in the lexicon at most; the frequent ones by count over all texts. Bounds the automaton.
LEXICON_WORDS = 50_000
#: Longer words are left to the exact merge.
LEXICON_WORD_CHARS = 40


@functools.lru_cache(maxsize=2)
def _encoder(name: str, folder: str, file: str | None) -> lx.Encoder:
    found = None
    if file:
        found = lx.Lexicon(SparkFiles.get(file))
    return lx.Encoder(name, found, folder)


def frequent_words(texts: DataFrame, column: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of PATTERN over all texts: whole steps of frequency, at most ``most``."""

    def count(batches):
        kept = (t for b in batches for t in b.column(0).to_pylist())
        for words in lx.word_counts(kept):
            short = {w: n for w, n in words.items() if len(w) <= LEXICON_WORD_CHARS}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], names=["word", "n"]
            )

    counts = cut(texts.select(column).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    return [r.word for r in most_frequent(counts, "n", most).select("word").collect()]


def build_lexicon(texts: DataFrame, column: str, name: str, folder: str = lx.TOKENIZERS, most: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon and gives it to every executor; the name of its file there."""
    spark = texts.sparkSession
    merge = lx.encoding(name, folder)
    words = {w.encode(): merge._encode_single_piece(w.encode()) for w in frequent_words(texts, column, most)}
    uri = put_file(spark, lx.compile_lexicon(words), f"lexicon-{os.urandom(6).hex()}.bin")
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[1]


def encode(
    texts: DataFrame, key: str = "doc_id", column: str = "text", name: str = "byte_bpe_50k", folder: str = lx.TOKENIZERS
) -> DataFrame:
    """(key, ids): token ids of every text, without special tokens.

    An empty and a null text have an empty list; strings of special tokens are ordinary text; other
    columns are ignored; repeated rows stay. The lexicon's words are counted over all texts.
    """
    file = build_lexicon(texts, column, name, folder)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        own = _encoder(name, folder, file)
        for b in batches:
            keys, col = b.column(0), b.column(1)
            at = 0
            while at < len(col):  # a few thousand texts at a time, fewer where they are long
                step = 512
                ids = [own.encode(t) if t else () for t in col.slice(at, step).to_pylist()]
                ends = np.zeros(len(ids) + 1, "i4")
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate([np.frombuffer(x, "i4") for x in ids if len(x)] or [np.zeros(0, "i4")])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, step), lists], names=[key, "ids"])
                at += step

    return texts.select(key, column).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(
    texts: DataFrame, column: str = "text", name: str = "byte_bpe_50k", folder: str = lx.TOKENIZERS, out: str = "n_tokens"
) -> DataFrame:
    """The given rows with ``column`` replaced by its number of tokens; null and empty have 0."""
    keep = [c for c in texts.columns if c != column]

    def run(batches):
        own = _encoder(name, folder, None)
        for b in batches:
            n = [own.count(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != column)
    return texts.select(*keep, column).mapInArrow(run, f"{schema}, {out} bigint")
