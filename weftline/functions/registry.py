"""SQL functions of the engine: ``register(spark)`` makes them usable in ``spark.sql``."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import ArrayType, StringType

from ..operators.frontier import agent_rules, decoded_path, sitemap_entries
from . import charset, html
from . import text as T
from . import url as U


@udtf(returnType="allow boolean, regex string, size int")
class RobotsRules:
    """Rules of a robots file for an agent: ``SELECT * FROM robots_rules(status, body, agent)``."""

    def eval(self, status: int, body: str, agent: str):
        for rule in agent_rules(status, body, agent or "")[2]:
            yield rule


@arrow_udf(ArrayType(StringType()))
def shingles(text: pa.Array) -> pa.Array:
    """All runs of four words of a text, repeats included."""
    out = []
    for t in text.to_pylist():
        w = re.findall(r"\w+", t.lower()) if t else []
        out.append([" ".join(w[i : i + T.SHINGLE]) for i in range(max(1, len(w) - T.SHINGLE + 1))] if w else [])
    return T.lists(out, pa.string())


@arrow_udf(ArrayType(StringType()))
def char_grams(term: pa.Array) -> pa.Array:
    """The character trigrams of a term between boundary marks."""
    grams = T.Grams()
    return T.lists([grams[t] if t is not None else [] for t in term.to_pylist()], pa.string())


def register(spark: SparkSession) -> None:
    """surt, tokens, shingles, char_grams, url_normalize, url_absolute, fold_exact, simhash64, html_extract, to_markdown, decode_body,
    sitemap_entries, decoded_path, and the table function robots_rules."""
    for name, f in {
        "url_normalize": U.canonical_url, "url_absolute": U.absolute_url, "fold_exact": T.fold_exact, "simhash64": T.simhash_exact,
        "html_extract": html.extracted, "to_markdown": html.to_markdown, "decode_body": charset.decoded, "sitemap_entries": sitemap_entries, "decoded_path": decoded_path,
    }.items():
        spark.udf.register(name, f)
    for name, f in {"tokens": T.terms_exact, "shingles": shingles, "char_grams": char_grams}.items():
        spark.udf.register(name, f)
    spark.udtf.register("robots_rules", RobotsRules)
    # surt stays an expression, so that Spark sees through it.
    part = lambda k: f"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\\\?([^#]*))?', {k})"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION surt(url STRING) RETURNS STRING RETURN concat(
      CASE WHEN lower(regexp_extract({part(2)}, '(?:[^@]*@)?([^:]*)', 1)) RLIKE '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' THEN regexp_extract({part(2)}, '(?:[^@]*@)?([^:]*)', 1)
        ELSE array_join(reverse(split(lower(regexp_extract({part(2)}, '(?:[^@]*@)?([^:]*)', 1)), '[.]')), ',') END,
      CASE WHEN regexp_extract({part(2)}, ':([0-9]+)$', 1) NOT IN ('', '0') THEN concat(':', regexp_extract({part(2)}, ':([0-9]+)$', 1)) ELSE '' END,
      ')', CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, CASE WHEN {part(4)} <> '' THEN concat('?', {part(4)}) ELSE '' END)""")
