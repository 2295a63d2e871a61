"""Reading pages: from responses to Markdown rows, one for each request, errors as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from .frontier import robots_allowed


def read(requests: DataFrame, responses: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(ord, url, final_url, status, title, markdown, words, n_links, encoding, error).

    requests: (ord, url); responses: (url, final_url, status, content_type, body, error), one per
    url; rules: a robots table as of ``frontier.robots_rules``. A url that robots forbid, that has no
    response, failed, or is no HTML has its reason in ``error`` and no Markdown; the pages that
    remain are parsed once.
    """
    rows = requests.select("ord", "url").join(responses, "url", "left")
    if rules is not None:
        rows = rows.join(robots_allowed(requests, rules), "url", "left")
    else:
        rows = rows.withColumn("allowed", F.lit(True))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    error = (
        F.when(~F.coalesce("allowed", F.lit(True)), "blocked by robots.txt")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status").isNull(), "no response")
        .when(~F.col("status").between(200, 299), F.concat(F.lit("http "), F.col("status").cast("string")))
        .when(~kind.contains("html"), F.concat(F.lit("not html ("), kind, F.lit(")")))
    )
    body = F.when(F.col("_e").isNull(), F.col("body"))
    got = rows.withColumn("_e", error).withColumn("_b", body).withColumn("x", html.extracted("_b", "url", "content_type"))
    text = html.to_markdown("_b", "url", "content_type")
    words = F.when(F.col("_b").isNotNull(), F.size(F.filter(F.split("markdown", "\\s+"), lambda w: w != "")))
    return got.withColumn("markdown", text).select(
        "ord", "url", "final_url", "status", "x.title", "markdown", words.alias("words"), F.when(F.col("x").isNotNull(), F.size("x.links")).alias("n_links"), "x.encoding", F.col("_e").alias("error")
    )
