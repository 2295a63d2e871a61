"""Languages are learned from the corpus, and pages of any length are judged."""

import numpy as np

from foreign import NATURAL, PILES, SHORT
from weftline.llm import pages, spam


def test_pages_in_other_languages_are_no_spam_and_short_piles_are(spark, data):
    own = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/extracted.parquet").select("ord", "url", "title", "text", "main_text")
    texts = [*NATURAL.values(), *SHORT, *PILES]
    added = spark.createDataFrame([(10**9 + i, f"http://new{i}.example/p", None, t, t) for i, t in enumerate(texts)], "ord bigint, url string, title string, text string, main_text string")
    found = {r.ord - 10**9 for r in spam.found(pages.Judge(own.unionByName(added), "main_text")).collect() if r.ord >= 10**9}
    assert found == set(range(len(NATURAL) + len(SHORT), len(texts)))


def test_groups_and_function_words():
    rng = np.random.default_rng(1)
    said = {"a": "zu ka ri mo ta".split(), "b": "il po ve su na".split()}
    nouns = {k: [f"{k}noun{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)] for k in said}
    pages_ = []
    for i in range(60):
        k = "ab"[i % 2]
        pages_.append([" ".join(str(x) for w in rng.choice(nouns[k], 10) for x in (rng.choice(said[k]), w)) + "." for _ in range(6)])
    known = {w: 2 for k in said for w in said[k] + nouns[k]}
    found = spam.Languages(pages_, known)
    assert len(found.function) == 2
    assert {w for f in found.function.values() for w in f} <= {w for v in said.values() for w in v}
    one, two = (found.of((pages_[i][0]).rstrip(".").split()) for i in (0, 1))
    assert one != two and found.of("wholly other words stand here and there".split()) == spam.UNKNOWN
    assert spam.Languages([], {}).of(["x"]) == spam.UNKNOWN
