"""Whole texts in several encodings come back as they were."""

import pytest

from weftline.queries import QUERIES
from weftline.queries_web import _encoded

HOW = {
    0: ("utf-8", "utf-8 decoded cleanly"), 1: ("utf-8-sig", "bom"), 2: ("utf-16-le", "bom"), 3: ("utf-16-be", "bom"), 4: ("utf-32-be", "bom"),
    5: ("utf-8", "http header"), 6: ("utf-8", "meta tag"), 7: ("iso-8859-1", "http header"),
}


@pytest.fixture
def folder(spark, data, tmp_path):
    """The records of the test table and more in Latin letters, one of them long."""
    more = [(10_000 + i, f"Überall naïve café {i}\n" * (3000 if i == 7 else 2)) for i in range(60)]
    own = spark.read.parquet(f"{data}/extracted.parquet").select("ord", "text")
    own.unionByName(spark.createDataFrame(more, "ord bigint, text string")).write.parquet(f"{tmp_path}/extracted.parquet")
    return str(tmp_path)


def test_texts_survive_their_encoding(spark, folder):
    sent = {r.ord: r for r in _encoded(spark, folder).collect()}
    got = QUERIES["charset_texts"](spark, folder).collect()
    assert len(got) == len(sent) and {r.kind for r in sent.values()} == set(range(9))
    for r in got:
        s = sent[r.ord]
        if s.kind < 8:
            want = (s.sent, *HOW[s.kind])
        else:  # no declaration holds: UTF-8 if the bytes are, else windows-1252
            raw = s.sent.encode("latin-1")
            try:
                want = (raw.decode("utf-8"), "utf-8", "utf-8 decoded cleanly")
            except UnicodeDecodeError:
                want = (raw.decode("windows-1252", "replace"), "windows-1252", "fallback")
        text = r.text.removeprefix("﻿") if s.kind in (2, 3, 4) else r.text  # these decoders keep the mark
        assert (text, r.encoding, r.source) == want, (r.ord, s.kind)
