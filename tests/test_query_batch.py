"""The batch of all queries scores as each query by itself does."""

from weftline.operators import search as S
from weftline.plans.shared import table
from weftline.queries import QUERIES


def test_batch_equals_single_queries(spark, data):
    docs = table(spark, data, "documents")
    titles = {r.doc_id: r.title for r in docs.where("doc_id % 50 = 0").select("doc_id", "title").collect()}
    got = QUERIES["bm25_topk"](spark, data).collect()
    assert {r.query_id for r in got} == {q for q, t in titles.items() if S.parse_query(t or "")[0]}
    plain = {q: (t or "").replace('"', " ") for q, t in titles.items()}
    want = S.Index(docs).search(plain).collect()
    key = lambda rows: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in rows)
    assert key(got) == key(want)
