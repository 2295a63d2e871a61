"""Every corpus query runs, with a stable schema, and equals its SQL twin where it has one."""

import pytest

from helpers import rows, sql_rows
from weftline.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": {"ord_a": "bigint", "ord_b": "bigint"}, "p3_found": {"ord": "bigint", "line_no": "int"}, "p4_found": {"ord": "bigint"}, "p5_found": {"ord": "bigint"},
    "p6_found": {"ord": "bigint", "line_no": "int"}, "p7_found": {"ord": "bigint"}, "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows(df)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len(got) == len(set(got)), "a case stands once"
    if name in SQL:
        assert got == sql_rows(duck, SQL[name])
