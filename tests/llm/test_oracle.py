"""Every training-data query against its SQL, or at least run, over the smallest tables."""

import pytest

from foliant.llm import catalogue
from tests.conftest import oracle, rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
COLUMNS = {"p1_found": ["kind", "first_id", "copy_id"], "p2_found": ["image_id_a", "image_id_b"], "p4_found": ["seq", "line_no"], "p5_found": ["origin", "id_a", "id_b"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "line_no", "lang"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    if name == "p8_found":
        folder = "/root/testdata/sf0.01"  # of the smallest tables' texts a language model learns too little
    df = QUERIES[name](spark, folder)
    got = rows(df, *sorted(df.columns))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(got) == len(set(got))
    if name in SQL:
        names, want = oracle(SQL[name], folder)
        assert sorted(df.columns) == names
        assert got == want
    else:
        assert got
