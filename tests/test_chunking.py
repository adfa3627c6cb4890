import pytest
from pyspark.sql import functions as F

from foliant.operators import chunking as C
from tests.conftest import rows


@pytest.mark.parametrize(("n", "sizes"), [(0, [0]), (400, [400]), (401, [400, 51]), (750, [400, 400]), (751, [400, 400, 51]), (1000, [400, 400, 300])])
def test_window_sizes(spark, n, sizes):
    df = C.prose_windows(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, t string"), "id", "t")
    assert [r.words for r in df.orderBy("window_no").collect()] == sizes


def test_windows_cover_and_overlap(spark):
    said = " ".join(f"w{i}" for i in range(1000))
    parts = [r.text.split() for r in C.prose_windows(spark.createDataFrame([(1, said)], "id int, t string"), "id", "t").orderBy("window_no").collect()]
    assert parts[0] + parts[1][50:] + parts[2][50:] == said.split() and parts[0][-50:] == parts[1][:50]


def test_short_text_is_unchanged(spark):
    df = spark.createDataFrame([(1, "a  b\n c"), (2, None), (None, "x")], "id int, t string")
    assert rows(C.prose_windows(df, "id", "t"), "item", "window_no", "text") == [(1, 0, "a  b\n c"), (2, 0, "")]


@pytest.mark.parametrize(("header", "hits"), [(["Bits"], 2), (["Description"], 1), (["Pin", "Function"], 0), (["Register", "Access"], 1), (["Symbol", "Type", "Name"], 2), ([], 0)])
def test_bit_field_header(spark, header, hits):
    df = spark.createDataFrame([(header,)], "h array<string>")
    assert df.select(C.header_hits(F.col("h")), C.looks_like_bit_fields(F.col("h"))).first()[:] == (hits, hits >= 2)


def sections(spark, items):
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(items)], "doc_id string, seq int, kind string, page_no int, text string")
    return [tuple(r) for r in C.sections(df).orderBy("island").select("text", "page_start", "page_end", "section_path").collect()]


def test_sections(spark):
    got = sections(spark, [("header", 1, " Intro "), ("text", 1, "a b"), ("text", 2, "c"), ("table", 3, "t"), ("text", 3, "d"), ("text", 5, "e")])
    assert got == [("a b c", 1, 3, "Intro"), ("d e", 3, 3, "Intro")]


def test_page_zero_falls_through(spark):
    assert sections(spark, [("text", 0, "x"), ("header", 7, "H")]) == [("x", 7, 7, "")]
    assert sections(spark, [("text", 0, "x")]) == [("x", 0, 0, "")]


def test_other_kinds_count_for_nothing(spark):
    assert sections(spark, [("text", 1, "a"), ("footer", 2, "f"), ("text", 3, None), ("picture", 4, None), ("text", 5, "b")]) == [("a ", 1, 4, ""), ("b", 5, 5, "")]
    assert sections(spark, [("header", 1, "only")]) == []


def test_unique_ids(spark):
    data = [(i, "d", "same", "structural", 1, 1, "s", None) for i in range(3)] + [(3, "d", "same", "structural", 1, 1, "s", {"a": "1"}), (4, None, None, None, None, None, None, {}), (0, "d", "same", "structural", 1, 1, "s", None)]
    got = C.unique_ids(spark.createDataFrame(data, "seq int, doc_id string, text string, chunk_type string, page_start int, page_end int, section_path string, meta map<string,string>")).orderBy("seq").collect()
    assert [(r.seq, r.occurrence) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 0)] and len({r.chunk_id for r in got}) == 5


def test_repaired_ids(spark):
    data = [(i, "x", "t", 1, 2, "s") for i in range(4)] + [(9, "y", None, None, None, None)]
    got = {r.seq: r.id for r in C.repaired_ids(spark.createDataFrame(data, "seq int, id string, chunk_type string, page_start int, page_end int, section_path string"), "id").collect()}
    assert got[0] == "x" and got[9] == "y" and len(set(got.values())) == 5 and all(got[i].startswith("x_") for i in (1, 2, 3))


def test_upsert(spark):
    store = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep"), (None, 9, "no")], "k string, v int, x string")
    update = spark.createDataFrame([("a", 2, "new"), ("c", 1, None), ("b", 1, "keep")], "k string, v int, x string")
    assert rows(C.upserted(store, update, "k", "v")) == [("a", 2, "new"), ("b", 1, "keep"), ("c", 1, None)]
    assert C.upserted(store.limit(0), update.limit(0), "k", "v").count() == 0


def test_register_chunks(spark):
    df = spark.createDataFrame([("d", "R", 2, "b"), ("d", "R", 1, None), ("d", None, 3, "x"), ("d", "R", 2, "b")], "doc string, reg string, o int, c string")
    assert rows(C.register_chunks(df, "doc", "reg", "o", [("Reg", "reg"), ("C", "c")]), "register", "text", "rows") == [("R", "Register: R\nReg: R | C: \nReg: R | C: b", 2)]


def test_table_chunks(spark):
    schema = "doc_id string, seq int, kind string, page_no int, table struct<header:array<string>,rows:array<array<string>>>"
    data = [("d", 1, "table", 3, (["Register name", "Bits"], [["B", "1"], ["A", "2"], [None, "3"], ["B", None]])), ("d", 2, "table", 3, (["Pin", "Use"], [["1", "x"], ["2", None]])), ("d", 3, "table", 3, (["Register", "Access"], [["R", "rw"]])), ("d", 4, "text", 3, None), ("d", 5, "table", 3, None), ("d", 6, "table", 3, (["Pin"], []))]
    df = spark.createDataFrame(data, schema)
    got = {(r.seq, r.register): r.text for r in C.table_chunks(df).collect()}
    assert got == {(1, "A"): "Register: A\nRegister name: A | Bits: 2", (1, "B"): "Register: B\nRegister name: B | Bits: 1\nRegister name: B | Bits: ", (2, None): "Pin | Use\n1 | x\n2 | ", (3, None): "Register | Access\nR | rw", (6, None): "Pin"}
    assert C.table_rows(df).count() == 7
