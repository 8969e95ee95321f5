"""Workbooks: written and read back, against what was given, and files made by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F
from quaylight.sources import workbook
from quaylight.sources.workbook import MAIN, Look, column_name, column_number, plain, read_workbooks, safe, save_workbooks

KIND = "book string, sheet string, row long, cells array<string>"


def rows_of(df):
    return sorted((r.book, r.sheet, r.row, tuple(r.cells)) for r in df.collect())


def test_columns_and_texts():
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(column_number(f"{column_name(i)}7") == i for i in range(2000))
    for x in ("", "a<b>&", "\x00\x0b\r", "_x0041_", "__x000D__x", " two  blanks ", "line\nline\ttab", "￿"):
        assert plain(safe(x).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")) == x


def test_round_trip(spark, tmp_path):
    texts = ["", "a<b>&\"'", "\x00 \x0b\r\n", "_x0041_", "007", "-0", "0", "12.50", "12.5", "-3", "1e5", "é漢😀", " ", "x" * 100_000, "123456789012345678"]
    given = [(b, s, r, [t, None, t]) for b in ("one", "a/b+c.d~*", "", "_x", ".hid", "漢 字") for s in ("S 1", "<&\"'>") for r, t in enumerate(texts)]
    given += [("one", "gaps", 5, []), ("one", "gaps", 1000, [None, None, "x"]), ("one", "gaps", 7, ["y"])]
    save_workbooks(spark.createDataFrame(given, KIND).repartition(5), str(tmp_path / "w"))
    want = sorted((b, s, r, tuple(c)) for b, s, r, c in given)
    assert rows_of(read_workbooks(spark, str(tmp_path / "w"))) == want
    assert rows_of(read_workbooks(spark, str(tmp_path / "w"), ["gaps", "none"])) == [x for x in want if x[1] == "gaps"]
    assert sorted(f.suffix for f in (tmp_path / "w").iterdir()) == [".xlsx"] * 6


def test_sheets_in_order_with_looks(spark, tmp_path):
    rows = [("b", s, r, ["h" if r == 0 else "v"]) for s in ("z", "a", "m") for r in range(3)]
    save_workbooks(spark.createDataFrame(rows, KIND), str(tmp_path / "w"), order=["m", "z"], looks={"z": Look(1, (12,), {0: ["v", "w"]})})
    with zipfile.ZipFile(tmp_path / "w" / "b.xlsx") as z:
        assert z.testzip() is None
        assert list(workbook._entries(z)) == ["m", "z", "a"]
        xml = z.read(workbook._entries(z)["z"]).decode()
    assert '<col min="1" max="1" width="12"' in xml and 'sqref="A2:A1048576"><formula1>"v,w"</formula1>' in xml
    assert '<c r="A1" s="1"' in xml and '<c r="A2" t=' in xml and 'ySplit="1"' in xml


def test_a_large_sheet_goes_on_in_further_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "ROWS", 10)
    given = [("b", "s", r, [str(r)]) for r in range(35)]
    workbook.save_workbooks(spark.createDataFrame(given, KIND), str(tmp_path / "w"))
    assert sorted(f.name for f in (tmp_path / "w").iterdir()) == ["b+2.xlsx", "b+3.xlsx", "b+4.xlsx", "b.xlsx"]
    found = {n: [r for r, _ in sheet(tmp_path / "w" / n)] for n in ("b.xlsx", "b+4.xlsx")}
    assert found == {"b.xlsx": list(range(10)), "b+4.xlsx": list(range(5))}
    assert workbook.book_of("b+4.xlsx") == ("b", 4)


def sheet(path):
    with zipfile.ZipFile(path) as z:
        return list(workbook.read_sheet(z, workbook._entries(z)["s"]))


@pytest.mark.parametrize("bad", [(None, "s", 0), ("b", None, 0), ("b", "s", None), ("b", "s", -1), ("b", "s/t", 0), ("b", "s" * 32, 0), ("b", "s", 1)])
def test_a_refused_row_leaves_nothing(spark, tmp_path, bad):
    rows = [("b", "s", 1, ["x"]), (*bad, ["y"])]
    with pytest.raises(Exception, match="workbook|two rows"):
        save_workbooks(spark.createDataFrame(rows, KIND), str(tmp_path / "w"))
    left = list((tmp_path / "w").rglob("*")) if (tmp_path / "w").exists() else []
    assert not [f for f in left if f.suffix == ".xlsx"] and not [f for f in left if f.is_dir()]


def test_books_are_added_refused_and_replaced(spark, tmp_path):
    path = str(tmp_path / "w")
    one = lambda b, t: spark.createDataFrame([(b, "s", 0, [t])], KIND)
    save_workbooks(one("a", "1"), path)
    save_workbooks(one("b", "2"), path)
    with pytest.raises(Exception, match="a.xlsx"):
        save_workbooks(one("a", "3"), path)
    assert rows_of(read_workbooks(spark, path)) == [("a", "s", 0, ("1",)), ("b", "s", 0, ("2",))]
    save_workbooks(one("c", "4"), path, mode="overwrite")
    assert rows_of(read_workbooks(spark, path)) == [("c", "s", 0, ("4",))]
    assert [f.name for f in (tmp_path / "w").iterdir()] == ["c.xlsx"]


def test_no_rows(spark, tmp_path):
    save_workbooks(spark.createDataFrame([], KIND), str(tmp_path / "w"))
    (tmp_path / "w").mkdir(exist_ok=True)
    assert read_workbooks(spark, str(tmp_path / "w")).count() == 0


def test_a_file_of_another_program(spark, tmp_path):
    """Shared strings, runs, booleans, cached results of formulas, cells without addresses."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = '<row><c t="s"><v>1</v></c><c t="b"><v>1</v></c><c><f>1+1</f><v>2</v></c></row><row r="4"><c r="C4" t="str"><f>A</f><v>q</v></c><c r="D4" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="k"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="k" Target="/xl/worksheets/w.xml"/></Relationships>')
        z.writestr("xl/worksheets/w.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>no</t></si><si><r><t>ri</t></r><rPh><t>!</t></rPh><r><t>ch</t></r></si></sst>')
    (tmp_path / "~$x.xlsx").write_bytes(b"lock")
    assert rows_of(read_workbooks(spark, str(tmp_path))) == [("x", "One", 0, ("rich", "TRUE", "2")), ("x", "One", 3, (None, None, "q", "ab"))]


def test_many_rows_are_read_in_batches(spark, tmp_path):
    df = spark.range(60_000).select(F.lit("b").alias("book"), F.lit("s").alias("sheet"), F.col("id").alias("row"), F.array(F.repeat(F.lit("t"), 200), F.col("id").cast("string")).alias("cells"))
    save_workbooks(df, str(tmp_path / "w"))
    out = read_workbooks(spark, str(tmp_path / "w")).agg(F.count("*"), F.sum(F.col("cells")[1].cast("long")), F.count_distinct("row")).first()
    assert tuple(out) == (60_000, 60_000 * 59_999 // 2, 60_000)
