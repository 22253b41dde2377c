from __future__ import annotations

import csv
import io
import random
import zipfile

import pytest

from batchline.queries.loading import _workbook
from batchline.sources import delimited, discovery, spanning, workbook

COMMENTS = {"id": "编号", "name": "名称", "note": "note"}


def put(folder, name: str, data: bytes) -> str:
    (folder / name).write_bytes(data)
    return f"file:{folder / name}"


def load(spark, *paths):
    df = delimited.load_delimited(spark, list(paths), COMMENTS)
    return None if df is None else sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_patterns():
    assert discovery.search_patterns("/in/a.csv") == ["in/a.csv"]
    assert discovery.search_patterns("in/sales*") == ["in/sales*.csv", "in/sales*.xlsx", "in/sales*.xls"]
    assert discovery.search_patterns("in/") == ["in/*.csv", "in/*.xlsx", "in/*.xls"]


def test_find_files(spark, tmp_path):
    for name in ("b.csv", "a.csv", "c.txt", "d.xlsx"):
        put(tmp_path, name, b"x")
    (tmp_path / "sub.csv").mkdir()
    found = [p.rsplit("/", 1)[1] for p in discovery.find_files(spark, f"file:{tmp_path}", "*")]
    assert found == ["a.csv", "b.csv", "d.xlsx"]
    assert discovery.find_files(spark, f"file:{tmp_path}", "none/*") == []
    with pytest.raises(ValueError, match="c.txt"):
        discovery.by_reader(["x/c.txt"])


def test_encodings_by_file(spark, tmp_path):
    text = "编号,名称\n1,商é\n"
    utf8 = put(tmp_path, "u.csv", b"\xef\xbb\xbf" + text.encode())
    gbk = put(tmp_path, "g.csv", "编号,名称\n2,商\n".encode("gbk"))
    latin = put(tmp_path, "l.csv", "ID,NAME\n3,caf\xe9\n".encode("latin-1"))
    kinds = {c.encoding: c.header for c in delimited.classify(spark, [utf8, gbk, latin])}
    assert kinds == {"UTF-8": ("编号", "名称"), "GBK": ("编号", "名称"), "ISO-8859-1": ("ID", "NAME")}
    assert load(spark, utf8, gbk, latin) == [("1", "商é"), ("2", "商"), ("3", "café")]


def test_empty_and_header_only_files(spark, tmp_path):
    empty = put(tmp_path, "e.csv", b"")
    assert load(spark, empty) is None
    head = put(tmp_path, "h.csv", b"ID,name\n")
    assert load(spark, empty, head) == []


def test_quotes_line_breaks_and_blank_lines(spark, tmp_path):
    path = put(tmp_path, "q.csv", b'\n id ,name,note\n1,"say ""hi"", x","two\nlines"\n\n2, padded ,\n')
    assert load(spark, path) == [("1", 'say "hi", x', "two\nlines"), ("2", " padded ", None)]


def test_header_with_a_line_break(spark, tmp_path):
    path = put(tmp_path, "hb.csv", b'id,"odd\nheader",name\n1,x,a\n')
    assert [c.header for c in delimited.classify(spark, [path])] == [("id", "odd\nheader", "name")]
    assert load(spark, path) == [("1", "a")]


def test_null_tokens_empty_rows_and_short_rows(spark, tmp_path):
    path = put(tmp_path, "n.csv", b"id,name,note\nNULL,,\\N\n1,NA,null\n2\n\"\",x,nan\n")
    assert load(spark, path) == [("1", "NA", None), ("2", None, None), (None, "x", "nan")]


def test_extra_field_is_an_error(spark, tmp_path):
    path = put(tmp_path, "x.csv", b"id,name\n1,a\n2,b,c\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        load(spark, path)


def test_repeated_and_empty_headers(spark, tmp_path):
    path = put(tmp_path, "r.csv", b"id,id,,A,a\n1,2,3,4,5\n")
    assert delimited.classify(spark, [path])[0].header == ("id", "id.1", "Unnamed: 2", "A", "a")
    assert load(spark, path) == [("1",)]


def test_files_that_differ_are_united_by_column(spark, tmp_path):
    one = put(tmp_path, "1.csv", b"name,id\na,1\n")
    two = put(tmp_path, "2.csv", b"note,ID\nz,2\n")
    assert load(spark, one, two) == [("1", "a", None), ("2", None, "z")]


def test_a_file_with_many_splits(spark, tmp_path):
    lines = "".join(f"{i},name {i},{'é' if i == 4000 else 'x'}\n" for i in range(5000))
    path = put(tmp_path, "big.csv", ("id,name,note\n" + lines).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert delimited.classify(spark, [path])[0].encoding == "ISO-8859-1"
        rows = load(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and ("4000", "name 4000", "é") in rows


def test_workbook_cells(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(_workbook([("x",)]))) as base, zipfile.ZipFile(out, "w") as book:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            book.writestr(name, base.read(name))
        book.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>编号</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>note</t></is></c></row>'
            '<row/><row><c r="A3"><v>12.0</v></c><c r="C3"><v>1.5</v></c><c r="D3" s="1"><v>45292</v></c></row>'
            '<row><c r="A4" t="b"><v>1</v></c><c r="D4" s="2"><v>45292.5</v></c></row><row><c r="B5"><v>9</v></c></row></sheetData></worksheet>',
        )
    path = put(tmp_path, "b.xlsx", out.getvalue())
    rows = workbook.load_workbooks(spark, [path], COMMENTS)
    got = sorted(map(tuple, rows.select("id", "name", "note").collect()), key=str)
    assert got == [("12", "1.5", "2024-01-01 00:00:00"), ("True", None, "2024-01-01 12:00:00")]


def test_workbooks_with_different_headers(spark, tmp_path):
    one = put(tmp_path, "1.xlsx", _workbook([("id", "name"), (1, "a"), (2, "NULL")]))
    two = put(tmp_path, "2.xlsx", _workbook([("note", "编号"), ("n", 3)]))
    rows = workbook.load_workbooks(spark, [one, two], COMMENTS)
    got = sorted(map(tuple, rows.select("id", "name", "note").collect()), key=str)
    assert got == [("1", "a", None), ("2", None, None), ("3", None, "n")]


@pytest.mark.parametrize(("encoding", "newline"), [("utf-8", "\n"), ("gbk", "\r\n"), ("latin-1", "\n")])
def test_a_large_file_with_line_breaks_is_read_in_splits(spark, tmp_path, encoding, newline):
    mark = {"utf-8": "商é", "gbk": "商", "latin-1": "é"}[encoding]
    want, text = [], f"ID,NAME,note{newline}"
    for i in range(3000):
        note = f'he said "{i}",{newline}{mark}' + ("\n" * (i % 4)) + "end" if i % 3 else f"plain {mark}"
        long = "x" * (900 if i % 50 == 0 else 1) + newline * (i % 50 == 0) + "y"
        want.append((str(i), long, note))
        cell = lambda v: '"' + v.replace('"', '""') + '"' if '"' in v or "\n" in v or "," in v else v
        text += f"{i},{cell(long)},{cell(note)}{newline}" + (newline if i % 7 == 0 else "")
    path = put(tmp_path, "span.csv", text.encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [c.layout for c in delimited.classify(spark, [path])] == ["records"]
        assert load(spark, path) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lone_carriage_returns(spark, tmp_path):
    path = put(tmp_path, "mac.csv", b'id,note\r1,"a\rb"\r2,c\r')
    assert [c.layout for c in delimited.classify(spark, [path])] == ["records"]
    assert [r[0] for r in load(spark, path)] == ["1", "2"]


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
def test_line_ends_of_both_kinds_in_one_file(spark, tmp_path, end):
    """Each quoted text keeps its breaks, whatever ends the records, in splits of any size."""
    notes = ["a\rb", "a\nb", "a\r\nb", "a\r\rb", "\n\r", "plain", 'say ""so""\r']
    body = "".join(f'{i},"{notes[i % 7]}"' + (end if i % 5 else "\n") + "\r" * (i % 11 == 0) for i in range(2000))
    path = put(tmp_path, "both.csv", f"id,note{end}{body}".encode())
    want = sorted(((str(i), notes[i % 7].replace('""', '"')) for i in range(2000)), key=str)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("256", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert load(spark, path) == want
            lines = spanning._lines(spark, [path], "UTF-8", spanning.line_end(body.encode()))
            assert lines.rdd.getNumPartitions() > 4 and lines.count() > 2000
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_irregular_quotes_are_read_in_splits(spark, tmp_path):
    body = "".join(f'{i},5" pipe {i},"a\nb"\n' for i in range(600))
    path = put(tmp_path, "odd.csv", ("id,name,note\n" + body).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [c.layout for c in delimited.classify(spark, [path])] == ["records"]
        assert load(spark, path) == sorted([(str(i), f'5" pipe {i}', "a\nb") for i in range(600)], key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['id,name\n1,a\n2,"open\n3,b\n4,c\n', 'id,name\n1,"a""\n', 'id,"na\nme'])
def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path, text):
    path = put(tmp_path, "open.csv", text.encode())
    with pytest.raises(ValueError, match="not closed.*open.csv"):
        load(spark, path)


def test_line_breaks_in_quotes_stay_as_they_are(spark, tmp_path):
    path = put(tmp_path, "crlf.csv", b'id,name,note\r\n1,"x\r\ny",5" z\r\n2,"a\nb",c\r\n')
    assert load(spark, path) == [("1", "x\r\ny", '5" z'), ("2", "a\nb", "c")]


def test_one_stray_quote_does_not_put_a_file_into_one_task(spark, tmp_path):
    path = put(tmp_path, "stray.csv", ("id,name\n" + "".join(f'{i},{"5 inch" if i == 50 else "n"}{chr(34) * (i == 50)}\n' for i in range(3000))).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = delimited.load_delimited(spark, [path], COMMENTS)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 3000
        assert df.filter("id = '50'").head()["name"] == '5 inch"'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", ["64", "1m"])
def test_records_are_those_of_a_reader_in_order(spark, tmp_path, size):
    """Random texts of quotes, commas and line breaks, in splits of any size."""
    rnd, texts = random.Random(9), {}
    while len(texts) < 25:
        text = "h,i\n" + "".join(rnd.choice(['"', '"', ",", "\n", "a", "bb", '"x"', ',"', '",', '""']) for _ in range(120))
        text = text.replace('\n"', '\nq,"') if rnd.random() < 0.5 else text
        reader, begin, records = csv.reader(io.StringIO(text, newline="")), 0, []
        lines = text.split("\n")
        try:
            for _ in reader:
                records.append("\n".join(lines[begin : reader.line_num]))
                begin = reader.line_num
        except csv.Error:
            continue
        reopened = csv.reader(io.StringIO(text + "\n,end,", newline=""))
        if [r for r in reopened][-1][-2:] != ["end", ""]:
            continue  # a quote is open at the end
        path = put(tmp_path, f"r{len(texts)}.csv", text.encode())
        texts[path.removeprefix("file:")] = [r for r in records if r.strip(" ")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        placed = spanning.place(spark, [f"file:{p}" for p in texts], "UTF-8")
        found = {}
        for r in spanning.records(placed).orderBy("path", "first").collect():
            found.setdefault("/" + r["path"].removeprefix("file:").lstrip("/"), []).append(r["text"])
        assert found == texts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
