from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from orrery.functions.dates import repaired
from orrery.functions.entries import entries
from orrery.functions.fuzzy import passage_place
from orrery.operators.asof import as_of
from orrery.operators.density import kept_ids
from orrery.operators.evidence import golden
from orrery.sources import export, formats, spreadsheet, store


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "events"), "event_id string, doc_id long, n long")
    assert s.read().count() == 0
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 1, 1)], s.schema)
    s.insert_once(rows, "event_id")
    s.insert_once(rows, "event_id")
    assert sorted(r.event_id for r in s.read().collect()) == ["a", "b"]
    s.upsert(spark.createDataFrame([("b", 2, 4), ("c", 3, 1)], s.schema), ["event_id"], add=["n"])
    assert {r.event_id: r.n for r in s.read().collect()} == {"a": 1, "b": 5, "c": 1}
    s.delete(F.col("event_id") == "a")
    store.cascade([s], spark.createDataFrame([(3,)], "doc_id long"))
    assert [r.event_id for r in s.read().collect()] == ["b"]


def test_catalog(spark, tmp_path):
    spark.createDataFrame([("x", "Jan 2024"), ("Total", "Jan 2024")], "Item string, Month string").write.parquet(str(tmp_path / "t"))
    rows = spark.createDataFrame([("log", "c1", str(tmp_path / "t"), ["item"], [], 2), ("log_again", "c1", str(tmp_path / "t"), ["item", "z"], [], 2)], store.CATALOG)
    found = store.register_catalog(spark, rows, {"log": "month"})
    assert set(found) == {"log", "log_raw", "log_clean"} and spark.table("log_clean").count() == 1
    assert [tuple(r) for r in store.catalog_stats(rows).select("tables", "columns", "rows").collect()] == [(2, 2, 4)]


def test_templates():
    dpr = formats.Template("dpr", r"dpr", ("Manpower",), ("Trade", "Day", "Night"), 0.66, ("daily progress",))
    good = formats.Look("DPR 3.xlsx", ("manpower",), ("trade", "day", "night"), 0.66, ("Daily Progress Report",))
    assert formats.best_template([dpr], good) == (dpr, 1.0, "auto")
    assert formats.best_template([dpr], formats.Look("x.xlsx", ("S",), ("a", "b"), 0.0))[2] == "none"


def test_reports_and_converters(spark):
    cells = spark.createDataFrame([("s", 1, "ACME", "Z1", "mason", "2", "1"), ("s", 2, None, None, "helper", "3", None), ("s", 3, "B", None, "cook", "0", "x")], "sheet string, row int, contractor string, zone string, trade string, d string, n string")
    assert sorted(map(tuple, formats.daily_report(cells, ["trade"], "d", "n").collect())) == [("helper", "ACME", "Z1", 3.0), ("mason", "ACME", "Z1", 3.0)]
    lines = spark.createDataFrame([("1.1", "1,000.5"), ("-", "LS"), (None, "5")], "code string, amount string")
    assert [tuple(r) for r in formats.invoice_breakup(lines, "code", "amount").collect()] == [("1.1", 1000.5)]
    known = formats.Converters()
    known.register(formats.Converter("double", lambda f: pd.DataFrame({"v": f["a"] * 2}), "v long", r"^double", ("a", "b", "c")))
    assert known.match("double.csv", []).name == "double" and known.match("x.csv", ["A", "B", "C"]).name == "double" and known.match("x.csv", ["A"]) is None
    assert [r.v for r in known.apply("double", spark.createDataFrame([(2,)], "a long")).collect()] == [4]


def test_entries(spark):
    rows = [("p", 0, "Title"), ("p", 1, "1. On 3 May 2020, work began."), ("p", 2, "(i) at the gate"), ("p", 3, "2) It stopped.")]
    got = entries(spark.createDataFrame(rows, "path string, paragraph long, text string")).orderBy("entry").collect()
    assert [(r.number, r.date_text, r.text) for r in got] == [(1, "3 May 2020", "work began. (i) at the gate"), (2, None, "It stopped.")]


def test_new_clusters_keep_ids(spark):
    old = spark.createDataFrame([(7, [1.0, 0.0])], "cluster int, centroid array<double>")
    new = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.0, 1.0])], "cluster int, centroid array<double>")
    assert {r.new_cluster: r.cluster for r in kept_ids(old, new).collect()} == {0: 7, 1: None}


def test_small_ones(spark):
    assert passage_place("The works were delayed by rain at the north gate.", "works were delayed by rain") == (4, 1.0)
    assert passage_place("The works were delaid by rain at the north gate.", "works were delayed by rain")[0] == 4
    assert passage_place("nothing alike", "works were delayed by rain") is None and passage_place(None, "x") is None
    rows = spark.createDataFrame([("Q ", "sql", 1, 2), ("q", "sql", 1, 1), ("q", "doc", 1, 3)], "question string, route string, vote int, ts int")
    assert sorted((r.route, r.ts) for r in golden(rows, ["ts"]).collect()) == [("doc", 3), ("sql", 1)]
    assert spark.createDataFrame([("2024-01-02T, 2024-01-03",)], "t string").select(repaired(F.col("t"))).first()[0] == "2024-01-02, 2024-01-03"


def test_workbooks_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a & <b>", 2.5, True, None), (2, None, None, False, dt.date(2024, 5, 6))], "k long, t string, v double, f boolean, d date")
    export.export_workbook(spark, str(tmp_path / "out" / "x.xlsx"), {"First": rows, "Empty": rows.limit(0)})
    cells = {(r.sheet, r.row, r.col): r.value for r in spreadsheet.read_cells(spark, str(tmp_path / "out")).collect()}
    assert cells["First", 1, 1] == "a & <b>" and cells["First", 2, 4] == "2024-05-06" and ("First", 2, 1) not in cells
    assert {(s, r) for s, r, _ in cells if s == "Empty"} == {("Empty", 0)}
    assert [export.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, None, 9), (5, "a", None), (6, "a", 3)], "id int, k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 9, 3.0), (None, 8, 4.0), ("b", 8, 5.0)], "k string, t long, v double")
    got = {r.id: r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: None, 4: None, 5: None, 6: None}
    assert as_of(left, right.limit(0), ["k"], "t", ["v"]).filter("v is not null").count() == 0


def test_broken_sheets_do_not_end_the_read(spark, tmp_path):
    """Cells without places follow one another; a sheet that cannot be read gives an error row; merged ranges are told whole."""
    import zipfile

    def book(name, sheet):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", sheet)

    rows = "".join(f'<row><c t="inlineStr"><is><t>{a}</t></is></c><c><v>{i}</v></c></row>' for i, a in enumerate("abc"))
    book("good.xlsx", f'<worksheet><sheetData>{rows}<row r="9"><c r="C9"><v>7</v></c><c><v>8</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A1048576"/></mergeCells></worksheet>')
    book("cut.xlsx", "<worksheet><sheetData><row>")
    book("index.xlsx", '<worksheet><sheetData><row><c t="s"><v>5</v></c></row></sheetData></worksheet>')
    cells = [(r.path.rsplit("/", 1)[1], r.row, r.col, r.value, r.error) for r in spreadsheet.read_cells(spark, str(tmp_path)).collect()]
    good = {c[1:4] for c in cells if c[0] == "good.xlsx" and c[2] != 0}
    assert good == {(0, 1, "0"), (1, 1, "1"), (2, 1, "2"), (8, 2, "7"), (8, 3, "8")}
    bad = {c[0]: c[4].split(":")[0] for c in cells if c[4]}
    assert bad == {"cut.xlsx": "ParseError", "index.xlsx": "IndexError"}
    merges = spreadsheet.read_merges(spark, str(tmp_path)).filter("error is null").collect()
    assert [tuple(r)[1:] for r in merges] == [("S", 0, 0, 1_048_575, 0, "a", None)]
    assert {r.path.rsplit("/", 1)[1] for r in spreadsheet.read_tables(spark, str(tmp_path)).filter("error is not null").collect()} == {"cut.xlsx", "index.xlsx"}
