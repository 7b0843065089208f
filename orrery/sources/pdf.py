"""PDF files: text by page, the decision whether a page must be read as an image, and tables by ruled lines or by aligned text.

A file's marks are read in Arrow batches; all that follows (lines, cells, grids,
rows) is DataFrame work over pages, so a file of many pages is spread like many
files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.extract import text_quality_needs_ocr
from orrery.operators.normalise import clean_names
from orrery.session import ship
from orrery.sources.pdf_marks import marks
from orrery.storage import stash

MARKS = "path string, page int, kind string, x0 double, y0 double, x1 double, y1 double, size double, text string, place long, error string"
#: Points by which lines may miss each other, and by which starts of words in a column may differ.
SNAP, ALIGN = 3.0, 5.0
#: A line's text is cut into cells at gaps of so many times its size, and a column needs starts in so many lines.
GAP, COLUMN_LINES = 1.5, 3
#: Tasks for each core that read files.
TASKS_A_CORE = 4
#: Rows of marks in a batch that leaves a Python worker.
ROWS = 20_000


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every PDF file below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content")


def page_marks(files: DataFrame) -> DataFrame:
    """The marks of ``files(path, content)``; a file that cannot be read, or is null, gives one row with its ``error``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = [(path.as_py(), *m[:8], i, None) for i, m in enumerate(marks(raw.as_py() or b""))]
                except Exception as broken:  # whatever is wrong with one file, the others are read
                    rows = [(path.as_py(), *[None] * 9, f"{type(broken).__name__}: {broken}"[:200])]
                for at in range(0, len(rows), ROWS):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS], strict=True), kinds, strict=True)], names=names)

    names = [c.split()[0] for c in MARKS.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}[c.split()[1]] for c in MARKS.split(", ")]
    # files are small against what reading them takes, so they are dealt out anew, by number and not by size
    tasks = TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(tasks).mapInArrow(run, MARKS)


def _numbered(rows: DataFrame, within: list[str], order: list[Column], new: Column, name: str) -> DataFrame:
    """Numbers stretches of rows in an order: ``new`` tells where one begins, from a row and the one before."""
    seen = Window.partitionBy(*within).orderBy(*order)
    return rows.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn(name, F.sum("_new").over(seen.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


PAGE = ["path", "page"]


def _runs(found: DataFrame) -> DataFrame:
    """Runs of text with their line, from the top, and their cell in it: runs that nearly touch are one cell."""
    runs = found.filter("kind = 'text'")
    down = [F.col("y0").desc(), "x0", "place"]
    runs = _numbered(runs, PAGE, down, F.lag("y0").over(Window.partitionBy(*PAGE).orderBy(*down)) - F.col("y0") > 0.5 * F.col("size"), "line")
    across = ["x0", "place"]
    before = Window.partitionBy(*PAGE, "line").orderBy(*across)
    runs = runs.withColumn("_gap", F.col("x0") - F.lag("x1").over(before))
    runs = runs.withColumn("space", F.coalesce(F.col("_gap") > 0.15 * F.col("size"), F.lit(False)))
    return _numbered(runs, [*PAGE, "line"], across, F.col("_gap") > GAP * F.col("size"), "cell").drop("_gap")


def _text(order: list[str], spaced: bool = True) -> Column:
    """Texts of a group in order, with a space where a gap asks for one."""
    held = F.array_sort(F.collect_list(F.struct(*order, "space", "text")))
    said = F.transform(held, lambda x, i: F.concat(F.when(x["space"] & (i > 0), F.lit(" ")).otherwise(F.lit("")), x["text"]))
    return F.trim(F.regexp_replace(F.array_join(said, "" if spaced else " "), r" {2,}", " "))


def page_texts(found: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``path, page, text, chars, image_share, needs_ocr, error``: a row for each page, and one for a file that cannot be read.

    Lines go from the top, the runs of a line from the left. A page without
    text has the empty text. ``runs`` are those of :func:`_runs`, where they are
    there already.
    """
    lines = (_runs(found) if runs is None else runs).groupBy(*PAGE, "line").agg(_text(["x0", "place"]).alias("text"))
    texts = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    pages = found.groupBy("path", "page", "error").agg(F.sum(F.when(F.col("kind") == "image", area)).alias("_images"), F.max(F.when(F.col("kind") == "page", area)).alias("_area"))
    rows = pages.join(texts, PAGE, "left").withColumn("text", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))))
    share = F.least(F.coalesce(F.col("_images") / F.nullif(F.col("_area"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return rows.select(*PAGE, "text", F.length("text").alias("chars"), share.alias("image_share"), text_quality_needs_ocr(F.length("text"), letters, share).alias("needs_ocr"), "error")


def _snapped(rulings: DataFrame, kind: str, axis: str) -> DataFrame:
    """Lines of a kind with ``at``: the mean place of all that lie within SNAP of the next."""
    lines = rulings.filter(F.col("kind") == kind)
    order = Window.partitionBy(*PAGE).orderBy(axis)
    lines = _numbered(lines, PAGE, [F.col(axis)], F.col(axis) - F.lag(axis).over(order) > SNAP, "_n")
    return lines.withColumn("at", F.avg(axis).over(Window.partitionBy(*PAGE, "_n"))).drop("_n")


def _ruled_grids(found: DataFrame) -> DataFrame:
    """Tables by their lines: ``path, page, table, top, bottom, left, right, across, down``, from the top, then the left.

    Vertical lines whose heights overlap are of one band; within a band, level
    lines whose widths overlap are of one table. ``across`` and ``down`` hold
    the lines with their extents.
    """
    up, level = _snapped(found, "v", "x0"), _snapped(found, "h", "y0")
    reach = F.min("y0").over(Window.partitionBy(*PAGE).orderBy(F.col("y1").desc(), "y0").rowsBetween(Window.unboundedPreceding, -1))
    banded = up.withColumn("_reach", reach)
    banded = _numbered(banded, PAGE, [F.col("y1").desc(), F.col("y0")], F.col("_reach").isNull() | (F.col("_reach") > F.col("y1") + SNAP), "band")
    bands = banded.groupBy(*PAGE, "band").agg(F.max("y1").alias("top"), F.min("y0").alias("bottom"), F.collect_list(F.struct("at", "y0", "y1")).alias("up"))
    held = level.join(bands, PAGE).filter(F.col("at").between(F.col("bottom") - SNAP, F.col("top") + SNAP)).select(*PAGE, "band", "up", "at", "x0", "x1")
    edge = F.max("x1").over(Window.partitionBy(*PAGE, "band").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_edge", edge)
    held = _numbered(held, [*PAGE, "band"], [F.col("x0"), F.col("x1")], F.col("_edge").isNull() | (F.col("_edge") < F.col("x0") - SNAP), "part")
    grids = held.groupBy(*PAGE, "band", "part").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.first("up").alias("up"), F.collect_list(F.struct("at", "x0", "x1")).alias("level"))
    inside = F.filter("up", lambda v: v["at"].between(F.col("left") - SNAP, F.col("right") + SNAP))
    grids = grids.withColumn("up", inside).withColumns({"columns": F.array_sort(F.array_distinct(F.transform("up", lambda v: v["at"]))), "rows": F.array_sort(F.array_distinct(F.transform("level", lambda v: v["at"])))})
    grids = grids.filter((F.size("columns") > 2) & (F.size("rows") > 2))
    order = Window.partitionBy(*PAGE).orderBy("band", "left")
    return grids.withColumn("table", F.row_number().over(order) - 1).drop("band", "part")


def _ruled_cells(found: DataFrame, runs: DataFrame) -> DataFrame:
    """``path, page, table, row, column, text``: a run is in the cell whose lines lie next to its middle.

    A line counts only where it reaches the run, so text of merged cells is in
    the first of them.
    """
    grids = _ruled_grids(found)
    runs = runs.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": F.col("y0") + 0.3 * F.col("size")})
    runs = runs.select(*PAGE, "line", "x0", "place", "space", "text", "mx", "my")
    met = runs.join(grids, PAGE).filter(F.col("mx").between(F.col("left"), F.col("right")) & F.col("my").between(F.array_min("rows"), F.array_max("rows")))
    left = F.array_max(F.transform(F.filter("up", lambda v: (v["at"] <= F.col("mx")) & F.col("my").between(v["y0"] - SNAP, v["y1"] + SNAP)), lambda v: v["at"]))
    top = F.array_min(F.transform(F.filter("level", lambda h: (h["at"] >= F.col("my")) & F.col("mx").between(h["x0"] - SNAP, h["x1"] + SNAP)), lambda h: h["at"]))
    met = met.withColumns({"_left": left, "_top": top}).filter("_left is not null and _top is not null")
    row, column = F.size("rows") - F.array_position("rows", F.col("_top")), F.array_position("columns", F.col("_left")) - 1
    cells = met.select(*PAGE, "table", row.cast("int").alias("row"), column.cast("int").alias("column"), (F.size("columns") - 1).alias("width"), "line", "x0", "place", "space", "text")
    return cells.groupBy(*PAGE, "table", "row", "column", "width").agg(_text(["line", "x0", "place"]).alias("text"))


def _aligned_cells(runs: DataFrame) -> DataFrame:
    """The same of pages without ruled tables: columns are where cells of at least COLUMN_LINES lines start."""
    words = runs.groupBy(*PAGE, "line", "cell").agg(F.min("x0").alias("x0"), _text(["x0", "place"]).alias("text"))
    counted = words.withColumn("_cells", F.count("*").over(Window.partitionBy(*PAGE, "line"))).filter("_cells > 1")
    order = Window.partitionBy(*PAGE).orderBy("x0")
    starts = _numbered(counted, PAGE, [F.col("x0")], F.col("x0") - F.lag("x0").over(order) > ALIGN, "_n")
    starts = starts.groupBy(*PAGE, "_n").agg(F.min("x0").alias("at"), F.count_distinct("line").alias("lines")).filter(F.col("lines") >= COLUMN_LINES)
    starts = starts.groupBy(*PAGE).agg(F.array_sort(F.collect_list("at")).alias("columns")).filter(F.size("columns") > 1)
    met = counted.join(starts, PAGE).withColumn("column", F.greatest(F.size(F.filter("columns", lambda c: c <= F.col("x0") + ALIGN)) - 1, F.lit(0)))
    cells = met.withColumn("row", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line")) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return cells.groupBy(*PAGE, F.lit(0).alias("table"), "row", "column", (F.size("columns")).alias("width")).agg(joined.alias("text"))


def page_tables(found: DataFrame) -> DataFrame:
    """``path, page, table, row, cells``: rows of the tables of all pages, cells by cleaned column name.

    Tables are found by ruled lines; pages without any are searched for text
    that is aligned in columns. Pages to be read as images are left out. The
    first row with text gives the names; rows without text and tables of fewer
    than two rows or columns are left out.
    """
    ship(found.sparkSession)
    runs = stash(_runs(found).select(*PAGE, "line", "cell", "x0", "x1", "y0", "size", "place", "space", "text"), "pdf-runs")
    clear = stash(page_texts(found, runs).filter("not needs_ocr and error is null").select(*PAGE), "pdf-pages")
    runs = runs.join(clear, PAGE)
    ruled = stash(_ruled_cells(found.filter("kind in ('v', 'h')").join(clear, PAGE), runs), "pdf-cells")
    cells = ruled.unionByName(_aligned_cells(runs.join(ruled.select(*PAGE).distinct(), PAGE, "left_anti"))).filter("text <> ''")
    rows = cells.groupBy(*PAGE, "table", "row", "width").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("texts"))
    table = Window.partitionBy(*PAGE, "table")
    rows = rows.withColumns({"_first": F.min("row").over(table), "_rows": F.count("*").over(table)}).filter("width > 1 and _rows > 2")
    names = F.udf(lambda texts, width: clean_names([texts.get(i) or "" for i in range(width)]), "array<string>")
    heads = rows.filter("row = _first").select(*PAGE, "table", names("texts", "width").alias("names"))
    body = rows.filter("row > _first").join(heads, [*PAGE, "table"])
    pairs = F.transform(F.map_entries("texts"), lambda e: F.struct(F.get("names", e["key"]).alias("key"), e["value"].alias("value")))
    number = F.row_number().over(Window.partitionBy(*PAGE, "table").orderBy("row")) - 1
    return body.select(*PAGE, "table", number.alias("row"), F.map_from_entries(pairs).alias("cells"))
