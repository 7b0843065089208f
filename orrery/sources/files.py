"""Readers: CSV, Parquet, JSON lines, text, mail, Word and spreadsheets, and the dispatch by extension.

All of them read through Spark, so paths may be in any store that it knows;
binary formats arrive as file contents and are parsed in Arrow batches.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.normalise import clean_names, nulls_from_tokens
from orrery.session import ship
from orrery.sources import compound

# Kinds of files by extension.
KINDS = {
    ".csv": "data", ".xlsx": "data", ".xlsm": "data", ".xls": "data", ".parquet": "data", ".json": "records", ".jsonl": "records",
    ".txt": "document", ".md": "document", ".docx": "document", ".pdf": "document", ".eml": "email", ".msg": "email",
}
#: Rows and columns to which a merged range is filled in where the sheet's own cells do not reach further.
MAX_ROWS, MAX_COLUMNS = 10_000, 500
#: Places of a sheet's grid, empty ones too; a larger sheet is an error.
MAX_GRID = 1 << 25
#: Characters of a page of mail.
MAIL_PAGE = 2_000


def kind_of(path: str) -> str:
    """``data``, ``records``, ``document``, ``email`` or ``unknown``; lock files of office programs are ``skip``."""
    name = PurePosixPath(path).name
    return "skip" if name.startswith("~$") else KINDS.get(PurePosixPath(name).suffix.lower(), "unknown")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred, names cleaned and null tokens as nulls."""
    frame = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    return nulls_from_tokens(frame.toDF(*clean_names(frame.columns)))


def read_parquet(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    if view:
        frame.createOrReplaceTempView(view)
    return frame


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines or a folder of JSON files; records that do not parse are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.filter(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``path, paragraph, text`` of Word files, from the zipped XML; files that are none give no rows."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, t) for p, raw in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(docx_paragraphs(raw))]
            yield pd.DataFrame(rows, columns=["path", "paragraph", "text"])

    return _contents(spark, path, "*.docx").mapInPandas(run, "path string, paragraph long, text string")


def docx_paragraphs(raw: bytes) -> list[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    out = ["".join(t.text or "" for t in p.iter() if name(t) == "t").strip() for p in root.iter() if name(p) == "p"]
    return [t for t in out if t]


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """:func:`mail` of the files at a path."""
    return mail(_contents(spark, path, "*.{eml,msg}"))


def mail(files: DataFrame) -> DataFrame:
    """``path, sender, recipients, subject, date, page, text, attachments, error`` of ``files(path, content)``, a row for each page of a message's body.

    A message without a body has one empty page; a compound file that cannot be
    read or is no message has a row of its path and the error. Bodies that are
    kept as compressed rich text only are not read.
    """
    ship(files.sparkSession)
    schema = "path string, sender string, recipients array<string>, subject string, date string, page long, text string, attachments array<string>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *row) for p, raw in zip(frame["path"], frame["content"], strict=True) for row in mail_pages(raw)]
            yield pd.DataFrame(rows, columns=["path", "sender", "recipients", "subject", "date", "page", "text", "attachments", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def mail_pages(raw: bytes) -> list[tuple]:
    """Headers and body of a message; a plain part is preferred, an HTML one is stripped."""
    if raw[:8] == compound.MAGIC:
        try:
            sender, people, subject, date, body, html, files = compound.message(raw)
        except (ValueError, struct.error, OverflowError) as broken:
            return [(*[None] * 7, f"{type(broken).__name__}: {broken}"[:200])]
    else:
        message = email.message_from_bytes(raw, policy=email.policy.default)
        part = message.get_body(preferencelist=("plain", "html"))
        body = part.get_content() if part is not None else ""
        html = part is not None and part.get_content_type() == "text/html"
        people = [a.strip() for h in ("to", "cc") for a in str(message.get(h) or "").split(",") if a.strip()]
        files = [a.get_filename() or "" for a in message.iter_attachments()]
        sender, subject, date = (str(message.get(h) or "") for h in ("from", "subject", "date"))
    if html:
        body = re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?is)<(style|script).*?</\1>", " ", body)))
    body = body.strip()
    pages = [body[i : i + MAIL_PAGE] for i in range(0, len(body), MAIL_PAGE)] or [""]
    return [(sender, people, subject, date, i, t, files, None) for i, t in enumerate(pages)]


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, length, modified`` of every file below a folder, contents unread."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.filter(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", F.coalesce(F.try_element_at(kinds, ending), F.lit("unknown")).alias("kind"), "length", "modified")
