"""Reading uploaded files: one row per file, its text or why it has none."""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..operators import headers
from . import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


class Records:
    """Rows under a header row, told as one line a row: its non-blank values, each after its column's name and a colon, or after ``unnamed``."""

    def __init__(self, rows: Iterable[Sequence[str]], unnamed: str):
        self.rows, self.unnamed = iter(rows), unnamed
        self.names, self.first = next(self.rows, None), next(self.rows, None)

    @property
    def headed(self) -> bool:
        """There is a row under the header."""
        return self.first is not None

    def told(self) -> str:
        labels = [f"{name}: " if name else self.unnamed for name in self.names]
        told = ("; ".join(label + value for label, value in zip(labels, row, strict=False) if not is_blank(value)) for row in chain([self.first], self.rows))
        return "\n".join(filter(None, told))


def is_blank(value: str) -> bool:
    return not value or value.isspace()


def csv_text(data: bytes) -> str:
    """The records of a CSV file; a file without a row under its header stays as it is."""
    text = decode(data)
    records = Records(csv.reader(io.StringIO(text)), ": ")
    return records.told() if records.headed else text


def _table(node: ET.Element) -> str:
    """The records of a table's rows that are not blank; cells of a lone row side by side, blank ones too."""
    cells = (["".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr"))
    records = Records((row for row in cells if any(row)), "")
    return records.told() if records.headed else " | ".join(records.names or ())


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in body order. Each run of text counts once; of nested tables, the outer rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    parts = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            parts.append("".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip())
        elif node.tag == f"{_W}tbl":
            parts.append(_table(node))
    return "\n\n".join(p for p in parts if p.strip())


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(filename, size, content) of the files under a path; columns that aren't used aren't read."""
    return spark.read.format("binaryFile").options(**options).load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "content")


def _read(readers: dict[str, Callable[[bytes], list[str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, errors = [], []
            for kind, data in zip(b["kind"], b["content"], strict=True):
                try:
                    got.append(readers[kind](bytes(data)))
                    errors.append(None)
                except Exception as e:  # a bad file is a row with an error, never a failed job
                    got.append(None)
                    errors.append(str(e)[:1000] or type(e).__name__)
            yield pd.DataFrame({"document_id": b["document_id"], "filename": b["filename"], "kind": b["kind"], "pages": got, "error": pd.Series(errors, dtype=object)})

    return run


def page_texts(pages: Column, keep_page_markers: bool = False) -> Column:
    """Text of a document of pages: each cleaned and under its marker, blank ones left out, repeated lines removed."""
    cleaned = F.transform(pages, lambda p, i: F.struct(i.alias("i"), T.clean_page(p).alias("t")))
    marked = F.transform(F.filter(cleaned, lambda p: T.strip(p["t"]) != ""), lambda p: T.page_text(p["i"] + 1, p["t"]))
    return headers.without_repeats(F.array_join(marked, "\n\n"), F.size(pages), keep_page_markers)


def parse_files(files: DataFrame, settings: Settings = DEFAULTS, keep_page_markers: bool = False, read_pdf: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """(document_id, filename, text, error) of files (document_id, filename, size, content), by extension.

    Unknown extensions and files above the size limit get an error. Text files never leave the JVM. CSV, DOCX and PDF files
    are read once, by one function; pages are cleaned in the row that they came in.
    """
    kinds = ", ".join("." + t for t in T.FILE_TYPES)
    files = files.select("document_id", "filename", "size", "content", T.file_type(F.col("filename")).alias("kind"))
    fits = F.col("size") <= settings.max_file_bytes
    known = F.col("kind").isin(*T.FILE_TYPES)
    none = F.lit(None).cast("string")
    inside = known & fits & F.col("kind").isin("txt", "md")
    why = F.when(~known, F.lit(f"unsupported file type; supported: {kinds}")).when(~fits, F.lit("file too large"))
    simple = files.where(~known | ~fits | F.col("kind").isin("txt", "md")).select("document_id", "filename", F.when(inside, T.decode_text(F.col("content"))).alias("text"), why.alias("error"))
    readers = {"csv": lambda d: [csv_text(d)], "docx": lambda d: [docx_text(d)], "pdf": read_pdf}
    asked = files.where(known & fits & F.col("kind").isin(*readers)).select("document_id", "filename", "kind", "content")
    read = asked.mapInPandas(_read(readers), "document_id string, filename string, kind string, pages array<string>, error string")
    text = F.when(F.col("error").isNotNull(), none).when(F.col("kind") == "pdf", page_texts(F.col("pages"), keep_page_markers)).otherwise(F.get("pages", F.lit(0)))
    return simple.unionByName(read.select("document_id", "filename", text.alias("text"), "error"))
