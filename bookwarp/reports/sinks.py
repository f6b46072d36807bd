"""Writing result tables: one file for people, or Spark's own writers for bulk.

The single-file writers stream rows through ``toLocalIterator``, so the driver holds one partition at a time.
"""

from __future__ import annotations

import csv
import html
import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame


def rows_of(df: DataFrame) -> Iterator[list]:
    for row in df.toLocalIterator():
        yield list(row)


class Sink(ABC):
    """Writes a table to one file and returns its path."""

    suffix = ""

    @abstractmethod
    def write_rows(self, headers: list[str], rows: Iterator[list], path: Path) -> None: ...

    def write(self, df: DataFrame, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        self.write_rows(df.columns, rows_of(df), path)
        return path


class CsvSink(Sink):
    suffix = ".csv"

    def write_rows(self, headers, rows, path):
        with path.open("w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            out.writerow(headers)
            out.writerows(rows)


class JsonSink(Sink):
    """One array of objects."""

    suffix = ".json"

    def write_rows(self, headers, rows, path):
        with path.open("w", encoding="utf-8") as f:
            f.write("[")
            for i, row in enumerate(rows):
                text = json.dumps(dict(zip(headers, row, strict=True)), indent=2, ensure_ascii=False, default=str)
                f.write(("," if i else "") + "\n  " + text.replace("\n", "\n  "))
            f.write("\n]\n")


class HtmlSink(Sink):
    suffix = ".html"

    def write_rows(self, headers, rows, path):
        cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
        with path.open("w", encoding="utf-8") as f:
            f.write('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Report</title></head><body><table>\n')
            f.write("<tr>" + "".join(cell("th", h) for h in headers) + "</tr>\n")
            for row in rows:
                f.write("<tr>" + "".join(cell("td", v) for v in row) + "</tr>\n")
            f.write("</table></body></html>\n")


class ExcelSink(Sink):
    suffix = ".xlsx"

    def write_rows(self, headers, rows, path):
        try:
            from openpyxl import Workbook
            from openpyxl.styles import Font
            from openpyxl.utils import get_column_letter
        except ImportError as error:
            raise ImportError("Excel reports need the optional 'openpyxl' dependency - install it with: pip install openpyxl") from error
        book = Workbook()
        sheet = book.active
        sheet.title = "Report"
        sheet.append(headers)
        width = [len(str(h)) for h in headers]
        for row in rows:
            sheet.append(row)
            width = [max(w, len(str(v))) for w, v in zip(width, row, strict=True)]
        for i, w in enumerate(width, 1):
            sheet.cell(1, i).font = Font(bold=True)
            sheet.column_dimensions[get_column_letter(i)].width = min(w + 2, 60)
        book.save(path)


class PdfSink(Sink):
    suffix = ".pdf"

    def write_rows(self, headers, rows, path):
        try:
            from fpdf import FPDF
        except ImportError as error:
            raise ImportError("PDF reports need the optional 'fpdf2' dependency - install it with: pip install fpdf2") from error
        pdf = FPDF(orientation="landscape")
        pdf.add_page()
        pdf.set_font("Helvetica", size=8)
        with pdf.table() as grid:
            head = grid.row()
            for h in headers:
                head.cell(str(h)[:40])
            for row in rows:
                line = grid.row()
                for v in row:
                    line.cell(str(v)[:60])
        pdf.output(str(path))


SINKS = {"csv": CsvSink, "json": JsonSink, "html": HtmlSink, "excel": ExcelSink, "pdf": PdfSink}


def write_report(df: DataFrame, path: str | Path, kind: str = "csv") -> Path:
    if kind not in SINKS:
        raise ValueError(f"Unknown report format: {kind!r}")
    return SINKS[kind]().write(df, path)


def write_bulk(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Spark's own writers, in parallel."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).option("emptyValue", "").csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
