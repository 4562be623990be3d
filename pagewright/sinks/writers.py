"""Sheets, tables and logs out of DataFrames."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterable
from datetime import date, datetime
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHEET = "xl/worksheets/sheet1.xml"
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Rows of one sheet, a limit of the format: more rows belong into Parquet.
SHEET_ROWS = 1_048_576


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = value.isoformat() if isinstance(value, (date, datetime)) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))}</t></is></c>'


def append_sheet(path: str, rows: Iterable[Iterable[object]]) -> int:
    """Append rows to the first sheet of a workbook, made if it is not there; no header is written.  Returns how many rows were written.

    Rows come as an iterator (``toLocalIterator``), so the driver never holds a whole result.  More rows than a sheet can have raise ``ValueError`` and leave
    the workbook as it was."""
    old = ""
    if os.path.exists(path):
        with zipfile.ZipFile(path) as z:
            old = re.search(r"<sheetData>(.*)</sheetData>", z.read(_SHEET).decode(), re.S)[1]
    n = 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        with z.open(_SHEET, "w", force_zip64=True) as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + old.encode())
            room = SHEET_ROWS - len(re.findall(r"<row[ >/]", old))
            for row in rows:
                if n == room:
                    raise ValueError(f"a sheet has at most {SHEET_ROWS} rows")
                f.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                n += 1
            f.write(b"</sheetData></worksheet>")
    os.replace(path + ".part", path)
    return n


def write_sheet(rows: DataFrame, path: str, values: str = "values", typed: str | None = None) -> dict:
    """Write the rows to be written (not skipped, no error rows) and return the counts; typed cells go before text cells."""
    writes = rows.where((F.col("action") == "write") & ~F.coalesce(F.col("is_error_row"), F.lit(False)))
    cells = F.coalesce(F.col(typed), F.col(values)) if typed else F.col(values)
    total = rows.count()
    written = append_sheet(path, (r[0] for r in writes.select(cells).toLocalIterator()))
    return {"total_rows": total, "selected_rows": written, "written_rows": written, "skipped_rows": total - written, "output_path": path}


def masked(payload: Column) -> Column:
    """JSON with the values of api keys and authorisations, on any level, as asterisks."""
    return F.regexp_replace(payload, r'(?i)("[^"]*(?:api_key|authorization)[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]]+)', '$1"****"')


def log_lines(events: DataFrame) -> DataFrame:
    """(event_date, line) of events (event_time, event_type, payload): JSON lines with secrets masked."""
    line = F.to_json(F.struct("event_time", "event_type", F.col("payload")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return events.select(F.to_date("event_time").alias("event_date"), masked(line).alias("line"))


def write_log(events: DataFrame, path: str) -> None:
    log_lines(events).write.mode("append").partitionBy("event_date").text(path)
