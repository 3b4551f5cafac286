"""CSV export of report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Quotes are doubled, NULL and '' are both empty fields, lines end in CRLF.
_OPTIONS = {
    "header": True,
    "lineSep": "\r\n",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def write_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Writes any report. ``single_file`` suits capped exports only: it runs in one task."""
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").options(**_OPTIONS).csv(path)
