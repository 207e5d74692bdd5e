"""Classification reports as single files: semicolon CSV and pretty JSON."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame

from loomtext.sources.security import output_path

COLUMNS = ["title_object", "name_file_dataset", "classify_names_list", "date_of_occurrence", "score_percent", "match_titles"]
HEADER = ["title object", "name_file_dataset", "classify_names_list", "date of occurrence", "score_percent", "match_titles"]


def write_csv(report: DataFrame, path: str, base: str | None = None) -> None:
    """Rows of a report (COLUMNS) to one CSV file; its folder must exist. Rows stream to the driver."""
    with open(output_path(path, base), "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=";", lineterminator="\n")
        out.writerow(HEADER)
        for r in report.select(*COLUMNS).toLocalIterator():
            out.writerow([r[0], r[1], r[2], r[3].isoformat() + "+00:00", f"{r[4]:.2f}", r[5]])


def write_json(report: DataFrame, path: str, name: str, base: str | None = None) -> None:
    """Rows of a report to {report_name, records} in one JSON file, in folders made as needed."""
    target = output_path(path, base)
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    rows = [{**r.asDict(), "date_of_occurrence": r["date_of_occurrence"].isoformat() + "+00:00"} for r in report.select(*COLUMNS).toLocalIterator()]
    Path(target).write_text(json.dumps({"report_name": name, "records": rows}, indent=2, ensure_ascii=False), encoding="utf-8")
