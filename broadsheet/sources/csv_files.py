"""CSV files written by the driver from a streamed result, reconciled before they replace anything."""

from __future__ import annotations

import csv
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from broadsheet.errors import ExportFailure


def write(outputs: Sequence[tuple[str | Path, DataFrame, Sequence[str], int]]) -> list[int]:
    """Write (path, rows, columns, expected) together; returns the rows written to each.

    UTF-8, CRLF records, line feeds inside values untouched, nulls empty, booleans 1 and 0. Rows
    come partition by partition, so the driver holds one partition. If any count differs from the
    expected one, no file is replaced.
    """
    made: list[tuple[str, Path]] = []
    counts = []
    try:
        for path, df, columns, expected in outputs:
            if len(set(columns)) != len(columns):
                raise ExportFailure("columns must differ")
            path = Path(path)
            path.parent.mkdir(parents=True, exist_ok=True)
            handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".part")
            made.append((temporary, path))
            written = 0
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
                out = csv.writer(f, lineterminator="\r\n")
                out.writerow(columns)
                for row in df.select(*columns).toLocalIterator(prefetchPartitions=True):
                    out.writerow(["" if v is None else int(v) if isinstance(v, bool) else v for v in row])
                    written += 1
            if written != expected:
                raise ExportFailure(f"{path.name}: {written} rows written, {expected} expected")
            counts.append(written)
        for temporary, path in made:
            os.replace(temporary, path)
        return counts
    finally:
        for temporary, _ in made:
            if os.path.exists(temporary):
                os.unlink(temporary)
