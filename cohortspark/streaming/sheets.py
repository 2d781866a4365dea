"""Metadata sheets as they arrive: typed rows and failing rows, each into a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortspark.operators.bad_rows import failed_rows, parse_sheet_rows, valid_rows


def split_stream(rows: DataFrame, sheets: DataFrame, valid_path: str, failed_path: str, checkpoint: str) -> list[StreamingQuery]:
    """Parses a stream of sheet rows (see parse_sheet_rows) and appends to two Parquet tables, exactly once each.

    Parsing needs no state, so there is no watermark and late rows are as good as others. Runs over what is there and
    stops; call it again, with the same checkpoint, for what came since.
    """
    parsed = parse_sheet_rows(rows, sheets)
    sinks = ((valid_rows(parsed), valid_path, "valid"), (failed_rows(parsed), failed_path, "failed"))
    return [
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for df, path, name in sinks
    ]
