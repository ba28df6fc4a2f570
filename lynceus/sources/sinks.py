"""Result writers: one ordered file for people, and partitioned tables for everything else."""

from __future__ import annotations

import csv
import json
import os
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.scoring import OUTPUT
from lynceus.plans.urls import json_records, result_cells


def write_csv(results: DataFrame, path: str | None, columns: list[str], header: list[str], row_id: str = "_row_id") -> int:
    """One CSV in the order of the input, with a byte-order mark; None is the screen. Rows stream through the driver."""
    cells = result_cells(results)
    rows = results.select(row_id, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns], *[cells[k].alias(f"_out_{k}") for k in OUTPUT]).orderBy(row_id).drop(row_id)
    n, out = 0, sys.stdout if path is None else open(path, "w", encoding="utf-8-sig", newline="")  # noqa: SIM115
    try:
        writer = csv.writer(out)
        writer.writerow([*header, *OUTPUT])
        for row in rows.toLocalIterator(prefetchPartitions=True):
            writer.writerow(row)
            n += 1
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    finally:
        if path is not None:
            out.close()
    return n


def write_json(results: DataFrame, path: str | None, url: str, keys: dict[str, str] | None = None, row_id: str = "_row_id") -> int:
    """JSON lines in the order of the input, ASCII only."""
    rows = results.select(row_id, json_records(results, url, keys).alias("json")).orderBy(row_id)
    n, out = 0, sys.stdout if path is None else open(path, "w", encoding="utf-8", newline="")  # noqa: SIM115
    try:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.write(json.dumps(json.loads(r.json)) + "\n")
            n += 1
    finally:
        if path is not None:
            out.close()
    return n


def write_table(results: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, typed; by splits it into folders, such as by split or verdict."""
    writer = results.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv_cell(cell: Column) -> Column:
    """A cell as CSV has it: in quotes, doubled inside, where it needs them."""
    cell = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(cell.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def write_csv_parts(results: DataFrame, path: str, columns: list[str], header: list[str], row_id: str = "_row_id", rows_per_file: int = 1_000_000) -> None:
    """As write_csv, in files by ranges of row numbers, written in parallel: each has the byte-order mark and the header.

    The files' names are in the order of the rows. Nothing passes the driver.
    """
    cells = result_cells(results)
    line = F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in columns], *[csv_cell(cells[k]) for k in OUTPUT])
    rows = results.select(F.col(row_id).alias("_row"), line.alias("line"))
    first = ",".join('"' + h.replace('"', '""') + '"' if any(c in h for c in ',"\r\n') else h for h in [*header, *OUTPUT])
    parts = max(1, -(-results.count() // rows_per_file))
    dealt = rows.repartitionByRange(parts, "_row").sortWithinPartitions("_row").select("line")
    _write_lines(dealt, path, "\ufeff" + first)


def _write_lines(lines: DataFrame, path: str, first: str) -> None:
    """Text files whose lines end as spreadsheets have them; the first line of each is given."""
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    with_first = lines.select(F.when(number == 0, F.concat(F.lit(first + "\r\n"), "line")).otherwise(F.col("line")).alias("value"))
    with_first.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json_parts(results: DataFrame, path: str, url: str, keys: dict[str, str] | None = None, row_id: str = "_row_id", rows_per_file: int = 1_000_000) -> None:
    """As write_json, in files by ranges of row numbers, written in parallel."""
    rows = results.select(F.col(row_id).alias("_row"), json_records(results, url, keys).alias("value"))
    parts = max(1, -(-results.count() // rows_per_file))
    rows.repartitionByRange(parts, "_row").sortWithinPartitions("_row").select("value").write.mode("overwrite").text(path)
