"""Sinks: tables, appended logs, JSON objects, Markdown reports, job folders."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str = "parquet", append: bool = False) -> None:
    """Overwrite or append a table as parquet or JSON lines."""
    df.write.mode("append" if append else "overwrite").format(kind).save(path)


def json_object(df: DataFrame, path: str) -> None:
    """One row as a readable JSON object in one file."""
    row = df.select(F.to_json(F.struct("*")).alias("j")).head()
    with open(path, "w", encoding="utf-8") as out:
        json.dump(json.loads(row.j) if row else {}, out, ensure_ascii=False, indent=2, sort_keys=True)


def report(title: str, counts: DataFrame, by: list[str], number: str = "n") -> DataFrame:
    """A Markdown report of a counts table, as one row (K04): largest numbers first, then by name."""
    line = F.concat(F.lit("- "), F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by]), F.lit(": "), F.col(number).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col(number)).alias("k"), line.alias("l"))))
    body = F.array_join(F.transform(rows, lambda r: r["l"]), "\n")
    return counts.agg(F.concat(F.lit(f"# {title}\n\nTotal: "), F.coalesce(F.sum(number), F.lit(0)).cast("string"), F.lit("\n\n"), body).alias("report"))


def job_folders(jobs: DataFrame, root: str) -> None:
    """Each job's input and prompt in a folder of its own, written by the tasks (K06). ``jobs(job_id, input, prompt)``."""

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            home = os.path.join(root, r.job_id)
            os.makedirs(home, exist_ok=True)
            for name, text in (("input.json", r.input), ("prompt.md", r.prompt)):
                with open(os.path.join(home, name), "w", encoding="utf-8") as out:
                    out.write(text or "")

    jobs.select("job_id", "input", "prompt").foreachPartition(put)
