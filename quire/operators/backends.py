"""Backends that answer jobs: an interface, a mock as columns, a command per row; job inputs and prompts."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class Backend(Protocol):
    """Answers one job at a time inside a task."""

    def answer(self, job_id: str, prompt: str) -> str: ...


class CommandBackend:
    """Runs a command per job with the prompt on its input; a failure or time-out is an empty answer."""

    def __init__(self, command: Callable[[str], list[str]], seconds: float = 120.0, attempts: int = 2) -> None:
        self.command, self.seconds, self.attempts = command, seconds, attempts

    def answer(self, job_id: str, prompt: str) -> str:
        for _ in range(max(1, self.attempts)):
            try:
                done = subprocess.run(self.command(job_id), input=prompt, capture_output=True, text=True, timeout=self.seconds, check=False)
            except (OSError, subprocess.TimeoutExpired):
                continue
            if done.returncode == 0:
                return done.stdout
        return ""


def run(jobs: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """job_id, answer, ok for ``jobs(job_id, prompt)``; one backend is made per task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for f in frames:
            said = [backend.answer(j, p) for j, p in zip(f.job_id, f.prompt)]
            yield pd.DataFrame({"job_id": f.job_id, "answer": said, "ok": [bool(s.strip()) for s in said]})

    return jobs.select("job_id", "prompt").mapInPandas(work, "job_id string, answer string, ok boolean")


def mock(jobs: DataFrame, prefix: str = "[MOCK_RU] ", failing: tuple[str, ...] = ()) -> DataFrame:
    """id, status, target: the deterministic answers of the mock, as columns."""
    bad = F.col("id").isin(*failing) if failing else F.lit(False)
    return jobs.select("id", F.when(bad, "failed").otherwise("completed").alias("status"), F.when(~bad, F.concat(F.lit(prefix), X.text("text"))).alias("target"))


def job_input(jobs: DataFrame) -> DataFrame:
    """job_id, input: the job's input as one JSON object, language codes lower case, blank terms left out."""
    terms = F.filter("payload.glossary", lambda g: (X.strip(g["source"]) != "") & (X.strip(g["target"]) != ""))
    job = F.struct(F.col("job.job_id").alias("job_id"), F.lower("job.source_language").alias("source_language"), F.lower("job.target_language").alias("target_language"))
    body = F.struct("payload.chunk_id", "payload.source_text", "payload.block_ids", "payload.footnote_markers", terms.alias("glossary"), "payload.style_hints")
    return jobs.select(F.col("job.job_id").alias("job_id"), F.to_json(F.struct("schema_version", job.alias("job"), body.alias("payload"))).alias("input"))


def prompts(jobs: DataFrame, template: str) -> DataFrame:
    """job_id, prompt: a template with its placeholders filled; one that is left is an error."""
    values = {"source_text": F.col("payload.source_text"), "source_language": F.lower("job.source_language"), "target_language": F.lower("job.target_language"), "chunk_id": F.col("payload.chunk_id")}
    return jobs.select(F.col("job.job_id").alias("job_id"), X.fill(F.lit(template), values).alias("prompt"))


def best_text(answer: Column) -> Column:
    """The first text that is not blank of the known fields of a JSON answer."""
    fields = [F.trim(F.get_json_object(answer, f"$.{k}"), F.lit(X.BLANKS)) for k in ("translated_text", "target_text", "edited_text")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])


