"""Problem 4: items over a size limit, cut at natural boundaries with an overlap.

Recursive separator hierarchy (section, paragraph, sentence, word, character) and greedy
packing. Cuts are offsets into the original text, so the pieces rebuild it exactly.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The hierarchy: a piece may end after a match. Fixed values, coarsest first.
SEPARATORS = (
    ("section", re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+|\n(?=#{1,6} |[=*_-]{3,}[ \t]*\n)|\f")),
    ("paragraph", re.compile(r"\n[ \t]*\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)
#: Parts of the block limit: block separators are empty lines.
_BLOCK = re.compile(r"\n[ \t]*\n")

PIECES = "piece_no int, start int, end int, overlap int, overlap_short int, boundary string, n_blocks int, text string"


def _blocks(ends: list[int], start: int, end: int) -> int:
    """Blocks that text[start:end] touches; ``ends`` are the places where a next block begins."""
    return 1 + bisect_left(ends, end) - bisect_right(ends, start)


class Limits:
    """What a piece may hold: its overlap and its new text together stay within both limits."""

    def __init__(self, text: str, max_chars: int | None, max_blocks: int | None, overlap: int | None) -> None:
        self.chars = max_chars if max_chars and max_chars > 0 else None
        self.blocks = max_blocks if max_blocks and max_blocks > 0 else None
        self.overlap = max(0, overlap or 0)
        self.ends = [m.end() for m in _BLOCK.finditer(text) if m.end() < len(text)]

    def back(self, begin: int) -> int:
        """Where the piece starts whose new text begins at ``begin``.

        The stated overlap before it; less only at the start of the text, or where nothing new would
        fit beside it: one character must, and the block it stands in.
        """
        back = max(0, begin - self.overlap)
        if self.chars:
            back = max(back, begin + 1 - self.chars)
        if self.blocks:
            first = bisect_left(self.ends, begin + 1) - self.blocks
            if first >= 0:
                back = max(back, self.ends[first])
        return min(back, begin)

    def fits(self, begin: int, end: int) -> bool:
        start = self.back(begin)
        return (self.chars is None or end - start <= self.chars) and (self.blocks is None or _blocks(self.ends, start, end) <= self.blocks)


def _cuts(text: str, start: int, end: int, level: int, fits: Callable[[int, int], bool]) -> list[tuple[int, str]]:
    """Ends of atoms that fit, within text[start:end]: split by the level, and what is still too large by the next."""
    if fits(start, end):
        return [(end, "end")]
    if level == len(SEPARATORS):
        out, at = [], start
        while not fits(at, end):
            low, high = at + 1, end
            while low < high:  # longest run of characters that fits
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(at, mid) else (low, mid - 1)
            # Not between a base character and what combines with it.
            while low > at + 1 and text[low : low + 1] and _joins(text[low]):
                low -= 1
            out.append((low, "character"))
            at = low
        return [*out, (end, "end")]
    name, separator = SEPARATORS[level]
    out, at = [], start
    for m in separator.finditer(text, start, end):
        if at < m.end() < end:
            out += [(e, name if b == "end" else b) for e, b in _cuts(text, at, m.end(), level + 1, fits)]
            at = m.end()
    return out + _cuts(text, at, end, level + 1, fits)


def _joins(c: str) -> bool:
    return unicodedata.combining(c) > 0 or c in "\u200d\ufe0f"


def split(text: str, max_chars: int | None, max_blocks: int | None, overlap: int | None) -> list[tuple[int, int, int, int, int, str, int, str]]:
    """Pieces (piece_no, start, end, overlap, overlap_short, boundary, n_blocks, text) of one item.

    Every piece is within both limits, its overlap included. ``start`` is where the new text of
    the piece begins; the piece is text[start - overlap:end]. Every piece but the first repeats
    exactly the stated number of characters before it. ``overlap_short`` says by how many it falls
    short: where the stated overlap reaches before the start of the text, is not below the limit
    of characters, or holds so many blocks that no new text would fit beside it.
    A null or non-positive limit does not bind. An item within the limits is one piece.
    """
    limits = Limits(text, max_chars, max_blocks, overlap)
    if limits.fits(0, len(text)):
        return [(0, 0, len(text), 0, 0, "end", _blocks(limits.ends, 0, len(text)), text)]
    atoms = _cuts(text, 0, len(text), 0, limits.fits)
    out: list[tuple[int, int, int, int, int, str, int, str]] = []
    begin, i = 0, 0
    while i < len(atoms):
        end, boundary = atoms[i]
        i += 1
        while i < len(atoms) and limits.fits(begin, atoms[i][0]):
            end, boundary = atoms[i]
            i += 1
        back = limits.back(begin)
        short = limits.overlap - (begin - back) if out else 0
        out.append((len(out), begin, end, begin - back, short, boundary, _blocks(limits.ends, back, end), text[back:end]))
        begin = end
    return out


def oversized(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Jobs over a limit of their profile: job_id, source_text, limits, reason; one row per delivery."""
    limits = profiles.groupBy("name").agg(*(F.max(c).alias(c) for c in ("chunk_max_chars", "chunk_max_blocks", "overlap_chars")))
    rows = jobs.select(F.col("job.job_id").alias("job_id"), F.col("payload.source_text").alias("source_text"), F.coalesce(F.size("payload.block_ids"), F.lit(0)).alias("n_ids"), F.col("profile_name").alias("name"))
    chars, blocks = F.length("source_text") > F.col("chunk_max_chars"), F.col("n_ids") > F.col("chunk_max_blocks")
    reason = F.when(chars & blocks, "both").when(chars, "chars").when(blocks, "blocks")
    return rows.join(limits, "name").withColumn("reason", reason).where("reason is not null and job_id is not null")


def split_jobs(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pieces of every job over the limits of its profile.

    ``jobs(job.job_id, payload.source_text, payload.block_ids, profile_name)``, ``profiles(name,
    chunk_max_chars, chunk_max_blocks, overlap_chars)``. A job delivered again is split once.
    Result: job_id, reason (chars, blocks or both), piece_no, start, end, overlap, overlap_short,
    boundary (what the piece ends with), n_blocks, text. Jobs exactly at a limit, jobs with a null text or
    an unknown profile have no pieces; null block ids count as none; extra columns are not read.
    Where the ids of a job outnumber the empty lines of its text, the block limit is applied to
    the blocks of the text.
    """
    over = oversized(jobs, profiles).where("source_text is not null")
    # Only the oversized rows are brought together by key, not the whole table.
    once = over.groupBy("job_id").agg(F.min(F.struct("source_text", "chunk_max_chars", "chunk_max_blocks", "overlap_chars", "reason")).alias("r")).select("job_id", "r.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job, text, chars, blocks, overlap, reason in zip(frame.job_id, frame.source_text, frame.chunk_max_chars, frame.chunk_max_blocks, frame.overlap_chars, frame.reason):
                number = lambda x: None if pd.isna(x) else int(x)
                rows += [(job, reason, *piece) for piece in split(text, number(chars), number(blocks), number(overlap) or 0)]
            yield pd.DataFrame(rows, columns=["job_id", "reason", "piece_no", "start", "end", "overlap", "overlap_short", "boundary", "n_blocks", "text"])

    return once.mapInPandas(run, f"job_id string, reason string, {PIECES}")


def oversized_jobs(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(job_id, reason) of the jobs that ``split_jobs`` cuts: one row per job, from its first pieces."""
    return split_jobs(jobs, profiles).where("piece_no = 0").select("job_id", "reason")
