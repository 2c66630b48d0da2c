"""PDF and scanner sources. The readers of the page content need tools that may be absent (a PDF
library, a page renderer, a character reader); what comes out of them is processed here either way."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import TSV

SPANS = "path string, page_num int, page_width double, page_height double, ord int, text string, x double, y double, size double, font string"
LINES = "path string, page_num int, place int, text string, x0 double, y0 double, x1 double, y1 double, avg_font double, max_font double, fonts array<string>"


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Text spans of PDF files with their place and font (S03, S04); a page without spans gives its plain lines.

    Needs ``pypdf`` on the executors; a page that cannot be read gives no rows.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for f in frames:
            rows: list[tuple] = []
            for name, content in zip(f.path, f.content):
                for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    w, h = float(page.mediabox.width), float(page.mediabox.height)
                    found: list[tuple] = []

                    def see(text, _cm, tm, font, size, found=found):
                        if text.strip():
                            found.append((text.strip(), float(tm[4]), float(tm[5]), float(size or 0), str((font or {}).get("/BaseFont", "unknown"))))

                    try:
                        page.extract_text(visitor_text=see)
                        if not found:
                            lines = [t.strip() for t in (page.extract_text() or "").splitlines() if t.strip()]
                            found = [(t, 0.0, h - 14.0 * k, 10.0, "unknown") for k, t in enumerate(lines, 1)]
                    except Exception:  # a broken page must not end the job
                        continue
                    rows += [(name, number, w, h, k, *s) for k, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, SPANS)


def lines(found: DataFrame, near: float = 3.0) -> DataFrame:
    """Lines of a page from its spans (W04, R25): spans join the first line whose first span is within ``near`` points.

    Which line a span joins depends on those before it, so a page is folded as a whole; pages run in parallel.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for s in frame.sort_values(["y", "x", "ord"], ascending=[False, True, True]).itertuples(index=False):
            home = next((g for g in groups if abs(g[0].y - s.y) <= near), None)
            if home is None:
                groups.append([s])
            else:
                home.append(s)
        rows = []
        for g in groups:
            g.sort(key=lambda s: (s.x, s.ord))
            wide = [max(max(len(s.text.strip()), 1) * s.size * 0.5, s.size) for s in g]
            sizes = [s.size for s in g if s.size > 0]
            x1 = min(g[0].page_width, max(s.x + w for s, w in zip(g, wide)))
            y1 = min(g[0].page_height, max(s.y + 1.2 * max(s.size, 10.0) for s in g))
            rows.append((g[0].path, g[0].page_num, len(rows) + 1, " ".join(s.text for s in g).strip(), round(max(0.0, g[0].x), 2), round(max(0.0, min(s.y for s in g)), 2), round(x1, 2), round(y1, 2), round(sum(sizes) / len(sizes), 2) if sizes else 0.0, round(max(sizes, default=0.0), 2), sorted({s.font for s in g if s.font})))
        return pd.DataFrame([r for r in rows if r[3]], columns=[c.split()[0] for c in LINES.split(", ")])

    return found.groupBy("path", "page_num").applyInPandas(build, LINES)


def scanned_words(spark: SparkSession, path: str, dpi: int = 200, language: str = "eng", seconds: float = 300.0) -> DataFrame:
    """Word tables of scanned PDF files through a page renderer and a character reader.

    Needs ``pdftoppm`` and ``tesseract`` on the executors and fails with their names where they are absent.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = [t for t in ("pdftoppm", "tesseract") if not shutil.which(t)]
        if missing:
            raise RuntimeError(f"not installed: {', '.join(missing)}")
        names = [c.split()[0] for c in TSV.split(", ")]
        for f in frames:
            for name, content in zip(f.path, f.content):
                with tempfile.TemporaryDirectory() as home:  # of one task, gone with it
                    Path(home, "in.pdf").write_bytes(content)
                    subprocess.run(["pdftoppm", "-r", str(dpi), "-png", f"{home}/in.pdf", f"{home}/p"], check=True, timeout=seconds)
                    for number, image in enumerate(sorted(Path(home).glob("p*.png")), 1):
                        out = subprocess.run(["tesseract", str(image), "stdout", "-l", language, "tsv"], capture_output=True, text=True, check=True, timeout=seconds).stdout
                        rows = [r.split("\t", 11) for r in out.splitlines()[1:]]
                        yield pd.DataFrame([(f"{name}#{number}", *map(int, r[:10]), float(r[10]), r[11]) for r in rows if len(r) == 12], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, TSV)


def image_suffix(name, filters):
    """The file suffix of an image: that of its name, else by its filters."""
    own = F.regexp_extract(F.lower(name), r"(\.[a-z0-9]+)$", 1)
    joined = F.lower(F.array_join(F.coalesce(filters, F.array().cast("array<string>")), " "))
    guess = F.when(joined.rlike("dct|jpeg"), ".jpg").when(joined.contains("jp"), ".jp2").when(joined.contains("flate"), ".png").otherwise(".bin")
    return F.when(own != "", own).otherwise(guess)
