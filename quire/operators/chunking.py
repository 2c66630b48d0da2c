"""Chunks: greedy packing of paragraphs, contexts, hints, adaptive split and merge, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import cut
from . import complexity
from .ordered import neighbours, running
from .structure import ORDER

CHUNK_TYPES = ("paragraph_group", "caption", "footnote", "heading", "auxiliary")


def chunk_type(block_type: Column) -> Column:
    """The kind of chunk that a kind of block belongs to."""
    return (
        F.when(block_type == "paragraph", "paragraph_group").when(block_type.isin("heading", "caption"), block_type)
        .when(block_type.isin("footnote_body", "footnote_marker"), "footnote").otherwise("auxiliary")
    )


def pack(blocks: DataFrame, max_chars: int = 1200, max_blocks: int = 8) -> DataFrame:
    """Blocks with ``chunk_no`` (from 1 in every book) and ``chapter_id``.

    Consecutive paragraphs of one section fill a chunk until the next would pass ``max_chars``
    (one more for the line end between two) or ``max_blocks``; other blocks are chunks of their own.
    Runs of paragraphs are found first, with the two-level order of the book; only a run is folded.
    """
    # The narrow rows of the order are used several times over; they are kept once.
    base = cut(blocks.select("doc_id", "block_id", "page_num", "reading_order", "block_type", F.coalesce("section_id", F.lit("section-unknown")).alias("chapter_id"), F.length(X.text("text")).alias("n")))
    marked = base.withColumn("run_key", F.when(F.col("block_type") == "paragraph", F.col("chapter_id")))
    near = neighbours(marked, "doc_id", "page_num", ORDER, "run_key", "run_before", "_after").drop("_after")
    starts = (F.col("run_key").isNull() | ~F.col("run_key").eqNullSafe(F.col("run_before"))).cast("int")
    runs = cut(running(near, "doc_id", "page_num", ORDER, starts, "run"))
    single = runs.where("block_type <> 'paragraph'").select("doc_id", "block_id", F.lit(1).alias("opens"))
    members = runs.where("block_type = 'paragraph'").groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("page_num", "reading_order", "block_id", "n"))).alias("m"))

    def step(s: Column, x: Column) -> Column:
        full = (s["k"] == 0) | (s["k"] >= max_blocks) | (s["c"] + 1 + x["n"] > max_chars)
        return F.struct(
            F.when(full, 1).otherwise(s["k"] + 1).alias("k"), F.when(full, x["n"]).otherwise(s["c"] + 1 + x["n"]).alias("c"),
            F.when(full, F.concat(s["o"], F.array(x["block_id"]))).otherwise(s["o"]).alias("o"),
        )

    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("c"), F.array().cast("array<string>").alias("o"))
    opened = members.select("doc_id", F.explode(F.aggregate("m", zero, step, lambda s: s["o"])).alias("block_id"), F.lit(1).alias("opens"))
    placed = base.join(single.unionByName(opened), ["doc_id", "block_id"], "left")
    return cut(running(placed, "doc_id", "page_num", ORDER, F.coalesce("opens", F.lit(0)), "chunk_no").drop("opens", "n"))


def chunks(blocks: DataFrame, max_chars: int = 1200, max_blocks: int = 8, most_hints: int = 12) -> DataFrame:
    """One row per chunk: doc_id, chunk_id, chapter_id, chunk_type, start_page, end_page, block_ids, source_text, hints, token_estimate."""
    packed = pack(blocks, max_chars, max_blocks).join(blocks.select("doc_id", "block_id", X.strip("text").alias("t")), ["doc_id", "block_id"])
    rows = F.array_sort(F.collect_list(F.struct("page_num", "reading_order", "block_id", "t")))
    whole = packed.groupBy("doc_id", "chunk_no").agg(F.first("chapter_id").alias("chapter_id"), chunk_type(F.first("block_type")).alias("chunk_type"), F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"), rows.alias("r"))
    source = F.array_join(F.filter(F.col("r.t"), lambda t: t != ""), "\n")
    out = whole.select("doc_id", F.format_string("chk-%05d", "chunk_no").alias("chunk_id"), "chunk_no", "chapter_id", "chunk_type", "start_page", "end_page", F.col("r.block_id").alias("block_ids"), source.alias("source_text"))
    return out.withColumns({"hints": X.hints("source_text", most_hints), "token_estimate": X.token_estimate("source_text")})


def contexts(blocks: DataFrame, packed: DataFrame, most: int = 280) -> DataFrame:
    """doc_id, chunk_no, before, after: the two blocks before and after every chunk, cut to ``most`` characters."""
    edge = packed.join(blocks.select("doc_id", "block_id", X.strip("text").alias("t")), ["doc_id", "block_id"]).select("doc_id", "block_id", "page_num", "reading_order", "chunk_no", "t")
    cell = edge.withColumn("v", F.struct("t"))
    one = neighbours(cell, "doc_id", "page_num", ORDER, "v", "p1", "n1")
    two = neighbours(one, "doc_id", "page_num", ORDER, "p1", "p2", "_x")
    two = neighbours(two.drop("_x"), "doc_id", "page_num", ORDER, "n1", "_y", "n2").drop("_y")
    key = F.struct("page_num", "reading_order", "block_id")
    ends = two.groupBy("doc_id", "chunk_no").agg(F.min_by(F.array("p2.t", "p1.t"), key).alias("b"), F.max_by(F.array("n1.t", "n2.t"), key).alias("a"))
    join = lambda c: F.array_join(F.filter(c, lambda t: t.isNotNull() & (t != "")), "\n")
    return ends.select("doc_id", "chunk_no", X.tail(join("b"), most).alias("before"), X.head(join("a"), most).alias("after"))


def note_refs(chunk_rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, chunk_id, n_refs, markers: links whose marker or body lies in the chunk, each once."""
    ids = links.withColumn("link", F.xxhash64("doc_id", "marker_block_id", "body_block_id", "marker"))
    sides = ids.select("doc_id", "link", "marker", F.explode(F.array_compact(F.array("marker_block_id", "body_block_id"))).alias("block_id"))
    members = chunk_rows.select("doc_id", "chunk_id", F.explode("block_ids").alias("block_id"))
    found = members.join(sides, ["doc_id", "block_id"]).groupBy("doc_id", "chunk_id", "link").agg(F.min("marker").alias("marker"))
    return found.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n_refs"), F.array_join(F.array_sort(F.collect_set("marker")), ",").alias("markers"))


def merge_pairs(scored: DataFrame, max_chars: int = 1400, max_blocks: int = 8) -> DataFrame:
    """Chunk pairs to merge, left to right without overlap: doc_id, chunk_id, with_id.

    ``scored`` has doc_id, chunk_no, chunk_id, chapter_id, chunk_type, score, n_chars, n_blocks,
    n_refs. In each run of links between mergeable neighbours the odd links are taken, which is
    what a pass from left to right chooses.
    """
    w = W.partitionBy("doc_id").orderBy("chunk_no")
    nxt = {c: F.lead(c).over(w) for c in ("chunk_id", "chapter_id", "chunk_type", "score", "n_chars", "n_blocks", "n_refs")}
    both = scored.withColumns({f"_{c}": v for c, v in nxt.items()})
    fits = (
        (F.col("chunk_type") == "paragraph_group") & (F.col("_chunk_type") == "paragraph_group") & (F.col("chapter_id") == F.col("_chapter_id")) & (F.col("n_refs") + F.col("_n_refs") == 0)
        & (F.col("score") < 0.25) & (F.col("_score") < 0.25) & (F.col("n_chars") + F.col("_n_chars") <= int(max_chars * 1.5)) & (F.col("n_blocks") + F.col("_n_blocks") <= int(max_blocks * 1.5))
    )
    linked = both.select("doc_id", "chunk_no", "chunk_id", F.col("_chunk_id").alias("with_id"), F.coalesce(fits, F.lit(False)).alias("fits"))
    gaps = linked.withColumn("gap", F.sum((~F.col("fits")).cast("int")).over(w)).where("fits")
    nth = F.row_number().over(W.partitionBy("doc_id", "gap").orderBy("chunk_no"))
    return gaps.withColumn("nth", nth).where("nth % 2 = 1").select("doc_id", "chunk_id", "with_id")


def split_complex(scored: DataFrame, least: float = 0.74, max_blocks: int = 8) -> DataFrame:
    """Pieces of chunks above the score: doc_id, chunk_id (``...-s1``), parent, block_ids."""
    size = max(1, max_blocks // 2)
    big = scored.where((F.col("chunk_type") == "paragraph_group") & (F.col("score") >= least) & (F.size("block_ids") > 1))
    starts = F.sequence(F.lit(0), F.floor((F.size("block_ids") - 1) / size).cast("int"))
    return big.select("doc_id", F.col("chunk_id").alias("parent"), "block_ids", F.explode(starts).alias("i")).select("doc_id", F.format_string("%s-s%d", "parent", F.col("i") + 1).alias("chunk_id"), "parent", F.array_join(F.slice("block_ids", F.col("i") * size + 1, F.lit(size)), ",").alias("block_ids"))


def adapted(scored: DataFrame, blocks: DataFrame, least: float = 0.74, max_chars: int = 1400, max_blocks: int = 8) -> DataFrame:
    """doc_id, chunk_id, source_ids, chunk_type, block_ids, source_text, token_estimate: hard chunks split, easy neighbours joined.

    ``scored`` is that of ``complexity.assess`` over ``chunks``. Pieces have the texts of their blocks and are
    rated again before joining; ``source_ids`` are the chunks that a row comes from.
    """
    base = scored.select("doc_id", "chunk_no", "chunk_id", "chapter_id", "chunk_type", "block_ids", "source_text", "score")
    hard = (F.col("chunk_type") == "paragraph_group") & (F.col("score") >= least) & (F.size("block_ids") > 1)
    size = max(1, max_blocks // 2)
    members = base.where(hard).select("doc_id", "chunk_no", F.col("chunk_id").alias("parent"), "chapter_id", "chunk_type", F.posexplode("block_ids").alias("at", "block_id"))
    placed = members.withColumn("piece", F.floor(F.col("at") / size).cast("int") + 1).join(blocks.select("doc_id", "block_id", X.strip("text").alias("t")), ["doc_id", "block_id"])
    pieces = placed.groupBy("doc_id", "chunk_no", "parent", "chapter_id", "chunk_type", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "block_id", "t"))).alias("r"))
    cut_up = pieces.select("doc_id", (F.col("chunk_no").cast("bigint") * 100_000 + F.col("piece")).alias("chunk_no"), F.format_string("%s-s%d", "parent", "piece").alias("chunk_id"), F.array("parent").alias("source_ids"), "chapter_id", "chunk_type", F.col("r.block_id").alias("block_ids"), F.array_join(F.filter(F.col("r.t"), lambda t: t != ""), "\n").alias("source_text"))
    whole = base.where(~hard).select("doc_id", (F.col("chunk_no").cast("bigint") * 100_000).alias("chunk_no"), "chunk_id", F.array("chunk_id").alias("source_ids"), "chapter_id", "chunk_type", "block_ids", "source_text")
    rows = cut(complexity.assess(whole.unionByName(cut_up)).withColumns({"n_blocks": F.size("block_ids"), "n_refs": F.lit(0)}))
    pairs = cut(merge_pairs(rows.withColumn("n_refs", F.col("notes")), max_chars, max_blocks))
    part = rows.select("doc_id", "chunk_id", "source_ids", "chunk_type", "block_ids", F.trim("source_text").alias("source_text"))
    left, right = (part.select("doc_id", F.col("chunk_id").alias(name), F.struct("source_ids", "chunk_type", "block_ids", "source_text").alias(f"{name}_row")) for name in ("chunk_id", "with_id"))
    both = pairs.join(left, ["doc_id", "chunk_id"]).join(right, ["doc_id", "with_id"])
    a, b = F.col("chunk_id_row"), F.col("with_id_row")
    joined = both.select("doc_id", F.concat_ws("+", "chunk_id", "with_id").alias("chunk_id"), F.concat(a["source_ids"], b["source_ids"]).alias("source_ids"), a["chunk_type"].alias("chunk_type"), F.concat(a["block_ids"], b["block_ids"]).alias("block_ids"), F.trim(F.concat_ws("\n", a["source_text"], b["source_text"])).alias("source_text"))
    used = pairs.select("doc_id", F.explode(F.array("chunk_id", "with_id")).alias("chunk_id"))
    out = part.join(used, ["doc_id", "chunk_id"], "left_anti").unionByName(joined)
    return out.withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.length("source_text") / 4).cast("int")))


def chunk_errors(chunk_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, error: doubled ids, unknown types, missing blocks, bad page ranges, mixed kinds, empty texts."""
    ids = chunk_rows.select("doc_id", "chunk_id")
    out = ids.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "chunk_id", F.lit("doubled_id").alias("error"))
    own = F.explode(F.array_compact(F.array(
        F.when(~F.col("chunk_type").isin(*CHUNK_TYPES), "unknown_type"), F.when(F.size("block_ids") == 0, "no_blocks"),
        F.when((F.col("start_page") < 1) | (F.col("end_page") < F.col("start_page")), "bad_page_range"), F.when(X.strip("source_text") == "", "empty_text"),
    )))
    members = chunk_rows.select("doc_id", "chunk_id", "chunk_type", F.explode("block_ids").alias("block_id")).join(blocks.select("doc_id", "block_id", "block_type"), ["doc_id", "block_id"], "left")
    missing = members.where("block_type is null").select("doc_id", "chunk_id", F.lit("missing_block").alias("error")).distinct()
    mixed = members.where(chunk_type(F.col("block_type")) != F.col("chunk_type")).select("doc_id", "chunk_id", F.lit("mixed_kinds").alias("error")).distinct()
    return out.unionByName(chunk_rows.select("doc_id", "chunk_id", own.alias("error"))).unionByName(missing).unionByName(mixed)
