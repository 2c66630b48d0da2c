"""Planning of the work on texts: prefilter, repeats, fingerprints, batches, resume, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import cut
from . import memory as M


def fragment(text: Column, kind: Column | None = None) -> Column:
    """A text without anything to translate: figures, signs, or a short capitalised auxiliary line."""
    t = F.trim(text, F.lit(X.BLANKS))
    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    short = (F.length(t) <= 80) & ((letters == 0) | (capitals / F.nullif(letters, F.lit(0)) >= 0.65))
    signs = t.rlike(r"^\d+(?:[./-]\d+)*$") | t.rlike(r"^[^\p{L}\p{N}]+$")
    return F.coalesce(signs if kind is None else signs | ((kind == "auxiliary") & short), F.lit(False))


def prefilter(texts: DataFrame, memory: DataFrame, margin: float = 0.03) -> DataFrame:
    """id, action, reason, target: what can be answered without a backend.

    ``texts(id, ord, text, chapter_id)``, and perhaps ``near``: the threshold of rows that may reuse
    near entries, null for the others. In order: empty and fragments are skipped; a text that an
    earlier row reused repeats it; a text equal to a memory entry reuses that; a text whose best near
    entry passes its threshold by ``margin`` reuses that; the rest needs the backend. Only texts that
    are left by the cheap rules reach the joins, and only those without an equal entry the near search.
    """
    may = F.col("near") if "near" in texts.columns else F.lit(None).cast("double")
    base = texts.select("id", "ord", may.alias("near"), "chapter_id", "text", X.strip("text").alias("s"), X.normalize("text").alias("key"))
    cheap = F.when(F.col("s") == "", "empty_source").when(fragment(F.col("s")), "non_translatable_fragment")
    base = cut(base.withColumn("cheap", cheap))
    memory = cut(memory.select("entry_id", "source_text", "target_text", "chapter_id"))
    open_rows = base.where("cheap is null")
    reuse = M.exact_matches(open_rows, memory)
    joined = open_rows.join(reuse, "id", "left").withColumn("exact", F.col("target").isNotNull())
    least = open_rows.agg(F.min("near")).head()[0] if "near" in texts.columns else None
    if least is not None:
        asked = open_rows.where("near is not null").join(reuse.select("id"), "id", "left_anti")
        usable = memory.where(X.strip("target_text") != "").select("entry_id", "source_text", "chapter_id", "target_text")
        # The best by rank counts, which adds for the chapter; what is below a row's threshold was not ranked there.
        pairs = M.near_pairs(asked.select("id", "text", F.lit(0).alias("k")), usable.select("entry_id", "source_text", F.lit(0).alias("k")), least)
        placed = pairs.join(asked.select("id", "near", "chapter_id"), "id").where("similarity >= near").join(usable.withColumnRenamed("chapter_id", "c"), "entry_id")
        order = F.struct((-M.rank(F.col("similarity"), F.col("chapter_id") == F.col("c"))).alias("r"), (-F.col("similarity")).alias("s"), "entry_id", "target_text", "similarity", "near")
        best = placed.groupBy("id").agg(F.min(order).alias("m")).where(F.col("m.similarity") >= F.col("m.near") + margin - 1e-9)
        joined = joined.join(best.select("id", F.col("m.target_text").alias("like")), "id", "left").withColumn("target", F.coalesce("target", "like")).drop("like")
    # Of every text only the first row that was reused matters: one narrow row per text, whatever the number of its copies.
    first = joined.where("target is not null").groupBy("key").agg(F.min(F.struct("ord", "target")).alias("first"))
    joined = joined.join(first, "key", "left").withColumn("repeat", F.when(F.col("ord") > F.col("first.ord"), F.col("first.target"))).drop("first")
    reason = F.when(F.col("repeat").isNotNull(), "repeated_approved_translation").when(F.col("exact"), "translation_memory_exact").when(F.col("target").isNotNull(), "translation_memory_near").otherwise("requires_model_translation")
    action = F.when(reason == "requires_model_translation", "model").otherwise("reuse")
    done = joined.select("id", action.alias("action"), reason.alias("reason"), F.coalesce("repeat", "target").alias("target"))
    skipped = base.where("cheap is not null").select("id", F.lit("skip").alias("action"), F.col("cheap").alias("reason"), F.when(F.col("cheap") != "empty_source", F.col("s")).alias("target"))
    return done.unionByName(skipped)


def fingerprints(texts: DataFrame) -> DataFrame:
    """id, fingerprint: the content hash of what a job depends on."""
    return texts.select("id", X.fingerprint(F.col("template_id").alias("template"), X.normalize("text").alias("text"), F.col("src").alias("src"), F.col("tgt").alias("tgt")).alias("fingerprint"))


def cached(prints: DataFrame, cache: DataFrame) -> DataFrame:
    """id, output: the cached output of an equal fingerprint and template."""
    best = cache.where("output is not null").groupBy("fingerprint", "template_id").agg(F.max_by("output", "created_at").alias("output"))
    return prints.join(best, ["fingerprint", "template_id"]).select("id", "output")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts by action and reason, and the share of rows that need no backend."""
    total = F.sum("n").over(W.partitionBy())
    return plan.groupBy("action", "reason").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def batches(jobs: DataFrame, size: int = 24) -> DataFrame:
    """book_id, batch_id, id: runs of one chapter in the order of the book, cut into batches of ``size``.

    ``jobs(book_id, id, chapter_id)``; the order is that of the ids. A null chapter is a chapter of its own.
    """
    book = W.partitionBy("book_id").orderBy("id")
    chapter = F.when(X.strip("chapter_id") == "", "range").otherwise(X.strip("chapter_id"))
    base = jobs.select("book_id", "id", chapter.alias("chapter"))
    runs = base.withColumn("new", (~F.col("chapter").eqNullSafe(F.lag("chapter").over(book))).cast("int")).withColumn("run", F.sum("new").over(book))
    placed = runs.withColumn("at", F.row_number().over(W.partitionBy("book_id", "run").orderBy("id")) - 1).withColumn("opens", (F.col("at") % size == 0).cast("int"))
    numbered = placed.withColumn("no", F.sum("opens").over(book))
    return numbered.select("book_id", "id", F.concat(F.format_string("batch-%04d-", "no"), X.slug("chapter", "batch")).alias("batch_id"))


def batch_progress(batched: DataFrame, done: DataFrame) -> DataFrame:
    """book_id, batch_id, n_chunks, n_done, completed."""
    both = batched.join(done.select("id", F.lit(1).alias("d")).distinct(), "id", "left")
    return both.groupBy("book_id", "batch_id").agg(F.count("*").alias("n_chunks"), F.count("d").alias("n_done"), F.bool_and(F.col("d").isNotNull()).alias("completed"))


def remaining(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a completed answer."""
    return jobs.join(done.select("id").distinct(), "id", "left_anti")


def merged_answers(first: DataFrame, later: DataFrame) -> DataFrame:
    """The answer of every id, a later table overriding the first, the newest row within a table.

    Both have id, text, loaded_at; blank texts do not count.
    """
    both = first.withColumn("p", F.lit(0)).unionByName(later.withColumn("p", F.lit(1))).where((X.strip("text") != "") & (X.strip("id") != ""))
    return both.groupBy("id").agg(F.max_by("text", F.struct("p", "loaded_at")).alias("text"))


def checks(rated: DataFrame, fuzzy: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
    """``rated`` with ``run_editorial`` and ``run_qa``: whether a text is worth a second pass.

    ``rated(id, tier, risks)`` as from ``complexity.assess``; ``fuzzy(id)`` are texts near glossary terms,
    ``decided(id)`` texts with decisions on terms.
    """
    rows = rated
    for name, ids in (("_fuzzy", fuzzy), ("_decided", decided)):
        rows = rows.withColumn(name, F.lit(False)) if ids is None else rows.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    risky = lambda *names: F.arrays_overlap(F.split("risks", ","), F.array(*[F.lit(n) for n in names]))
    editorial = (F.col("tier") == "C") | risky("terminology_dense") | F.col("_fuzzy") | F.col("_decided") & (F.col("tier") == "B")
    qa = (F.col("tier") == "C") | risky("footnote_markers", "terminology_dense", "numeric_or_formula_dense")
    return rows.withColumns({"run_editorial": editorial, "run_qa": qa}).drop("_fuzzy", "_decided")


def plan(filtered: DataFrame, rated: DataFrame, cache: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """id, action, reason, target, tier, weight, run_editorial, run_qa: the plan of all texts.

    ``filtered`` is that of ``prefilter``, ``rated`` has the ``checks``, ``cache(id, output)`` outputs known by
    fingerprint (``cached``), ``weights(id, weight)`` the size of every text's context. What the prefilter
    leaves and the cache knows is reused; only the rest goes to the model, with its checks.
    """
    known = filtered.select("id", F.lit(None).cast("string").alias("output")).limit(0) if cache is None else cache.select("id", "output")
    sized = filtered.select("id", F.lit(None).cast("bigint").alias("weight")).limit(0) if weights is None else weights.select("id", F.col("weight").cast("bigint").alias("weight"))
    rows = filtered.join(rated.select("id", "tier", "run_editorial", "run_qa"), "id").join(known, "id", "left").join(sized, "id", "left")
    model = F.col("action") == "model"
    hit = model & (X.strip("output") != "")
    left = model & ~hit
    return rows.select(
        "id", F.when(hit, "reuse").otherwise(F.col("action")).alias("action"), F.when(hit, "job_cache_hit").otherwise(F.col("reason")).alias("reason"), F.when(hit, F.col("output")).otherwise(F.col("target")).alias("target"),
        "tier", F.when(model, F.col("weight")).alias("weight"), (left & F.col("run_editorial")).alias("run_editorial"), (left & F.col("run_qa")).alias("run_qa"),
    )


def savings(planned: DataFrame, max_retries: int = 2, baseline_jobs: int = 3, baseline_retries: int = 3) -> DataFrame:
    """One row: counts of a ``plan``, its mean context weight, the retries it avoids and the share of jobs it saves (A10)."""
    n = lambda test, name: F.count_if(test).alias(name)
    c = F.col
    reason = lambda x: c("reason") == x
    sums = planned.agg(
        F.count("*").alias("n"), n(c("action") == "model", "n_model"), n(reason("translation_memory_exact") | reason("translation_memory_near"), "n_memory"), n(reason("repeated_approved_translation"), "n_repeated"),
        n(reason("job_cache_hit"), "n_cached"), n(c("action") == "skip", "n_skipped"), n(c("run_editorial"), "n_editorial"), n(c("run_qa"), "n_qa"), F.coalesce(F.round(F.avg("weight"), 1), F.lit(0.0)).alias("weight"),
    )
    base, jobs = c("n") * baseline_jobs, c("n_model") + c("n_editorial") + c("n_qa")
    saved = F.when(base > 0, F.round(F.greatest(F.lit(0), base - jobs) / base * 100.0, 1)).otherwise(0.0)
    return sums.withColumns({"retries_avoided": c("n_model") * max(0, baseline_retries - max_retries), "saved_percent": saved})


def selected(batched: DataFrame, first: str | None = None, last: str | None = None, only_failed: bool = False, resume: bool = False) -> DataFrame:
    """Rows of ``batched(book_id, batch_id, status)`` that a run takes (F03): from one batch to another, failed ones or unfinished ones only.

    ``first`` and ``last`` are ids or beginnings of ids; a book that lacks one is an error, as its range has no end.
    """
    rows = batched
    for bound, over in ((first, True), (last, False)):
        if bound is not None:
            edge = batched.groupBy(F.col("book_id").alias("_b")).agg(F.min(F.when(F.startswith("batch_id", F.lit(bound)), F.col("batch_id"))).alias("_e"))
            known = F.coalesce("_e", F.raise_error(F.concat(F.lit(f"no batch {bound} in book "), F.col("book_id"))).cast("string"))
            rows = rows.join(edge, F.col("book_id").eqNullSafe(F.col("_b"))).where(F.col("batch_id") >= known if over else F.col("batch_id") <= known).drop("_b", "_e")
    states = ["failed"] if only_failed else ["pending", "failed", "running"] if resume else None
    return rows if states is None else rows.where(F.col("status").isin(states))


def tasks(batched: DataFrame, planned: DataFrame) -> DataFrame:
    """book_id, batch_id, id, status, error, action: the rows of batches with their plan; one without a plan has failed."""
    rows = batched.select("book_id", "batch_id", "id").join(planned.select("id", "action"), "id", "left")
    lost = F.col("action").isNull()
    return rows.select("book_id", "batch_id", "id", F.when(lost, "failed").otherwise("pending").alias("status"), F.when(lost, F.concat(F.lit("no plan for "), F.col("id"))).alias("error"), "action")


def local_targets(filtered: DataFrame, texts: DataFrame, cache: DataFrame) -> DataFrame:
    """id, target: what is known without a backend (R03): the plan's target, else the cached output, else a skipped text itself, else an empty text."""
    rows = filtered.select("id", "action", "target").join(texts.select("id", "text"), "id").join(cache.select("id", "output"), "id", "left")
    return rows.select("id", F.coalesce(F.nullif("target", F.lit("")), F.nullif("output", F.lit("")), F.when(F.col("action") == "skip", X.text("text")), F.lit("")).alias("target"))
