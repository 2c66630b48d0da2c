"""Problem 3: text values cut off by field limits.

A stack automaton walks over each value (quotes, brackets, markup, escapes, broken sequences)
and names the state it ends in. The state of the translation is then judged against that of
its source text and against the usual relation of the two lengths: a heading without a final
stop is complete, a sentence whose source goes on is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text import strip_invisible

#: Openers and closers the automaton follows (fixed values); the straight quotation mark closes itself.
PAIRS = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]", "{": "}", '"': '"'}
#: Elements of markup without a closing tag (fixed values, HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = re.compile(r"[«»“”„()\[\]{}\"]|<(/?)([A-Za-z][\w:-]*)[^<>]*?(/?)>")
_CLOSER = {"»": "«", "”": "“", ")": "(", "]": "[", "}": "{"}
_NOTE = re.compile(r"\[[\w*]{1,6}\]")
_RAISED = "¹²³⁴⁵⁶⁷⁸⁹⁰†‡*"
#: Broken escapes, entities and tags are looked for behind the last sign that opens one.
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?")
_ENTITY = re.compile(r"&(?:#?\w{1,8})?")
_TAG = re.compile(r"<(?:[A-Za-z/!][^<>]*)?")
_TORN = frozenset("�ÐÑÃ")
_CLOSING = "”»\"'’“)] \n"
_KINDS = dict.fromkeys(".!?。؟।", "stop") | {":": "colon", ";": "semicolon"}
#: Complete texts that a source is credited with before its habit is judged.
_FEW = 8
STATE = "finish string, open int, broken boolean, lines int, chars int"


def _open_marks(text: str) -> int:
    """How many quotes, brackets and elements of markup are open after the text.

    A closing mark pops its opener from the top of the stack; an element's closing tag pops the
    elements within that were left open with it. Marks that close nothing are passed over.
    """
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        mark, name = m[0], m[2]
        if name is not None:
            name = "<" + name.lower()
            if m[1]:
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not m[3] and name[1:] not in VOID:
                stack.append(name)
        elif stack and (stack[-1] == _CLOSER.get(mark) or mark == '"' == stack[-1] or mark == "“" and stack[-1] == "„"):
            stack.pop()
        elif mark in PAIRS:
            stack.append(mark)
    return len(stack)


def _torn(text: str) -> bool:
    """Whether the text stops within a character, an escape, an entity or a tag."""
    if not text:
        return False
    if text[-1] in _TORN or "\ud800" <= text[-1] <= "\udfff":
        return True
    for opener, pattern in (("\\", _ESCAPE), ("&", _ENTITY), ("<", _TAG)):
        if (at := text.rfind(opener)) >= 0 and pattern.fullmatch(text, at):
            return True
    return False


def _body(text: str) -> str:
    """The text without what may stand behind its last sentence: note markers, and a bracketed group behind a stop."""
    while text:
        if text[-1] in _RAISED:
            text = text.rstrip(_RAISED).rstrip()
        elif text[-1] == "]" and (at := text.rfind("[")) >= 0 and _NOTE.fullmatch(text, at):
            text = text[:at].rstrip()
        else:
            break
    if text.endswith(")") and (at := text.rfind("(")) > 0 and ")" not in text[at:-1]:
        before = text[:at].rstrip()
        if before.endswith((".", "!", "?", "…")):
            return before
    return text


def state(text: str | None) -> tuple[str, int, bool, int, int] | None:
    """State of the automaton after the whole text: kind of finish, open marks, broken tail, lines, code points.

    Finish: ``none`` (nothing visible), ``dots``, ``stop``, ``colon``, ``semicolon``, ``inside``
    (letter, digit, comma, dash, opener ...). Note markers, closing quotes and a bracketed group
    after a stop are not part of the finish. Null gives null.
    """
    if text is None:
        return None
    bare = strip_invisible(text).strip()
    lines = sum(1 for line in bare.split("\n") if line.strip()) if "\n" in bare else bool(bare)
    end = _body(bare)
    end = end.rstrip(_CLOSING) or end
    if not end:
        finish = "none" if not bare else "stop"
    elif end.endswith(("…", "..")):
        finish = "dots"
    else:
        finish = _KINDS.get(end[-1], "inside")
    return finish, _open_marks(text), _torn(bare), int(lines), len(bare)


def states(df: DataFrame, key: str, column: str, keep: list[str]) -> DataFrame:
    """``key``, ``keep`` and the automaton's state of ``column``; rows with a null text have a null state."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(key, *keep).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [state(x if isinstance(x, str) else None) or (None,) * 5 for x in frame[column]]
            out = frame[[key, *keep]].copy()
            for i, name in enumerate(("finish", "open", "broken", "lines", "chars")):
                out[name] = pd.array([s[i] for s in found], dtype={"finish": "string", "broken": "boolean"}.get(name, "Int32"))
            yield out

    return df.select(key, *keep, column).mapInPandas(run, f"{schema}, {STATE}")


def judge(s: str = "s", t: str = "t", low: str = "low", loose: str | None = None) -> Column:
    """Whether the target state ``t`` is a cut against the source state ``s``.

    ``low`` is the least usual ratio of lengths. ``loose`` tells that this source writes complete
    texts without a final stop: there a missing one says nothing, and the lengths must tell.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    stopless = (c(t, "finish") == "inside") & c(s, "finish").isin("stop", "dots", "semicolon", "colon")
    habit = F.lit(False) if loose is None else F.coalesce(F.col(loose), F.lit(False))
    cut_inside = stopless & ~habit
    dotted = (c(t, "finish") == "dots") & (c(s, "finish") != "dots")
    torn = c(t, "broken") & ~c(s, "broken")
    unclosed = (c(t, "finish") != "stop") & (c(t, "open") > 0) & (c(s, "open") == 0)
    # Alike ends (both without a stop, or both with dots): the target stops early if lines are
    # missing, or if a text of some length is shorter than complete targets ever are.
    alike = (c(t, "finish") == c(s, "finish")) & c(t, "finish").isin("inside", "dots", "semicolon") | stopless & habit
    short = (c(s, "lines") > 1) & (c(t, "lines") < c(s, "lines")) | (c(s, "lines") == 1) & (c(s, "chars") >= 60) & (c(t, "chars") < F.col(low) * c(s, "chars"))
    said = (c(t, "finish") != "none") & (c(s, "finish") != "none")
    return F.coalesce(said & (cut_inside | dotted | torn | unclosed | alike & short), F.lit(False))


def _pairs(memory: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """rec, origin, source, direction and both states; only states are shuffled, not the texts."""
    tm = memory.where("entry_id is not null").select(F.col("entry_id").alias("rec"), "source", "source_text", "target_text")
    both = states(states(tm, "rec", "source_text", ["source", "target_text"]).select("rec", "source", "target_text", F.struct("finish", "open", "broken", "lines", "chars").alias("s")), "rec", "target_text", ["source", "s"])
    tm_states = both.select("rec", F.lit("translation_memory").alias("origin"), "source", F.lit("memory").alias("direction"), "s", F.struct("finish", "open", "broken", "lines", "chars").alias("t"))
    ins = jobs.select(F.col("job.job_id").alias("rec"), F.lower(F.substring("job.target_language", 1, 2)).alias("direction"), F.col("payload.source_text").alias("source_text")).where("rec is not null")
    outs = outputs.select(F.col("job_id").alias("rec"), "source", "translated_text").where("rec is not null")
    state_of = F.struct("finish", "open", "broken", "lines", "chars")
    ins_states = states(ins, "rec", "source_text", ["direction"]).select("rec", "direction", state_of.alias("s")).dropDuplicates(["rec"])
    out_states = states(outs, "rec", "translated_text", ["source"]).select("rec", "source", state_of.alias("t"))
    return tm_states.unionByName(ins_states.join(out_states, "rec").withColumn("origin", F.lit("job_outputs")))


def _judged(memory: DataFrame, jobs: DataFrame, outputs: DataFrame, deviations: float, habit: float) -> DataFrame:
    pairs = cut(_pairs(memory, jobs, outputs).dropDuplicates(["origin", "rec"]))
    # The baseline of lengths: complete pairs (both with a final stop) of some length, by direction.
    ratio = F.log(F.col("t.chars") / F.col("s.chars"))
    usual = pairs.where("s.finish = 'stop' and t.finish = 'stop' and s.chars >= 60 and t.chars > 0 and s.lines = 1").groupBy("direction")
    low = usual.agg(F.exp(F.avg(ratio) - deviations * F.coalesce(F.stddev(ratio), F.lit(0.1))).alias("low"))
    # The baseline of terminators: how often the targets of a source go without the stop of their text.
    ended = pairs.where("s.finish = 'stop' and t.finish in ('stop', 'inside')").groupBy("origin", "source")
    # A few texts make no habit: the share is weighed against as many as ``_FEW`` complete ones.
    loose = ended.agg((F.count_if(F.col("t.finish") == "inside") > habit * (F.count("*") + _FEW)).alias("loose")).where("loose")
    known = pairs.join(F.broadcast(low), "direction", "left").withColumn("low", F.coalesce("low", F.lit(0.7)))
    habits = loose.select(F.col("origin").alias("o"), F.col("source").alias("of"), "loose")
    known = known.join(habits, (F.col("origin") == F.col("o")) & F.col("source").eqNullSafe(F.col("of")), "left").drop("o", "of")
    return known.withColumn("truncated", judge(loose="loose"))


def truncated(memory: DataFrame, jobs: DataFrame, outputs: DataFrame, deviations: float = 2.5, habit: float = 0.5) -> DataFrame:
    """(rec): entries and jobs whose target stops before its translation ends.

    Null and empty targets or sources are no cases; outputs without a job cannot be judged and
    give none; a record delivered again counts once; extra columns are not read. The baseline has
    one row per translation direction, whatever the data, and is broadcast.
    """
    return _judged(memory, jobs, outputs, deviations, habit).where("truncated").select("rec")


def truncation_rates(memory: DataFrame, jobs: DataFrame, outputs: DataFrame, deviations: float = 2.5, habit: float = 0.5) -> DataFrame:
    """Per table and ``source``: records with a target, how many are truncated, and the rate."""
    judged = _judged(memory, jobs, outputs, deviations, habit).where("t.finish <> 'none'")
    return judged.groupBy("origin", "source").agg(F.count("*").alias("n_records"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("rate"))
