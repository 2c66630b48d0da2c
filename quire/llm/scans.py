"""Problem 2: noise in text from scanned pages.

Misread words: a symmetric-delete index over the corpus frequency lexicon gives correction
candidates, a weighted edit distance with confusion pairs ranks them and bigram context picks the
repair. Running lines and printed page numbers are found by their recurrence over the pages of a
book and by the fixed distance of printed numbers to page positions; words broken at line and page
ends by the lexicon counts of the joined and of the compound form.
The unit of work is the page, which is bounded; a book of any size is spread over all tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, spread

#: What scanners take for what (fixed values), by script: true form, misread forms. Lower case.
LATIN = {
    "o": ("0",), "a": ("o",), "e": ("c",), "t": ("f",), "l": ("1", "i", "|"), "i": ("l", "1"), "s": ("5",), "b": ("6",), "h": ("b",), "g": ("9",), "z": ("2",),
    "n": ("ri",), "u": ("ii",), "m": ("rn",), "d": ("cl",), "w": ("vv",),
}
CYRILLIC = {
    "т": ("г",), "н": ("п",), "и": ("н", "п"), "л": ("п",), "о": ("0",), "е": ("с",), "в": ("8",), "з": ("3",), "б": ("6",), "м": ("rn",), "ы": ("ьl", "ьi", "ь1"), "ж": ("ас",), "ш": ("щ",), "щ": ("ш",), "ч": ("4",),
}
#: Letters that are misread figures (fixed values).
FIGURES = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "О": "0", "о": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "З": "3", "з": "3", "б": "6"})
MARKS = "-‐‑¬­"
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(rf"([^\W\d_]+)([{MARKS}])[ \t]*(?:\n\s*([^\W\d_]+)|\s*$)")
_HYPHEN = re.compile("[-‐‑]")
_COMPOUND = re.compile(r"(?<![\w-])([^\W\d_]+)[-‐‑]([^\W\d_]+)(?![\w-])")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_NUMBER = r"[0-9lIOoSBZ|]{1,5}|[ivxlc]{1,7}"
_LONE = re.compile(rf"[\s—–\-\[(·|.]*(?:page|p\.|стр\.|с\.|seite)?\s*({_NUMBER})[\s—–\-\])·|.]*", re.IGNORECASE)
_LEAD = re.compile(rf"({_NUMBER})(?:\s*[|·—–-]\s*|\s+)(?=[^\W\d_])")
_TRAIL = re.compile(rf"(?:(?:[|·—–-]\s*)|\s)({_NUMBER})$")
_CAPTION = re.compile(r"(?:figure|fig\.|table|рис\.|рисунок|табл\.|таблица)\s", re.IGNORECASE)
_STOPS = ".,;?!:" + MARKS
_FEW_LETTERS = 6


def number(token: str) -> tuple[int | None, bool]:
    """The value of a printed number, Roman ones included, and whether letters were read for figures."""
    if token.isdigit():
        return int(token), False
    low = token.lower()
    if set(low) <= set(_ROMAN) and token == low:
        total = 0
        for a, b in zip(low, low[1:] + "i"):
            total += -_ROMAN[a] if _ROMAN[a] < _ROMAN[b] else _ROMAN[a]
        return total, False
    plain = token.translate(FIGURES)
    return (int(plain), True) if plain.isdigit() and any(c.isdigit() for c in token) else (None, False)


def _fold_table(confusions: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, str]], dict[int, str]]:
    """Multi-letter misreadings, longest first, and one representative for each class of single ones."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    many = []
    for true, reads in confusions.items():
        for read in reads:
            if len(read) == 1:
                parent[root(read)] = root(true)
            else:
                many.append((read, true))
    one = {ord(x): root(x) for x in parent}
    return sorted({(read.translate(one), true.translate(one)) for read, true in many}, key=lambda x: (-len(x[0]), x)), one


_FOLDS = {script: _fold_table(c) for script, c in (("latin", LATIN), ("cyrillic", CYRILLIC))}
_CYRILLIC = re.compile("[а-яё]")


def fold(word: str) -> str:
    """A lower-case word with every class of confusable shapes of its script brought to one letter."""
    many, one = _FOLDS["cyrillic" if _CYRILLIC.search(word) else "latin"]
    word = word.translate(one)
    for read, true in many:
        if read in word:
            word = word.replace(read, true)
    return word


def delete_keys(word: str) -> set[str]:
    """The symmetric-delete keys: the folded word, and it without any one letter."""
    f = fold(word)
    return {f, *(f[:i] + f[i + 1 :] for i in range(len(f)))} if len(f) > 3 else {f}


def _pairs() -> set[tuple[str, str]]:
    """(true, read): the confusion pairs, two-letter readings with a letter of them read wrongly again, and those turned round."""
    out = set()
    for confusions in (LATIN, CYRILLIC):
        for true, reads in confusions.items():
            for read in reads:
                out.add((true, read))
                if len(read) > 1:
                    out.add((read, true))
                    out |= {(true, read[:i] + again + read[i + 1 :]) for i, c in enumerate(read) for again in confusions.get(c, ()) if len(again) == 1}
    return out


_PAIR = _pairs()


def distance(read: str, true: str, most: float = 2.0) -> float:
    """Weighted edit distance: 0.3 for a confusion pair in either number of letters, 1 for any other edit."""
    n, m = len(read), len(true)
    if abs(n - m) > 4:
        return 9.0
    row = {0: {j: float(j) for j in range(m + 1)}}
    for i in range(1, n + 1):
        now = {0: float(i)}
        for j in range(1, m + 1):
            best = row[i - 1][j - 1] + (0.0 if read[i - 1] == true[j - 1] else 0.3 if (true[j - 1], read[i - 1]) in _PAIR else 1.0)
            best = min(best, row[i - 1][j] + 1.0, now[j - 1] + 1.0)
            if i > 1 and (true[j - 1], read[i - 2 : i]) in _PAIR:
                best = min(best, row[i - 2][j - 1] + 0.3)
            if j > 1 and (true[j - 2 : j], read[i - 1]) in _PAIR:
                best = min(best, row[i - 1][j - 2] + 0.3)
            now[j] = best
        row[i] = now
        if min(now.values()) > most and min(row[i - 1].values()) > most:
            return 9.0
    return row[n][m]


_HAS_MARK = re.compile(rf"[{MARKS}][ \t]*(?:\n|$)")


def _joined(text: str) -> str:
    """A block without its breaks: nothing is counted from words that a line end breaks."""
    return _BROKEN.sub(" ", text) if _HAS_MARK.search(text) else text


def pages(ocr: DataFrame) -> DataFrame:
    """(doc_id, page_num, blocks): the blocks of a page in reading order, each once."""
    if "confidence" not in ocr.columns:
        ocr = ocr.withColumn("confidence", F.lit(None).cast("double"))
    rows = ocr.where("doc_id is not null and block_id is not null and text is not null")
    block = F.struct(F.coalesce("reading_order", F.lit(0)).alias("ro"), "block_id", "text", "confidence")
    # Blocks without a page number stand alone, so that they make no page without bound.
    own = F.coalesce("page_num", (-1 - F.pmod(F.xxhash64("block_id"), F.lit(1_000_000_000))).cast("int"))
    return rows.groupBy("doc_id", own.alias("page_num")).agg(F.array_sort(F.collect_set(block)).alias("blocks"))


def _flat(paged: DataFrame) -> DataFrame:
    """One row per block again, with whether it is the first of its page."""
    return paged.select("doc_id", "page_num", F.posexplode("blocks").alias("at", "b")).select("doc_id", "page_num", "b.block_id", "b.text", "b.confidence", (F.col("at") == 0).alias("top"))


def _header_parts(line: str) -> tuple[str, str]:
    """Folded words and number token of a line that may be a running line; the number may be missing."""
    token = ""
    if m := _LEAD.match(line):
        token, rest = m[1], line[m.end() :]
        if number(token)[0] is not None:
            return fold("".join(_WORD.findall(rest)).lower()), token
    if m := _TRAIL.search(line):
        token, rest = m[1], line[: m.start()]
        if number(token)[0] is not None:
            return fold("".join(_WORD.findall(rest)).lower()), token
    return fold("".join(_WORD.findall(line)).lower()), ""


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that may be running lines or page numbers, one row each."""
    for f in frames:
        rows = []
        for doc, page, block, text, top in zip(f.doc_id, f.page_num, f.block_id, f.text, f.top):
            lines = text.split("\n")
            for at, line in enumerate(lines):
                s = line.strip()
                if not s:
                    continue
                if (m := _LONE.fullmatch(s)) and number(m[1])[0] is not None:
                    value, misread = number(m[1])
                    rows.append((doc, page, block, at, "", value, misread, True, len(lines) == 1, top))
                    continue
                if s[0].islower() and not _LEAD.match(s) or s[-1] in _STOPS and not (s[-1] == "." and s[-2:-1].isdigit()) or _CAPTION.match(s):
                    continue
                key, token = _header_parts(s)
                if not key:
                    continue
                value, misread = number(token) if token else (None, False)
                rows.append((doc, page, block, at, key, value, misread, False, len(lines) == 1, top))
        yield pd.DataFrame(rows, columns=["doc_id", "page_num", "block_id", "line", "key", "value", "misread", "lone", "whole", "top"]).astype({"value": "Int64"})


_LINES = "doc_id string, page_num int, block_id string, line int, key string, value bigint, misread boolean, lone boolean, whole boolean, top boolean"


def page_furniture(paged: DataFrame, least_pages: int = 3, least_share: float = 0.2) -> DataFrame:
    """Lines that are running lines or printed page numbers: doc_id, page_num, block_id, line, running, numbered, misread.

    The distance of printed number and page position is that of most numbered lines of the book.
    A line is a running line if it bears its page's number, or if it recurs on ``least_pages`` and
    ``least_share`` of the pages without numbers; a heading whose running line bears numbers is
    kept where it stands without one. A line is a page number only with the number of its page
    (or one figure of it misread, in a line that recurs).
    """
    lines = cut(_flat(paged).mapInPandas(_lines, _LINES))
    shift = (F.col("value") - F.col("page_num")).alias("shift")
    votes = lines.where("value is not null").groupBy("doc_id", shift).agg(F.countDistinct("page_num").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.abs("shift")).alias("small"), "shift")).alias("b")).where("b.n >= 2").select("doc_id", F.col("b.shift").alias("shift"))
    size = paged.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    placed = lines.join(best, "doc_id", "left").join(size, "doc_id").withColumn("due", F.col("page_num") + F.col("shift"))
    exact = F.coalesce(F.col("value") == F.col("due"), F.lit(False))
    keys = placed.where("not lone").groupBy("doc_id", "key").agg(F.countDistinct("page_num").alias("on_pages"), F.countDistinct(F.when(exact, F.col("page_num"))).alias("on_numbered"), F.count_if("top").alias("on_top"))
    known = placed.join(keys, ["doc_id", "key"], "left")
    off = F.levenshtein(F.col("value").cast("string"), F.col("due").cast("string")) == 1
    recurs = F.coalesce((F.col("on_numbered") >= 2), F.lit(False))
    nearly = F.coalesce(F.col("value").isNotNull() & off & recurs, F.lit(False))
    bare = F.coalesce((F.col("on_pages") >= least_pages) & (F.col("on_pages") >= least_share * F.col("n_pages")) & (F.col("on_numbered") * 2 < F.col("on_pages")), F.lit(False))
    # A line of running text may end with the number of its page by chance: a running line recurs, or stands apart.
    # One of a few letters (a measure, say) must recur with the numbers of its pages.
    few = F.length("key") < _FEW_LETTERS
    apart = F.col("lone") | F.when(few, recurs).otherwise(F.coalesce(F.col("on_pages") >= 2, F.lit(False)) | F.col("whole") | F.col("top"))
    exact = exact & apart
    running = ~F.col("lone") & (exact | nearly | bare)
    numbered = exact | nearly & ~F.col("lone")
    return known.select("doc_id", "page_num", "block_id", "line", running.alias("running"), numbered.alias("numbered"), (numbered & (F.col("misread") | nearly)).alias("misread")).where("running or numbered")


def _rejoined(text: str) -> list[str]:
    """The words that line ends break within the text, in one piece."""
    return [m[1] + m[3] for m in _BROKEN.finditer(text) if m[3]] if _HAS_MARK.search(text) else []


def _counts(clean: bool):
    """Word counts of a batch as rows (word, n_clean, n_scan, n_broken): combined before anything is shuffled.

    Compounds count as such as well; words broken at line ends count apart, as what they are is open.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        broken: Counter[str] = Counter()
        for f in frames:
            for text in f.text:
                low = text.lower()
                if not clean:
                    broken.update(_rejoined(low))
                    low = _joined(low)
                total.update(_WORD.findall(low))
                if _HYPHEN.search(low):
                    total.update(f"{a}-{b}" for a, b in _COMPOUND.findall(low))
            if len(total) > 400_000:
                yield _table(total, broken, clean)
                total, broken = Counter(), Counter()
        if total or broken:
            yield _table(total, broken, clean)

    return run


def _table(total: Counter[str], broken: Counter[str], clean: bool) -> pd.DataFrame:
    words = list(total | broken)
    n = np.array([total[w] for w in words], np.int64)
    none = np.zeros(len(words), np.int64)
    return pd.DataFrame({"word": words, "n_clean": n if clean else none, "n_scan": none if clean else n, "n_broken": np.array([broken[w] for w in words], np.int64)})


def lexicon(ocr: DataFrame, blocks: DataFrame) -> DataFrame:
    """(word, n_clean, n_scan, n_broken): counts over all scanned texts and all texts that were not scanned."""
    schema = "word string, n_clean bigint, n_scan bigint, n_broken bigint"
    scanned = spread(ocr.where("text is not null").select("text")).mapInPandas(_counts(False), schema)
    scan_flag = F.coalesce(F.array_contains("flags", "ocr"), F.lit(False))
    rest = spread(blocks.where(~scan_flag & F.col("text").isNotNull()).select("text")).mapInPandas(_counts(True), schema)
    return scanned.union(rest).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n_clean", "n_scan", "n_broken")])


def corrections(words: DataFrame, most: float = 0.95) -> DataFrame:
    """(word, fixes, counts, n_clean, n_seen): words of the scans that may be misreadings, with all their corrections, best first.

    A candidate comes from the symmetric-delete index over the lexicon; it must be far more
    frequent than the word and within ``most`` of the weighted distance: up to three confusions and
    no other edit, so that pieces of broken words are not corrected. A word that no clean text has
    is a misreading; one with ``n_clean`` > 0 must be rare in clean texts against the candidate, and
    each of its occurrences is open (``open_readings``). ``counts`` are those of the fixes in clean texts.
    """
    worded = words.where(~F.col("word").contains("-") & F.col("word").rlike(r"\p{L}"))
    suspects = worded.where("n_scan + n_broken > 0 and length(word) > 1")
    known = worded.where("n_clean + n_scan >= 3 and length(word) > 2")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[xxhash.xxh64_intdigest(k) for k in delete_keys(w)] for w in f.word]
            n = [len(x) for x in found]
            yield pd.DataFrame({"word": np.repeat(f.word.to_numpy(object), n), "n": np.repeat(f.n.to_numpy(), n), "n_clean": np.repeat(f.n_clean.to_numpy(), n), "key": np.array([k for x in found for k in x], np.uint64).view(np.int64)})

    schema = "word string, n bigint, n_clean bigint, key bigint"
    weight = F.greatest(F.lit(1), F.col("n_clean") + F.col("n_scan")).alias("n")
    left = suspects.select("word", weight, "n_clean").mapInPandas(keys, schema)
    right = known.select("word", weight, "n_clean").mapInPandas(keys, schema).toDF("fix", "n_fix", "fix_clean", "key")
    rare = F.when(F.col("n_clean") == 0, F.col("n") * 3 <= F.col("n_fix")).otherwise(F.col("n_clean") * 3 <= F.col("fix_clean"))
    pairs = left.join(right, "key").where("word <> fix").where(rare).select("word", "fix", "n_fix", "fix_clean").distinct()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cost = np.array([distance(a, b, most) for a, b in zip(f.word, f.fix)])
            keep = cost <= most
            yield pd.DataFrame({"word": f.word[keep], "fix": f.fix[keep], "cost": cost[keep], "n_fix": f.n_fix[keep], "fix_clean": f.fix_clean[keep]})

    judged = pairs.mapInPandas(judge, "word string, fix string, cost double, n_fix bigint, fix_clean bigint").withColumn("clean", F.col("fix_clean") > 0)
    # Words that only scans have correct nothing that a word of clean texts can correct.
    best = judged.withColumn("any_clean", F.max("clean").over(W.partitionBy("word"))).where("clean = any_clean")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("word").orderBy("cost", F.desc("n_fix"), "fix")))
    listed = ranked.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "fix", "fix_clean"))).alias("f"))
    return listed.join(suspects, "word").select("word", F.col("f.fix").alias("fixes"), F.col("f.fix_clean").alias("counts"), "n_clean", (F.col("n_scan") + F.col("n_broken")).alias("n_seen"))


def misreadings(words: DataFrame, most: float = 0.95) -> DataFrame:
    """(word, fixes): words of the scans that are misreadings wherever they stand, as no clean text has them."""
    return corrections(words, most).where("n_clean = 0").select("word", "fixes")


def _open_contexts(bitmap: np.ndarray):
    """Occurrences of words that the bitmap holds with the words beside them: doc_id, page_num, block_id, word, before, after."""
    bits = int(len(bitmap)).bit_length() + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for f in frames:
            rows = set()
            if len(known) > 500_000:
                known.clear()
            for doc, page, block, text in zip(f.doc_id, f.page_num, f.block_id, f.text):
                low = text.lower()
                tokens = _WORD.findall(_joined(low))
                whole = _rejoined(low)
                for i, t in enumerate(tokens + whole):
                    hit = known.get(t)
                    if hit is None:
                        slot = _slot(t, bits)
                        hit = known[t] = bool(bitmap[slot >> 3] >> (slot & 7) & 1)
                    if hit:
                        inside = i < len(tokens)
                        rows.add((doc, page, block, t, tokens[i - 1] if inside and i else "", tokens[i + 1] if inside and i + 1 < len(tokens) else ""))
            yield pd.DataFrame(sorted(rows), columns=["doc_id", "page_num", "block_id", "word", "before", "after"])

    return run


def _level(confidence: str = "confidence") -> Column:
    """The tenth of the scanner's confidence, -1 where it gives none or a figure out of bounds."""
    c = F.col(confidence)
    return F.when(c.between(0, 1), F.least(F.floor(c * 10), F.lit(9))).otherwise(-1).cast("int")


def confidence_odds(paged: DataFrame, sure: DataFrame) -> DataFrame:
    """(level, weight): how much likelier blocks of a level of confidence bear misread words than all blocks, as log odds.

    ``sure(doc_id, block_id)`` are the blocks with words that are misread wherever they stand. Eleven
    rows, whatever the data. Where the scanner's figures tell nothing the weights are near zero.
    """
    marked = paged.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.block_id", _level("b.confidence").alias("level")).join(sure.distinct().withColumn("bad", F.lit(1)), ["doc_id", "block_id"], "left")
    counts = marked.groupBy("level").agg(F.count("bad").alias("bad"), F.count("*").alias("n"))
    every = W.partitionBy()
    bad, fine = F.col("bad"), F.col("n") - F.col("bad")
    # Each level is smoothed with twenty blocks like all others.
    share = F.sum("bad").over(every) / F.sum("n").over(every)
    own = (bad + 20 * share) / (F.col("n") + 20)
    return counts.select("level", F.coalesce(F.log(own / (1 - own)) - F.log(share / (1 - share)), F.lit(0.0)).alias("weight"))


def open_readings(paged: DataFrame, doubtful: DataFrame, words: DataFrame, clean: DataFrame, apart: DataFrame | None = None, sure: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_num, block_id, word, before, after, fix): occurrences of words of clean texts that are misread all the same.

    ``doubtful`` are the ``corrections`` with ``n_clean`` > 0. The odds that an occurrence is misread are those of
    the scans' surplus over the rate of the clean texts, times how much likelier the words beside
    it are next to the fix than next to the word, by the word pairs of ``clean(text)``; each side
    is smoothed with the frequency of the neighbour. With ``sure(doc_id, block_id)`` the scanner's confidence
    in the block adds what ``confidence_odds`` finds it to be worth. ``apart(doc_id, block_id, word)`` adds
    occurrences without neighbours.
    """
    size = words.agg(F.sum("n_clean").alias("c"), F.sum(F.col("n_scan") + F.col("n_broken")).alias("s")).head()
    total, share = float(size.c or 1), float(size.s or 0) / float(size.c or 1)
    key = ["doc_id", "page_num", "block_id", "word", "before", "after"]
    found = _flat(paged).mapInPandas(_open_contexts(_bitmap(doubtful)), "doc_id string, page_num int, block_id string, word string, before string, after string")
    if apart is not None:
        found = found.unionByName(apart.select("doc_id", F.lit(None).cast("int").alias("page_num"), "block_id", "word", F.lit("").alias("before"), F.lit("").alias("after")))
    seen = cut(found.join(doubtful, "word"))
    tried = seen.select(*key, "n_clean", "n_seen", F.explode(F.arrays_zip("fixes", "counts")).alias("z")).select(*key, "n_clean", "n_seen", F.col("z.fixes").alias("fix"), F.col("z.counts").alias("n_fix"))
    side = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("key"))
    pair = lambda a, b: F.concat_ws(" ", a, b)
    roles = {"wl": pair("before", "word"), "wr": pair("word", "after"), "fl": pair("before", "fix"), "fr": pair("fix", "after"), "l": F.col("before"), "r": F.col("after")}
    asked = tried.select("*", F.explode(F.array(*[side(k, x) for k, x in roles.items()])).alias("q")).select(*tried.columns, "q.role", "q.key")
    pairs = asked.where("length(role) = 2").select(F.col("key").alias("word")).distinct()
    counted = spread(clean.where("text is not null").select("text")).mapInPandas(_bigrams(_bitmap(pairs)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    every = counted.unionByName(words.select("word", F.col("n_clean").alias("n"))).toDF("key", "n")
    # Words and pairs are told apart by the blank.
    got = asked.join(every, "key", "left").groupBy(*tried.columns).agg(*[F.max(F.when(F.col("role") == k, F.coalesce("n", F.lit(0)))).alias(k) for k in roles])

    def likelier(fix: str, word: str, beside: str, name: str):
        rate = (F.col(beside) + 0.5) / total
        ratio = F.log((F.col(fix) + rate) / (F.col("n_fix") + 1)) - F.log((F.col(word) + rate) / (F.col("n_clean") + 1))
        return F.when(F.col(name) == "", 0.0).otherwise(ratio)

    due = F.col("n_clean") * share
    prior = F.log(F.greatest((F.col("n_seen") - due) / due, 0.01 * F.col("n_fix") / F.col("n_clean")))
    odds = prior + likelier("fl", "wl", "l", "before") + likelier("fr", "wr", "r", "after")
    rated = got.withColumn("odds", odds)
    if sure is not None:
        levels = paged.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.block_id", _level("b.confidence").alias("level"))
        known = levels.join(got.select("doc_id", "block_id").distinct(), ["doc_id", "block_id"], "left_semi").groupBy("doc_id", "block_id").agg(F.min("level").alias("level"))
        worth = known.join(F.broadcast(confidence_odds(paged, sure)), "level").select("doc_id", "block_id", "weight")
        rated = rated.join(worth, ["doc_id", "block_id"], "left").withColumn("odds", F.col("odds") + F.coalesce("weight", F.lit(0.0)))
    return rated.where("odds > 0").groupBy(*key).agg(F.max_by("fix", F.struct("odds", "n_fix", "fix")).alias("fix"))


def _figures_read(token: str) -> bool:
    """Whether a token is a figure in which letters were read."""
    return len(token) > 1 and not token.isdigit() and number(token)[1]


def _bitmap(words: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap over word hashes: bounded, whatever the data, and without misses."""

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            slot = np.array([_slot(w, bits) for w in f.word], np.int64)
            yield pd.DataFrame({"byte": slot >> 3, "mask": (1 << (slot & 7)).astype(np.int32)})

    rows = words.mapInPandas(slots, "byte bigint, mask int").groupBy("byte").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[rows["byte"].to_numpy(np.int64)] = rows["mask"].to_numpy()
    return out


def _slot(word: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(word) & ((1 << bits) - 1)


def _odd_words(bitmap: np.ndarray):
    """Rows (doc_id, block_id, word) of words that the bitmap holds; a null word for a misread figure."""
    bits = int(len(bitmap)).bit_length() + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str | None, bool]] = {}
        for f in frames:
            rows = []
            if len(known) > 500_000:
                known.clear()
            for doc, block, text in zip(f.doc_id, f.block_id, f.text):
                for token in {*_WORD.findall(_joined(text)), *_rejoined(text)}:
                    found = known.get(token)
                    if found is None:
                        low = token.lower()
                        slot = _slot(low, bits)
                        found = known[token] = (low if bitmap[slot >> 3] >> (slot & 7) & 1 else None, _figures_read(token))
                    if found[0]:
                        rows.append((doc, block, found[0]))
                    if found[1]:
                        rows.append((doc, block, None))
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "word"])

    return run


def _breaks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words broken at line ends and block ends; ``head`` rows carry the word that a page goes on with.

    ``other`` is the block of the right part.
    """
    for f in frames:
        rows = []
        for doc, page, blocks in zip(f.doc_id, f.page_num, f.blocks):
            open_left: tuple[str, str, str] | None = None
            head = None
            for b in blocks:
                text = b["text"]
                first = _first_word(text)
                if first and head is None:
                    head = (first, b["block_id"])
                if first and open_left:
                    rows.append((doc, page, *open_left, first, b["block_id"], False))
                    open_left = None
                for m in _BROKEN.finditer(text) if _HAS_MARK.search(text) else ():
                    left, mark, right = m[1].lower(), m[2], (m[3] or "").lower()
                    if right:
                        rows.append((doc, page, b["block_id"], left, mark, right, b["block_id"], False))
                    else:
                        open_left = (b["block_id"], left, mark)
            if open_left:
                rows.append((doc, page + 1, *open_left, "", "", False))
            if head:
                rows.append((doc, page, "", "", "", *head, True))
        yield pd.DataFrame(rows, columns=["doc_id", "page_num", "block_id", "left", "mark", "right", "other", "head"])


def _first_word(text: str) -> str | None:
    """The word a block goes on with: that of its first line which begins in lower case and is no number line."""
    for line in text.split("\n"):
        s = line.strip()
        if not s or _LONE.fullmatch(s):
            continue
        m = _WORD.match(s)
        if m and m[0][0].islower():
            return m[0].lower()
        if _header_parts(s)[1]:
            continue
        return None
    return None


def breaks(paged: DataFrame) -> DataFrame:
    """doc_id, block_id, left, mark, right, other: words broken at line and block ends, completed from the next page where it ends one."""
    found = cut(paged.mapInPandas(_breaks, "doc_id string, page_num int, block_id string, left string, mark string, right string, other string, head boolean"))
    heads = found.where("head").groupBy("doc_id", "page_num").agg(F.first(F.struct("right", "other")).alias("next"))
    rows = found.where("not head").join(heads, ["doc_id", "page_num"], "left")
    bare = F.col("right") == ""
    return rows.select("doc_id", "block_id", "left", "mark", F.when(bare, F.coalesce("next.right", F.lit(""))).otherwise(F.col("right")).alias("right"), F.when(bare, F.coalesce("next.other", F.lit(""))).otherwise(F.col("other")).alias("other"))


def broken_words(broken: DataFrame, words: DataFrame) -> DataFrame:
    """``breaks`` with ``real``: false where the corpus writes the two parts with a hyphen of its own and not as one word."""
    count = words.select("word", (F.col("n_clean") + F.col("n_scan")).alias("n"))
    whole = broken.select("left", "right").distinct().withColumns({"as_one": F.concat("left", "right"), "as_two": F.concat("left", F.lit("-"), "right")})
    counted = whole.join(count.toDF("as_one", "n_one"), "as_one", "left").join(count.toDF("as_two", "n_two"), "as_two", "left")
    real = (F.coalesce("n_one", F.lit(0)) >= F.coalesce("n_two", F.lit(0))) | (F.col("right") == "")
    return broken.join(counted.select("left", "right", real.alias("real")), ["left", "right"])


def _apart(broken: DataFrame) -> DataFrame:
    """Breaks whose parts stand in two blocks, with the whole word."""
    return broken.where((F.col("right") != "") & (F.col("other") != F.col("block_id"))).withColumn("word", F.concat("left", "right"))


def _with_broken(words: DataFrame, broken: DataFrame) -> DataFrame:
    """The lexicon with the words that block ends break."""
    extra = _apart(broken).select("word").distinct().join(words, "word", "left_anti")
    return words.unionByName(extra.select("word", F.lit(0).cast("bigint").alias("n_clean"), F.lit(0).cast("bigint").alias("n_scan"), F.lit(1).cast("bigint").alias("n_broken")))


def scan_noise(ocr: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, noise): which blocks of ``ocr`` bear hyphenation, misread, running_line or page_number.

    ``ocr(doc_id, block_id, page_num, reading_order, text, confidence)``; ``blocks(text, flags)`` adds clean text to
    the lexicon and may be empty. Rows with a null key or text and empty texts have no noise;
    deliveries count once; a block without a page number is a page of its own; extra columns are not read.
    """
    paged = cut(pages(ocr))
    words = cut(lexicon(ocr, blocks))
    furniture = cut(page_furniture(paged))
    broken = cut(breaks(paged))
    lexical = _with_broken(words, broken)
    judged = cut(corrections(lexical))
    wrong, doubtful = judged.where("n_clean = 0").select("word", "fixes"), judged.where("n_clean > 0")
    tokens = _flat(paged).mapInPandas(_odd_words(_bitmap(wrong)), "doc_id string, block_id string, word string")
    # The bitmap lets some other words through; the join settles it.
    listed = cut(tokens.join(wrong.select("word"), "word").select("doc_id", "block_id").distinct())
    figures = tokens.where("word is null").select("doc_id", "block_id").union(furniture.where("misread").select("doc_id", "block_id"))
    # Of a word in two blocks the part that the correction changes was misread.
    fix = F.col("fixes")[0]
    split = _apart(broken).join(wrong, "word").select("doc_id", F.when(F.startswith(fix, F.col("left")), F.col("other")).otherwise(F.col("block_id")).alias("block_id"))
    misread = listed.union(figures).union(split)
    if not doubtful.isEmpty():
        clean = blocks.where(~F.coalesce(F.array_contains("flags", "ocr"), F.lit(False))).select("text")
        both = _apart(broken).select("doc_id", "block_id", "other", "left", "word")
        read = open_readings(paged, doubtful, lexical, clean, both, listed)
        # An occurrence over two blocks has no page.
        over = read.where("page_num is null").join(both, ["doc_id", "block_id", "word"]).select("doc_id", F.when(F.startswith("fix", "left"), F.col("other")).otherwise(F.col("block_id")).alias("block_id"))
        misread = misread.union(read.where("page_num is not null").select("doc_id", "block_id")).union(over)
    parts = (
        misread.withColumn("noise", F.lit("misread"))
        .union(furniture.where("running").select("doc_id", "block_id", F.lit("running_line").alias("noise")))
        .union(furniture.where("numbered").select("doc_id", "block_id", F.lit("page_number").alias("noise")))
        .union(broken_words(broken, words).where("real").select("doc_id", "block_id", F.lit("hyphenation").alias("noise")))
    )
    return parts.distinct()


def _contexts(bitmap: np.ndarray):
    """Occurrences of misread words with the words beside them: doc_id, page_num, word, before, after."""
    bits = int(len(bitmap)).bit_length() + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for f in frames:
            rows = set()
            if len(known) > 500_000:
                known.clear()
            for doc, page, text in zip(f.doc_id, f.page_num, f.text):
                tokens = _WORD.findall(_joined(text).lower())
                whole = _rejoined(text.lower())
                for i, t in enumerate(tokens + whole):
                    hit = known.get(t)
                    if hit is None:
                        slot = _slot(t, bits)
                        hit = known[t] = bool(bitmap[slot >> 3] >> (slot & 7) & 1)
                    if hit:
                        inside = i < len(tokens)
                        rows.add((doc, page, t, tokens[i - 1] if inside and i else "", tokens[i + 1] if inside and i + 1 < len(tokens) else ""))
            yield pd.DataFrame(sorted(rows), columns=["doc_id", "page_num", "word", "before", "after"])

    return run


def _bigrams(bitmap: np.ndarray):
    """Counts of the pairs of adjacent words that the bitmap asks for."""
    bits = int(len(bitmap)).bit_length() + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        known: dict[tuple[str, str], bool] = {}
        for f in frames:
            for text in f.text:
                tokens = _WORD.findall(text.lower())
                for pair in zip(tokens, tokens[1:]):
                    hit = known.get(pair)
                    if hit is None:
                        slot = _slot(" ".join(pair), bits)
                        hit = known[pair] = bool(bitmap[slot >> 3] >> (slot & 7) & 1)
                    if hit:
                        total[" ".join(pair)] += 1
            if len(known) > 1_000_000:
                known.clear()
            if len(total) > 400_000:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = Counter()
        yield pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"n": "int64", "word": object})

    return run


def repairs(paged: DataFrame, wrong: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page_num, word, fix): the repair of every misread word of a page.

    Among the candidates the one wins whose pairs with the words beside it are the most frequent
    in ``texts(text)``; without any such pair the first candidate does.
    """
    seen = _flat(paged).mapInPandas(_contexts(_bitmap(wrong)), "doc_id string, page_num int, word string, before string, after string").join(wrong, "word")
    seen = cut(seen)
    tried = seen.where(F.size("fixes") > 1).select("doc_id", "page_num", "word", "before", "after", F.posexplode("fixes").alias("rank", "fix"))
    tried = tried.withColumns({"left": F.concat_ws(" ", "before", "fix"), "right": F.concat_ws(" ", "fix", "after")})
    asked = tried.select(F.explode(F.array("left", "right")).alias("word")).distinct()
    counts = cut(spread(texts.where("text is not null").select("text")).mapInPandas(_bigrams(_bitmap(asked)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    scored = tried.join(counts.toDF("left", "n_left"), "left", "left").join(counts.toDF("right", "n_right"), "right", "left")
    score = F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0)))
    best = scored.groupBy("doc_id", "page_num", "word").agg(F.max_by("fix", F.struct(score.alias("s"), (-F.col("rank")).alias("r"))).alias("fix"))
    single = seen.where(F.size("fixes") == 1).select("doc_id", "page_num", "word", F.col("fixes")[0].alias("fix")).distinct()
    return best.unionByName(single)


def _cased(fix: str, like: str) -> str:
    return fix.upper() if like.isupper() and len(like) > 1 else fix.capitalize() if like[0].isupper() else fix


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs of each page without furniture, breaks and misreadings."""
    ends = re.compile(r"[.!?…:;»”)\]]$")
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            drop = {(x["block_id"], x["line"]) for x in (r.lines if r.lines is not None else ())}
            fix = dict(zip(r.bad, r.good)) if r.bad is not None else {}
            keep = {(x["left"], x["right"]) for x in (r.compounds if r.compounds is not None else ())}
            open_fixes: dict[str, dict[tuple[str, str, str], str]] = {}
            for x in r.open if r.open is not None else ():
                open_fixes.setdefault(x["block_id"], {})[x["before"], x["word"], x["after"]] = x["fix"]
            parts: list[str] = []
            for b in r.blocks:
                said = _reread(b["text"], open_fixes[b["block_id"]]) if b["block_id"] in open_fixes else b["text"]
                lines = [line for i, line in enumerate(said.split("\n")) if (b["block_id"], i) not in drop and line.strip()]
                text = "\n".join(lines)
                if not text:
                    continue
                if parts and not ends.search(parts[-1]) and text.lstrip()[0].islower():
                    parts[-1] += "\n" + text
                else:
                    parts.append(text)
            done = [_flow(p, fix, keep) for p in parts]
            rows.append((r.doc_id, r.page_num, done))
        yield pd.DataFrame(rows, columns=["doc_id", "page_num", "parts"])


def _reread(text: str, fixes: dict[tuple[str, str, str], str]) -> str:
    """A block with the occurrences repaired that ``open_readings`` names, line by line as it was."""
    out: list[str] = []
    tokens: list[tuple[int, str]] = []

    def plain(piece: str) -> None:
        at = 0
        for m in _WORD.finditer(piece):
            out.append(piece[at : m.start()])
            tokens.append((len(out), m[0]))
            out.append(m[0])
            at = m.end()
        out.append(piece[at:])

    at = 0
    for m in _BROKEN.finditer(text) if _HAS_MARK.search(text) else ():
        plain(text[at : m.start()])
        better = fixes.get(("", (m[1] + m[3]).lower(), "")) if m[3] else None
        out.append(_cased(better, m[1] + m[3]) + "\n" * m[0].count("\n") if better else m[0])
        at = m.end()
    plain(text[at:])
    low = ["", *(t.lower() for _, t in tokens), ""]
    for i, (place, token) in enumerate(tokens):
        if better := fixes.get((low[i], low[i + 1], low[i + 2])):
            out[place] = _cased(better, token)
    return "".join(out)


def _flow(text: str, fix: dict[str, str], keep: set[tuple[str, str]]) -> str:
    """One paragraph: breaks joined, misread words repaired, figures read, white space single."""

    def rejoin(m: re.Match[str]) -> str:
        if not m[3]:
            return m[0]
        return f"{m[1]}-{m[3]}" if (m[1].lower(), m[3].lower()) in keep else m[1] + m[3]

    def repair(m: re.Match[str]) -> str:
        word = m[0]
        if _figures_read(word):
            return word.translate(FIGURES)
        better = fix.get(word.lower())
        return _cased(better, word) if better else word

    return re.sub(r"\s+", " ", _WORD.sub(repair, _BROKEN.sub(rejoin, text))).strip()


def paragraphs(ocr: DataFrame, blocks: DataFrame) -> DataFrame:
    """Continuous, readable paragraphs per book: doc_id, page_num, paragraph_no, text.

    Running lines and page numbers are left out, broken words joined, misread words repaired by
    bigram context, lines joined. A paragraph that a page end interrupts is completed with the
    beginning of the next page and stands on the page where it begins.
    """
    paged = cut(pages(ocr))
    words = cut(lexicon(ocr, blocks))
    judged = cut(corrections(words))
    wrong, doubtful = judged.where("n_clean = 0").select("word", "fixes"), judged.where("n_clean > 0")
    clean = blocks.where(~F.coalesce(F.array_contains("flags", "ocr"), F.lit(False))).select("text")
    fixes = repairs(paged, wrong, ocr.select("text").union(clean)).groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("word", "fix")).alias("w"))
    fixes = fixes.select("doc_id", "page_num", F.col("w.word").alias("bad"), F.col("w.fix").alias("good"))
    lines = page_furniture(paged).groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("block_id", "line")).alias("lines"))
    split = broken_words(breaks(paged), words).where("not real").select("doc_id", "block_id", "left", "right")
    home = paged.select("doc_id", "page_num", F.explode("blocks.block_id").alias("block_id"))
    compounds = split.join(home, ["doc_id", "block_id"]).groupBy("doc_id", "page_num").agg(F.collect_set(F.struct("left", "right")).alias("compounds"))
    key = ["doc_id", "page_num"]
    ready = paged.join(lines, key, "left").join(fixes, key, "left").join(compounds, key, "left")
    read = F.struct("block_id", "before", "word", "after", "fix")
    if doubtful.isEmpty():
        ready = ready.withColumn("open", F.array().cast("array<struct<block_id:string,before:string,word:string,after:string,fix:string>>"))
    else:
        ready = ready.join(open_readings(paged, doubtful, words, clean).groupBy(*key).agg(F.collect_list(read).alias("open")), key, "left")
    done = cut(ready.select("doc_id", "page_num", "blocks", "lines", "bad", "good", "compounds", "open").mapInPandas(_repaired, "doc_id string, page_num int, parts array<string>"))
    # Over page ends: the heads of the pages that go on go to the tail where the paragraph begins. A page
    # that is one part and goes on is within the paragraph as a whole, and so may be the page after it.
    tail, head = F.element_at("parts", -1), F.element_at("parts", 1)
    some = done.where(F.size("parts") > 0)
    narrow = some.select("doc_id", "page_num", (F.size("parts") == 1).alias("single"), tail.rlike("[.!?…:;»”)\\]]$").alias("ended"), head.rlike("^\\p{Ll}").alias("low"))
    book = W.partitionBy("doc_id").orderBy("page_num")
    goes_on = (F.lag("page_num").over(book) == F.col("page_num") - 1) & ~F.lag("ended").over(book) & F.col("low")
    placed = narrow.withColumn("lost", F.coalesce(goes_on, F.lit(False)))
    owner = F.last(F.when(~(F.col("lost") & F.col("single")), F.col("page_num")), ignorenulls=True).over(book.rowsBetween(W.unboundedPreceding, -1))
    lost = cut(placed.withColumn("owner", owner).where("lost").select(*key, "owner"))
    moved = some.select(*key, head.alias("head")).join(lost, key)
    onward = moved.groupBy("doc_id", F.col("owner").alias("page_num")).agg(F.array_sort(F.collect_list(F.struct(F.col("page_num").alias("page"), "head"))).alias("more"))

    def glue(said, more):
        return F.when(said.rlike(f"\\p{{L}}[{MARKS}]$"), F.concat(F.regexp_replace(said, f"[{MARKS}]$", ""), more["head"])).otherwise(F.concat_ws(" ", said, more["head"]))

    both = some.join(onward, key, "left").join(lost.select(*key, F.lit(1).alias("lost")), key, "left")
    kept = F.slice("parts", F.lit(1), F.greatest(F.lit(0), F.size("parts") - 1))
    whole = F.when(F.col("more").isNotNull(), F.concat(kept, F.array(F.aggregate("more", tail, glue)))).otherwise(F.col("parts"))
    rows = both.withColumn("parts", whole).withColumn("parts", F.when(F.col("lost") == 1, F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1))).otherwise(F.col("parts")))
    return rows.select("doc_id", "page_num", F.posexplode("parts").alias("paragraph_no", "text")).where("text <> ''")
