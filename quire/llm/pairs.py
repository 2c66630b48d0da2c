"""Problem 6: defective prompt and response pairs.

Response openings are clustered by the shingles that they share. An opening that recurs across unrelated
prompts is a template of its own, not a rendering of its prompt: a refusal. Copy, language and
termination checks label the other defects.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .filters import bitmap, held
from .minhash import WordHashes, mix, shingles, signatures
from .text import plain, strip_invisible, visible
from .truncation import judge, state

#: Frequent short words of languages (fixed values), lower case.
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for on with as at by from this not but are be or an i you which while then if without never what when can cannot more than may any here am please could another",
    "de": "der die das und ist nicht mit ein eine den dem von zu auf für im sich auch des nach über unter bei aus wird wir ich sie",
    "fr": "le la les des et est un une du de dans que qui pour pas sur avec au aux par plus sous ce cette sans en nous je vous après",
    "es": "el la los las de y es un una del que en por con para no se al lo su sin como más bajo este esta después",
    "it": "il lo la gli le di e è un una del della che in per con non si al sono dei nel senza più sotto questo questa dopo",
    "pt": "o a os as de e é um uma do da que em por com para não se ao no na sem mais sob este esta depois",
    "nl": "de het een en van is niet met op in te dat voor zijn aan door bij naar over onder zonder dit deze ook na",
    "pl": "i w na z że nie do jest się o od po za pod przez dla jak ten ta to przy bez oraz który jego",
    "cs": "a v na se že je z do s o od po za pod pro jak ten ta to při bez který jeho není",
    "tr": "ve bir bu da de için ile çok daha gibi olan olarak sonra kadar altında ne var değil",
    "sv": "och i att det som en på är av för med den till inte om ett under efter utan vid från",
    "ru": "и в не на я что с по это как но из у за к то же для от так мы вы он она они или если без между когда чем при под бы был этот эта перед после до во со о об который где также могу",
    "uk": "і й в у на не що з та до як це але за від по про або якщо без між коли ніж при під був цей ця після щоб він вона вони для",
    "be": "і ў у на не што з да як гэта але за ад па пра або калі без паміж пры пад быў гэты пасля каб ён яна яны для",
    "bg": "и в на не се че за от с по това как но из до или ако без между когато при под беше този тази след преди той тя те е са към във със",
    "sr": "и у на не се да је са за од по то као али из до или ако без између када при под био овај ова после пре он она они су што",
}
#: Letters that a language of the script does not write, and letters that mark one (fixed values).
FOREIGN_LETTERS = {"en": "äöüßéèêëàâçñłśźżąęćóôîïûœæøåčřšžýáíúãõ", "ru": "іїєґўјљњћђџѓќ"}
MARKS = {"de": "äöüß", "fr": "éèêëàâçîïôûœ", "es": "ñ¿¡", "pl": "łśźżąęćń", "cs": "řěůčšž", "pt": "ãõ", "sv": "å", "tr": "ğış", "uk": "іїєґ", "be": "ў", "sr": "јљњћђџ"}
_TOKEN = re.compile(r"(?<!\S)[^\w\s]*([^\W\d_]{2,}(?:[-'’][^\W\d_]+)*)[^\w\s]*(?!\S)")
_ALL_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NEIGHBOURS = frozenset(FOREIGN_LETTERS["ru"])
_FIGURES = re.compile(r"[0-9]+")
_CYRILLIC_LANGS = ("ru", "uk", "be", "bg", "sr")
_LATIN_LANGS = tuple(x for x in FUNCTION_WORDS if x not in _CYRILLIC_LANGS)
_LANGS_OF: dict[str, list[str]] = {}
for _lang, _those in FUNCTION_WORDS.items():
    for _word in _those.split():
        _LANGS_OF.setdefault(_word, []).append(_lang)


def _worded(text: str) -> list[str]:
    """Tokens between blanks that are a word within stops and quotation marks; formulas and figures are none."""
    return _TOKEN.findall(text)


def _figures(text: str) -> list[str]:
    """The different figures of a text."""
    return sorted({*_FIGURES.findall(text)})


def _first(text: str, n: int) -> list[str]:
    """The first ``n`` words, in whatever they stand."""
    return [m[0] for m in islice(_ALL_WORDS.finditer(text), n)]


def _script(words: list[str]) -> str:
    """``cyrillic``, ``latin`` or ``none``: that of most letters in words of three or more."""
    cyrillic = latin = 0
    for w in words:
        if (n := len(w)) > 2:
            if "\u0400" <= w[0] <= "\u04ff":
                cyrillic += n
            else:
                latin += n
    return ("cyrillic" if cyrillic > latin else "latin") if cyrillic + latin else "none"


def script(text: str) -> str:
    return _script(_worded(plain(text)))


_GRAMS = 1 << 16
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _trigrams(words: list[str]) -> np.ndarray:
    """Cells of the three-letter pieces of a text's words, blanks between words included."""
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = a[:-2] * _SPREAD[0] + a[1:-1] * _SPREAD[1] + a[2:] * _SPREAD[2]
    h ^= h >> np.uint64(31)
    return (h * _SPREAD[1] >> np.uint64(48)).astype(np.int64)


@dataclass
class Profile:
    """Three-letter pieces of a language, as log shares of hashed cells, and the mean score from which a text belongs to it."""

    shares: np.ndarray
    least: float

    @classmethod
    def fit(cls, texts: list[str], deviations: float = 6.0) -> Profile:
        cells = [g for g in (_trigrams(_worded(plain(t))) for t in texts) if len(g) > 1]
        counts = np.bincount(np.concatenate(cells), minlength=_GRAMS) if cells else np.zeros(_GRAMS)
        shares = np.log((counts + 0.5) / (counts.sum() + 0.5 * _GRAMS)).astype(np.float32)
        scores = np.array([shares[g].mean() for g in cells]) if cells else np.zeros(1)
        return cls(shares, float(scores.mean() - deviations * scores.std()))

    def holds(self, cells: np.ndarray) -> bool:
        return float(self.shares[cells].mean()) >= self.least


def fit_profiles(jobs: DataFrame, most: int = 4_000, least: int = 50) -> dict[str, Profile]:
    """Profiles of the languages that prompts are labelled with, from a sample of ``most`` rows, which the hash of the job's id draws.

    ``jobs(job_id, src, source_text)``. A language with fewer than ``least`` texts in the sample has none;
    its texts are then judged by words and letters alone.
    """
    # About twice the sample passes the threshold of the hash, whatever the number of rows and tasks; the rest stays in the tasks.
    n = jobs.count()
    drawn = jobs.where("job_id is not null and source_text is not null and src is not null").withColumn("h", F.xxhash64("job_id"))
    if n > 2 * most:
        drawn = drawn.where(F.col("h") < 2**64 * 2 * most // n - 2**63)
    rows = drawn.orderBy("h", "job_id").select("src", "source_text").limit(most).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.src, []).append(r.source_text)
    return {lang: Profile.fit(those) for lang, those in texts.items() if len(those) >= least}


def language(text: str, profiles: dict[str, Profile] | None = None) -> str:
    """The language of the text by its three-letter pieces, short words and letters; ``und`` where nothing tells."""
    words = _worded(plain(text))
    return _language(words, _script(words), profiles or {})


def _language(words: list[str], kind: str, profiles: dict[str, Profile]) -> str:
    if kind == "none":
        return "und"
    words = [w for w in words if ("\u0400" <= w[0] <= "\u04ff") == (kind == "cyrillic")]
    # Texts like the prompts of a language are of that language; words and letters judge the others.
    if profiles:
        cells = _trigrams(words)
        for lang, profile in profiles.items():
            if profile.holds(cells):
                return lang
    n, joined = len(words), "".join(words)
    score = dict.fromkeys(_CYRILLIC_LANGS if kind == "cyrillic" else _LATIN_LANGS, 0.0)
    for w, c in Counter(words).items():
        for lang in _LANGS_OF.get(w, ()):
            if lang in score:
                score[lang] += c / n
    present = set(joined)
    share = lambda letters: sum(joined.count(c) for c in present.intersection(letters)) / len(joined)
    for lang, those in MARKS.items():
        if lang in score:
            score[lang] += 6 * share(those)
    home = "ru" if kind == "cyrillic" else "en"
    score[home] -= 6 * share(FOREIGN_LETTERS[home])
    if home == "ru":
        # Letters that Russian uses often and its neighbours lack or use far less.
        score["ru"] += 3 * share("ыэё")
        for lang, lacks in (("uk", "ыэёъ"), ("sr", "ыэёъщьйюя"), ("bg", "ыэё"), ("be", "ищъ")):
            score[lang] -= 6 * share(lacks)
    best = max(score, key=lambda k: score[k])
    return best if score[best] > 0.02 else "und"


#: Words of a prompt's beginning by which prompts are held related.
_FIRST = 6
#: Minima of a prompt's words by which whole prompts are held alike.
_SKETCH = 8


def _prompts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for f in frames:
        texts = [x if isinstance(x, str) else "" for x in f.source_text]
        low = [plain(x) for x in texts]
        words = [_worded(x) for x in low]
        values, bounds = shingles(words, 1, hashes)
        full = np.flatnonzero(np.diff(bounds))
        sketch: list[list[int]] = [[] for _ in texts]
        if len(full):
            for i, row in zip(full, signatures(values, np.append(bounds[full], len(values)), _SKETCH).view(np.int64)):
                sketch[i] = row.tolist()
        rows = [(job, src, tgt, _script(w), sorted({*_first(y, _FIRST)}), k, _figures(y), state(x)) for job, src, tgt, x, y, w, k in zip(f.job_id, f.src, f.tgt, texts, low, words, sketch)]
        yield pd.DataFrame(rows, columns=["job_id", "src", "tgt", "script", "first", "sketch", "figures", "s"])


def _responses(opening: int, profiles: dict[str, Profile]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for job, text in zip(f.job_id, f.translated_text):
                if not (isinstance(text, str) and visible(text)):
                    rows.append((job, False, "none", "und", [], [], None))
                    continue
                text = strip_invisible(text)
                low = plain(text)
                words = _worded(low)
                kind = _script(words)
                rows.append((job, True, kind, _language(words, kind, profiles), _first(low, opening), _figures(low), state(text)))
            yield pd.DataFrame(rows, columns=["job_id", "visible", "script", "lang", "opening", "said", "t"])

    return run


_STATE = "struct<finish:string,open:int,broken:boolean,lines:int,chars:int>"


def _features(jobs: DataFrame, outputs: DataFrame, opening: int, sample: int) -> DataFrame:
    code = lambda c: F.lower(F.substring(F.trim(c), 1, 2))
    asked = jobs.select(F.col("job.job_id").alias("job_id"), code("job.source_language").alias("src"), code("job.target_language").alias("tgt"), F.col("payload.source_text").alias("source_text")).where("job_id is not null")
    prompts = asked.mapInPandas(_prompts, f"job_id string, src string, tgt string, script string, first array<string>, sketch array<bigint>, figures array<string>, s {_STATE}").dropDuplicates(["job_id"])
    told = outputs.select("job_id", "translated_text").where("job_id is not null")
    responses = told.mapInPandas(_responses(opening, fit_profiles(asked, sample)), f"job_id string, visible boolean, script string, lang string, opening array<string>, said array<string>, t {_STATE}").dropDuplicates(["job_id"])
    return prompts.withColumnRenamed("script", "prompt_script").join(responses, "job_id")


def copy_share(source: str, target: str) -> float:
    """The share of the source's words that stand in the target, or of the longer text if the target is much longer."""
    a, b = Counter(_worded(plain(source))), Counter(_worded(plain(target)))
    n, m = sum(a.values()), sum(b.values())
    if not n or not m:
        return 0.0
    return sum((a & b).values()) / max(n, min(m, m - 3))


def _copies(suspects: DataFrame, jobs: DataFrame, outputs: DataFrame, least: float) -> DataFrame:
    """Jobs whose response is the prompt again. Only responses in the prompt's script are compared text with text."""
    # Few texts pass the bitmap of the suspects, so only theirs are shuffled; the semi-joins settle it.
    bits = bitmap(suspects, "job_id")
    prompts = jobs.select(F.col("job.job_id").alias("job_id"), F.col("payload.source_text").alias("source_text")).where(held(bits, "job_id")).join(suspects, "job_id", "left_semi")
    responses = outputs.select("job_id", "translated_text").where(held(bits, "job_id")).join(suspects, "job_id", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[copy_share(a, b) >= least for a, b in zip(f.source_text, f.translated_text)], ["job_id"]]

    return prompts.join(responses, "job_id").mapInPandas(run, "job_id string").distinct()


def _least_common(m: int, n: int, similarity: float) -> int:
    """How many elements sets of ``m`` and ``n`` must share to be alike; 0 where they cannot be."""
    return next((k for k in range(1, min(m, n) + 1) if k >= similarity * (m + n - k)), 0)


#: Parts of one set, in one comparison, up to which sets meet by their parts; larger sets meet in pairs.
_MOST_PARTS = 100


def _parts(sizes: list[int], similarity: float, few: np.ndarray | None):
    """Rows (opening_hash, low, high, key, side), a key for each part of a set that suffices to be alike.

    Two sets are alike if and only if they share a part of as many elements as their sizes call for.
    Sides: 0 for sets of one size, else 1 for the smaller and 2 for the larger. ``few`` is the bitmap
    of what sets below the largest size hold: only parts within it may meet a smaller set's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n_of = f.grams.map(len).to_numpy()
            for n in np.unique(n_of):
                own = f[n_of == n]
                grams = mix(np.stack(own.grams.to_list()).view(np.uint64))
                if few is not None:
                    slots = np.stack(own.slots.to_list()).view(np.uint64) & np.uint64(len(few) * 64 - 1)
                    may = (few[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
                for other in sizes:
                    k = _least_common(n, other, similarity)
                    if not k:
                        continue
                    at = np.array([*combinations(range(n), k)])
                    low, high = min(n, other), max(n, other)
                    keys = mix(grams[:, at].sum(axis=2, dtype=np.uint64) ^ np.uint64(low << 32 | high)) & ~np.uint64(1)
                    i, j = np.nonzero(may[:, at].all(axis=2) if other < n else np.ones(keys.shape, bool))
                    yield pd.DataFrame({c: own[c].to_numpy()[i] for c in ("opening_hash", "low", "high")} | {"key": keys[i, j].view(np.int64), "side": np.int32(0 if other == n else 1 + (other < n))})

    return run


def _pairs_alike(made: DataFrame, similarity: float) -> DataFrame:
    """(opening_hash, cluster): all pairs of sets alike, either way. Sets alike share one of their first elements in any order that all keep."""
    n = F.size("grams")
    first = made.select("opening_hash", F.explode(F.slice(F.array_sort("grams"), F.lit(1), n - F.ceil(similarity * n - 1e-9).cast("int") + 1)).alias("gram"))
    of = lambda x: made.select(F.col("opening_hash").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("grams", "low", "high")))
    met = first.withColumnRenamed("opening_hash", "a").join(first.withColumnRenamed("opening_hash", "b"), "gram").where("a < b").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    alike = cut(met.where(both >= similarity * (F.size("a_grams") + F.size("b_grams") - both)).where("least(a_low, b_low) < greatest(a_high, b_high)").select("a", "b"))
    return alike.selectExpr("a as opening_hash", "b as cluster").union(alike.selectExpr("b", "a"))


def opening_clusters(openings: DataFrame, width: int = 2, similarity: float = 0.5) -> DataFrame:
    """Clusters of openings: ``openings(opening array<string>)`` distinct, to (opening_hash, cluster).

    A cluster is an opening, its head, and every opening whose word shingles have at least this Jaccard
    similarity to the head's, and each opening is a head. Heads that are like the same openings have one
    cluster, by the smallest hash. Clusters are not joined through their members: of many texts that
    would chain unlike ones.

    Which openings are alike is exact: two are if they share a part of their shingles that is large
    enough, so all with one part are alike, and a cluster is the union of its head's parts. So no pairs are made,
    however many openings are alike, unless openings are so long that they have too many parts.

    With the smallest and largest owner of each opening, ``openings(opening, low, high)``, openings that
    meet only others of the same single owner are left in clusters of their own; a cluster has the
    same owners then as it has without.
    """
    if "low" not in openings.columns:
        openings = openings.withColumn("low", F.xxhash64("opening")).withColumn("high", F.col("low"))
    keyed = openings.select("opening", "low", "high", F.xxhash64("opening").alias("opening_hash"))
    own = keyed.select("opening_hash", F.col("opening_hash").alias("cluster"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("opening") - width + 1), lambda i: F.xxhash64(F.slice("opening", i, width))))
    made = cut(keyed.where(F.size("opening") >= width).select("opening_hash", "low", "high", grams.alias("grams")))
    sizes = sorted(r.n for r in made.select(F.size("grams").alias("n")).distinct().collect())
    if any(comb(n, _least_common(m, n, similarity)) > _MOST_PARTS for n in sizes for m in sizes):
        return _pairs_alike(made, similarity).union(own)

    few = bitmap(made.where(F.size("grams") < sizes[-1]).select(F.explode("grams").alias("gram")), "gram") if len(sizes) > 1 else None
    slots = F.transform("grams", lambda x: F.xxhash64(x))
    entries = made.withColumn("slots", slots).mapInPandas(_parts(sizes, similarity, few), "opening_hash bigint, low bigint, high bigint, key bigint, side int")
    here = Window.partitionBy("key")
    ends = {f"{at}_{c}": f(c).over(here) for c in ("opening_hash", "side") for at, f in (("first", F.min), ("last", F.max))} | {"least": F.min("low").over(here), "most": F.max("high").over(here)}
    # Parts of one opening or of one owner add nothing to a cluster, nor do those for two sizes that only one of them has.
    live = entries.withColumns(ends).where("least < most and first_opening_hash < last_opening_hash and (side = 0 or first_side < last_side)")
    live = cut(live.select("opening_hash", "key", "side"))
    # A larger set is like the smaller ones with its part, and need not be like the other larger ones: these go by the key's neighbour.
    heads = live.groupBy("opening_hash").agg(F.array_sort(F.collect_set(F.col("key") + (F.col("side") == 2).cast("int"))).alias("keys"), F.min("side").alias("side"))
    heads = heads.groupBy("keys", F.when(F.col("side") > 0, F.col("opening_hash")).alias("single")).agg(F.min("opening_hash").alias("cluster"))
    members = live.select("opening_hash", "key").union(live.where("side = 1").select("opening_hash", F.col("key") + 1))
    linked = heads.select("cluster", F.explode("keys").alias("key")).join(members, "key").select("opening_hash", "cluster")
    alone = heads.where("single is not null").select(F.col("cluster").alias("opening_hash"), "cluster")
    return linked.union(alone).distinct().union(own.join(live.select("opening_hash").distinct(), "opening_hash", "left_anti"))


def templates(placed: DataFrame, prompts: DataFrame, least_prompts: int) -> DataFrame:
    """(cluster): clusters whose responses answer unrelated prompts.

    ``placed(job_id, cluster)``, ``prompts(job_id, first, sketch)``. The prompts of a cluster are
    related if one word stands at the beginning of most of them that is rare at the beginning of
    prompts at large (renderings of one phrase answer prompts that begin alike), or if the prompts
    are near copies of each other, which their sketches tell.
    """
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least_prompts)
    members = placed.join(sizes, "cluster")
    usual = prompts.select(F.explode("first").alias("word")).groupBy("word").agg((F.count("*") / F.lit(max(1, prompts.count()))).alias("usual"))
    # Prompts that begin with the same words count together.
    begins = members.join(prompts.select("job_id", "first"), "job_id").groupBy("cluster", "n", "first").agg(F.count("*").alias("k"))
    words = begins.select("cluster", "n", "k", F.explode("first").alias("word")).groupBy("cluster", "n", "word").agg(F.sum("k").alias("n_word"))
    share = F.col("n_word") / F.col("n")
    begun = words.where(share > 0.5 + 0.5 / F.col("n")).join(usual, "word")
    # A phrase that a large part of all prompts begins with shows in a large cluster by standing in all of it.
    begun = begun.where((share >= 3 * F.col("usual")) | ((F.col("n") >= 20) & (share >= 0.98) & (F.col("usual") <= 0.85))).select("cluster").distinct()
    # Only the few clusters that are left are tried by sketches.
    left = cut(members.join(begun, "cluster", "left_anti"))
    minima = left.join(prompts.select("job_id", "sketch"), "job_id").select("cluster", "n", F.posexplode("sketch").alias("at", "value")).groupBy("cluster", "n", "at", "value").agg(F.count("*").alias("k"))
    alike = minima.groupBy("cluster", "n", "at").agg(F.max("k").alias("k")).groupBy("cluster").agg(F.avg(F.col("k") / F.col("n")).alias("agree")).where("agree >= 0.6").select("cluster")
    return left.select("cluster").distinct().join(alike, "cluster", "left_anti")


def defective_pairs(jobs: DataFrame, outputs: DataFrame, opening: int = 8, window: int = 6, similarity: float = 0.5, least_prompts: int = 3, copy_at: float = 0.7, deviations: float = 2.5, sample: int = 4_000) -> DataFrame:
    """(job_id, defect): empty, copy, wrong_language, refusal or truncated; at most one per job, in this order.

    ``jobs(job.job_id, job.source_language, job.target_language, payload.source_text)`` and
    ``outputs(job_id, translated_text)``. Every run of ``window`` words of a response's opening (its
    first ``opening`` words; all of a shorter one), so that a template with a changing lead recurs, is
    clustered with all that are like it; a cluster that answers at least ``least_prompts`` unrelated prompts
    is a refusal template. ``sample`` rows of the prompts give the profiles of their languages.
    Jobs without an output give no row; null texts count as empty; sources without words have no
    defect when returned as they are; deliveries count once; other columns are not read.
    """
    pairs = cut(_features(jobs, outputs, opening, sample))
    worded = F.col("prompt_script") != "none"
    suspects = pairs.where(F.col("visible") & worded & (F.col("script") == F.col("prompt_script"))).select("job_id")
    copies = cut(_copies(suspects, jobs, outputs, copy_at).select("job_id", F.lit(True).alias("copied")))
    foreign = F.col("visible") & worded & (F.col("lang") != "und") & (F.col("lang") != F.col("src")) & (F.col("lang") != F.col("tgt"))
    flagged = pairs.withColumn("foreign", F.coalesce(foreign, F.lit(False))).withColumn("may", held(bitmap(copies, "job_id"), "job_id"))
    # Only the few rows that may be copies meet them.
    met = flagged.where("may").join(copies, "job_id", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    rest = cut(flagged.where("not may").withColumn("copied", F.lit(False)).unionByName(met).drop("may"))
    own = rest.where(F.col("visible") & ~F.col("copied") & ~F.col("foreign"))
    # A response that carries figures of its prompt renders it, however its opening recurs.
    renders = F.arrays_overlap("figures", "said")
    prompts = own.select("job_id", "first", "sketch")
    some = own.where(F.size("opening") >= 3)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("opening") - window)))
    runs = some.select("job_id", "opening", at.alias("at")).select("job_id", F.slice("opening", F.col("at") + 1, window).alias("opening")).withColumn("opening_hash", F.xxhash64("opening"))
    owner = F.xxhash64("job_id")
    openings = runs.groupBy("opening").agg(F.min(owner).alias("low"), F.max(owner).alias("high"))
    placed = cut(runs.select("job_id", "opening_hash").join(opening_clusters(openings, similarity=similarity), "opening_hash").select("job_id", "cluster").distinct())
    refusals = placed.join(templates(placed, prompts, least_prompts), "cluster", "left_semi").select("job_id").distinct().withColumn("refused", F.lit(True))
    ratio = F.log(F.col("t.chars") / F.col("s.chars"))
    usual = own.where("s.finish = 'stop' and t.finish = 'stop' and s.chars >= 60 and t.chars > 0").groupBy("tgt").agg(F.exp(F.avg(ratio) - deviations * F.coalesce(F.stddev(ratio), F.lit(0.1))).alias("low"))
    defect = (
        F.when(~F.col("visible"), "empty")
        .when(F.col("copied"), "copy")
        .when(F.col("foreign"), "wrong_language")
        .when(F.coalesce("refused", F.lit(False)) & ~F.coalesce(renders, F.lit(False)), "refusal")
        .when(judge(), "truncated")
    )
    judged = rest.join(refusals, "job_id", "left").join(F.broadcast(usual), "tgt", "left").withColumn("low", F.coalesce("low", F.lit(0.7)))
    return judged.select("job_id", defect.alias("defect")).where("defect is not null")


def defect_report(jobs: DataFrame, outputs: DataFrame, **options: float) -> DataFrame:
    """Defects by backend: source, defect, n."""
    found = defective_pairs(jobs, outputs, **options)
    of = outputs.where("job_id is not null").groupBy("job_id").agg(F.max("source").alias("source"))
    return found.join(of, "job_id").groupBy("source", "defect").agg(F.count("*").alias("n"))
