"""Scalar text functions as Spark columns: everything stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \n\t\r\f\v"
#: Patterns of the text checks (fixed values).
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
LINK = r"(?i)\b(?:https?://\S+|www\.\S+)\b"
DATES = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b",
)
EQUATION = r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[^,;\n]{1,64}"
ACRONYM = r"\b[A-Z]{2,}\b"
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
LONG_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
TOKEN = r"[A-Za-zА-Яа-яЁё0-9\-]+"
MARKER = r"\[(\d{1,3})\]"
#: Words too common to count as terms (fixed values).
COMMON_WORDS = (
    "about", "after", "before", "because", "between", "chapter", "example", "general", "information", "language",
    "method", "number", "people", "process", "result", "section", "system", "theory", "through", "without",
)
#: Capitalised words that start sentences and are no names (fixed values).
STOP_NAMES = ("The", "A", "An", "In", "On", "At", "By", "Of")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at either end; null is empty."""
    return F.trim(text(c), F.lit(BLANKS))


def normalize(c: Column | str) -> Column:
    """Stripped, lower case, every run of white space one space."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def line_token(c: Column | str) -> Column:
    """Lower case, figures as ``#``, white space collapsed: recurring lines become equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\d+", "#"), r"\s+", " "))


def lines(c: Column | str) -> Column:
    """Lines without blank ones, each collapsed; CR LF counts as a line end."""
    parts = F.split(F.regexp_replace(text(c), "\r\n?", "\n"), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def typeset(c: Column | str) -> Column:
    return F.array_join(lines(c), "\n")


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), r"\s+", "")


def marker(c: Column | str) -> Column:
    """A note marker as its figures, else stripped and lower case; null is empty."""
    digits = F.regexp_replace(text(c), r"\D", "")
    return F.when(F.length(digits) > 0, digits).otherwise(F.lower(strip(c)))


def slug(c: Column | str, default: str = "item") -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    out = F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out != "", out).otherwise(F.lit(default))


def found(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def distinct_sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def tokens(c: Column | str) -> Column:
    """Tokens of the lower-cased text."""
    return found(F.lower(text(c)), TOKEN)


def numbers(c: Column | str) -> Column:
    return distinct_sorted(found(c, NUMBER))


def links(c: Column | str) -> Column:
    return distinct_sorted(found(c, LINK))


def dates(c: Column | str) -> Column:
    return distinct_sorted(F.concat(*[found(c, p) for p in DATES]))


def equations(c: Column | str) -> Column:
    return distinct_sorted(F.filter(F.transform(found(c, EQUATION), compact), lambda x: x != ""))


def date_supported(date: Column, target: Column) -> Column:
    """The date itself or all its figures stand in the target."""
    return F.contains(target, date) | F.forall(F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0)), lambda d: F.contains(target, d))


def equation_supported(equation: Column, target: Column) -> Column:
    """The equation, its left side or all its figures stand in the target."""
    left = F.trim(F.substring_index(equation, "=", 1))
    figures = F.regexp_extract_all(equation, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    loose = F.contains(equation, F.lit("=")) & F.contains(target, F.lit("=")) & (((left != "") & F.contains(target, left)) | ((F.size(figures) > 0) & F.forall(figures, lambda d: F.contains(target, d))))
    return F.contains(target, equation) | F.contains(compact(target), equation) | loose


def distinct_folded(a: Column) -> Column:
    """Ordered distinct by lower case, first spelling kept."""
    return F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1)


def hints(c: Column | str, most: int = 12) -> Column:
    """Acronyms, then capitalised sequences, distinct by lower case, at most ``most``."""
    all_of = distinct_folded(F.concat(found(c, ACRONYM), found(c, NAME)))
    return F.slice(all_of, 1, most) if most > 0 else F.slice(all_of, 1, 0)


def token_estimate(c: Column | str) -> Column:
    """Words times 1.3, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.size(found(c, r"\S+")) * F.lit(1.3)).cast("int"))


def char_estimate(c: Column | str) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text(c)) / 4).cast("int"))


def share_of(c: Column | str, pattern: str) -> Column:
    """Share of the characters that match (X15); 0 for empty text."""
    n = F.length(text(c))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text(c), F.lit(pattern)) / n)


def list_line(line: Column) -> Column:
    """A line that begins like a list item."""
    return line.rlike(r"^(?:[-*•] |\d+[.)]\s+)")


def list_density(c: Column | str) -> Column:
    rows = F.filter(F.transform(F.split(text(c), r"\r\n|[\n\r]"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    return F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(F.size(F.filter(rows, list_line)) / F.size(rows))


def rare_terms(c: Column | str, given: Column | None = None) -> Column:
    """Distinct given hints by lower case, else distinct uncommon words of six or more letters, at most 10."""
    words = F.filter(found(c, r"\b[A-Za-z][A-Za-z\-]{5,}\b"), lambda w: ~F.lower(w).isin(*COMMON_WORDS))
    own = F.least(F.size(F.array_distinct(words)), F.lit(10))
    if given is None:
        return own
    kept = F.array_distinct(F.filter(F.transform(given, lambda x: F.lower(strip(x))), lambda x: x != ""))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, F.size(kept)).otherwise(own)


def head(c: Column | str, most: int) -> Column:
    """The first ``most`` characters, trimmed at the cut."""
    return F.when(F.length(text(c)) <= most, text(c)).otherwise(F.rtrim(F.left(text(c), F.lit(most)), F.lit(BLANKS)))


def tail(c: Column | str, most: int) -> Column:
    return F.when(F.length(text(c)) <= most, text(c)).otherwise(F.ltrim(F.right(text(c), F.lit(most)), F.lit(BLANKS)))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON in the order given."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def clamp(c: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    """A value of the set, else the default."""
    low = F.lower(strip(c))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def duration(seconds: Column) -> Column:
    """Seconds as ``hh:mm:ss``, or ``mm:ss`` below an hour; negative counts as 0."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` by its value; a placeholder that is left raises an error."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), text(value))
    return F.when(F.contains(out, F.lit("{{")) | F.contains(out, F.lit("}}")), F.raise_error(F.concat(F.lit("placeholder left: "), F.left(out, F.lit(80))))).otherwise(out)
