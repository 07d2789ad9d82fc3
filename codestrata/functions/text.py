"""Scalar functions on strings, paths, dates and numbers, as column expressions. Nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def week_start(value: Column) -> Column:
    """The Monday of a date given as text; text that is no date comes back as it is."""
    day = F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"), value)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, size: int = 120) -> Column:
    """The first line of the first ``size`` characters, white space collapsed."""
    return collapse(F.substring_index(F.substring(text, 1, size), "\n", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def normal_path(path: Column) -> Column:
    """Slashes forward, '.' and empty segments dropped, '..' resolved against the segment before it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda acc, x: (F.when(x.isin("", "."), acc)
                           .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                           .otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def snake(name: Column) -> Column:
    humps = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(humps, r"([A-Z])([A-Z][a-z])", "$1_$2"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def question_hash(question: Column) -> Column:
    """A short hash of a question that ignores case, punctuation and spacing."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}_]", " "), r"\s+", " ")), 256), 1, 16)


def block_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def line_number(text: Column, needle: Column) -> Column:
    """The line, from 1, on which ``needle`` first stands; null if it doesn't."""
    at = F.instr(text, needle)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3)


def mask_secret(text: Column) -> Column:
    """The first and last four characters of a long secret, stars for a short one."""
    return F.when(F.length(text) <= 8, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.left(text, F.lit(4)), F.lit("…"), F.right(text, F.lit(4))))


def script_json(value: Column) -> Column:
    """JSON that may stand inside a page: the characters that could end a script are escaped."""
    out = F.to_json(value)
    for c, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def downgrade(severity: Column) -> Column:
    return F.when(severity == "high", "medium").otherwise("low")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def glob_pattern(glob: str) -> str:
    """The regular expression of a file-name pattern with * ? and [...]."""
    import fnmatch

    return fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")


def glob_match(path: Column, glob: str) -> Column:
    """Whether the whole path or its last part fits a pattern."""
    p = glob_pattern(glob)
    return path.rlike("^" + p) | basename(path).rlike("^" + p)


# Words that a question is full of.
STOPWORDS = ("the and for with what which how does where when who why this that these those from into onto about are was were is it its in on of to a an be been can could should would do did has have had not "
             "but or if then than as at by we you they he she our your their all any each code file files function functions class method module show me please tell explain find list give used use uses call calls").split()


def query_tokens(question: Column, least: int = 3) -> Column:
    """The distinct identifiers and words of a question, in order of appearance: split at dots and slashes, no stop words, no short ones."""
    raw = F.regexp_extract_all(question, F.lit(r"[\p{L}_][\p{L}\p{N}_./-]*"), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda t: F.split(t, r"[./-]+")))
    kept = F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS))
    return F.array_distinct(kept)


def is_strong(token: Column) -> Column:
    """A token that looks like an identifier: underscore, slash, dot, inner capital, or long."""
    return token.rlike(r"[_/.]|[a-z][A-Z]") | (F.length(token) >= 8)


def fuzzy(text: Column, needle: str) -> Column:
    """Whether the letters of ``needle`` occur in order, in any case."""
    import re

    return F.lower(text).rlike(".*?".join(re.escape(c) for c in needle.lower()))
