"""Text expressions: all are Columns and stay in the JVM.

Java's regular expressions decide: \\s, \\d and \\W are ASCII, \\p{C} takes unassigned code points too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r""".,;:!?"'()\[\]{}\-–—/\\@&%#+=*<>|"""
PAGE_LABEL = r"^[\W_]*\d{1,4}[\W_]*$"


def sanitize(t: Column) -> Column:
    """Replacement and control characters become blanks, runs of blanks one, ends are trimmed."""
    t = F.regexp_replace(t, r"[\x{FFFD}]", " ")
    t = F.regexp_replace(t, r"\p{C}", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "))


def normalize(t: Column) -> Column:
    return F.trim(F.regexp_replace(sanitize(t), r"\s+", " "))


def alpha_ratio(t: Column) -> Column:
    """Letters / length; empty: 0."""
    n = F.length(t)
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n)


def symbol_share(t: Column) -> Column:
    """Share of characters that are no letter, digit, white space or usual punctuation; empty: 1."""
    n = F.length(t)
    return F.when(n == 0, 1.0).otherwise(F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{Nd}}\s{PUNCTUATION}]", "")) / n)


def is_page_label(t: Column) -> Column:
    return t.rlike(PAGE_LABEL)


def is_junk(t: Column, min_chars: int = 80, min_alpha: float = 0.45, max_symbols: float = 0.55) -> Column:
    return (F.length(t) < min_chars) | (alpha_ratio(t) < min_alpha) | (symbol_share(t) > max_symbols) | is_page_label(t)


def is_junk_strict(t: Column) -> Column:
    """The older test: under 40 characters, a page label, or 60 % of the words all digits."""
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    words = F.split(t, r"\s+")
    digits = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Nd}*$")))
    return (F.length(t) < 40) | is_page_label(t) | (digits >= F.size(words) * 0.6)


def language(t: Column) -> Column:
    """"en" where over 95 % of the characters are ASCII (or there are none), else "unk"."""
    n = F.length(t)
    ascii_ = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    return F.when((n == 0) | (ascii_ / n > 0.95), "en").otherwise("unk")


def title(raw: Column, uri: Column, most: int = 200) -> Column:
    """The first non-empty line, trimmed, `most` characters of it; without one the file's stem."""
    line = F.trim(F.regexp_extract(raw, r"(?m)^[ \t]*(\S[^\r\n]*)", 1))
    stem = F.regexp_replace(F.regexp_extract(uri, r"([^/]*)/*$", 1), r"\.[^.]*$", "")
    return F.substring(F.when(F.length(line) > 0, line).otherwise(stem), 1, most)


def words(t: Column) -> Column:
    """Likely words: lower case, letters only, two or more of them and a vowel among them."""
    found = F.split(F.trim(F.regexp_replace(F.lower(sanitize(t)), r"[^\p{L}]+", " ")), r"\s+")
    return F.filter(found, lambda w: (F.length(w) >= 2) & w.rlike("[aeiouy]"))


def chunk_count(n: Column, window: int, overlap: int) -> Column:
    """How many windows cover n characters."""
    return F.when(n <= 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / (window - overlap)) + 1).cast("long")


def snippet(t: Column, most: int = 600) -> Column:
    return F.substring(F.regexp_replace(t, r"\s+", " "), 1, most)


def clip(t: Column, most: int, mark: str) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(mark))).otherwise(t)


def is_references(t: Column) -> Column:
    """Reference lists and acknowledgements: by their words, or by brackets, years and commas."""
    s = F.trim(F.lower(t))
    head = s.startswith("references") | s.startswith("acknowledg") | s.contains("in proceedings") | s.contains("acm press") | s.contains("conference on")
    cited = (F.regexp_count(s, F.lit(r"\[[0-9]{1,3}\]")) >= 3) & (F.regexp_count(s, F.lit(r"(19|20)\d{2}")) >= 2) & (F.regexp_count(s, F.lit(",")) >= 6)
    return head | cited


def section_boost(t: Column) -> Column:
    s = F.lower(t)
    return (
        F.when(s.startswith("abstract"), 0.08).otherwise(0.0)
        + F.when(s.startswith("introduction") | s.startswith("1. introduction"), 0.05).otherwise(0.0)
        + F.when(s.startswith("conclusion"), 0.03).otherwise(0.0)
    )


def word_set(t: Column) -> Column:
    """Different lower-case words, split at ASCII non-word characters; a leading empty one counts."""
    s = F.split(F.lower(t), r"\W+")
    return F.array_distinct(F.when((F.size(s) > 1) & (F.element_at(s, -1) == ""), F.slice(s, 1, F.size(s) - 1)).otherwise(s))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
