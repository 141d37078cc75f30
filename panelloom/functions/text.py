"""Text cleaning as Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: every character Python's ``\s`` matches, spelled so that Java and RE2 agree on it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"

#: Fixed value: a parenthesis that only annotates a code.
CODE_PAREN = r"(?i)\([^)]*(?:c[oóOÓ]digos?|CNO|CNAE)[^)]*\)"

#: Spellings broken by text extraction and their repair.
LITERAL_REPAIRS = {"ma rco": "marco", "provi ncial": "provincial"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_space(c: Column | str) -> Column:
    """Collapse every run of white space (no-break space included) to one space and trim."""
    return F.trim(F.regexp_replace(_col(c).cast("string"), SPACE + "+", " "))


def _single_spaces(c: Column) -> Column:
    """``normalize_space`` for text whose only white space is the plain space already."""
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " +", " ")).otherwise(c))


def clean_title(c: Column | str) -> Column:
    """Drop code annotations in parentheses and tidy the full stops of a title."""
    text = F.regexp_replace(normalize_space(c), CODE_PAREN, "")
    text = F.regexp_replace(text, r" +\.", ".")
    text = F.regexp_replace(text, r"\. *", ". ")
    text = F.regexp_replace(text, r"[. ]+$", "")
    return _single_spaces(text)


def repair_text(c: Column | str) -> Column:
    """Undo the spacing damage of extracted text: split words, hyphenation, space before punctuation."""
    text = normalize_space(c)
    for broken, fixed in LITERAL_REPAIRS.items():
        text = F.replace(text, F.lit(broken), F.lit(fixed))
    joined = F.regexp_replace(text, r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2")
    text = F.when(F.contains(text, F.lit("- ")), joined).otherwise(text)
    return _single_spaces(F.regexp_replace(text, " +([,.;:])", "$1"))


def limit_text(c: Column | str, limit: int) -> Column:
    """Texts longer than ``limit`` are cut there, back to the last space, and closed with a full stop."""
    text = normalize_space(c)
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?s) [^ ]*$", "")
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.regexp_replace(cut, r"[ ,;]+$", ""), F.lit("."))
    )


def described_title(title: Column | str, description: Column | str) -> Column:
    """Text to embed: title and description when there is one, else the bare title."""
    clean = clean_title(title)
    body = normalize_space(description)
    return F.when(
        F.coalesce(body, F.lit("")) != "",
        F.concat(F.lit("O*NET occupation: "), clean, F.lit(". Description: "), body),
    ).otherwise(clean)


def cache_key(*parts: Column | str) -> Column:
    """sha256 over the NUL-joined parts."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("\u0000", *columns), 256)


def strip_quotes(c: Column | str) -> Column:
    return F.regexp_replace(normalize_space(c), "^[\"']+|[\"']+$", "")
