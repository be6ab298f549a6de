"""Text and SQL-text expressions. Everything here is a JVM-side Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in the corpus format
# (Unicode white space plus the four ASCII separators), as a regex class body
# and as plain characters for trimming.
SPACE_CLASS = (r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
# What has to become one blank: longer runs, and lone characters other than a
# blank. Lone blanks, by far the most frequent, are left alone by the regex, and
# ranges without any space, which most characters are of, are passed over first.
NO_SPACES = r"!-~\x{a1}-\x{167f}\x{3001}-\x{ffff}"
SPACES = f"(?![{NO_SPACES}])(?: [{SPACE_CLASS}]+|[{SPACE_CLASS}&&[^ ]][{SPACE_CLASS}]*)"

# Comment, literal and token patterns. ``(?d)`` makes LF the only
# line end for ``.`` and ``$``.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"(?dm)--.*?$"
LINE_COMMENT_EOL = r"(?d)--.*?(\r?\n|$)"
HASH_COMMENT_EOL = r"(?d)#.*?(\r?\n|$)"
STRING_LITERAL = "'[^']*'"
HEX_LITERAL = r"(?<![\p{L}\p{N}_])0x[a-f0-9]+(?![\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}_]{2,}"

MODES = ("sql", "semantic")


def check_mode(mode: str) -> str:
    """Lower-cased mode, or ValueError before any plan is built."""
    lowered = mode.lower()
    if lowered not in MODES:
        raise ValueError("mode must be 'sql' or 'semantic'")
    return lowered


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column) -> Column:
    return collapse_spaces(F.lower(F.coalesce(text, F.lit(""))))


def clean_sql(sql: Column) -> Column:
    """Drop block comments, then line comments, then outer white space."""
    without_blocks = F.regexp_replace(sql, BLOCK_COMMENT, "")
    return strip(F.regexp_replace(without_blocks, LINE_COMMENT, ""))


def normalize_sql(sql: Column) -> Column:
    """Comment-free, lower-case SQL on one line; null gives ''."""
    text = clean_sql(F.coalesce(sql, F.lit("")))
    for pattern in (LINE_COMMENT_EOL, HASH_COMMENT_EOL, BLOCK_COMMENT):
        text = F.regexp_replace(text, pattern, " ")
    return collapse_spaces(F.lower(text))


def mask_literals(text: Column) -> Column:
    """Lower-case, single-spaced text with string and hex literals blanked out."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " ")
    masked = F.regexp_replace(spaced, STRING_LITERAL, "'<val>'")
    return F.trim(F.regexp_replace(masked, HEX_LITERAL, "<address>"))


def text_hash(text: Column) -> Column:
    """SHA-1 hex digest of the UTF-8 bytes."""
    return F.sha1(text)


def normalize_tags(tags: Column) -> Column:
    """Lower-cased, stripped tags; null elements go, a null array becomes empty."""
    present = F.filter(tags, lambda t: t.isNotNull())
    return F.coalesce(F.transform(present, lambda t: strip(F.lower(t))),
                      F.array().cast("array<string>"))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def _part(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _tag_part() -> Column:
    # an empty list adds nothing; array_join keeps the blanks of empty tags
    return F.when(F.size("tags") > 0, F.array_join("tags", " "))


def text_semantic() -> Column:
    """name, description, owner and tags joined by one blank; empty parts skipped."""
    return F.concat_ws(" ", _part("name"), _part("description"), _part("owner"), _tag_part())


def text_sql() -> Column:
    return clean_sql(F.coalesce(F.col("query_sql"), F.lit("")))


def embedding_text(mode: str) -> Column:
    """Text that is embedded for clustering."""
    return text_sql() if check_mode(mode) == "sql" else text_semantic()


def described_text() -> Column:
    """name, description and tags, without the owner."""
    return F.concat_ws(" ", _part("name"), _part("description"), _tag_part())


def dedup_text(mode: str) -> Column:
    """Normalised text whose hash decides what a duplicate is."""
    if check_mode(mode) == "sql":
        return normalize_sql(F.col("query_sql"))
    return normalize_text(described_text())


def keyword_text(mode: str) -> Column:
    """Text the cluster keywords come from; SQL is taken raw, comments included."""
    if check_mode(mode) == "sql":
        return F.coalesce(F.col("query_sql"), F.lit(""))
    return described_text()


def structure_text() -> Column:
    """Normalised SQL with its literals masked."""
    return mask_literals(normalize_sql(F.col("query_sql")))
