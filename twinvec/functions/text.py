"""String column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the six ASCII blanks that separate tokens (space, tab, newline,
# vertical tab, form feed, carriage return). Other spaces (e.g. U+00A0) are part of words.
BLANKS_REGEX = "[ \\t\\n\\x0B\\f\\r]+"
# The same pattern written for a SQL string literal (backslashes are not escapes there).
BLANKS_REGEX_SQL = "[ \\t\\n\\x0B\\f\\r]+"


def split_tokens(text: Column | str) -> Column:
    """Whitespace tokenizer: ASCII blanks only, case kept, empty tokens dropped."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(col, F.lit("")), BLANKS_REGEX), lambda t: t != "")


def parse_word_list(text: Column | str) -> Column:
    """Query word list: lower-case; when a comma is present drop spaces and split on commas."""
    col = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.when(F.instr(col, ",") > 0, F.split(F.regexp_replace(col, " ", ""), ",")).otherwise(F.array(col))
