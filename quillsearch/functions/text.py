"""Tokenizers and key normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that separate words, as a class of a regular expression
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: The same class as SQL engines with RE2 write it.
SPACE_RE2 = SPACE.replace(r"\x85\xa0", r"\x{85}\x{a0}")
for _code in ("1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    SPACE_RE2 = SPACE_RE2.replace(rf"\u{_code}", rf"\x{{{_code}}}")


def clean_key(key: Column) -> Column:
    """Upper case, without surrounding white space of any kind."""
    return F.upper(F.regexp_replace(key, rf"^{SPACE}+|{SPACE}+$", ""))


def words_by_space(text: Column) -> Column:
    """Tokens between runs of white space of any script or control: case and punctuation kept, no empty tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def words_by_pattern(text: Column) -> Column:
    """Runs of letters, numbers (also ² and ½) and ``_`` of any script, one-character tokens included, case kept; marks separate."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
