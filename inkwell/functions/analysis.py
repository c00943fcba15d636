"""Analyzers: expressions from a text to the set of its terms. All stay in the JVM."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of more bytes than this have no suffixes; a suffix has at least so many bytes.
LONGEST_EXPANDED = 64
LEAST_SUFFIX = 5


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; other letters stay as they are. A text of ASCII alone goes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def whitespace(text: Column) -> Column:
    """What stands between blanks, tabs and carriage returns (line feeds don't part); case is kept."""
    return F.array_distinct(F.filter(F.split(text, "[ \t\r]+"), lambda x: x != ""))


WORD, HAN = r"[a-z0-9]+(?:\.[a-z0-9]+)*", "\u3400-\u4dbf\u4e00-\u9fff"


def word(text: Column) -> Column:
    """Runs of ASCII letters and digits, joined over single dots, in lower case; of a run of Han characters each two
    neighbours (a single one is itself), as no dictionary is at hand."""
    low = ascii_lower(text)
    plain = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"{WORD}|[{HAN}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^[{HAN}]") & (F.char_length(t) > 1), F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array(t))))
    return F.array_distinct(F.when((F.octet_length(text) != F.char_length(text)) & text.rlike(f"[{HAN}]"), pairs).otherwise(plain))


def whole(text: Column) -> Column:
    """The value as its one term; an empty value has none."""
    return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def suffixes(term: Column, least: int = LEAST_SUFFIX) -> Column:
    """The term and its suffixes at character bounds of at least `least` bytes (or the term's, if fewer)."""
    tails = F.transform(F.sequence(F.lit(1), F.char_length(term)), lambda i: F.substr(term, i))
    tails = F.filter(tails, lambda s: F.octet_length(s) >= F.least(F.lit(least), F.octet_length(term)))
    return F.when(term == "", F.array().cast("array<string>")).when(F.octet_length(term) <= LONGEST_EXPANDED, tails).otherwise(F.array(term))


def split_string(text: Column, by: str) -> Column:
    """Parts between the characters of `by`, without empty ones."""
    return F.filter(F.split(text, "[" + "".join(c if c.isalnum() else "\\" + c for c in by) + "]"), lambda x: x != "")


def trim_string(text: Column, of: str = " ") -> Column:
    return F.btrim(text, F.lit(of))


ANALYZERS = {"whitespace": whitespace, "word": word, "whole": whole}


def query_terms(text: str, analyzer: str = "word") -> list[str]:
    """The terms that an analyzer's expression makes of a text, for the few texts of a query."""
    if analyzer == "whole":
        found = [text] if text else []
    elif analyzer == "whitespace":
        found = [x for x in re.split("[ \t\r]+", text) if x]
    else:
        low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        runs = re.findall(f"{WORD}|[{HAN}]+", low)
        found = [t for r in runs for t in ([r] if r[0] < "\u3400" or len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]
    return list(dict.fromkeys(found))
