"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^ \t\n\r]+"
SENTENCE = r"[^.!?]*[.!?]|[^.!?]+$"


def trim(text: Column) -> Column:
    r"""Without white space at both ends; ``\z``, since ``$`` also fits before a last U+0085, U+2028 or U+2029, and so inside the text."""
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+\z", "")


def token_count(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def sentences(text: Column, least_words: int = 4) -> Column:
    """Sentences, each up to a full stop, exclamation or question mark (or the end), trimmed, of ``least_words`` or more."""
    cut = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), trim)
    return F.filter(cut, lambda s: token_count(s) >= least_words)


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile by nearest rank of an array: the element at round(p / 100 * (n - 1)) in order."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.lit(p / 100.0) * (F.size(ordered) - 1) + 0.5) + 1).cast("int"))
