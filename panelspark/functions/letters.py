"""Letters of any script, one code point for one."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _small_and_capital() -> tuple[str, str]:
    """All small letters and, in the same order, the one capital of each; letters that are only spelled out have none."""
    small, capital = [], []
    for c in map(chr, (i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)):
        up = next((x for x in (c.upper(), c.title()) if len(x) == 1), c) if c != "ß" else "ẞ"
        if up != c:
            small.append(c)
            capital.append(up)
    return "".join(small), "".join(capital)


def capitals(text: Column) -> Column:
    """Upper case, one letter for one as in the oracle, where `upper` spells some letters out: it makes SS of the sharp s, which has
    a capital of its own, FI of a ligature. Only texts that hold others of these than the sharp s are translated letter by letter."""
    upper = F.upper(F.replace(text, F.lit("ß"), F.lit("ẞ")))
    return F.when(F.length(upper) == F.length(text), upper).otherwise(F.translate(text, *_small_and_capital()))
