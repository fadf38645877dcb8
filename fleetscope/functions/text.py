"""Text expressions: line splitting, entropy, previews, token estimates."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The separators of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# The characters Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters per token of the length heuristic, preview sizes.
CHARS_PER_TOKEN = 4
PREVIEW_LINES = 10
FULL_TEXT_BELOW_LINES = 200

#: Characters whose entropies are computed at once.
ENTROPY_CHARACTERS = 1 << 20

# The Arrow function below travels to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once. Keeps expressions that use an intermediate result
    many times small enough to be compiled."""
    return F.get(F.transform(F.array(value), body), 0)


def unpack(values: Column, body: Callable[[Column], Column]) -> Column:
    """Generator of one row per element of an array, its columns being the struct that ``body`` returns.

    Filters on those columns stay above the generator, so a costly parse is not repeated in them.
    """
    return F.inline(F.transform(values, body))


def lines(text: Column) -> Column:
    """``array<string>`` of the text's lines; a final line break opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(
        parts
    )


def strip(text: Column) -> Column:
    """Both ends free of any white space (``trim`` alone removes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, 0 for the empty string.

    The characters are sorted, so one pass cuts them into runs and a run's length is its character's
    count. Meant for values of a line; :func:`text_entropy` is the faster form for whole texts.
    """
    size = F.length(text)
    ordered = F.array_join(F.sort_array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    shares = F.transform(runs, lambda run: F.length(run) / size)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.lit(0.0) - total)


@F.pandas_udf(DoubleType())
def text_entropy(texts: pd.Series) -> pd.Series:
    """:func:`entropy` of whole texts, all characters of some texts in one array: sorted by text and code point,
    the runs are the counts.

    Built-in expressions have no histogram of characters; they would need a sort of every text or a
    shuffled row per character, at more than ten times the cost per character.
    """
    out = np.full(len(texts), np.nan)
    known = np.flatnonzero(texts.notna().to_numpy())
    sizes = texts.iloc[known].str.len().to_numpy(dtype=np.int64)
    at = 0
    while at < len(known):
        # Texts of about a million characters together, or one that is longer.
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), ENTROPY_CHARACTERS, "right")) + at)
        joined = "".join(texts.iloc[known[at:to]]).encode("utf-32-le", "surrogatepass")
        owner = np.repeat(np.arange(to - at), sizes[at:to])
        keys, counts = np.unique(owner * 0x110000 + np.frombuffer(joined, dtype="<u4"), return_counts=True)
        owner = keys // 0x110000
        shares = counts / sizes[at:to][owner]
        sums = np.bincount(owner, shares * np.log2(shares), to - at)
        out[known[at:to]] = 0.0 - sums
        at = to
    return pd.Series(out).astype(object).where(texts.notna().to_numpy(), None)


def token_estimate(text: Column) -> Column:
    """``max(1, length // 4)``, 0 for empty text."""
    return tokens_of_length(F.length(text))


def tokens_of_length(length: Column) -> Column:
    return F.when(length == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.floor(length / CHARS_PER_TOKEN))
    )


def savings_percent(raw: Column, brief: Column) -> Column:
    """Share of tokens saved, half-even to two places; 0 without raw tokens."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(F.bround((1 - brief / raw) * 100, 2))


def compact_count(n: Column) -> Column:
    """``950``, ``45.2k``, ``1M``."""

    def scaled(unit: int, suffix: str) -> Column:
        text = F.format_string("%.1f", F.bround(n / unit, 1))
        return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit(suffix))

    return (
        F.when(n >= 1_000_000, scaled(1_000_000, "M"))
        .when(n >= 1_000, scaled(1_000, "k"))
        .otherwise(n.cast("string"))
    )


def preview(text: Column, always: Column | bool = False) -> Column:
    """The first lines of long texts (or of any text when ``always``), else the text as it is."""
    rows = lines(text)
    cut = F.array_join(F.slice(rows, 1, PREVIEW_LINES), "\n")
    always = F.lit(always) if isinstance(always, bool) else always
    return F.when(always | (F.size(rows) >= FULL_TEXT_BELOW_LINES), cut).otherwise(text)


def truncate(text: Column, max_length: int, notice: str) -> Column:
    """Cut to ``max_length`` characters including a closing notice."""
    room = max_length - len(notice)
    if room <= 0:
        return F.when(F.length(text) <= max_length, text).otherwise(F.lit(notice.strip()))
    head = F.regexp_replace(F.substring(text, 1, room), r"(?U)\s+$", "")
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(head, F.lit(notice)))
