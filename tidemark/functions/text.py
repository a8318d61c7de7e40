"""Text parsing and formatting columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def money(text: Column, suffixes: Sequence[str] = ("K", "M", "B", "T")) -> Column:
    """``$1.2M`` to a number. The first suffix (in the given order) found anywhere decides the factor.

    Every occurrence of that suffix is removed before the rest is read as a number; unreadable text is 0.
    """
    plain = F.regexp_replace(text, r"[$,]", "")
    out = None
    for i, s in enumerate(suffixes):
        value = F.try_multiply(F.trim(F.regexp_replace(plain, s, "")).try_cast("double"), F.lit(1000.0 ** (i + 1)))
        cond = plain.contains(s)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.coalesce(out.otherwise(F.trim(plain).try_cast("double")), F.lit(0.0))


def volume(text: Column) -> Column:
    """Like ``money`` without the trillion suffix."""
    return money(text, ("K", "M", "B"))


def percent_in(text: Column) -> Column:
    """First whole number followed by a percent sign, as a share; one half when there is none."""
    found = F.nullif(F.regexp_extract(text, r"([0-9]+)%", 1), F.lit("")).try_cast("double")
    return F.coalesce(found / 100.0, F.lit(0.5))


def confidence_in(text: Column) -> Column:
    """``high confidence`` and so on; the first level found wins, one half when none is."""
    low = F.lower(text)
    out = None
    for word, value in fixed.CONFIDENCE_WORDS:
        cond = low.contains(f"{word} confidence")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(0.5)


def contract_in(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/token/([A-Za-z0-9]+)", 1), F.lit(""))


def contains_any(text: Column, words: Sequence[str], whole_words: bool = False) -> Column:
    """Any of the words in the text. By default a word also counts inside a longer one."""
    if whole_words:
        return text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def filled(template: str, x: Column) -> Column:
    """A number put into a printf template; a fixed number of decimals rounds ties to even."""
    digits = re.search(r"%[+]?\.(\d)f", template)
    if not digits:
        return F.format_string(template, x)
    r = F.bround(x.cast("double"), int(digits[1]))
    return F.format_string(template, F.when((x < 0) & (r == 0), F.lit(-0.0)).otherwise(r))


def whole(x: Column) -> Column:
    return filled("%.0f", x)


def thousands(x: Column) -> Column:
    return F.format_number(F.bround(x.cast("double"), 0), 0)


def usd(x: Column) -> Column:
    return F.concat(F.lit("$"), thousands(x))


def usd_k(x: Column) -> Column:
    return F.concat(F.lit("$"), whole(x / 1000), F.lit("K"))


def signed_pct(x: Column) -> Column:
    return filled("%+.1f%%", x)


def short_address(a: Column, n: int = 12) -> Column:
    return F.concat(F.substring(a, 1, n), F.lit("..."))


def explorer(chain: Column, address: Column) -> Column:
    """Block-explorer link of the chains that have one."""
    return (F.when(chain == "base", F.concat(F.lit("https://basescan.org/token/"), address))
            .when(chain == "solana", F.concat(F.lit("https://solscan.io/token/"), address)).otherwise(""))


def bubble_map(chain: Column, address: Column) -> Column:
    return F.concat(F.lit("https://app.bubblemaps.io/"), chain, F.lit("/token/"), address)
