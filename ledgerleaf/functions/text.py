"""String rules of the shop's pages, as Spark column expressions.

All are built-in expressions (no Python UDF), so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters PHP's trim() removes by default.
PHP_TRIM_CHARS = " \t\n\r\0\x0b"
# The currency sign and the unit suffix the pages print.
CURRENCY_SIGN = "₱"
UNIT_SUFFIX = "-based"


def is_empty(value) -> bool:
    """PHP ``empty()`` for a request parameter: None, "" and "0" mean no filter."""
    return value is None or value == "" or value == "0"


def php_trim(value: str | None) -> str | None:
    return None if value is None else value.strip(PHP_TRIM_CHARS)


def trim_col(c: Column | str) -> Column:
    """PHP ``trim`` on a column (Spark's plain ``trim`` strips only spaces)."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(PHP_TRIM_CHARS))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters and their base letters, by the rule of canonical decomposition: every composed letter of the Latin and
    Greek blocks stands for its first code point; combining marks (last, without a partner) are dropped."""
    composed = [(chr(c), unicodedata.normalize("NFD", chr(c))) for block in ((0xC0, 0x250), (0x370, 0x400), (0x1E00, 0x2000))
                for c in range(*block)]
    pairs = [(ch, parts[0]) for ch, parts in composed
             if len(parts) > 1 and ch.isalpha() and all(unicodedata.combining(m) for m in parts[1:])]
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(ch for ch, _ in pairs) + marks, "".join(base for _, base in pairs)


def fold_text(value: str) -> str:
    """``folded`` for a search word."""
    letters, bases = _accent_table()
    return value.translate({ord(ch): bases[i] if i < len(bases) else None for i, ch in enumerate(letters)})


def folded(c: Column | str) -> Column:
    """The text without accents, letter by letter, so that the wildcards of LIKE still count letters."""
    letters, bases = _accent_table()
    return F.translate(F.col(c) if isinstance(c, str) else c, letters, bases)


def like_contains(c: Column | str, needle: str, fold_accents: bool = True) -> Column:
    """``name LIKE '%needle%'`` under the tables' collation, which ignores case and accents.

    ``%`` and ``_`` typed by the user stay wildcards, as in the pages. Spark's ``LIKE`` takes no accent-insensitive
    collation, so both sides lose their accents first. ``fold_accents=False`` ignores case only.
    """
    col = F.col(c) if isinstance(c, str) else c
    if fold_accents:
        col, needle = folded(col), fold_text(needle)
    # A backslash escapes a wildcard or itself; before any other character, or at the end, it stands for itself.
    needle = re.sub(r"\\(?:([%_\\])|)", lambda m: m[0] if m[1] else "\\\\", needle)
    return col.ilike(f"%{needle}%")


def ci_equals(c: Column | str, value: str, fold_accents: bool = True) -> Column:
    """Equality under the tables' collation (without ``fold_accents`` only case is ignored)."""
    col = F.col(c) if isinstance(c, str) else c
    if fold_accents:
        return F.collate(col, "UNICODE_CI_AI") == F.lit(value)
    return F.lower(col) == F.lit(value.lower())


# A leading number as PHP reads it: sign, digits with or without a point, exponent.
_NUMBER = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WIDE = "decimal(38,9)"


def _leading_number(c: Column | str) -> Column:
    """0 where the text does not begin with a number; NULL where the number is wider than 29 digits."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.regexp_extract(F.coalesce(col.cast("string"), F.lit("")), _NUMBER, 1)
    return F.when(text == "", F.lit(0).cast(_WIDE)).otherwise(text.try_cast(_WIDE))


def php_intval(c: Column | str) -> Column:
    """PHP ``intval`` on text: the leading number without its fraction, else 0. NULL where no long holds it.

    Text of digits alone, the usual case, is cast without the number's pattern.
    """
    col = F.col(c) if isinstance(c, str) else c
    n = _leading_number(col)
    plain = F.coalesce(col.rlike(r"^[0-9]{1,18}$"), F.lit(False))
    return F.when(plain, col.try_cast("long")).otherwise(n.try_cast("long"))  # a cast drops the fraction


def php_floatval_money(c: Column | str) -> Column:
    """PHP ``floatval`` on a price, rounded once to decimal(10,2). NULL where that column cannot hold it."""
    return F.round(_leading_number(c), 2).try_cast("decimal(10,2)")


def money_text(c: Column | str, decimals: int = 2) -> Column:
    """Currency text with thousands separators, rounded half away from zero.

    ``format_number`` alone rounds half-to-even; rounding first with ``round``
    (HALF_UP) gives the pages' ``number_format`` result.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(F.round(col, decimals), decimals))


def unit_label(c: Column | str) -> Column:
    """``ucfirst(unit ?? 'Other') . '-based'``; the rest of the word keeps its case."""
    col = F.col(c) if isinstance(c, str) else c
    u = F.coalesce(col, F.lit("Other"))
    return F.concat(F.upper(F.substring(u, 1, 1)), F.substring(u, 2, 1 << 30), F.lit(UNIT_SUFFIX))


def status_badge(c: Column | str) -> Column:
    """Badge class of a sale's status (case-insensitive)."""
    s = F.lower(F.col(c) if isinstance(c, str) else c)
    return (F.when(s == "completed", "completed")
            .when(s == "void", "void")
            .when(s.isin("cancelled", "canceled"), "cancelled")
            .otherwise("pending"))
