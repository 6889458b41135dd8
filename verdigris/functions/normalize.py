"""Column functions that bring labels, keys, money and dates to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode's included (Spark's trim takes spaces only).
_ENDS = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def norm_text(x: Column) -> Column:
    """Stripped and lower case; blank becomes null."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def norm_phone(x: Column) -> Column:
    """norm_text, and the tokens that stand for no number become null."""
    t = norm_text(x)
    return F.when(~t.isin("0", "none", "nan"), t)


def norm_reasons(*slots: Column, keep_empty: bool = False) -> Column:
    """Comma-separated labels of several slots as one sorted distinct array, never null.

    keep_empty keeps the empty string between two commas, as one of the metric
    variants does; blank slots never add one.
    """
    filled = F.array_compact(F.array(*[F.when(strip(s) != "", s) for s in slots]))
    parts = F.transform(F.split(F.array_join(filled, ","), ","), lambda p: F.lower(strip(p)))
    parts = F.when(F.size(filled) == 0, F.array().cast("array<string>")).otherwise(parts)
    if not keep_empty:
        parts = F.filter(parts, lambda p: p != "")
    return F.array_sort(F.array_distinct(parts))


def _span(first: int, last: int | None = None) -> str:
    return "".join(map(chr, range(first, (last or first) + 1)))


#: Letters whose capital is another one letter by itself than Spark's upper gives: it writes two or three for some,
#: and knows letters of a later Unicode. The first have a capital of their own, the others stay as they are.
_OWN = dict(zip(_span(0x1F80, 0x1F87) + _span(0x1F90, 0x1F97) + _span(0x1FA0, 0x1FA7) + "ß\u1fb3\u1fc3\u1ff3", _span(0x1F88, 0x1F8F) + _span(0x1F98, 0x1F9F) + _span(0x1FA8, 0x1FAF) + "ẞ\u1fbc\u1fcc\u1ffc", strict=True))
_STAY = (
    "\u0149\u019b\u01f0\u0264\u0390\u03b0\u0587\u1c8a" + _span(0x1E96, 0x1E9A) + "\u1f50\u1f52\u1f54\u1f56" + "".join(_OWN.values()).replace("ẞ", "")
    + "\u1fb2\u1fb4\u1fb6\u1fb7\u1fc2\u1fc4\u1fc6\u1fc7\u1fd2\u1fd3\u1fd6\u1fd7" + _span(0x1FE2, 0x1FE4) + "\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\ua7cd\ua7db"
    + _span(0xFB00, 0xFB06) + _span(0xFB13, 0xFB17) + _span(0x10D70, 0x10D85)
)


def capitals_sql(x: str) -> str:
    """SQL (Spark's) of a text in capitals letter by letter, so that it keeps its length: ß becomes ẞ, not SS. DuckDB's upper is that."""
    odd, to = "".join(_OWN) + _STAY, "".join(_OWN.values()) + _STAY
    return f"array_join(transform(regexp_extract_all({x}, '[{odd}]|[^{odd}]+', 0), p -> if(contains('{odd}', p), translate(p, '{odd}', '{to}'), upper(p))), '')"


def nfc(x: Column) -> Column:
    """Unicode canonical composition, by the ICU classes Spark ships; null stays null."""
    return F.when(x.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(False)))


def text_key(x: Column) -> Column:
    """Composed, lower case, without white space or zero-width characters."""
    return F.lower(F.regexp_replace(nfc(x), r"(?U)[\s\x{200B}-\x{200D}\x{FEFF}]+", ""))


def tax_id(x: Column, cut: bool = True) -> Column:
    """Digits, filled with zeros on the left to 13; more than 13 are cut, or kept."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    width = F.lit(13) if cut else F.greatest(F.lit(13), F.length(digits))
    return F.nullif(F.lpad(digits, width, F.lit("0")), F.lit("0" * 13))


def money(x: Column) -> Column:
    """'1,234.50-' -> -1234.50 as decimal(18,2); what is no number becomes null."""
    plain = F.replace(strip(x), F.lit(","), F.lit(""))
    turned = F.when(plain.endswith("-"), F.concat(F.lit("-"), F.rtrim(F.left(plain, F.length(plain) - 1)))).otherwise(plain)
    return turned.try_cast("decimal(18,2)")


def any_date(x: Column, *formats: str) -> Column:
    """The first of the formats that reads the text as a date, else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in formats])


def blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def typed_value(x: Column, kind: Column) -> Column:
    """Canonical text of a value by kind: text, taxid, amount, date or bool; null where it cannot be read."""
    word = norm_text(x)
    return (
        F.when(kind == "taxid", tax_id(x, cut=False))
        .when(kind == "amount", money(x).cast("string"))
        .when(kind == "date", F.date_format(any_date(strip(x), "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "yyyyMMdd"), "yyyy-MM-dd"))
        .when(kind == "bool", F.when(word.isin("true", "yes", "y", "1"), "true").when(word.isin("false", "no", "n", "0"), "false"))
        .otherwise(word)
    )
