"""Numbers in transcribed speech: digit words, whole numerals, numerals beside their unit, and entities that survive either way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Thai digits as they are spoken, 0 to 9; the months; units of each kind of number.
DIGIT_WORDS = ("ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า")
MONTHS = (
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน",
    "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม",
)
UNITS = {"amount": ("บาท",), "months": ("เดือน",), "speed": ("เมกะบิต", "mbps", "เมก")}
#: Characters that may stand between a numeral and its unit.
NEAR = 15


def runs_pattern(words: tuple[str, ...] = DIGIT_WORDS, least: int = 3) -> str:
    """`least` digit words or more, spaces between them; longer words are tried first."""
    return "(?:(?:" + "|".join(sorted(words, key=len, reverse=True)) + f") *){{{least},}}"


def spoken_runs(text: Column, words: tuple[str, ...] = DIGIT_WORDS, least: int = 3) -> Column:
    """Every run of digit words as its digits. text: composed and normalised."""
    found = F.regexp_extract_all(text, F.lit(runs_pattern(words, least)), 0)

    def digits(run: Column) -> Column:
        for word in sorted(words, key=len, reverse=True):
            run = F.replace(run, F.lit(word), F.lit(str(words.index(word))))
        return F.replace(run, F.lit(" "), F.lit(""))

    return F.transform(found, digits)


def without_thousands(text: Column) -> Column:
    """1,290 as 1290: commas between two digits go."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", "")


def numerals(text: Column) -> Column:
    """All whole runs of ASCII digits, thousands separators taken out, each once."""
    return F.array_distinct(F.regexp_extract_all(without_thousands(text), F.lit("[0-9]+"), 0))


def beside_unit(text: Column, digits: Column, units: tuple[str, ...]) -> Column:
    """Whether the numeral stands, whole, at most NEAR other characters before one of the units, whatever their case."""
    pattern = F.concat(F.lit(r"(?i)(?<!\d)"), digits, F.lit(rf"(?!\d)[^\d]{{0,{NEAR}}}?(?:{'|'.join(units)})"))
    return F.regexp_like(text, pattern)


def surface_hit(spoken: Column, text: Column) -> Column:
    """Whether the words as spoken are in the text, spaces apart."""
    return F.replace(text, F.lit(" "), F.lit("")).contains(F.replace(spoken, F.lit(" "), F.lit("")))


def value_hit(kind: Column, value: Column, text: Column, runs: Column) -> Column:
    """Whether an entity's value can be read from the text: a phone or id as a
    whole run; an amount, months or a speed beside its unit; a date by its day
    and its month's name; a package by its name. Other kinds never.

    text is normalised; runs: its numerals and spoken runs.
    """
    plain = without_thousands(text)
    digits = F.regexp_replace(value, r"\D", "")
    hit = F.when(kind.isin("phone", "id"), F.array_contains(runs, value))
    for name, units in UNITS.items():
        hit = hit.when(kind == name, (digits != "") & F.array_contains(runs, digits) & beside_unit(plain, digits, units))
    parts = F.split(value, "-", -1)
    day, month = F.get(parts, F.lit(2)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.when(month.between(1, 12), month - 1))
    hit = hit.when(kind == "date", (F.size(parts) == 3) & F.array_contains(runs, day.cast("string")) & text.contains(name))
    hit = hit.when(kind == "package", text.contains(value))
    return F.coalesce(hit.otherwise(False), F.lit(False))
