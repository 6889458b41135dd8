"""What kind of answer a model's raw response is."""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a refusal says in its first REFUSAL_WINDOW characters.
REFUSALS = (
    "i'm sorry",
    "i am sorry",
    "i cannot",
    "i can't",
    "i won't",
    "i'm unable",
    "i am unable",
    "unable to assist",
    "unable to provide",
    "cannot assist",
    "cannot comply",
    "as an ai",
    "as a language model",
    "ขออภัย",
    "ขอโทษ",
    "ไม่สามารถ",
)
REFUSAL_WINDOW = 200
_BRACE_OR_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)


def without_mark(text: str) -> str:
    return text.removeprefix("\ufeff")


def unfenced(text: str) -> str:
    """The body of a code fence that the text starts with, closed or not."""
    head, line, body = text.strip().partition("\n")
    if not head.startswith("```") or not line:
        return text
    return (body.rpartition("```")[0] if "```" in body else body).strip()


def first_object(text: str) -> str:
    """From the first brace to the one that closes it; a cut-off object is no object, nor is one inside it."""
    start, depth = text.find("{"), 0
    for token in _BRACE_OR_STRING.finditer(text, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth:
            return text[start : token.end()]
    return text


REPAIRS = (("bom", without_mark), ("fence", unfenced), ("prose", first_object))


def read_object(text: str) -> tuple[object, list[str]] | None:
    """The JSON value of a response and the repairs it took, each on top of those before."""
    taken: list[str] = []
    for name, repair in (("", str), *REPAIRS):
        mended = repair(text)
        if name and mended.strip() == text.strip() and name != "bom" or name == "bom" and mended == text:
            continue
        text = mended
        taken += [name] if name else []
        try:
            return json.loads(text), taken
        except ValueError:
            pass
    return None


def refuses(text: str) -> bool:
    """Of a text without a JSON value: whether it opens as a refusal. What opens as an object declines nothing."""
    head = text.strip()[:REFUSAL_WINDOW].lower()
    return not head.startswith("{") and any(r in head for r in REFUSALS)


_KIND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("repairs", T.ArrayType(T.StringType()))])


@F.pandas_udf(_KIND)
def parsed(text: pd.Series) -> pd.DataFrame:
    """object, other (valid JSON of another shape), refusal or none; an object's keys; the repairs."""

    def one(t: str | None) -> tuple:
        found = None if t is None else read_object(t)
        if found is not None:
            value, repairs = found
            return ("object", sorted(value), repairs) if isinstance(value, dict) else ("other", [], repairs)
        return ("refusal" if refuses(t or "") else "none", [], [])

    return pd.DataFrame([one(t) for t in text], columns=["kind", "keys", "repairs"])


def outcome(text: Column, finish_reason: Column, transport_error: Column, required: tuple[str, ...]) -> Column:
    """One of the eight outcomes, the first that applies."""
    p = parsed(F.coalesce(text, F.lit("")))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), p["keys"])) > 0
    blank = text.isNull() | (F.trim(text) == "")
    return (
        F.when(transport_error.isNotNull(), "transport_error")
        .when(finish_reason == "error", "provider_error")
        .when(blank & (finish_reason == "length"), "empty_length")
        .when(blank, "empty_other")
        .when(p["kind"] == "refusal", "refusal")
        .when(p["kind"] == "none", "not_json")
        .when((p["kind"] == "other") | missing, "schema_violation")
        .otherwise("ok")
    )


def decision(qualified: bool, defects: int, incumbent_ok: float, candidate_ok: float, verdicts: dict[str, str], nets: dict[str, int], margin: int, floor: float = 0.99) -> str:
    """PASS, FAIL, INCONCLUSIVE or UNAVAILABLE from a comparison's few aggregates; what is not known fails closed."""
    if not qualified:
        return "UNAVAILABLE"
    if defects or incumbent_ok < floor:
        return "INCONCLUSIVE"
    if candidate_ok < floor or "BEHIND" in verdicts.values():
        return "FAIL"
    weak = [d for d, v in verdicts.items() if v == "UNDERPOWERED" or (v == "INDISTINGUISHABLE" and nets[d] < -margin)]
    return "INCONCLUSIVE" if weak or not verdicts else "PASS"
