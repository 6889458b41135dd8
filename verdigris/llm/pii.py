"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) follow their contract's patterns exactly,
leftmost and without overlap within a kind; a match that fails its check is
dropped and not retried. Further kinds are proposed by patterns of their own,
confirmed by their checksum (mod 97, ABA) or, where there is none, by a range
rule (SSN) or the spread of their characters (keys, tokens, passwords), and
reported from `MIN_SCORE` on. Every span, of base kinds too, has a score: its
kind's prior, moved by the words around it. An IBAN has no end of its own in a
text: every end its pattern allows is tried, see ibans().

One pass over the texts in Arrow batches, nothing is shuffled. Regular
expressions run per text; a text that lacks the characters a kind needs is not
searched for it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "aba", "key", "token", "password")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can only start where digits do
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_ABA = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
_WORD = re.compile(r"[A-Za-z0-9]")
_ASSIGNED = r"""["']?\s{0,3}[=:]\s{0,3}["']?"""
#: Secrets: the text that has to stand in the lower-cased text for one to be there, and the pattern, whose last group is the secret.
_SECRETS = (
    ("key", ("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("key", ("private key",), re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)")),
    ("token", ("gh", "xox", "sk-", "eyj"), re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)")),
    ("token", ("token", "secret", "key"), re.compile(r"(?i)(?<![A-Za-z])(?:token|secret|api[_ -]?key|access[_ -]?key|secret[_ -]?key)" + _ASSIGNED + r"([A-Za-z0-9+/_=-]{16,})")),
    ("password", ("passw", "pwd"), re.compile(r"(?i)(?<![A-Za-z])(?:password|passwd|pwd)" + _ASSIGNED + r"""([^\s"',;]{6,})""")),
)
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Characters of an IBAN without spaces, by country, of the registry.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

#: Words that speak for or against a kind when they stand near it.
CONTEXT = {
    "email": (("mail", "email", "contact", "write", "reach"), ("example", "sample", "test")),
    "ip": (("ip", "host", "server", "address", "login"), ("version", "release", "section", "v")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "expires"), ("order", "invoice", "serial", "test", "isbn")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "whatsapp"), ("version", "order", "serial")),
    "key": (("aws", "access", "key", "id", "secret"), ("example", "sample", "dummy", "test")),
    "token": (("token", "secret", "key", "auth", "bearer"), ("example", "sample", "dummy", "test", "checksum", "commit")),
    "password": (("user", "login", "password", "account"), ("example", "sample", "dummy")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "swift", "bic"), ("sample", "example", "test")),
    "ssn": (("ssn", "social", "security", "taxpayer"), ("part", "serial", "order", "invoice", "isbn")),
    "aba": (("aba", "routing", "transit", "bank"), ("order", "invoice", "serial", "id")),
}
#: Score before context: how far the pattern and its check alone are trusted.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "aba": 0.2, "key": 0.9, "token": 0.7, "password": 0.7}
#: Bits a character that a token or password has at least.
LEAST_SPREAD = 2.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    return digits != "000000000" and sum(w * int(c) for w, c in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0


def spread(secret: str) -> float:
    """Shannon entropy of a string's characters, in bits."""
    n = len(secret)
    return -sum(c / n * math.log2(c / n) for c in Counter(secret).values())


def secrets(text: str) -> list[tuple[str, int, int]]:
    """Keys, tokens and passwords by kind, then start, each place once; a word of the language is no token."""
    low, found = text.lower(), {}
    for kind, needed, pattern in _SECRETS:
        if any(x in low for x in needed):
            for m in pattern.finditer(text):
                value = m.group(1)
                mixed = kind != "token" or (any(c.isdigit() for c in value) and any(c.isalpha() for c in value))
                if kind == "key" or (mixed and spread(value) >= LEAST_SPREAD):
                    found.setdefault((KINDS.index(kind), m.start(1)), (kind, *m.span(1)))
    return [found[k] for k in sorted(found)]


def emails(text: str) -> list[tuple[int, int]]:
    """Matches around each @: the leftmost start is where the run of local-part
    characters before it begins (or the last match ended)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Where IBANs stand: at a start, the end that the country's length gives, or for
    a country that is not listed the last at which mod 97 holds, of the ends where no
    letter or digit follows. The search goes on behind what was accepted; a start
    without such an end is passed by alone."""
    out, m = [], _IBAN.search(text)
    while m:
        start, length, end = m.start(), IBAN_LENGTHS.get(m.group()[:2]), None
        size = len(m.group().replace(" ", ""))
        for at in range(m.end(), start + 14, -1):
            if text[at - 1] == " ":
                continue
            whole = not _WORD.match(text, at)
            if whole and size >= 15 and (size == length or not length) and mod97(text[start:at]):
                end = at
                break
            size -= 1
        if end:
            out.append((start, end))
        m = _IBAN.search(text, end or start + 1)
    return out


def context_score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
    words = set(re.findall(r"[a-z]+", near.lower()))
    good, bad = CONTEXT[kind]
    score = PRIOR[kind] + 0.4 * bool(words & set(good)) - 0.3 * bool(words & set(bad))
    return min(1.0, max(0.0, score))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start; code points, end exclusive."""
    out = []

    def add(kind: str, start: int, end: int, always: bool = False) -> None:
        score = context_score(kind, text, start, end)
        if always or score >= MIN_SCORE:
            out.append((kind, start, end, score))

    for s, e in emails(text) if "@" in text else ():
        add("email", s, e, True)
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
                add("ip", *m.span(), True)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    add("card", *m.span(), True)
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                add("phone", *m.span(), True)
        for s, e in ibans(text):
            add("iban", s, e)
        for m in _SSN.finditer(text) if "-" in text else ():
            add("ssn", *m.span())
        for m in _ABA.finditer(text):
            if aba(m.group()):
                add("aba", *m.span())
    for kind, s, e in secrets(text):
        add(kind, s, e)
    return out


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_email .. n_phone, base_sha256, spans (joined to text) of find_pii(),
    n_spans (of all kinds) and scores (of the spans, in their order)."""

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",")
    more = [F.size("spans").cast("long").alias("n_spans"), scores.alias("scores")]
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), *more)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score).

    Null texts are empty and have no spans; repeated rows and null ids keep
    their rows; an empty table gives no rows. Other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            found = []
            for t in batch.column(1):
                spans = find_spans(t.as_py() or "")
                found.append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)

