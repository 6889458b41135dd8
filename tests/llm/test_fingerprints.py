"""Fingerprints where digests collide: the bytes decide."""

import hashlib

from pyspark.sql import functions as F
from test_texts import canon

from verdigris.llm import fingerprints


def brute(rows):
    ordered = sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        out[i] = (len(t), t, t[: len(t) - half] + after[:half], after)
    return out


def holds(got, want):
    names = {}
    for r in got:
        n, text, changed, after = want[r["doc_id"]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == (canon(text) == canon(changed)) and r["near_next"] == (canon(text) == canon(after))
        names.setdefault(canon(text), set()).add(r["fingerprint"])
        names.setdefault(canon(changed), set()).add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in names.values()) and len(set().union(*names.values())) == len(names)


def test_edits_against_a_plain_version(docs, rows):
    once = [r for r in rows if r[0] != 90]
    holds(fingerprints.fingerprint_edits(docs.where("doc_id <> 90")).collect(), brute(once))


def test_colliding_digests_are_told_apart_by_their_bytes(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lpad(F.hex(F.pmod(F.xxhash64(c), F.lit(7))), 32, "0"))
    once = [r for r in rows if r[0] != 90]
    holds(fingerprints.fingerprint_edits(docs.where("doc_id <> 90"), 3).collect(), brute(once))
