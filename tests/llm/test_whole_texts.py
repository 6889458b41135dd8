"""What stands in a text is found wherever it stands."""

import numpy as np
import pytest

from verdigris.llm import ngram_join, pii


@pytest.mark.parametrize(
    "text, want",
    [
        ("iban GB82 WEST 1234 5698 7654 32 BIC WESTGB2L", ["GB82 WEST 1234 5698 7654 32"]),
        ("DE89370400440532013000 2024-01-01", ["DE89370400440532013000"]),
        ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
        ("AB12 DE89370400440532013000", ["DE89370400440532013000"]),
        ("NO9386011117947", ["NO9386011117947"]),
        ("(MT84 MALT 0110 0001 2345 MTLC AST0 01S)", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
        ("DE89370400440532013001 DE8937040044053201300x NO938601111794", []),
    ],
)
def test_ibans(text, want):
    assert [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"] == want


def test_the_most_frequent_token_of_a_full_summary_is_last():
    known = np.arange(1, ngram_join.FREQUENT + 1, dtype=np.uint64) * np.uint64(3)
    rank = np.arange(1, ngram_join.FREQUENT + 1, dtype=np.uint64)
    tokens = np.array([known[-1], known[0], 1, known[-2], 2], np.uint64)
    keys = ngram_join.rarity_keys(tokens, known, rank)
    assert np.argsort(keys)[2:].tolist() == [1, 3, 0]
