import json

from verdigris.operators import usage

PRICES = [("f", "input", "text", 0.00000015), ("f", "input", "audio", 0.0000005), ("f", "output", "all", 0.00000125), ("t", "input", "text", 0.000001), ("t", "output", "text", 0.000003), ("t", "output", "thoughts", 0.000003)]


def said(inputs=(), outputs=(), thoughts=None, cached=None):
    detail = lambda x: [{"modality": m, "tokenCount": n} for m, n in x]
    out = {"promptTokensDetails": detail(inputs), "candidatesTokensDetails": detail(outputs), "thoughtsTokenCount": thoughts, "cachedContentTokenCount": cached}
    return json.dumps({k: v for k, v in out.items() if v is not None})


def test_costs_by_hand(spark):
    rows = [
        (1, "f", said([("TEXT", 18000), ("AUDIO", 4425), ("TEXT", 353)], [("TEXT", 1200)], cached=5000)),
        (2, "t", said([("TEXT", 10000)], [("TEXT", 500)], thoughts=1500, cached=2000)),
        (3, "f", said([("TEXT", 100), ("AUDIO", 50), ("IMAGE", 7), ("SMELL", 9)], cached=120)),
        (4, "nobody", said([("TEXT", 5)], [("TEXT", 6)], thoughts=7)),
        (5, None, "no json"),
        (6, "f", None),
        (7, "f", said([("TEXT", None)])),
    ]
    df = usage.usage_tokens(spark.createDataFrame(rows, "i int, model string, usage string"))
    got = {r["i"]: (r["cost_input"], r["cost_output"], r["unpriced"]) for r in usage.with_costs(df, spark.createDataFrame(PRICES, "model string, direction string, modality string, cost_per_token double")).collect()}
    assert got == {1: (0.004215, 0.0015, 0), 2: (0.008, 0.006, 0), 3: (0.000015, 0.0, 7), 4: (0.0, 0.0, 18), 5: (0.0, 0.0, 0), 6: (0.0, 0.0, 0), 7: (0.0, 0.0, 0)}
