"""Notices that are wrapped, and words that are scattered."""

from verdigris.llm import license_scan

MIT = license_scan.TEMPLATES[5][1]


def labels(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (list(r["labels"]), r["score"]) for r in license_scan.scan_licenses(docs).collect()}


def test_wrapped_and_scattered_notices(spark):
    words = MIT.split()
    wrapped = "intro words\n" + " ".join(words[:9]) + "\n" + " ".join(words[9:]) + "\nand more"
    comment = "# " + "\n# ".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    far = "pad " * 1000 + MIT + " pad" * 1000
    scattered = (" filler" * 30).join(words)
    part = " ".join(words[: len(words) * 3 // 4])
    short = "licensed" + " x" * 40 + " under" + " x" * 40 + " cc" + " x" * 40 + " by"
    got = labels(spark, wrapped, comment, far, scattered, part, short, "licensed under\ncc by nc")
    assert [got[i][0] for i in range(7)] == [["mit"], ["mit"], ["mit"], [], [], [], ["cc-by", "cc-by-nc"]]
    assert got[0][1] == 1.0 and got[3][1] == 0.0
