"""Canonical exact fingerprints of whole documents.

The canonical form of a text is its Unicode compatibility composition (NFKC),
case-folded, composed again, runs of white space folded to one space and the
ends trimmed. The fingerprint is a 128-bit digest of it, two xxhash64 over
differently salted bytes. Texts with one digest are compared byte by byte: a
digest that stands for several canonical texts has its texts' SHA-256 put
behind it, so fingerprints are equal exactly if canonical texts are.

Normalisation runs in the JVM through the SQL function java_method on the ICU
classes that Spark ships; there is no Python on this path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

_ICU = "com.ibm.icu"
_KINDS = ("", "edited_", "next_")
#: Rows that are broadcast to others up to this count, else both are shuffled: digests, ids with a hash.
MAX_BROADCAST = 500_000
#: White space of Unicode's White_Space property.
_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    # ASCII has no decompositions, and lower() folds it: ICU is for the others
    composed = F.java_method(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.java_method(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.java_method(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)
    spaced = F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(again), _SPACE, " ")
    return F.when(text.isNotNull(), F.btrim(spaced))


def digest(canon: Column) -> Column:
    """32 hex digits: two differently salted xxhash64."""
    wide = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0") for salt in (0x51ED270B, 0x2545F491)]
    return F.concat(*wide)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text, fingerprint, n_same (documents with that
    canonical text).

    Null texts are empty texts. The digest's group is reduced before and after
    the shuffle to its least and greatest canonical text and a count, so a hot
    group of copies is a few rows; these are what is compared byte by byte.
    """
    named = docs.select("doc_id", "text", canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("digest", digest(F.col("canon")))
    return with_checked(named, "digest", "fingerprint").drop("canon", "digest")


def shared_digests(canons: DataFrame) -> DataFrame:
    """(canon, digest) -> the digests that stand for more than one canonical text."""
    groups = canons.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return groups.where(F.col("least") != F.col("most")).select(F.col("digest").alias("shared"))


def with_checked(df: DataFrame, digest_col: str, name: str) -> DataFrame:
    shared = shared_digests(df.select("canon", F.col(digest_col).alias("digest")))
    out = df.join(shared, F.col(digest_col) == F.col("shared"), "left")
    return out.withColumn(name, F.when(F.col("shared").isNull(), F.col(digest_col)).otherwise(F.concat(digest_col, F.lit("-"), F.sha2("canon", 256)))).drop("shared")


def buckets_by_id(docs: DataFrame, buckets: int) -> list[int]:
    """Cut points of doc_id into about equal ranges; at most `buckets` numbers."""
    at = [i / buckets for i in range(1, buckets)]
    found = docs.where("doc_id is not null").approxQuantile("doc_id", at, 0.2 / buckets) if buckets > 1 else []
    return sorted({int(x) for x in found})


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text) -> with next_id, next_text: the next row in ascending
    doc_id order, after the last the first; null ids come first, ties by text.

    Rows are dealt by ranges of doc_id, and each range also gets the first row
    of the range after it, so no window spans the table.
    """
    cuts = buckets_by_id(docs, buckets)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))), F.lit(0))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.cast("int").alias("bucket"))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f")).select("bucket", "f.doc_id", "f.text")
    order = [r["bucket"] for r in firsts.select("bucket").orderBy("bucket").collect()]  # numbers of ranges
    previous = {b: order[i - 1] for i, b in enumerate(order)}
    pairs = docs.sparkSession.createDataFrame(list(previous.items()) or [(-1, -1)], "bucket int, before int")
    heads = firsts.join(F.broadcast(pairs), "bucket").select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("head"))
    both = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("head")).unionByName(heads)
    w = Window.partitionBy("bucket").orderBy("head", F.asc_nulls_first("doc_id"), "text")
    after = {"next_id": F.lead("doc_id").over(w), "next_text": F.lead("text").over(w)}
    return both.withColumns(after).where("head = 0").drop("head", "bucket")


def edited(text: Column, after: Column) -> Column:
    """The text with its last half replaced by the first as many code points of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(after, half))


def likeness(a: Column, b: Column) -> Column:
    """Of exact fingerprints: 1 if equal, else 0."""
    return (a == b).cast("double")


def bounded(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, own, next_id, next_own, ..) -> with text and next_text, found by id and hash."""
    both = [F.struct(F.col(i).alias("id"), F.col(h).alias("hash")) for i, h in (("doc_id", "own"), ("next_id", "next_own"))]
    keys = rows.select(F.inline(F.array(*both)))
    keys = written(keys.distinct(), "wanted")
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").alias("id_"), F.xxhash64(text).alias("hash_"), text.alias("text_"))
    found = found.join(bounded(keys), F.col("id_").eqNullSafe(F.col("id")) & (F.col("hash_") == F.col("hash")), "left_semi").dropDuplicates(["id_", "hash_"])
    found = written(found, "again")
    for name, at, own in (("text", "doc_id", "own"), ("next_text", "next_id", "next_own")):
        side = found.select(F.col("id_").alias("i"), F.col("hash_").alias("h"), F.col("text_").alias(name))
        rows = rows.join(side, F.col(at).eqNullSafe(F.col("i")) & (F.col(own) == F.col("h"))).drop("i", "h")
    return rows


def suspects(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(canon, digest) of the texts and edited texts in buckets of several rows."""
    names = rows.select(F.explode(F.array("digest", "edited_digest")).alias("of")).groupBy("of").count().where("count > 1").select("of")
    names = bounded(written(names, "several"))
    plain = rows.join(names, F.col("digest") == F.col("of"), "left_semi").select(F.col("doc_id").alias("id"), F.col("own").alias("hash"))
    plain = bounded(written(plain.distinct(), "copies"))
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("own"), text.alias("text"))
    found = found.join(plain, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left_semi").select(canonical(F.col("text")).alias("canon"))
    changed = with_texts(docs, rows.join(names, F.col("edited_digest") == F.col("of"), "left_semi"))
    changed = changed.select(canonical(edited(F.col("text"), F.col("next_text"))).alias("canon"))
    return found.unionByName(changed).withColumn("digest", digest(F.col("canon")))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every document and its edited text.

    Null texts are empty; an empty document's edited text is empty. The only
    document of a table is its own next. Null ids come before all others, equal
    ids are ordered by text, repeated rows keep their rows. An empty table gives
    no rows. Other columns of docs are not read.

    Texts are moved once, to meet the text after them. Those in a bucket of
    several rows are fetched again, and their canonical bytes are compared.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs.select("doc_id", "text"), buckets)
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        "next_id",
        F.xxhash64("text").alias("own"),
        F.xxhash64("next_text").alias("next_own"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"),
        canonical(F.col("edited_text")).alias("edited_canon"),
        canonical(F.col("next_text")).alias("next_canon"),
    )
    rows = rows.withColumns({f"{k}digest": digest(F.col(f"{k}canon")) for k in _KINDS})
    rows = written(rows.drop("canon", "edited_canon", "next_canon"), "fingerprints")
    shared = bounded(written(shared_digests(suspects(docs, rows)), "shared-digests"))
    canons = rows
    for k in _KINDS:
        canons = canons.join(shared, F.col(f"{k}digest") == F.col("shared"), "left").withColumn(f"{k}odd", F.col("shared").isNotNull()).drop("shared")
    odd = F.col("odd") | F.col("edited_odd") | F.col("next_odd")
    plain_rows = canons.where(~odd).withColumns({f"{k}fp": F.col(f"{k}digest") for k in _KINDS})
    # of a digest that stands for several texts: their SHA-256 behind it, for which the texts are needed once more
    whole = with_texts(docs, canons.where(odd))
    for k, text in zip(_KINDS, (F.col("text"), edited(F.col("text"), F.col("next_text")), F.col("next_text")), strict=True):
        named = F.concat(f"{k}digest", F.lit("-"), F.sha2(canonical(text), 256))
        whole = whole.withColumn(f"{k}fp", F.when(F.col(f"{k}odd"), named).otherwise(F.col(f"{k}digest")))
    rows = plain_rows.unionByName(whole.select(*plain_rows.columns))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
