"""Whether the phrases that an answer quotes stand in the conversation, and who said them.

An answer is JSON: products, each with up to three slots, each with a keyword
that may hold several quotes between commas. A conversation is one text of its
turns, and the turns' own texts by speaker. A record's slots stay an array in
its row, so a record is joined to its conversation once and no row is multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What starts a line of either speaker, and the two artefacts of recognised speech.
AGENT, CUSTOMER = "เจ้าหน้าที่:", "ลูกค้า:"
ARTEFACTS = (("เเ", "แ"), ("​", ""))
SLOTS = ("main", "secondary", "third")

COUNTERS = (
    "records", "product_blocks", "keyword_slots_present", "blank_keyword_slots", "nonstring_keyword_slots", "spans_whole", "verbatim_whole",
    "comma_fields", "spans_split", "verbatim_split", "customer_speech", "agent_only", "cross_turn", "near_miss", "hard_miss",
)


def without_artefacts(x: Column) -> Column:
    for old, new in ARTEFACTS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


#: White space around a quote, as a pattern.
SPACE = r"(?U:\s)"


def _stripped(x: Column, space: str) -> Column:
    return F.regexp_replace(x, rf"^{space}+|{space}+\z", "")


def from_lines(items: DataFrame, item: str = "item_id", transcript: str = "transcript") -> DataFrame:
    """item_id, transcript, customers, agents of written transcripts; a line that starts with neither speaker is nobody's."""
    lines = F.split(F.col(transcript), "\n", -1)
    said = lambda who: F.transform(F.filter(lines, lambda x: x.startswith(who)), lambda x: F.substring(x, F.lit(len(who) + 1), F.length(x)))
    return items.select(F.col(item).alias("item_id"), F.col(transcript).alias("transcript"), said(CUSTOMER).alias("customers"), said(AGENT).alias("agents"))


def from_turns(turns: DataFrame, item: str = "item_id", position: str = "turn", role: str = "role", text: str = "text", customer: str = "user", agent: str = "assistant") -> DataFrame:
    """item_id, transcript, customers, agents of conversations that come a row a
    turn. A group is one conversation, which is a text by itself."""
    who = F.when(F.col(role) == customer, CUSTOMER).when(F.col(role) == agent, AGENT).otherwise("")
    rows = turns.groupBy(F.col(item).alias("item_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), who.alias("who"), F.coalesce(text, F.lit("")).alias("said")))).alias("turns"))
    said = lambda x: F.transform(F.filter("turns", lambda t: t["who"] == x), lambda t: t["said"])
    return rows.select("item_id", F.array_join(F.transform("turns", lambda t: F.concat(t["who"], t["said"])), "\n").alias("transcript"), said(CUSTOMER).alias("customers"), said(AGENT).alias("agents"))


def with_slots(records: DataFrame, payload: str = "payload") -> DataFrame:
    """records with product_blocks, the number of its products that are objects,
    and slots, array of product, slot, keyword (null unless text) and other
    (a keyword that is neither text nor null)."""
    products = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.product", "map<string,variant>")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    blocks = F.coalesce(F.filter(F.map_entries(products), lambda e: is_object(e["value"])), F.array())
    rows = records.withColumn("_blocks", blocks)

    def slot(block: Column, name: str) -> Column:
        nested = F.try_variant_get(block["value"], f"$.{name}", "variant")
        keyword = F.when(is_object(nested), F.try_variant_get(nested, "$.keyword", "variant"))
        kind = F.coalesce(F.schema_of_variant(keyword), F.lit("VOID"))
        return F.struct(block["key"].alias("product"), F.lit(name).alias("slot"), F.when(kind == "STRING", F.try_variant_get(keyword, "$", "string")).alias("keyword"), (~kind.isin("STRING", "VOID")).alias("other"))

    found = F.flatten(F.transform("_blocks", lambda b: F.array(*[slot(b, s) for s in SLOTS])))
    return rows.withColumn("slots", F.filter(found, lambda s: s["keyword"].isNotNull() | s["other"])).withColumn("product_blocks", F.size("_blocks")).drop("_blocks")


def segments(keyword: Column, space: str = SPACE) -> Column:
    """The quotes of a keyword: parts between commas, stripped, not blank, case kept."""
    return F.filter(F.transform(F.split(keyword, ",", -1), lambda s: _stripped(s, space)), lambda s: s != "")


def placed(segment: Column) -> Column:
    """Where a quote stands, for rows with transcript, customers, agents and _clean:
    customer_speech before agent_only before cross_turn; else near_miss where only artefacts differ; else hard_miss."""
    inside = F.when(F.exists("customers", lambda t: t.contains(segment)), "customer_speech").when(F.exists("agents", lambda t: t.contains(segment)), "agent_only").otherwise("cross_turn")
    return F.when(F.col("transcript").contains(segment), inside).when(F.col("_clean").contains(without_artefacts(segment)), "near_miss").otherwise("hard_miss")


def _met(records: DataFrame, conversations: DataFrame) -> DataFrame:
    """Parsed records with their conversation. Refused: a conversation twice, a record without one."""
    if not conversations.groupBy("item_id").count().where("count > 1").isEmpty():
        raise ValueError("an item has two transcripts")
    parsed = records.where("parse_ok")
    if not parsed.join(conversations, "item_id", "left_anti").isEmpty():
        raise ValueError("a record's item has no transcript")
    return with_slots(parsed).join(conversations, "item_id").withColumn("_clean", without_artefacts(F.col("transcript")))


def quotes(records: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each quote of every parsed record: item_id, product, slot, segment, place."""
    rows = _met(records, conversations)
    spans = F.filter("slots", lambda s: s["keyword"].isNotNull())
    found = F.flatten(F.transform(spans, lambda s: F.transform(segments(s["keyword"]), lambda x: F.struct(s["product"].alias("product"), s["slot"].alias("slot"), x.alias("segment"), placed(x).alias("place")))))
    return rows.select("item_id", F.inline(found))


def evidence_rates(records: DataFrame, conversations: DataFrame, by: Sequence[str] = (), space: str = SPACE) -> DataFrame:
    """All counters and the rates of whole keywords and of quotes, for records
    (item_id, parse_ok, payload, by) and conversations as from_turns() or
    from_lines() gives them. A rate without anything to count is 0. format_gap is
    what keeping the asked-for format costs the whole-keyword rate. space is the
    pattern of what is stripped off quotes, Unicode's white space by default."""
    rows = _met(records, conversations)
    text = F.filter("slots", lambda s: s["keyword"].isNotNull())
    blank = lambda s: _stripped(s["keyword"], space) == ""
    rows = rows.withColumn("_spans", F.filter(text, lambda s: ~blank(s))).withColumn("_text", text)
    rows = rows.withColumn("_places", F.flatten(F.transform("_spans", lambda s: F.transform(segments(s["keyword"], space), placed))))
    where = lambda *names: F.size(F.filter("_places", lambda p: p.isin(*names)))
    counts = {
        "records": F.lit(1),
        "product_blocks": F.col("product_blocks"),
        "keyword_slots_present": F.size("_text"),
        "blank_keyword_slots": F.size("_text") - F.size("_spans"),
        "nonstring_keyword_slots": F.size(F.filter("slots", lambda s: s["other"])),
        "spans_whole": F.size("_spans"),
        "verbatim_whole": F.size(F.filter("_spans", lambda s: F.col("transcript").contains(s["keyword"]))),
        "comma_fields": F.size(F.filter("_spans", lambda s: s["keyword"].contains(","))),
        "spans_split": F.size("_places"),
        "verbatim_split": where("customer_speech", "agent_only", "cross_turn"),
        **{name: where(name) for name in COUNTERS[-5:]},
    }
    sums = rows.groupBy(*by).agg(*[F.sum(counts[c]).cast("long").alias(c) for c in COUNTERS])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    whole, split = rate("verbatim_whole", "spans_whole"), rate("verbatim_split", "spans_split")
    return sums.withColumns({"whole_field_rate": whole, "segment_rate": split, "format_gap": split - whole})
