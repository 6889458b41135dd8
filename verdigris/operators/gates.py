"""Gates of a comparison: what is wrong with an arm's calls, and what its evidence decides.

Both are fail-closed: what is missing or does not fit counts as a defect, never as a pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .operations import RELIABLE

#: The scored dimensions, and the one that both policies ask for besides.
DIMENSIONS, STABILITY = ("call_result", "reason", "product"), "stability"
POLICIES = ("decision_grade_v2", "legacy_v1")


def runtime_gate(calls: DataFrame, by: Sequence[str], model: str, provider: str) -> DataFrame:
    """calls (by, item_id, outcome, model, provider, reasoning_tokens, prompt_tokens) -> by,
    total, parse_ok, reliable, problems.

    problems names, in this order: model, provider (another one was seen, or none);
    model_unknown, provider_unknown (an answered call lacks it); reasoning (some, or unknown
    where answered); usage (an answered call without prompt tokens); split (an item whose
    prompt had several lengths). Calls that failed need no usage, or one failure would
    count twice. An outcome of null is a failed call.
    """
    ok = F.coalesce(F.col("outcome") == "ok", F.lit(False))
    tokens = F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens"))
    any_ = lambda when: F.coalesce(F.bool_or(when), F.lit(False))
    wanted = {"model": model, "provider": provider}
    flags = {
        "model_unknown": ok & F.col("model").isNull(),
        "provider_unknown": ok & F.col("provider").isNull(),
        "reasoning": (F.col("reasoning_tokens") != 0) | (ok & F.col("reasoning_tokens").isNull()),
        "usage": ok & tokens.isNull(),
    }
    seen = {f"_{c}": F.col(c) == w for c, w in wanted.items()} | {f"_no_{c}": F.col(c) != w for c, w in wanted.items()}
    # items first: of them an arm needs flags and counts only, so no set of items is gathered
    per_item = [any_(v).alias(k) for k, v in (flags | seen).items()]
    items = calls.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(ok).alias("_ok"), F.max(tokens).alias("_high"), F.min(tokens).alias("_low"), *per_item)
    sums = items.groupBy(*by).agg(
        F.sum("_n").alias("total"),
        F.sum("_ok").alias("parse_ok"),
        *[(F.bool_or(f"_no_{c}") | ~F.bool_or(f"_{c}")).alias(c) for c in wanted],
        *[F.bool_or(c).alias(c) for c in flags],
        any_(F.col("_high") != F.col("_low")).alias("split"),
    )
    problems = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in (*wanted, *flags, "split")]))
    return sums.select(*by, "total", "parse_ok", reliable("parse_ok", "total").alias("reliable"), problems.alias("problems"))


def reliable(ok: str, total: str) -> Column:
    """Whether the unrounded share of parsed answers reaches the gate; false for counts that cannot be."""
    return F.coalesce((F.col(total) > 0) & F.col(ok).between(F.lit(0), F.col(total)) & (F.col(ok) / F.nullif(total, F.lit(0)) >= RELIABLE), F.lit(False))


def sound_evidence() -> Column:
    """Whether a verdict (discordant, net, band, verdict) is what its counts give: it is judged anew, not trusted."""
    d, net = F.col("discordant"), F.col("net")
    fits = (d >= 0) & (F.abs(net) <= d) & ((d - net) % 2 == 0)
    band = stats.sign_band_of(F.when(d >= 0, d))
    return F.coalesce(fits & F.col("band").eqNullSafe(band) & (F.col("verdict") == stats.verdict(net, band)), F.lit(False))


def decisions(arms: DataFrame, verdicts: DataFrame, by: Sequence[str], expected: Sequence[str] = DIMENSIONS, margins: Mapping[str, int] | None = None, policy: str = POLICIES[0]) -> DataFrame:
    """arms (by, qualification, parse_ok, total, problems, ref_parse_ok, ref_total, ref_problems) and
    verdicts (by, dimension, discordant, net, band, verdict) -> by, decision, reasons.

    decision_grade_v2, the first that applies: UNAVAILABLE for an arm that is not QUALIFIED; INCONCLUSIVE
    for evidence that is not one sound verdict for each expected dimension and stability, for
    impossible counts or problems of either side, and for an unreliable incumbent; FAIL for an
    unreliable candidate, or BEHIND anywhere; INCONCLUSIVE for UNDERPOWERED, or INDISTINGUISHABLE with a net
    loss above the dimension's margin (0 unless given); PASS. legacy_v1 takes the verdicts as they are,
    fails an arm for its own problems or impossible counts, and knows neither completeness nor margins.
    Without incumbent counts (both null; in legacy_v1 either) its reliability is not asked for.
    """
    margins = dict(margins or {})
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if not expected or len(set(expected)) != len(expected) or set(margins) - {*expected, STABILITY} or any(isinstance(m, bool) or not isinstance(m, int) or m < 0 for m in margins.values()):
        raise ValueError("expected dimensions are different names; margins are whole numbers of them, 0 or more")
    asked, dim = (*expected, STABILITY), F.col("dimension")
    of = lambda when, name: F.count_if(F.coalesce(when, F.lit(False))).alias(name)
    lost = {d: (F.col("verdict") == "INDISTINGUISHABLE") & (F.col("net") < -margins.get(d, 0)) for d in asked}
    sums = [of(~F.coalesce(dim.isin(*asked), F.lit(False)), "_unexpected")]
    for i, d in enumerate(asked):
        sums += [of(dim == d, f"_n{i}"), of((dim == d) & ~F.col("_sound"), f"_bad{i}"), of((dim == d) & lost[d], f"_lost{i}")]
    for v in ("BEHIND", "UNDERPOWERED"):
        sums += [of((dim == d) & (F.col("verdict") == v), f"_{v}{i}") for i, d in enumerate(asked)]
        sums += [of((F.col("verdict") == v) & ~F.coalesce(dim.isin(*asked), F.lit(False)), f"_{v}_other")]
    found = verdicts.withColumn("_sound", sound_evidence()).groupBy(*[F.col(b).alias(f"_v_{b}") for b in by]).agg(*sums)
    rows = arms.join(found, [F.col(b).eqNullSafe(F.col(f"_v_{b}")) for b in by], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    say = lambda *rules: F.array_compact(F.array(*[F.when(when, F.lit(text)) for text, when in rules]))
    each = lambda word, column: [(f"{word}:{d}", n(f"{column}{i}") > 0) for i, d in enumerate(asked)]
    named = lambda who, column: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda p: F.concat(F.lit(f"{who}:"), p))
    possible = lambda ok, total: F.coalesce((F.col(total) > 0) & F.col(ok).between(F.lit(0), F.col(total)), F.lit(False))
    unasked = F.col("ref_parse_ok").isNull() & F.col("ref_total").isNull()

    unavailable = say(("qualification", ~F.coalesce(F.col("qualification") == "QUALIFIED", F.lit(False))))
    weak_reference = say(("incumbent_unreliable", ~unasked & ~reliable("ref_parse_ok", "ref_total")))
    weak = say(("unreliable", ~reliable("parse_ok", "total")))
    behind = say(*each("behind", "_BEHIND"))
    if policy == POLICIES[1]:
        weak_reference = say(("incumbent_unreliable", F.col("ref_parse_ok").isNotNull() & F.col("ref_total").isNotNull() & ~reliable("ref_parse_ok", "ref_total")))
        behind = say(*each("behind", "_BEHIND"), ("behind:other", n("_BEHIND_other") > 0))
        thin = say(*each("underpowered", "_UNDERPOWERED"), ("underpowered:other", n("_UNDERPOWERED_other") > 0))
        steps = [("UNAVAILABLE", unavailable), ("INCONCLUSIVE", named("incumbent", "ref_problems")), ("INCONCLUSIVE", weak_reference), ("FAIL", F.concat(named("candidate", "problems"), weak, behind)), ("INCONCLUSIVE", thin)]
    else:
        shape = [(f"missing:{d}", n(f"_n{i}") == 0) for i, d in enumerate(asked)] + [(f"duplicate:{d}", n(f"_n{i}") > 1) for i, d in enumerate(asked)]
        counts = [("incumbent_counts", ~unasked & ~possible("ref_parse_ok", "ref_total")), ("candidate_counts", ~possible("parse_ok", "total"))]
        invalid = F.concat(say(*shape, ("unexpected", n("_unexpected") > 0), *each("evidence", "_bad"), *counts), named("incumbent", "ref_problems"), named("candidate", "problems"))
        steps = [("UNAVAILABLE", unavailable), ("INCONCLUSIVE", invalid), ("INCONCLUSIVE", weak_reference), ("FAIL", weak), ("FAIL", behind), ("INCONCLUSIVE", say(*each("underpowered", "_UNDERPOWERED"), *each("net_loss", "_lost")))]
    made = rows.withColumn("_steps", F.array(*[F.struct(F.lit(d).alias("decision"), r.alias("reasons")) for d, r in steps]))
    first = F.try_element_at(F.filter("_steps", lambda s: F.size(s["reasons"]) > 0), F.lit(1))
    last = F.struct(F.lit("PASS").alias("decision"), F.array().cast("array<string>").alias("reasons"))
    return made.withColumn("_d", F.coalesce(first, last)).select(*by, "_d.*")
