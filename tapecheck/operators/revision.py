"""Has a provider rewritten history? Comparison of two snapshots of raw candles.

Inputs: ``baseline`` and ``audit`` with ``product, day`` and the six text
fields, and ``reference`` with ``product, reference_day`` (the day the baseline
was retrieved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.constants import CANDLE_KEYS, CANDLE_NUMERIC
from tapecheck.functions.decimals import is_finite_decimal, normal_form
from tapecheck.operators.blocks import materialize

BUCKETS = ("1", "2-7", "8-30", ">30")


def age_bucket(age: Column) -> Column:
    return (
        F.when(age == 1, "1")
        .when(age.between(2, 7), "2-7")
        .when(age.between(8, 30), "8-30")
        .when(age > 30, ">30")
        .otherwise(F.raise_error(F.lit("candle day has a non-positive age")).cast("string"))
    )


def _paired_days(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """Both candles of every day before the reference day, either may be NULL."""
    pack = lambda df, name: df.select("product", "day", F.struct(*CANDLE_KEYS).alias(name))
    pairs = pack(baseline, "old").join(pack(audit, "new"), ["product", "day"], "full_outer")
    return (
        pairs.join(reference.select("product", "reference_day"), "product")
        .where("day < reference_day")
        .withColumn("age_days", F.datediff("reference_day", "day"))
        .withColumn("bucket", age_bucket(F.col("age_days")))
    )


def _differences() -> Column:
    """Difference records of one day as an array; empty when identical."""
    field = lambda kind, name, old, new: F.struct(
        kind.alias("kind"), name.alias("field"), old.alias("old"), new.alias("new")
    )
    none = F.lit(None).cast("string")
    one = []
    for f in CANDLE_KEYS:
        old, new = F.col("old")[f], F.col("new")[f]
        kind = F.lit("format_only")
        if f in CANDLE_NUMERIC:
            # Text that is no decimal has no normal form, and so never counts as format.
            kind = F.when(normal_form(old) == normal_form(new), "format_only").otherwise("value")
        one.append(F.when(old != new, field(kind, F.lit(f), old, new)))
    whole = lambda kind, old, new: F.array(field(F.lit(kind), none, old, new))
    return (
        F.when(F.col("old").isNull(), whole("audit_only", none, F.to_json("new")))
        .when(F.col("new").isNull(), whole("baseline_only", F.to_json("old"), none))
        .otherwise(F.filter(F.array(*one), lambda x: x.isNotNull()))
    )


def revision_diff(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """One record per differing field, or per day present on one side only."""
    days = _paired_days(baseline, audit, reference)
    return days.select(
        "product", "day", "age_days", "bucket", F.inline(_differences())
    )


def _day_facts(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    days = _paired_days(baseline, audit, reference).withColumn("diff", _differences())
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    of_kind = lambda k: F.size(F.filter("diff", lambda d: d["kind"] == k))
    flag = lambda c: c.cast("int")
    return days.select(
        "product",
        "day",
        "age_days",
        "bucket",
        flag(both).alias("matched_days"),
        flag(both & (F.size("diff") == 0)).alias("identical_days"),
        flag(F.size("diff") > 0).alias("differing_days"),
        flag(F.exists("diff", lambda d: d["kind"] != "format_only")).alias("semantic_differing_days"),
        of_kind("value").alias("value_records"),
        of_kind("format_only").alias("format_only_records"),
        of_kind("baseline_only").alias("baseline_only_records"),
        of_kind("audit_only").alias("audit_only_records"),
    )


_COUNTS = (
    "days_evaluated", "matched_days", "identical_days", "differing_days",
    "semantic_differing_days", "value_records", "format_only_records",
    "baseline_only_records", "audit_only_records",
)


def revision_counts(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts per product and age bucket, plus a ``total`` row per product.

    Every calendar day from the first one seen counts as evaluated, also when
    it is absent on both sides. Calendar days are added as rows of the same
    aggregation instead of being joined.
    """
    facts = materialize(_day_facts(baseline, audit, reference))
    # The reference day follows from any row, so the snapshots are not read again for it.
    span = facts.groupBy("product").agg(
        F.min("day").alias("first_day"),
        F.min_by(F.date_add("day", F.col("age_days")), "day").alias("reference_day"),
    )
    calendar = (
        span.select(
            "product",
            "reference_day",
            F.explode(F.sequence("first_day", F.date_sub("reference_day", 1))).alias("day"),
        )
        .withColumn("bucket", age_bucket(F.datediff("reference_day", "day")))
        .select("product", "bucket", F.lit(1).alias("days_evaluated"))
    )
    every = span.select("product", F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    rows = (
        facts.drop("day", "age_days")
        .unionByName(calendar, allowMissingColumns=True)
        .unionByName(every, allowMissingColumns=True)
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]
    return (
        rows.groupingSets([["product", "bucket"], ["product"]], "product", "bucket")
        .agg(F.grouping("bucket").alias("is_total"), *sums)
        .withColumn("bucket", F.when(F.col("is_total") == 1, "total").otherwise(F.col("bucket")))
        .drop("is_total")
    )


def revision_verdict(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """How far back history still moves, from the ages of semantic differences."""
    facts = _day_facts(baseline, audit, reference).groupBy("product").agg(
        F.max(F.when(F.col("semantic_differing_days") == 1, F.col("age_days"))).alias("oldest"),
        F.max("differing_days").alias("any"),
        F.sum("format_only_records").alias("drift"),
    )
    later = (
        audit.join(reference.select("product", "reference_day"), "product")
        .where("day >= reference_day")
        .groupBy("product")
        .agg(F.count("*").alias("later"))
    )
    return facts.join(later, "product", "left").select(
        "product",
        F.when(F.col("oldest").isNull() & (F.col("any") == 0), "PASS")
        .when(F.col("oldest").isNull(), "PASS_WITH_FORMAT_DRIFT")
        .when(F.col("oldest") >= 8, "STOP")
        .when(F.col("oldest") >= 2, "PASS_WITH_7D_EMBARGO")
        .otherwise("PASS_WITH_1D_EMBARGO")
        .alias("verdict"),
        (F.col("drift") == 0).alias("raw_representation_stable"),
        F.coalesce("later", F.lit(0)).alias("audit_days_after_baseline"),
    )


def snapshot_pair_violations(
    baseline: DataFrame, audit: DataFrame, reference: DataFrame
) -> DataFrame:
    """Preconditions of a comparison, one row per product and broken rule.

    Same products and, where the snapshots have an ``interval``, the same one; no repeated
    day; the baseline ends the day before the reference day; all fields are what the strict decoder takes.
    """
    sides = baseline.select("product", "day", F.lit("baseline").alias("side")).unionByName(
        audit.select("product", "day", F.lit("audit").alias("side"))
    )
    repeated = sides.groupBy("product", "side", "day").count().where("count > 1").select(
        "product", F.concat("side", F.lit("_duplicate_day")).alias("rule")
    )
    ends = baseline.groupBy("product").agg(F.max("day").alias("last_day"))
    known = reference.select("product", "reference_day")
    late = known.join(ends, "product", "left").select(
        "product",
        F.when(F.col("last_day").isNull(), "baseline_empty")
        .when(F.col("last_day") != F.date_sub("reference_day", 1), "baseline_last_day")
        .alias("rule"),
    )
    strangers = (
        audit.select("product").distinct().join(known, "product", "left_anti")
        .select("product", F.lit("product_mismatch").alias("rule"))
    )
    found = repeated.unionByName(late.where("rule is not null")).unionByName(strangers)
    for side, rows in (("baseline", baseline), ("audit", audit)):
        bad = ~F.coalesce(F.col("start").rlike(r"\A[0-9]+\z"), F.lit(False))
        for c in CANDLE_NUMERIC:
            bad = bad | ~is_finite_decimal(F.col(c))
        found = found.unionByName(rows.where(bad).select("product", F.lit(f"{side}_undecodable").alias("rule")))
    if "interval" in baseline.columns and "interval" in audit.columns:
        kinds = baseline.select("product", "interval").unionByName(audit.select("product", "interval"))
        mixed = kinds.groupBy("product").agg(F.min("interval").alias("lo"), F.max("interval").alias("hi"))
        found = found.unionByName(mixed.where("lo <> hi").select("product", F.lit("interval_mismatch").alias("rule")))
    return found.distinct()


def revision_audit(baseline: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """The verdict for every product that may be compared; ``REJECTED`` with its broken rules for the others."""
    broken = (
        snapshot_pair_violations(baseline, audit, reference)
        .groupBy("product")
        .agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("broken_rules"))
    )
    broken = materialize(broken)
    sound = [df.join(broken, "product", "left_anti") for df in (baseline, audit, reference)]
    rejected = broken.select("product", F.lit("REJECTED").alias("verdict"), "broken_rules")
    judged = revision_verdict(*sound).withColumn("broken_rules", F.lit(""))
    return judged.unionByName(rejected, allowMissingColumns=True)
