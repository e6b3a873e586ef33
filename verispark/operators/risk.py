"""Can a candidate station be independent of a reference network?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_identifier, compound_parts, truthy
from .neighbours import nearest_match


def identifier_matches(candidates: DataFrame, reference: DataFrame, candidate_columns: Sequence[str],
                       reference_columns: Sequence[str]) -> DataFrame:
    """Per candidate: the reference stations that share any identifier, as a sorted '|' list.

    One identifier stands for one station: the owner in the first of ``reference_columns`` that has it, the smallest id
    within a column; the parts of eleven-digit station ids come after all columns, and a station id itself is no identifier.
    """
    named = [F.struct(F.lit(k).alias("rank"), clean_identifier(F.col(c)).alias("key")) for k, c in enumerate(reference_columns)]
    parts = F.transform(compound_parts(F.col("station_id").cast("string")), lambda p: F.struct(F.lit(len(named)).alias("rank"), p.alias("key")))
    every = F.concat(F.array(*named), parts) if named else parts
    known = (reference.select(F.col("station_id").cast("string").alias("_ref"), F.explode(every).alias("_k")).where(F.col("_k.key").isNotNull())
             .groupBy(F.col("_k.key").alias("_key")).agg(F.min(F.struct("_k.rank", "_ref")).alias("_owner")).select("_key", F.col("_owner._ref").alias("_ref")))
    keys = F.array_distinct(F.array_compact(F.array(*[clean_identifier(F.col(c)) for c in candidate_columns])))
    wanted = candidates.select("station_id", F.explode(keys).alias("_key"))
    return (wanted.join(known, "_key").groupBy("station_id")
            .agg(F.array_join(F.array_sort(F.collect_set("_ref")), "|").alias("identifier_overlap_ids")))


def _either(df: DataFrame, column: str, shape) -> Column:
    return shape(F.col(column)) if column in df.columns else shape(F.lit(None).cast("string"))


def classify(candidates: DataFrame, reference: DataFrame, registry: dict[str, str], identifier_columns: Sequence[str],
             radius_km: float, elevation_tolerance_m: float, operational_types: Sequence[str],
             low_risk_types: Sequence[str], extra_identifiers: Sequence[str] = ("site_identifier", "isd_station_id")) -> DataFrame:
    """Risk class of every candidate, by the first rule that applies.

    Overlap with the reference (same place, or a shared identifier) decides
    first, then an operational route, then what the registry says of the network.
    """
    columns = [c for c in (*identifier_columns, *extra_identifiers) if c in candidates.columns]
    ref_columns = [c for c in (*identifier_columns, *extra_identifiers) if c in reference.columns]
    near = nearest_match(candidates, reference, "station_id", "station_id")
    heights = reference.select(F.col("station_id").alias("nearest_id"), F.col("altitude_m").alias("_ref_z"))
    joined = (near.join(heights, "nearest_id", "left")
              .join(identifier_matches(candidates, reference, columns, ref_columns), "station_id", "left"))
    gap = F.abs(F.col("altitude_m") - F.col("_ref_z"))
    # A candidate without coordinates is nowhere near, and stays in the result.
    physical = F.coalesce((F.col("nearest_km") <= radius_km) & (gap.isNull() | (gap <= elevation_tolerance_m)), F.lit(False))
    report = _either(candidates, "report_type", lambda c: F.upper(F.coalesce(c, F.lit(""))))
    international = F.lit(False)
    for c in identifier_columns:
        if c in candidates.columns:
            international = international | clean_identifier(F.col(c)).isNotNull()
    exchange = _either(candidates, "operational_exchange", truthy)
    documented = _either(candidates, "documented_non_operational", truthy)
    base = F.lit("unknown")
    for network, status in registry.items():
        base = F.when(F.lower(F.trim("network")) == network, F.lit(status)).otherwise(base)
    flagged = (joined.withColumn("elevation_gap_m", gap).withColumn("physical_overlap", physical)
               .withColumn("identifier_overlap", F.col("identifier_overlap_ids").isNotNull())
               .withColumn("identifier_overlap_ids", F.coalesce("identifier_overlap_ids", F.lit("")))
               .withColumn("international_identifier", international)
               .withColumn("_high", exchange | report.isin(*operational_types) | international)
               .withColumn("_low_type", report.isin(*low_risk_types))
               .withColumn("_low", documented | report.isin(*low_risk_types)).withColumn("_base", base))
    rules = (
        (F.col("physical_overlap") | F.col("identifier_overlap"), "potentially_assimilated", "reference overlap"),
        (F.col("_high"), "potentially_assimilated", "operational route or international identifier"),
        (F.col("_base") == "potentially_assimilated", "potentially_assimilated", "network registry"),
        (F.col("_base") == "confirmed_independent", "confirmed_independent", "network registry"),
        ((F.col("_base") == "low_risk_candidate") & F.col("_low"), "low_risk_candidate", "documented local route"),
        (F.col("_low_type") & F.col("_low"), "low_risk_candidate", "low-risk report type"),
    )
    risk, reason = F.lit("unknown"), F.lit("provenance insufficient")
    for condition, label, why in reversed(rules):
        risk, reason = F.when(condition, label).otherwise(risk), F.when(condition, why).otherwise(reason)
    return (flagged.withColumn("risk_class", risk).withColumn("risk_reason", reason)
            .withColumn("low_risk_stratum", F.col("risk_class").isin("confirmed_independent", "low_risk_candidate"))
            .drop("_high", "_low", "_low_type", "_base", "_ref_z"))
