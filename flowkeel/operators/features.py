"""Flow rows to feature vectors, against a traffic profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkeel.functions.stats import log1p_clamped, robust_score
from flowkeel.operators.lookup import lookup_join
from flowkeel.params import FeatureParams

RAW = ("duration", "src_bytes", "dst_bytes", "src_packets", "dst_packets")
ROBUST = {"duration": "DURATION", "src_bytes": "SRC BYTES", "dst_bytes": "DST BYTES"}


def feature_names(params: FeatureParams) -> list[str]:
    """Slot names in vector order."""
    names = [f"raw_{c}" for c in RAW if getattr(params, f"use_raw_{c}")]
    names += [f"robust_{c}" for c in ROBUST if getattr(params, f"use_robust_{c}")]
    if params.use_rare_src_ip:
        names.append("rare_src_ip")
    if params.use_protocol_encoding:
        names += ["protocol_tcp", "protocol_udp", "protocol_other"]
    return names


def _required(column: str) -> Column:
    """A missing volume is an error, not a feature."""
    missing = F.raise_error(F.lit(f"null in {column}")).cast("double")
    return F.coalesce(F.col(column).cast("double"), missing)


def _inputs(params: FeatureParams) -> dict[str, Column]:
    scale = 1e6 if params.duration_units == "seconds" else 1.0
    return {"duration": _required("duration_us") / F.lit(scale), **{c: _required(c) for c in RAW[1:]}}


def raw_features(flows: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """log1p of the volumes, negative values as 0."""
    values = _inputs(params)
    wanted = [c for c in RAW if getattr(params, f"use_raw_{c}")]
    return flows.withColumns({f"raw_{c}": log1p_clamped(values[c]) for c in wanted}) if wanted else flows


def robust_features(flows: DataFrame, profile: DataFrame,
                    params: FeatureParams = FeatureParams()) -> DataFrame:
    """Clipped robust scores against `profile` rows `(metric, median, iqr)`.

    The profile reaches the rows as one scalar subquery, not as a join.
    """
    wanted = [c for c in ROBUST if getattr(params, f"use_robust_{c}")]
    if not wanted:
        return flows
    table = profile.filter(F.col("metric").isin([ROBUST[c] for c in wanted])).agg(F.struct(*[
        F.max(F.when(F.col("metric") == ROBUST[c], F.struct("median", "iqr"))).alias(c) for c in wanted
    ])).scalar()
    values = _inputs(params)
    return flows.withColumn("_profile", table).withColumns({
        f"robust_{c}": robust_score(values[c], F.col(f"_profile.{c}.median"), F.col(f"_profile.{c}.iqr"))
        for c in wanted
    }).drop("_profile")


def rare_feature(flows: DataFrame, rare: DataFrame, **kw) -> DataFrame:
    """1.0 where the source address is in `rare(src_ip)`, else 0.0."""
    marked = rare.select("src_ip", F.lit(1.0).alias("_rare"))
    return lookup_join(flows, marked, "src_ip", **kw).withColumn(
        "rare_src_ip", F.coalesce("_rare", F.lit(0.0))).drop("_rare")


def protocol_features(flows: DataFrame) -> DataFrame:
    """TCP / UDP / other in any case; a missing protocol is other."""
    name = F.coalesce(F.upper("protocol"), F.lit("NONE"))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return flows.withColumns({
        "protocol_tcp": flag(name == "TCP"),
        "protocol_udp": flag(name == "UDP"),
        "protocol_other": flag(~name.isin("TCP", "UDP")),
    })


def feature_columns(flows: DataFrame, profile: DataFrame | None, rare: DataFrame | None,
                    params: FeatureParams = FeatureParams(), **kw) -> DataFrame:
    """Adds one column per slot.

    The lookup comes first, so that no computed column is shuffled with its rows. Without `rare`
    the flows bring its result, as `rare_feature` adds it.
    """
    out = rare_feature(flows, rare, **kw) if params.use_rare_src_ip and rare is not None else flows
    out = raw_features(out, params)
    if any(getattr(params, f"use_robust_{c}") for c in ROBUST):
        out = robust_features(out, profile, params)
    if params.use_protocol_encoding:
        out = protocol_features(out)
    return out


def build_features(flows: DataFrame, profile: DataFrame | None, rare: DataFrame | None,
                   params: FeatureParams = FeatureParams(), **kw) -> DataFrame:
    """Adds `features ARRAY<DOUBLE>`; its width follows from `params`."""
    names = feature_names(params)
    if not names:
        raise ValueError("no feature is switched on")
    out = feature_columns(flows, profile, rare, params, **kw)
    return out.select(*flows.columns, F.array(*names).alias("features"))


def vector_inputs(params: FeatureParams) -> list[str]:
    """The columns that `build_features` reads where the flows bring the rare flag."""
    wanted = ["duration_us", *RAW[1:]]
    return wanted + ["rare_src_ip"] * params.use_rare_src_ip + ["protocol"] * params.use_protocol_encoding


def feature_sanity(features: DataFrame) -> DataFrame:
    """Rows, width and the extremes and mean over every element."""
    f = F.col("features")
    per_row = features.select(
        F.size(f).alias("w"), F.array_min(f).alias("lo"), F.array_max(f).alias("hi"),
        F.aggregate(f, F.lit(0.0), lambda a, x: a + x).alias("s"))
    return per_row.agg(
        F.count("*").alias("rows"), F.max("w").alias("width"),
        F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.try_divide(F.sum("s"), F.sum("w")).alias("mean"))
