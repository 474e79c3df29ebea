"""Flat tables from nested policy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.listings import latest

ASPECTS = (
    "aspects array<struct<localizedAspectName:string,"
    "aspectConstraint:struct<aspectRequired:boolean,aspectMode:string,aspectMaxLength:int,itemToAspectCardinality:string>,"
    "aspectValues:array<struct<localizedValue:string>>>>"
)
CONDITIONS = (
    "itemConditionPolicies array<struct<categoryId:string,itemConditions:array<struct<conditionId:string,"
    "conditionDescriptors:array<struct<name:string,conditionDescriptorId:string,"
    "values:array<struct<conditionDescriptorValueId:string,conditionDescriptorValueName:string>>>>>>>>"
)


def flatten_aspects(policies: DataFrame, json: str = "payload") -> DataFrame:
    """One row per named aspect: name, required, selection_only, values, max_length, cardinality; other columns stay."""
    keep = [c for c in policies.columns if c != json]
    rows = policies.select(*keep, F.explode(F.from_json(json, ASPECTS)["aspects"]).alias("a"))
    c = F.col("a.aspectConstraint")
    return rows.where(F.coalesce("a.localizedAspectName", F.lit("")) != "").select(
        *keep,
        F.col("a.localizedAspectName").alias("name"),
        F.coalesce(c["aspectRequired"], F.lit(False)).alias("required"),
        F.coalesce(c["aspectMode"] == "SELECTION_ONLY", F.lit(False)).alias("selection_only"),
        F.filter(F.coalesce("a.aspectValues.localizedValue", F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")).alias("values"),
        c["aspectMaxLength"].alias("max_length"),
        F.when(c["itemToAspectCardinality"] == "MULTI", "MULTI").otherwise("SINGLE").alias("cardinality"),
    )


def flatten_condition_policies(policies: DataFrame, json: str = "payload") -> DataFrame:
    """One row per category, condition, descriptor and value, with its position in the document."""
    keep = [c for c in policies.columns if c != json]
    rows = policies.select(*keep, F.posexplode(F.from_json(json, CONDITIONS)["itemConditionPolicies"]).alias("p0", "p"))
    rows = rows.select(*keep, "p0", F.col("p.categoryId").alias("category_id"), F.posexplode_outer("p.itemConditions").alias("p1", "i"))
    rows = rows.select(*keep, "p0", "p1", "category_id", F.col("i.conditionId").alias("condition_id"), F.posexplode_outer("i.conditionDescriptors").alias("p2", "d"))
    rows = rows.select(
        *keep, "p0", "p1", "p2", "category_id", "condition_id", F.col("d.name").alias("descriptor_name"),
        F.col("d.conditionDescriptorId").alias("descriptor_id"), F.posexplode_outer("d.values").alias("p3", "v"),
    )
    return rows.select(
        *keep, "category_id", "condition_id", "descriptor_name", "descriptor_id",
        F.col("v.conditionDescriptorValueId").alias("value_id"), F.col("v.conditionDescriptorValueName").alias("value_name"),
        F.struct("p0", "p1", "p2", "p3").alias("position"),
    )


def upsert_policy_cache(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The newest payload of each marketplace, category and environment."""
    return latest(cache.unionByName(fetched), ["marketplace", "category_id", "environment"], ["fetched_at"])
