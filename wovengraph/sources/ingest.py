"""Many new resources in one batch, with client IDs for the links among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.functions import text


def minted(resources: DataFrame, base: str, batch: str) -> DataFrame:
    """Client IDs with IRIs. A retried task mints the same IRI, since it follows from batch and client ID."""
    uuid = text.stable_uuid(F.lit(batch), F.col("client_id"))
    return resources.select("client_id", F.concat_ws("/", F.lit(base), text.uuid_to_base64(uuid)).alias("iri"))


def bulk_ingest(
    resources: DataFrame, values: DataFrame, links: DataFrame, base: str, batch: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Resources, values and links under their new IRIs, and what could not be resolved.

    resources: (client_id, ...); values: (client_id, prop, ...); links:
    (client_id, prop, target), where a target ``ref:ID`` is a client ID of the
    batch. Problems: (client_id, prop, target, problem), for duplicate client
    IDs, unknown owners and dangling references.
    """
    counted = resources.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    twice = counted.where("n > 1").select("client_id")
    once = resources.join(twice, "client_id", "left_anti")
    ids = minted(once, base, batch)
    new_resources = once.join(ids, "client_id")
    new_values = values.join(ids.withColumnRenamed("iri", "resource"), "client_id")
    resolved = text.resolve_client_references(links.withColumn("_asked", F.col("target")), "target", ids)
    owned = resolved.join(ids.withColumnRenamed("iri", "src"), "client_id", "left")
    new_links = owned.where("src IS NOT NULL AND target IS NOT NULL").select("client_id", "src", "prop", F.col("target").alias("dst"))
    none = F.lit(None).cast("string")
    problems = (
        twice.select("client_id", none.alias("prop"), none.alias("target"), F.lit("duplicate client ID").alias("problem"))
        .union(values.join(ids, "client_id", "left_anti").select("client_id", "prop", none, F.lit("unknown owner")))
        .union(owned.where("src IS NULL").select("client_id", "prop", "_asked", F.lit("unknown owner")))
        .union(owned.where("src IS NOT NULL AND target IS NULL").select("client_id", "prop", "_asked", F.lit("dangling reference")))
    )
    return new_resources, new_values, new_links, problems
