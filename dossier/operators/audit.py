"""Floors that a build must reach, and the audit that sums them up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import graph as G

PASS, FAIL, DEGRADED = "PASS", "FAIL", "DEGRADED"
#: Shares of entities in the largest component, and of duplicate groups that are merged.
LARGEST, MERGED = 0.90, 0.80


def floors(entity: DataFrame, edge: DataFrame, groups: DataFrame, least_edges: int, people: int, money: float, poison: str) -> DataFrame:
    """(floor, value, needed, ok) of a resolved build.

    groups is (id, gold): ids of one gold group should be one entity. The floors: edges kept, share of
    entities in the largest component, duplicate groups merged, people not merged, edges with a source,
    traces of the planted unsupported entity, money kept on funding edges.
    """
    spark = entity.sparkSession
    n = entity.count()
    sizes = G.components(entity, edge).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    left = groups.join(entity.select("id"), "id").groupBy("gold").agg(F.count(F.lit(1)).alias("n"))
    each = groups.select("gold").distinct().join(left, "gold", "left").agg(F.avg((F.coalesce("n", F.lit(0)) <= 1).cast("int"))).first()[0] or 0.0
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    told = edge.agg(
        F.count(F.lit(1)).alias("edges"), F.count(F.when(blank("provenance") & blank("source_url"), 1)).alias("bare"),
        F.count(F.when((F.col("source_id") == poison) | (F.col("target_id") == poison), 1)).alias("poisoned"),
        F.coalesce(F.sum(F.when(F.col("edge_type") == "FUNDED_BY", F.col("amount_total").cast("double"))), F.lit(0.0)).alias("money"),
    ).first()
    persons = entity.where("entity_type = 'person'").count()
    ghosts = entity.where(F.col("id") == poison).count() + told["poisoned"]
    rows = [
        ("edges", float(told["edges"]), float(least_edges), told["edges"] >= least_edges), ("largest component", largest / max(n, 1), LARGEST, largest / max(n, 1) >= LARGEST), ("merge recall", float(each), MERGED, each >= MERGED),
        ("people", float(persons), float(people), persons >= people), ("edges without source", float(told["bare"]), 0.0, not told["bare"]), ("poison", float(ghosts), 0.0, not ghosts), ("money", told["money"], float(money), told["money"] == money),
    ]
    return spark.createDataFrame(rows, "floor string, value double, needed double, ok boolean")


def audit(checks: dict[str, Callable[[], bool | None]]) -> tuple[list[tuple[str, str, str]], str]:
    """((name, status, detail) of each check, verdict). A check is true, false, or None if what it needs is not there.

    An error is a failure, never a silent pass; one failure fails the audit, and without any a check
    that could not be made degrades it.
    """
    out = []
    for name, check in checks.items():
        try:
            got, detail = check(), ""
        except Exception as e:  # noqa: BLE001
            got, detail = False, f"{type(e).__name__}: {e}"[:200]
        out.append((name, PASS if got else DEGRADED if got is None else FAIL, detail))
    said = {s for _, s, _ in out}
    return out, next((s for s in (FAIL, DEGRADED) if s in said), PASS)
