"""What a graph view needs: tags by rules, years, a timeline, tallies, no dangling edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X

Rules = list[tuple[str, str]]


def tagged(entity: DataFrame, domains: Rules, stories: Rules, default: str = "other", text: str = "label") -> DataFrame:
    """entity with its year, the domain of the first rule that fits, and the stories of all that fit."""
    c = F.coalesce(F.col(text), F.lit(""))
    return entity.withColumns({"year": F.nullif(X.year(c), F.lit("")).cast("int"), "domain": X.first_rule(c, domains, default), "stories": X.all_rules(c, stories)})


def timeline(entity: DataFrame) -> DataFrame:
    """(id, label, year) of the entities with a year, in its order."""
    return entity.where("year is not null").select("id", "label", "year").orderBy("year", "id")


def view(entity: DataFrame, edge: DataFrame, domains: Rules, stories: Rules, default: str = "other") -> dict[str, DataFrame]:
    """Tables of a view: nodes with tags, edges with both ends, and tallies (what, name, n) of domains, types and stories."""
    nodes = tagged(entity, domains, stories, default)
    ids = nodes.select("id")
    whole = edge.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    tally = lambda what, c: nodes.select(F.lit(what).alias("what"), c.alias("name")).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))
    tallies = tally("domain", F.col("domain")).union(tally("type", F.col("entity_type"))).union(tally("story", F.explode("stories")))
    return {"nodes": nodes, "edges": whole.select("source_id", "target_id", "edge_type"), "tallies": tallies}


def limited(rows: DataFrame, most: int) -> DataFrame:
    """The first most of ordered rows with a column truncated, true if there are more; one row over the limit is read to tell."""
    found = rows.limit(most + 1)
    return rows.limit(most).withColumn("truncated", F.lit(found.count() > most))
