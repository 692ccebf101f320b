"""Lineage in tables: ancestors, integrity, cache reuse, replay checks and rendering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import identity as ids
from . import catalog

MAX_DEPTH = 256


def edges(arguments: DataFrame) -> DataFrame:
    """(child, parent) between recipes."""
    return arguments.where("parent_kind = 'recipe'").selectExpr("recipe_id child", "parent_id parent").distinct()


def ancestors(arguments: DataFrame, roots: DataFrame, limit: int = MAX_DEPTH, keep=None) -> DataFrame:
    """(root, id, depth): every recipe that a root derives from, with its least distance; the root itself at 0.

    The frontier of each step holds new nodes only, so shared ancestors are walked once. keep writes a
    step's table (for example to a checkpoint folder), so that lineage stays short on deep graphs.
    """
    keep = keep or (lambda df: df.checkpoint())
    links = edges(arguments).persist()
    frontier = roots.select(F.col("recipe_id").alias("root"), F.col("recipe_id").alias("id")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, limit + 2):
        step = frontier.join(links, F.col("id") == F.col("child")).select("root", F.col("parent").alias("id")).distinct()
        frontier = keep(step.join(seen, ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            links.unpersist()
            return seen
        if depth > limit:
            break
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))
    raise EngineError(f"lineage is deeper than {limit} steps or holds a cycle")


RECURSIVE = """
WITH RECURSIVE up(root, id, depth) AS (
  SELECT recipe_id, recipe_id, 0 FROM {roots}
  UNION ALL
  SELECT up.root, e.parent, up.depth + 1 FROM up JOIN {edges} e ON e.child = up.id WHERE up.depth < {limit}
) SELECT root, id, min(depth) AS depth FROM up GROUP BY root, id
"""


def recomputed_recipes(t: Mapping[str, DataFrame], ns: ids.Namespace = ids.DEFAULT) -> DataFrame:
    """(recipe_id, actual): each stored recipe with the id that its rows give."""
    part = F.struct("argument_index", F.col("semantic_kind").alias("kind"), F.col("semantic_id").alias("id"))
    args = t["lineage_arguments"].groupBy("recipe_id").agg(F.array_sort(F.collect_list(part)).alias("args"))
    deps = t["invocation_observations"].groupBy("recipe_id").agg(F.collect_list("dependency_id").alias("deps"))
    rows = t["lineage_invocations"].join(args, "recipe_id", "left").join(deps, "recipe_id", "left")
    none = F.expr("cast(array() as array<struct<argument_index:int,kind:string,id:string>>)")
    actual = ids.recipe_id(F.col("transform_id"), F.transform(F.coalesce("args", none), lambda a: F.struct(a.getField("kind").alias("kind"), a.getField("id").alias("id"))), F.coalesce("deps", F.expr("cast(array() as array<string>)")), ns)
    return rows.select("recipe_id", actual.alias("actual"))


def argument_issues(t: Mapping[str, DataFrame], ns: ids.Namespace = ids.DEFAULT) -> DataFrame:
    """(recipe_id, argument_index, issue) of arguments whose parts contradict each other."""
    a = t["lineage_arguments"].alias("a")
    sources = t["source_assets"].select("source_id", "locator", F.col("content_id").alias("source_content"))
    known = t["lineage_invocations"].select(F.col("recipe_id").alias("known"))
    rows = a.join(sources, (F.col("a.parent_kind") == "source") & (F.col("a.parent_id") == F.col("source_id")), "left")
    rows = rows.join(known, (F.col("a.parent_kind") == "recipe") & (F.col("a.parent_id") == F.col("known")), "left")
    issue = (
        F.when(~F.col("a.semantic_kind").isin("content", "source", "recipe"), "unknown semantic kind")
        .when(F.col("a.parent_kind").isNotNull() & (F.col("a.semantic_kind") != F.col("a.parent_kind")), "parent of another kind")
        .when(F.col("a.parent_kind").isNotNull() & (F.col("a.semantic_id") != F.col("a.parent_id")), "identity differs from its parent")
        .when((F.col("a.parent_kind") == "source") & F.col("source_id").isNull(), "unknown source")
        .when((F.col("a.parent_kind") == "source") & (ids.source_id(F.col("locator"), F.col("source_content"), ns) != F.col("a.parent_id")), "source does not match its identity")
        .when((F.col("a.parent_kind") == "recipe") & F.col("known").isNull(), "unknown recipe")
        .when(F.col("a.parent_kind").isNull() & (F.col("a.semantic_kind") != "content"), "lineage identity without a parent")
    )
    return rows.select("a.recipe_id", "a.argument_index", issue.alias("issue")).where("issue is not null")


# ---- reuse of results -------------------------------------------------------------------


def cached(requests: DataFrame, t: Mapping[str, DataFrame], ns: ids.Namespace = ids.DEFAULT, host: str = "orebed") -> DataFrame:
    """requests(recipe_id, ...) with content_id and hit; a result whose object, of any kind, fails its hash is a miss."""
    wanted = t["recipe_results"].join(requests.select("recipe_id").distinct(), "recipe_id", "left_semi")
    kinds = catalog.contents(t).join(wanted.select("content_id").distinct(), "content_id", "left_semi").select("content_id", "kind")
    proven = catalog.with_actual(kinds.join(t["objects"].select("content_id", "data"), "content_id"), ns, host)
    results = wanted.join(proven.where("actual = content_id").select("content_id"), "content_id", "left_semi").select("recipe_id", "content_id")
    return requests.join(results, "recipe_id", "left").withColumn("hit", F.col("content_id").isNotNull())


def replay_mismatches(recomputed: DataFrame, recorded: DataFrame) -> DataFrame:
    """(recipe_id, expected, actual) where a recomputed result differs from the recorded one, or is missing."""
    a = recorded.select("recipe_id", F.col("content_id").alias("expected"))
    b = recomputed.select("recipe_id", F.col("content_id").alias("actual"))
    return a.join(b, "recipe_id", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def changed_dependencies(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded observations that the world no longer gives: (dependency_id, expected, actual)."""
    now = live.select("capability", "observation_key", F.col("observed_content_id").alias("actual"))
    out = recorded.join(now, ["capability", "observation_key"], "left")
    return out.where(~F.col("observed_content_id").eqNullSafe(F.col("actual"))).select("dependency_id", F.col("observed_content_id").alias("expected"), "actual")


def changed_sources(t: Mapping[str, DataFrame], live: DataFrame, ns: ids.Namespace = ids.DEFAULT) -> DataFrame:
    """Recorded sources whose locator now reads as another content."""
    now = live.select("locator", ids.raw_content_id(F.col("data"), ns).alias("actual"))
    used = t["lineage_arguments"].where("parent_kind = 'source'").select(F.col("parent_id").alias("source_id")).distinct()
    out = t["source_assets"].join(used, "source_id", "left_semi").join(now, "locator", "left")
    return out.where(~F.col("content_id").eqNullSafe(F.col("actual"))).select("source_id", "locator", F.col("content_id").alias("expected"), "actual")
