"""Lookups, memberships, overlays and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the order; the order must name one row."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def conflicts(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys whose rows disagree in their payload, with the number of payloads."""
    each = rows.select(*keys, F.struct(*payload).alias("_p")).distinct()
    return each.groupBy(*keys).agg(F.count("*").alias("n_payloads")).where("n_payloads > 1")


def ordered_lookup(lists: DataFrame, keys: list[str], ids: str, table: DataFrame, id_col: str) -> DataFrame:
    """Rows of the table for each id of each list, in the list's order (``pos``); ids without a row have ``found`` false."""
    flat = lists.select(*keys, F.posexplode(ids).alias("pos", id_col))
    return flat.join(table.withColumn("found", F.lit(True)), id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def by_id(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The rows that are asked for; an id without a row is an error when the result is read."""
    found = wanted.select(id_col).distinct().join(rows.withColumn("_found", F.lit(True)), id_col, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row has {id_col} "), F.col(id_col).cast("string")))
    return found.where(F.when(F.col("_found"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_found")


def members(rows: DataFrame, owner: str, member: str, order: list[str], into: str) -> DataFrame:
    """One row an owner with its members in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, member)))
    return rows.groupBy(owner).agg(F.transform(ordered, lambda x: x[member]).alias(into))


def ambiguous_lookup(rows: DataFrame, key: str, fields: list[str], aliases: DataFrame, alias: str, entry: str) -> DataFrame:
    """For each row the entry that its first field with any match names, if just one does.

    Fields are tried in order.  A field whose value is the alias of no entry passes on to the next; of one, decides; of several,
    ends the search without a result.
    """
    flat = rows.select(key, F.posexplode(F.array(*fields)).alias("priority", alias)).where(F.col(alias).isNotNull())
    named = aliases.select(alias, entry).distinct().groupBy(alias).agg(F.count("*").alias("_n"), F.min(entry).alias("_entry"))
    hit = flat.join(named, alias).groupBy(key).agg(F.min_by(F.struct("_n", "_entry", "priority"), F.col("priority")).alias("_m"))
    return rows.join(hit, key, "left").select(*rows.columns, F.when(F.col("_m._n") == 1, F.col("_m._entry")).alias(entry), (F.coalesce("_m._n", F.lit(0)) > 1).alias("ambiguous"))


def overlay(automatic: DataFrame, include: DataFrame, exclude: DataFrame, key: str, pool: DataFrame | None = None) -> DataFrame:
    """key, source and whether the key was automatic: automatic keys that are neither excluded nor included, and every included key as a manual one.

    A key that is both included and excluded, and with a pool a key that the pool lacks, is an error.
    """
    manual, out = include.select(key).distinct(), exclude.select(key).distinct()
    both = manual.join(out, key, "left_semi").orderBy(key).first()
    if both:
        raise ValueError(f"{key} {both[0]} is both included and excluded")
    if pool is not None:
        unknown = manual.union(out).join(pool.select(key), key, "left_anti").orderBy(key).first()
        if unknown:
            raise ValueError(f"{key} {unknown[0]} is none of the rows to choose from")
    auto = automatic.select(key).distinct()
    kept = auto.join(out.union(manual), key, "left_anti").select(key, F.lit("accepted-auto").alias("source"), F.lit(True).alias("automatic"))
    added = manual.join(auto.withColumn("automatic", F.lit(True)), key, "left").select(key, F.lit("accepted-manual").alias("source"), F.coalesce("automatic", F.lit(False)).alias("automatic"))
    return kept.union(added)


def frontier(edges: DataFrame, selected: DataFrame, excluded: DataFrame, node: str = "node") -> DataFrame:
    """Neighbours of the selected nodes that are neither selected nor excluded; edges have a and b, and go both ways."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    near = both.join(selected.select(F.col(node).alias("a")), "a", "left_semi").select(F.col("b").alias(node)).distinct()
    return near.join(selected.select(node), node, "left_anti").join(excluded.select(node), node, "left_anti")


def bounded_paths(edges: DataFrame, start: DataFrame, most: int, node: str = "node") -> DataFrame:
    """Simple paths of 1 to ``most`` edges from the start nodes, as arrays of nodes."""
    both = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b")).union(edges.select("b", "a")).distinct()
    now = start.select(F.array(node).alias("path"))
    out = None
    for _ in range(most):
        now = now.join(both, F.element_at("path", -1) == F.col("_a")).where(~F.expr("array_contains(path, _b)")).select(F.concat("path", F.array("_b")).alias("path"))
        out = now if out is None else out.union(now)
    return out


def best_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key in the order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def dimmed(rows: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """The rows that a choice leaves in the background: all that are not chosen, and none where nothing is."""
    some = chosen.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return rows.join(some, id_col, "left_anti").join(some.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi")


def available(rows: DataFrame, files: DataFrame, id_col: str, kind: str, wanted: list[str]) -> DataFrame:
    """The rows that have a file of every wanted kind."""
    whole = files.where(F.col(kind).isin(wanted)).groupBy(id_col).agg(F.countDistinct(kind).alias("_n")).where(F.col("_n") == len(set(wanted)))
    return rows.join(whole, id_col, "left_semi")
