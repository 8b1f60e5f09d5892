"""Shaping of small results: treemap layout, caller patterns, budgets, envelopes, follow-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squarified(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, width, height) of areas in proportion to falling positive values: rows are filled
    along the shorter side as long as that improves their worst aspect ratio."""
    out: list[tuple[float, float, float, float]] = []
    areas = [v * w * h / total for v in values] if (total := sum(values)) > 0 else []

    def worst(row: list[float], side: float) -> float:
        s = sum(row)
        return max(max(side * side * a / (s * s), s * s / (side * side * a)) for a in row)

    while areas:
        side, row = min(w, h), [areas[0]]
        while len(row) < len(areas) and worst([*row, areas[len(row)]], side) <= worst(row, side):
            row.append(areas[len(row)])
        areas, depth, at = areas[len(row) :], sum(row) / side, 0.0
        for a in row:
            size = a / depth
            out.append((x, y + at, depth, size) if w >= h else (x + at, y, size, depth))
            at += size
        x, y, w, h = (x + depth, y, w - depth, h) if w >= h else (x, y + depth, w, h - depth)
    return out


def treemap(rows: DataFrame, group: str, node: str, value: str, width: float = 100.0, height: float = 60.0) -> DataFrame:
    """A treemap for each group, ``group, node, x, y, w, h``; groups are pictures, so they are small. Rows
    without a positive value are left out."""
    kinds = dict(rows.dtypes)

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, node], ascending=[False, True])
        boxes = squarified(pdf[value].astype(float).tolist(), 0.0, 0.0, width, height)
        return pd.DataFrame({group: pdf[group], node: pdf[node], **{c: [b[k] for b in boxes] for k, c in enumerate("xywh")}})

    schema = f"{group} {kinds[group]}, {node} {kinds[node]}, x double, y double, w double, h double"
    return rows.filter(F.col(value) > 0).groupBy(group).applyInPandas(lay, schema)


def caller_pattern(callers: DataFrame, owner: str, name: str, directory: str, share: float = 0.5) -> DataFrame:
    """``owner, pattern``: the directory if all callers are in one, else the longest prefix of 3 to 10
    characters that more than ``share`` of the names have (then by the alphabet); null without either."""
    dirs = callers.groupBy(owner).agg(F.min(directory).alias("_lo"), F.max(directory).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    each = callers.select(owner, name, F.explode(F.sequence(F.lit(3), F.lit(10))).alias("_k")).filter(F.length(name) >= F.col("_k"))
    prefixes = each.groupBy(owner, F.expr(f"substring({name}, 1, _k)").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    common = prefixes.join(dirs.select(owner, "_n"), owner).filter(F.col("_c") > F.col("_n") * share)
    best = common.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(F.length("_p").desc(), "_p"))).filter("_r = 1")
    return dirs.join(best.select(owner, "_p"), owner, "left").select(owner, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_p")).alias("pattern"))


def budgeted_groups(rows: DataFrame, group: str, order: list[Column | str], cap: int) -> DataFrame:
    """At most ``cap`` rows: those from the tail of the largest group go first. A row's place in its group
    is its cost, so equal places of all groups stay or go together, the smaller group first on ties."""
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.filter(F.col("_place") <= cap).orderBy("_place", group).limit(cap).drop("_place")


def envelope(rows: DataFrame, columns: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """One row ``ok, total, truncated, results`` with a JSON array of the first rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.select(*columns).orderBy(*order).limit(limit).withColumn("_n", F.monotonically_increasing_id())
    packed = top.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*columns).alias("row")))), lambda s: s["row"])).alias("results"))
    return total.crossJoin(packed).select((F.col("total") > 0).alias("ok"), "total", (F.col("total") > limit).alias("truncated"), "results")


def follow_ups(command: str, n: int) -> list[str]:
    """Suggestions after a command, by the number of its results."""
    if n == 0:
        return {"refs": ["search for the name", "check the index state"], "impact": ["list references"]}.get(command, ["search for the name"])
    return {"refs": ["show callers"], "impact": ["run the covering tests", "plan the change"]}.get(command, [])


def follow_ups_of(command: str, n: Column) -> Column:
    """``follow_ups`` for each row, by its number of results; a missing number is none."""
    said = lambda k: F.array(*map(F.lit, follow_ups(command, k))).cast("array<string>")
    return F.when(F.coalesce(n, F.lit(0)) == 0, said(0)).otherwise(said(1))


def lerp_colour(low: tuple[int, int, int], high: tuple[int, int, int], share: Column) -> Column:
    """Hex colour between two."""
    s = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    part = [F.lpad(F.lower(F.hex(F.round(F.lit(float(a)) + (b - a) * s).cast("int"))), 2, "0") for a, b in zip(low, high, strict=True)]
    return F.concat(F.lit("#"), *part)
