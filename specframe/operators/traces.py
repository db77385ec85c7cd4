"""Plot data: each style turns points (plot, x, y, text) into drawn ones.

A null point ends a stroke.  Results are rows (plot, trace, point, pos, x, y,
text) that ``to_json`` turns into one document a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = {"micro": 10_000, "tiny": 2_000, "small": 200, "medium": 100, "big": 50}
STYLES = ("sticks", "triangle", "lines", "points", "label.hoverinfo", "label.sticks", "label.triangle", "label.linear", "label.spline")
POSITIONS = {"top": 1.0, "bottom": -0.05}


def validate(style: str) -> tuple[str, str]:
    """Name and option of a style, or an error."""
    for name in sorted(STYLES, key=len, reverse=True):
        if style == name or style.startswith(name + "."):
            option = style[len(name) + 1 :]
            if name in ("triangle", "label.triangle"):
                if option and option not in WIDTHS:
                    raise ValueError(f"no such triangle width: {option}")
            elif name in ("label.linear", "label.spline"):
                if option not in ("", *POSITIONS):
                    raise ValueError(f"no such label position: {option}")
            elif option:
                raise ValueError(f"{name} takes no option")
            return name, option
    raise ValueError(f"no such style: {style}")


def in_range(points: DataFrame, mz_range: tuple[float, float] | None = None, int_range: tuple[float, float] | None = None) -> DataFrame:
    """Points within both ranges, ends included."""
    for c, r in (("x", mz_range), ("y", int_range)):
        if r is not None:
            points = points.where(F.col(c).between(*r))
    return points


def _text(points: DataFrame) -> Column:
    return F.col("text") if "text" in points.columns else F.lit(None).cast("string")


def _strokes(points: DataFrame, drawn: list[tuple[Column, Column]], keys: list[str]) -> DataFrame:
    text = _text(points)
    null = F.lit(None).cast("double")
    steps = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), text.alias("text")) for x, y in drawn]
    steps.append(F.struct(null.alias("x"), null.alias("y"), F.lit(None).cast("string").alias("text")))
    return points.select(*keys, F.posexplode(F.array(*steps)).alias("pos", "p")).select(*keys, "pos", "p.x", "p.y", "p.text")


def sticks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Up from the axis and down again."""
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    return _strokes(points, [(x, zero), (x, y), (x, zero)], keys)


def triangles(points: DataFrame, keys: list[str], width: str = "medium", precision: float | None = None, plot: str = "plot") -> DataFrame:
    """A triangle on the axis; as wide as the precision, or a share of the plot's greatest x."""
    if precision is not None:
        w = F.col("x") * precision
    else:
        if width not in WIDTHS:
            raise ValueError(f"no such triangle width: {width}")
        widest = points.groupBy(plot).agg(F.max("x").alias("__widest"))
        points = points.join(widest, plot)
        w = F.col("__widest") / WIDTHS[width]
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    return _strokes(points, [(x - w, zero), (x, y), (x + w, zero)], keys)


def spans(points: DataFrame, keys: list[str], position: str = "top", plot: str = "plot") -> DataFrame:
    """Labels over a span (x0, x1): level at the plot's greatest y, or 5 per cent of it below the axis."""
    if position not in POSITIONS:
        raise ValueError(f"no such label position: {position}")
    highest = points.groupBy(plot).agg(F.max("y").alias("__highest"))
    level = F.col("__highest") * POSITIONS[position]
    return _strokes(points.join(highest, plot), [(F.col("x0"), level), ((F.col("x0") + F.col("x1")) / 2, level), (F.col("x1"), level)], keys)


def trace(points: DataFrame, style: str, keys: list[str], precision: float | None = None) -> DataFrame:
    """Points in any style."""
    name, option = validate(style)
    if name.startswith("label.") and "text" not in points.columns:
        raise ValueError("a label needs a text")
    if name.endswith("sticks"):
        return sticks(points, keys)
    if name.endswith("triangle"):
        return triangles(points, keys, option or "medium", precision)
    if name in ("label.linear", "label.spline"):
        return spans(points, keys, option or "top")
    return points.select(*keys, F.lit(0).alias("pos"), "x", "y", _text(points).alias("text"))


def extents(points: DataFrame, plot: str = "plot") -> DataFrame:
    return points.groupBy(plot).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def to_json(traces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys…, json: one document for each trace, its points in order."""
    points = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "x", "y", "text"]))))
    drawn = F.to_json(F.struct(*[F.col(f"p.{c}").alias(c) for c in ("x", "y", "text")]), {"ignoreNullFields": "false"})
    return traces.groupBy(*keys).agg(points.alias("p")).select(*keys, drawn.alias("json"))


def to_html(drawn: DataFrame, keys: list[str], order: list[str], width: int = 900, height: int = 400) -> DataFrame:
    """keys…, html: one page for each trace with its strokes as a drawing; texts are its tool tips' lines."""
    points = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "x", "y", "text"]))))
    grouped = drawn.groupBy(*keys).agg(points.alias("p"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    at = lambda c, low, high, size: F.format_string("%.2f", F.coalesce(F.try_divide((c - F.col(low)) * size, F.col(high) - F.col(low)), F.lit(size / 2)))
    # A null point ends a stroke: the next one moves instead of drawing on.
    begins = lambda i: (i == 0) | F.get(F.col("p"), i - 1)["x"].isNull()
    step = lambda q, i: F.when(q["x"].isNotNull(), F.concat(F.when(begins(i), "M").otherwise("L"), at(q["x"], "min_x", "max_x", width), F.lit(" "), at(F.lit(0) - q["y"] + F.col("max_y") + F.col("min_y"), "min_y", "max_y", height))).otherwise("")
    path = F.array_join(F.transform("p", step), "")
    escaped = F.replace(F.replace(F.replace(F.array_join(F.array_distinct(F.transform(F.filter("p", lambda q: q["text"].isNotNull()), lambda q: q["text"])), "\n"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit(f'<!DOCTYPE html><html><body><svg width="{width}" height="{height}" viewBox="0 0 {width} {height}"><title>'), escaped, F.lit('</title><path fill="none" stroke="black" d="'), path, F.lit('"/></svg></body></html>'))
    return grouped.select(*keys, html.alias("html"))


def numbered(points: DataFrame, plot: str = "plot") -> DataFrame:
    return points.withColumn("point", F.row_number().over(Window.partitionBy(plot).orderBy("x", "y")))
