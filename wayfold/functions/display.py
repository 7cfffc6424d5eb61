"""Arithmetic of the display as Columns: sizes and pixel ratios, camera targets, address parameters, list toggles and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scene's full size, label sizes, the largest canvas, the closest zoom of a target and its margin.
WIDTH, HEIGHT = 960 * 0.8, 540 * 0.8
LARGE, SMALL = 28, 14
CANVAS = 4096
ZOOM, MARGIN = 15, 100


def scene_size(width: Column, height: Column) -> Column:
    """width and height of the scene inside a window: of one shape always, never above the full size; the full size for an empty window."""
    ratio = WIDTH / HEIGHT
    w = F.when((width <= 0) | (height <= 0), F.lit(WIDTH)).otherwise(F.least(width.cast("double"), height * ratio, F.lit(WIDTH)))
    return F.struct(w.alias("width"), F.when((width <= 0) | (height <= 0), F.lit(HEIGHT)).otherwise(w / ratio).alias("height"))


def presentation_scale(width: Column) -> Column:
    return F.when(width > 0, width / WIDTH).otherwise(1.0)


def label_size(size: Column, scale: Column) -> Column:
    return F.when(size == "large", LARGE).otherwise(SMALL) * scale


def pixel_ratio(width: Column, height: Column, shown_width: Column, shown_height: Column, device: Column, canvas: int = CANVAS) -> Column:
    """visual, desired and effective ratio of a canvas: as sharp as the device shows it, but no larger than a canvas may be, and 1 at least."""
    sound = (width > 0) & (height > 0)
    side = lambda shown, own: F.when(sound & (shown > 0), shown / F.when(own > 0, own).otherwise(1)).otherwise(1.0)
    visual = F.least(side(shown_width, width), side(shown_height, height))
    desired = F.when(device > 0, device).otherwise(1) * visual
    most = F.when(sound, F.least(canvas / F.when(width > 0, width).otherwise(1), canvas / F.when(height > 0, height).otherwise(1))).otherwise(1.0)
    return F.struct(visual.alias("visual"), desired.alias("desired"), F.greatest(F.lit(1.0), F.least(desired, most)).alias("effective"))


def dark(behaviour: Column, manual: Column, active: Column) -> Column:
    """Whether the base map is dark: by what is active where that decides, else as set."""
    return F.when(behaviour == "auto", active).otherwise(manual)


def camera_target(kind: Column, geometry_type: Column, own: Column, scene: Column) -> Column:
    """mode (point, scene or box), bounds and margin (null for the scene's own) of the view that shows a feature."""
    whole = kind.isin("historical-road", "railway")
    point = geometry_type == "Point"
    mode = F.when(point, "point").when(whole, "scene").otherwise("box")
    return F.struct(mode.alias("mode"), F.when(point, own).when(whole, scene).otherwise(own).alias("bounds"), F.when(point | whole, F.lit(None).cast("int")).otherwise(MARGIN).alias("margin"), F.when(point, ZOOM).alias("zoom"))


def parameter(search: Column, name: str) -> Column:
    """The first value of a parameter of an address, decoded; null without it, empty without a value."""
    pairs = F.transform(F.split(F.regexp_replace(search, r"^\?", ""), "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    return F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"]


def story_parameters(search: Column) -> Column:
    """story, project (null where blank), capture, autoplay (as capture where it is not given) and time (0 or more, null where it is no number)."""
    given = lambda n: F.nullif(F.trim(parameter(search, n)), F.lit(""))
    capture = F.coalesce(parameter(search, "capture") == "1", F.lit(False))
    raw = F.trim(parameter(search, "t"))
    time = F.when(raw == "", F.lit(0.0)).otherwise(raw.try_cast("double"))
    sound = time.isNotNull() & ~F.isnan(time) & (F.abs(time) < float("inf"))
    return F.struct(given("story").alias("story"), given("project").alias("project"), capture.alias("capture"), F.coalesce(parameter(search, "autoplay") == "1", capture).alias("autoplay"), F.when(sound, F.greatest(time, F.lit(0.0))).alias("time"))


def toggled(values: Column, value: Column) -> Column:
    """A list without a value that it has, or with it at the end."""
    return F.when(F.array_contains(values, value), F.filter(values, lambda v: v != value)).otherwise(F.array_append(values, value))


def route_toggled(roads: Column, posts: Column, route: Column) -> Column:
    """roads and posts after a route is chosen or dropped: choosing adds its posts too, dropping leaves them."""
    adding = ~F.array_contains(roads, route) & ~F.array_contains(posts, route)
    return F.struct(toggled(roads, route).alias("roads"), F.when(adding, F.array_append(posts, route)).otherwise(posts).alias("posts"))


def continuity_text(checked: Column, resolved: Column, unresolved: Column) -> Column:
    return F.format_string("%s transitions checked · %s connected / auto repaired · %s unresolved", checked, resolved, unresolved)
