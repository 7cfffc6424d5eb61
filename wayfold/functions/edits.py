"""Edits of a story's steps and a scene's items, as expressions over arrays; every one gives the array back where there is nothing to do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that the camera takes to an activated feature.
CAMERA_SECONDS = 0.8


def _index(steps: Column, key: Column) -> Column:
    """Place of the step with a key, from 0; -1 if there is none."""
    return F.coalesce(F.array_position(F.transform(steps, lambda s: s["key"]), key), F.lit(0)).cast("int") - 1


def _upto(steps: Column, n: Column) -> Column:
    return F.slice(steps, F.lit(1), F.greatest(n, F.lit(0)))


def _behind(steps: Column, n: Column) -> Column:
    """What follows the first n."""
    return F.slice(steps, n + 1, F.greatest(F.size(steps) - n, F.lit(0)))


def insert_step(steps: Column, selected: Column, entry: Column) -> Column:
    """The entry behind the selected step, or at the end without a selection; a selection that does not exist puts it first."""
    at = F.when(selected.isNull(), F.size(steps)).otherwise(_index(steps, selected) + 1)
    return F.concat(_upto(steps, at), F.array(entry), _behind(steps, at))


def reorder_step(steps: Column, start: Column, to: Column) -> Column:
    """The step at one place moved to another, places from 0."""
    n = F.size(steps)
    rest = F.concat(_upto(steps, start), _behind(steps, start + 1))
    moved = F.concat(_upto(rest, to), F.array(F.get(steps, start)), _behind(rest, to))
    return F.when((start != to) & (start >= 0) & (to >= 0) & (start < n) & (to < n), moved).otherwise(steps)


def duplicate_step(steps: Column, key: Column, new_key: Column) -> Column:
    """A copy under a new key behind the step with the key."""
    at = _index(steps, key)
    copy = F.get(steps, F.greatest(at, F.lit(0))).withField("key", new_key)
    return F.when(at >= 0, F.concat(_upto(steps, at + 1), F.array(copy), _behind(steps, at + 1))).otherwise(steps)


def delete_step(steps: Column, key: Column) -> Column:
    return F.filter(steps, lambda s: s["key"] != key)


def selected_after_delete(steps: Column, selected: Column, key: Column) -> Column:
    """The key selected behind a deletion: the step that takes the place of a deleted selection, or the last one."""
    left = delete_step(steps, key)
    follower = F.get(left, F.least(F.greatest(_index(steps, key), F.lit(0)), F.size(left) - 1))["key"]
    return F.when((_index(steps, key) >= 0) & (selected == key), F.when(F.size(left) > 0, follower)).otherwise(selected)


def update_step(steps: Column, key: Column, step: Column) -> Column:
    return F.transform(steps, lambda s: F.when(s["key"] == key, s.withField("step", step)).otherwise(s))


def show_item(items: Column, id_: Column) -> Column:
    """Items (id, visible, backed) with the one asked for visible, at the end if it is new."""
    have = F.exists(items, lambda i: i["id"] == id_)
    shown = F.transform(items, lambda i: F.when(i["id"] == id_, i.withField("visible", F.lit(True))).otherwise(i))
    return F.when(have, shown).otherwise(F.concat(items, F.array(F.struct(id_.alias("id"), F.lit(True).alias("visible"), F.lit(False).alias("backed")))))


def hide_item(items: Column, id_: Column) -> Column:
    return F.transform(items, lambda i: F.when(i["id"] == id_, i.withField("visible", F.lit(False))).otherwise(i))


def focus_after_hide(active: Column, id_: Column) -> Column:
    """The item in focus; hiding or removing it clears the focus."""
    return F.nullif(active, id_)


def remove_item(items: Column, id_: Column) -> Column:
    """Items without the one asked for; what the project brings stays."""
    return F.filter(items, lambda i: (i["id"] != id_) | i["backed"])


def clear_items(items: Column) -> Column:
    return F.filter(items, lambda i: i["backed"])


def feature_step(id_: Column, action: Column) -> Column:
    """The step that a search result makes: show, activate (which also moves the camera) or hide."""
    return F.struct(action.alias("action"), id_.alias("id"), F.when(action == "activate", F.lit(CAMERA_SECONDS)).alias("cameraDuration"))


def story_json(story: Column) -> Column:
    """Text of a story (id, displayName, project, steps) in the order of its fields; an error without an id or steps."""
    bad = story["id"].isNull() | story["steps"].isNull() | F.exists(story["steps"], lambda s: s["action"].isNull())
    return F.when(bad, F.raise_error(F.lit("a story needs an id and steps with actions"))).otherwise(F.to_json(story))


def story_of(text: Column, schema: str) -> Column:
    """A story from its text; null if it is malformed."""
    return F.from_json(text, schema)
