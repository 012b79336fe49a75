"""Placed objects (object_id, layout, x, y, type) against label grids (x, y, tag)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, spatial


def surface_flags(objects: DataFrame, label: DataFrame, road: int, paved: list[int]) -> DataFrame:
    """Adds tag, on_road, on_paved and on_invalid (no label); one equi-join on the rounded pixel."""
    o = objects.withColumns({"px": F.bround(F.col("x").cast("double")).cast("long"), "py": F.bround(F.col("y").cast("double")).cast("long")})
    j = o.join(label.select(F.col("x").alias("px"), F.col("y").alias("py"), "tag"), ["px", "py"], "left")
    is_in = lambda tags: F.coalesce(F.col("tag").isin(tags), F.lit(False))
    return j.drop("px", "py").withColumns({"on_road": is_in([road]), "on_paved": is_in(paved), "on_invalid": F.col("tag").isNull()})


def pass_rates(flags: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per layout and type: total, passed and rate, each type by its own rule (a SQL predicate); types without a rule pass."""
    ok: Column = F.lit(True)
    for kind, rule in rules.items():
        ok = F.when(F.col("type") == kind, F.expr(rule)).otherwise(ok)
    g = flags.withColumn("_ok", ok).groupBy("layout", "type").agg(F.count("*").alias("total"), F.count_if("_ok").alias("passed"))
    return g.withColumn("rate", F.round(F.col("passed") / F.col("total"), 6))


def best_attempt(attempts: DataFrame, enough: float) -> DataFrame:
    """(layout, attempt, rate): the first attempt if its rate is enough, else the best, ties to the later."""
    rank = F.struct((F.when((F.col("attempt") == 1) & (F.col("rate") >= enough), 1).otherwise(0)).alias("a"), F.col("rate").alias("r"), F.col("attempt").alias("n"))
    return attempts.groupBy("layout").agg(F.max(rank).alias("m")).select("layout", F.col("m.n").alias("attempt"), F.col("m.r").alias("rate"))


def near_road(objects: DataFrame, near: DataFrame) -> DataFrame:
    """Adds near_road: whether the rounded pixel is in a mask (x, y)."""
    at = lambda c: F.bround(F.col(c).cast("double")).cast("long")
    mask = near.select(F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("near_road")).distinct()
    return objects.withColumns({"px": at("x"), "py": at("y")}).join(mask, ["px", "py"], "left").drop("px", "py").withColumn("near_road", F.coalesce("near_road", F.lit(False)))


#: Which surface a type must stand on; types not named may stand anywhere.
PLACES = {"hotlap": "on_road", "start": "on_road", "pit": "near_road AND NOT on_road AND NOT on_invalid"}


def flagged(objects: DataFrame, label: DataFrame, road: int, paved: list[int], near: int, width: int, height: int) -> DataFrame:
    """surface_flags and near_road, within so many pixels of the road."""
    zone = grid.dilate(label.where(F.col("tag") == road), "disc", near, width, height)
    return near_road(surface_flags(objects, label, road, paved), zone)


def snap_misplaced(flags: DataFrame, label: DataFrame, road: int, near: int, most: int, width: int, height: int) -> DataFrame:
    """(object_id, layout, type, x, y, snapped): objects off their surface move to the nearest pixel of it within ``most``, if there is one.

    Hot laps and starts go to the road; pits to labelled pixels near the road but not on it.  Others stay.
    """
    ok: Column = F.lit(True)
    for kind, rule in PLACES.items():
        ok = F.when(F.col("type") == kind, F.expr(rule)).otherwise(ok)
    o = flags.withColumn("ok", ok).select("object_id", "layout", "type", "x", "y", "ok")
    on = label.where(F.col("tag") == road).select("x", "y")
    beside = grid.dilate(on, "disc", near, width, height).join(label.where(F.col("tag") != road).select("x", "y"), ["x", "y"], "left_semi")
    moved = [
        spatial.snap_to_valid(o.where(F.col("type").isin(kinds) & ~F.col("ok")).select("object_id", "x", "y"), target, most)
        for kinds, target in ((["hotlap", "start"], on), (["pit"], beside))
    ]
    to = moved[0].unionByName(moved[1]).where("sx IS NOT NULL").select("object_id", "sx", "sy")
    return o.join(to, "object_id", "left").select("object_id", "layout", "type", F.coalesce("sx", "x").alias("x"), F.coalesce("sy", "y").alias("y"), F.col("sx").isNotNull().alias("snapped"))


def choose_attempt(attempts: DataFrame, enough: float) -> DataFrame:
    """Of flagged objects (layout, attempt, object_id, type, x, y, flags) those of each layout's best attempt, by the share that stands on its surface, with that rate."""
    ok: Column = F.lit(True)
    for kind, rule in PLACES.items():
        ok = F.when(F.col("type") == kind, F.expr(rule)).otherwise(ok)
    rates = attempts.groupBy("layout", "attempt").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("rate"))
    return attempts.join(best_attempt(rates, enough), ["layout", "attempt"])


def all_objects(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects of all parts (hot laps, pits, starts, gates), and the validation of each layout."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, validate(out)


def next_object_names(objects: DataFrame) -> DataFrame:
    """(layout, type, name): the next free name.  Gates go by the largest number of either side plus one; other types by their count."""
    prefix = F.create_map(*[F.lit(v) for kv in (("hotlap", "AC_HOTLAP_START"), ("pit", "AC_PIT"), ("start", "AC_START")) for v in kv])
    number = F.coalesce(F.nullif(F.regexp_extract("name", r"AC_TIME_(\d+)", 1), F.lit("")).cast("long"), F.lit(-1))
    gates = F.col("type").isin("timing_left", "timing_right")
    largest = objects.where(gates).groupBy("layout").agg((F.max(number) + 1).alias("next"))
    timing = largest.withColumn("s", F.explode(F.array(F.struct(F.lit("timing_left").alias("type"), F.lit("_L").alias("end")), F.struct(F.lit("timing_right").alias("type"), F.lit("_R").alias("end")))))
    timing = timing.select("layout", "s.type", F.concat(F.lit("AC_TIME_"), "next", "s.end").alias("name"))
    others = objects.where(~gates).groupBy("layout", "type").agg(F.count("*").alias("n"))
    return timing.unionByName(others.select("layout", "type", F.concat(F.coalesce(F.try_element_at(prefix, F.col("type")), F.lit("AC_OBJ")), F.lit("_"), "n").alias("name")))


def validate_walls(walls: DataFrame, kinds: list[str]) -> DataFrame:
    """Per layout what is wrong with its walls (layout, wall_id, type, n_points): unknown types, under two points, not just one outer wall."""
    bad_type, short = F.count_if(~F.coalesce(F.col("type").isin(kinds), F.lit(False))), F.count_if(F.coalesce(F.col("n_points"), F.lit(0)) < 2)
    g = walls.groupBy("layout").agg(bad_type.alias("t"), short.alias("s"), F.count_if(F.col("type") == "outer").alias("o"))
    errors = F.array(
        F.when(F.col("t") > 0, F.concat("t", F.lit(" walls of an unknown type"))), F.when(F.col("s") > 0, F.concat("s", F.lit(" walls of under two points"))),
        F.when(F.col("o") != 1, F.concat(F.lit("one outer wall, not "), "o")))
    return g.select("layout", F.array_join(F.filter(errors, lambda e: e.isNotNull()), "; ").alias("errors"))


def next_names(objects: DataFrame) -> DataFrame:
    """The next free number of each type and layout."""
    return objects.groupBy("layout", "type").agg(F.count("*").alias("next"))


def gate_pairs(gates: DataFrame) -> DataFrame:
    """(n, has_left, has_right): left and right gates by number, unmatched ones too."""
    left = gates.where("type = 'timing_left'").select("n").distinct().withColumn("l", F.lit(True))
    right = gates.where("type = 'timing_right'").select("n").distinct().withColumn("r", F.lit(True))
    return left.join(right, "n", "full").select("n", F.coalesce("l", F.lit(False)).alias("has_left"), F.coalesce("r", F.lit(False)).alias("has_right"))


def stable_names(items: DataFrame, group: str, name: str) -> DataFrame:
    """Adds number: from 0 within a group in order of name."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(name)) - 1)


def validate(documents: DataFrame) -> DataFrame:
    """Per layout the texts of what is wrong: exactly one hotlap, some pit, as many left as right gates."""
    n = lambda t: F.count_if(F.col("type") == t)
    g = documents.groupBy("layout").agg(n("hotlap").alias("h"), n("pit").alias("p"), n("timing_left").alias("l"), n("timing_right").alias("r"))
    errors = F.array(F.when(F.col("h") != 1, "one hotlap"), F.when(F.col("p") == 0, "a pit"), F.when(F.col("l") != F.col("r"), "paired gates"))
    return g.select("layout", F.array_join(F.filter(errors, lambda e: e.isNotNull()), "; ").alias("errors"))


#: The two ways around a track.
DIRECTIONS = ("clockwise", "counterclockwise")


def document_errors(documents: DataFrame, objects: DataFrame, required: list[str]) -> DataFrame:
    """(layout, place, error): what is wrong with each object document, a row for each finding; a document without a row is valid.

    documents: (layout, direction); objects: (layout, place, name, position, orientation, type), the vectors as arrays of doubles in which what was no number
    is null.  A document needs a known direction, some object, and an object of each required type; an object a name and two
    vectors of two numbers.  Findings about a whole document have a null place; one without objects is not asked for types.
    """
    def found(df: DataFrame, place, *errors) -> DataFrame:
        e = F.filter(F.array(*errors), lambda x: x.isNotNull())
        return df.select("layout", place.cast("long").alias("place"), F.explode(e).alias("error"))

    def vector(c: str):
        two = F.coalesce(F.size(c) == 2, F.lit(False)) & F.col(c).isNotNull()
        return F.when(~two, f"{c} must have two values").when(F.exists(c, lambda x: x.isNull()), f"{c} has a value that is no number")

    seen = objects.groupBy("layout").agg(*[F.bool_or(F.coalesce(F.col("type") == t, F.lit(False))).alias(f"has{k}") for k, t in enumerate(required)])
    d = documents.join(seen.withColumn("any", F.lit(True)), "layout", "left")
    missing = [F.when(F.col("any") & ~F.col(f"has{k}"), f"no object of type {t}") for k, t in enumerate(required)]
    whole = found(d, F.lit(None), F.when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "unknown direction"), F.when(F.col("any").isNull(), "no objects"), *missing)
    own = objects.join(documents.select("layout"), "layout", "left_semi")
    return whole.unionByName(found(own, F.col("place"), F.when(F.coalesce("name", F.lit("")) == "", "no name"), vector("position"), vector("orientation")))


def manual_first(manual: DataFrame, auto: DataFrame, source: str) -> DataFrame:
    """The rows of each source with ``manual``: its manual rows where it has any, else its automatic ones."""
    rest = auto.join(manual.select(source).distinct(), source, "left_anti")
    return manual.withColumn("manual", F.lit(True)).unionByName(rest.withColumn("manual", F.lit(False)))
