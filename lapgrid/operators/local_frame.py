"""Rings, directions and poses in the local frame of a tile set.

A frame is one row of a document: (doc_id, mode, lat0, lon0, h0, inverse).  mode is that of ``tiles.frame_mode``; inverse, a
column-major 4 x 4 matrix, is what takes earth-centred places to the tile set's own.  Local axes are (x, up, z).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

FRAME = ["mode", "lat0", "lon0", "h0", "inverse"]


def local_xyz(lon, lat, height: str = "zero", const: float = 0.0) -> Column:
    """(x, y, z) of a place on the ellipsoid in the row's frame; y is 0, the frame's own height (``frame``) or a constant."""
    g = geo.geodetic_to_ecef(lat, lon, F.lit(0.0))
    own = geo.mat4_apply(F.col("inverse"), g["x"], g["y"], g["z"])
    enu = geo.ecef_to_enu(g["x"], g["y"], g["z"], F.col("lat0"), F.col("lon0"), F.col("h0"))
    of_set = F.col("mode") == "tileset_local"
    up = {"zero": F.lit(0.0), "frame": F.when(of_set, own["z"]).otherwise(enu["u"]), "const": F.lit(float(const))}[height]
    return F.struct(F.when(of_set, own["x"]).otherwise(enu["e"]).alias("x"), up.alias("y"), F.when(of_set, own["y"]).otherwise(enu["n"]).alias("z"))


def direction_to_local(here: Column, ahead: Column) -> Column:
    """(x, z), the unit vector on the ground between two local places (x, y, z); null where they lie within 1e-9."""
    dx, dz = ahead["x"] - here["x"], ahead["z"] - here["z"]
    n = F.sqrt(dx * dx + dz * dz)
    return F.when(n > 1e-9, F.struct((dx / n).alias("x"), (dz / n).alias("z")))


def rings_to_local(rings: DataFrame, frames: DataFrame, height: str = "zero", const: float = 0.0) -> DataFrame:
    """Rings (doc_id, crs, ring: array of (x, y) in degrees, ..) with ``points`` in their document's frame and ``error``.

    error, where points is null: ``crs`` for one that is neither null nor EPSG:4326; ``height`` for a constant that is not
    finite; ``frame`` for a mode of error, a missing frame or one without its matrix.  Points that lack a coordinate go,
    and so do rings without points that have no error.  One join, on the document; a frame is one row of it.
    """
    if height not in ("zero", "frame", "const"):
        raise ValueError(f"height is zero, frame or const, not {height!r}")
    finite = height != "const" or abs(float(const)) < float("inf")
    lost = F.col("mode").isNull() | (F.col("mode") == "error") | ((F.col("mode") == "tileset_local") & F.col("inverse").isNull())
    error = F.when(F.coalesce(F.col("crs"), F.lit("EPSG:4326")) != "EPSG:4326", "crs").when(F.lit(not finite), "height").when(lost, "frame")
    whole = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    j = rings.join(frames.select("doc_id", *FRAME), "doc_id", "left").withColumn("error", error)
    made = F.transform(whole, lambda p: local_xyz(p["x"], p["y"], height, const))
    j = j.withColumn("points", F.when(F.col("error").isNull(), made))
    return j.where("error IS NOT NULL OR size(points) > 0").drop(*FRAME)


def repair_crs(rings: DataFrame, frames: DataFrame) -> DataFrame:
    """Rings (doc_id, ord, crs, ring, ..) of documents whose places were stored in UTM, as degrees; adds points and status.

    A document's first ring with points decides: ``geographic`` leaves it as it is, ``converted`` takes all its rings from the
    crs (EPSG:326zz or 327zz) to degrees and to the local frame, ``empty`` has no ring with points, and ``unknown``
    has a projected ring but no crs of that form or no frame.  points is null unless converted.
    """
    full = F.coalesce(F.size("ring"), F.lit(0)) > 0
    first = F.min_by(F.when(full, geo.looks_geographic_ring(F.col("ring"))), F.when(full, F.col("ord")))
    docs = rings.groupBy("doc_id").agg(first.alias("degrees"))
    j = rings.join(docs, "doc_id").join(frames.select("doc_id", *FRAME), "doc_id", "left")
    zone = F.regexp_extract(F.coalesce("crs", F.lit("")), r"^EPSG:32[67](0[1-9]|[1-5]\d|60)$", 1)
    south = F.substring("crs", 6, 3) == "327"
    usable = (zone != "") & F.col("mode").isin("enu", "tileset_local") & ~((F.col("mode") == "tileset_local") & F.col("inverse").isNull())
    status = F.when(F.col("degrees").isNull(), "empty").when(F.col("degrees"), "geographic").when(F.coalesce(usable, F.lit(False)), "converted").otherwise("unknown")
    j = j.withColumns({"status": status, "_zone": F.when(zone != "", zone.cast("int")), "_false": F.when(south, 10_000_000.0).otherwise(0.0)})

    def degrees(p: Column) -> Column:
        g = geo.utm_to_wgs84(p["x"], p["y"] - F.col("_false"), F.col("_zone"))
        return F.struct(g["lon"].alias("x"), g["lat"].alias("y"))

    converted = F.col("status") == "converted"
    j = j.withColumn("ring", F.when(converted & full, F.transform("ring", degrees)).otherwise(F.col("ring")))
    j = j.withColumn("points", F.when(converted & full, F.transform("ring", lambda p: local_xyz(p["x"], p["y"]))))
    return j.drop("degrees", "_zone", "_false", *FRAME)


def repair_counts(repaired: DataFrame) -> DataFrame:
    """(status, documents) of repair_crs."""
    return repaired.groupBy("status").agg(F.count_distinct("doc_id").alias("documents"))


def object_poses(objects: DataFrame, images: DataFrame, frames: DataFrame, offset: float, ahead: float = 10.0) -> DataFrame:
    """(doc_id, layout, name, x, y, z, hx, hz): objects (doc_id, layout, name, px, py, dx, dy), placed on an image, in the local frame.

    images: (doc_id, width, height, tl, tr, bl, br), corners as (x, y) in degrees.  The height is the offset; the heading is
    the ground direction to a point ``ahead`` pixels on, null without dx and dy or where both points coincide.  A layout is put before the name
    where the document has more than one; an object without a layout has ``Default``.  Objects without a position, an image or a usable frame go.
    """
    o = objects.where("px IS NOT NULL AND py IS NOT NULL").withColumn("layout", F.coalesce("layout", F.lit("Default")))
    several = objects.groupBy("doc_id").agg((F.count_distinct(F.coalesce("layout", F.lit("Default"))) > 1).alias("several"))
    usable = frames.where("mode = 'enu' OR (mode = 'tileset_local' AND inverse IS NOT NULL)").select("doc_id", *FRAME)
    j = o.join(several, "doc_id").join(images, "doc_id").join(usable, "doc_id")
    corner = [(F.col(c)["x"], F.col(c)["y"]) for c in ("tl", "tr", "bl", "br")]
    # A lambda's variable is one value; written out, each place would be repeated wherever its formula names it.
    shift = F.array(F.lit(0.0), F.lit(ahead))
    pixels = F.transform(shift, lambda d: F.struct((F.col("px") + F.coalesce("dx", F.lit(0.0)) * d).alias("x"), (F.col("py") + F.coalesce("dy", F.lit(0.0)) * d).alias("y")))
    places = F.transform(pixels, lambda p: geo.bilinear_forward(p["x"] / F.col("width"), p["y"] / F.col("height"), *corner))
    j = j.withColumn("at", F.transform(places, lambda p: local_xyz(p["x"], p["y"])))
    j = j.withColumn("to", F.when(F.col("dx").isNotNull() & F.col("dy").isNotNull(), direction_to_local(F.col("at")[0], F.col("at")[1])))
    name = F.when(F.col("several"), F.concat("layout", F.lit("__"), "name")).otherwise(F.col("name"))
    return j.select("doc_id", "layout", name.alias("name"), F.col("at")[0]["x"].alias("x"), (F.col("at")[0]["y"] + offset).alias("y"), F.col("at")[0]["z"].alias("z"), F.col("to.x").alias("hx"), F.col("to.z").alias("hz"))
