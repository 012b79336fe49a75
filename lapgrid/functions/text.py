"""Names, paths and progress lines: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Collision prefixes by surface tag.
COLLISION_PREFIX = {"road": "1ROAD", "grass": "1GRASS", "sand": "1SAND", "kerb": "1KERB", "road2": "1ROAD2"}


def tile_level(uri: Column) -> Column:
    """The number after the last underscore-separated token that starts with L; 0 without one."""
    stem = F.regexp_replace(uri, r"\.[^.]*$", "")
    found = F.filter(F.split(stem, "_"), lambda t: t.rlike("^L[0-9]+$"))
    return F.when(F.size(found) > 0, F.substring(F.element_at(found, -1), 2, 20).cast("int")).otherwise(0)


def collision_name(tag: Column, index: Column) -> Column:
    """Prefix and index; null for an unknown tag."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in COLLISION_PREFIX.items() for x in kv]), F.lower(F.trim(tag)))
    return F.concat(prefix, F.lit("_"), index.cast("string"))


def infer_type(name: Column, given: Column, known: list[str]) -> Column:
    """A known type stays; else by the name's end and start."""
    return (
        F.when(given.isin(known), given).when(name.endswith("_L"), "timing_left").when(name.endswith("_R"), "timing_right")
        .when(name.startswith("AC_PIT"), "pit").when(name.startswith("AC_START"), "start").when(name.startswith("AC_HOTLAP"), "hotlap").otherwise("unknown")
    )


def safe_name(text: Column) -> Column:
    """Runs of other characters than letters, digits, dot, dash and underscore become one underscore; nothing left: unnamed."""
    s = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed").otherwise(s)


def display_names(spec: Column) -> Column:
    """'a:x;b:y' to a map with lower-case keys."""
    return F.transform_keys(F.str_to_map(spec, F.lit(";"), F.lit(":")), lambda k, _v: F.lower(F.trim(k)))


def batch_type(label: Column) -> Column:
    return F.when(label.contains("collision"), "collision").when(label.contains("game_objects"), "game_objects").otherwise("terrain")


def layout_of_file(name: Column) -> Column:
    """The layout named after _go_, else shared."""
    found = F.regexp_extract(name, r"_go_([A-Za-z0-9]+)", 1)
    return F.when(found == "", "shared").otherwise(found)


def fenced_payload(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def progress_percent(line: Column) -> Column:
    """Of a progress line, clamped to 0..100; null for any other line."""
    n = F.regexp_extract(line, r"@@PROGRESS@@ (-?[0-9]+)", 1)
    return F.when(n != "", F.least(F.greatest(n.cast("int"), F.lit(0)), F.lit(100)))


def progress_message(line: Column) -> Column:
    return F.when(line.rlike(r"@@PROGRESS@@ -?[0-9]+"), F.regexp_extract(line, r"@@PROGRESS@@ -?[0-9]+(?:\.[0-9]+)? ?(.*)$", 1))


def stage_header(line: Column) -> Column:
    s = F.regexp_extract(line, r"^=== Stage ([0-9]+[a-z]?):", 1)
    return F.when(s != "", s)


def eta_text(elapsed: Column, share: Column) -> Column:
    """Time left as ~45s or ~2m05s; empty near either end."""
    left = F.floor(elapsed * (1 - share) / share + 0.5).cast("long")
    text = F.when(left < 60, F.format_string("~%ds", left)).otherwise(F.format_string("~%dm%02ds", (left / 60).cast("long"), left % 60))
    return F.when((share <= 0.005) | (share >= 0.99), "").otherwise(text)


#: The extension of each image format; others are written as png.
EXTENSIONS = {"PNG": "png", "JPEG": "jpg", "BMP": "bmp", "TIFF": "tiff", "TARGA": "tga", "OPEN_EXR": "exr", "HDR": "hdr"}


def texture_extension(fmt: Column) -> Column:
    of = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(of, F.upper(fmt)), F.lit("png"))


def is_jpeg(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?i)[^/\\]\.jpe?g$"))


def png_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.jpe?g$", ".png")


def clip_of_path(path: Column) -> Column:
    """tag is the parent folder; clip the file's stem without _blender, led by clip_."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)\.[^./\\]*$", 1), r"_blender$", "")
    return F.struct(F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1).alias("tag"), F.when(stem.startswith("clip_"), stem).otherwise(F.concat(F.lit("clip_"), stem)).alias("clip"))


def describe_track(name: Column, length_m: Column) -> Column:
    return F.concat_ws(", ", name, F.when(length_m > 0, F.format_string("%d m long", length_m.cast("long"))))
