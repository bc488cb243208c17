"""Where layers come from, and how raw tables become layers."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.text import normal_name
from meshwright.operators.aggregates import positions


@dataclass(frozen=True)
class Layer:
    """A table's name, its schema as DDL, and whether the work can go on without it."""

    name: str
    schema: str
    optional: bool = False


def resolve(name: str, folders: list[str], variable: str | None = None) -> str | None:
    """A source's path: an environment variable's if set, else the first local folder that has it, else None."""
    told = os.environ.get(variable or f"MESHWRIGHT_{name.upper()}")
    if told:
        return told
    return next((f"{d}/{name}.parquet" for d in folders if os.path.exists(f"{d}/{name}.parquet")), None)


def read_layer(spark: SparkSession, layer: Layer, path: str | None) -> DataFrame:
    """The layer's declared columns; without a path an optional layer is empty and another raises FileNotFoundError."""
    if path is not None:
        return spark.read.schema(layer.schema).parquet(path)
    if not layer.optional:
        raise FileNotFoundError(f"no source for {layer.name}")
    return spark.createDataFrame([], layer.schema)


def keep_listed(df: DataFrame, columns: list[str], key: str = "osm_id") -> DataFrame:
    """The listed columns that are there, and the key as text."""
    return df.select(F.col(key).cast("string").alias(key), *(F.col(f"`{c}`") for c in columns if c in df.columns and c != key))


#: Unnamed features that aren't places.
UNNAMED_AMENITIES = ("bench", "parking", "parking_space", "parking_entrance", "waste_basket", "waste_disposal", "bicycle_parking", "bicycle_repair_station", "toilets", "fountain", "recycling", "drinking_water", "shelter", "bbq", "grit_bin", "clock", "vending_machine", "telephone", "post_box", "smoking_area", "watering_place", "hunting_stand")
UNNAMED_LEISURE = ("swimming_pool", "pitch", "garden", "picnic_table", "bleachers", "outdoor_seating", "fitness_station", "track")
#: Categories of venues that are homes.
PRIVATE_CATEGORIES = ("Home (private)", "Residential Building (Apartment / Condo)", "Housing Development", "Assisted Living")


def admitted_places(df: DataFrame) -> DataFrame:
    """Named places, and unnamed ones unless they are street furniture or lie within a plot; all where nothing has a name column."""
    if "name" not in df.columns:
        return df
    furniture = [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in (("amenity", UNNAMED_AMENITIES), ("leisure", UNNAMED_LEISURE)) if c in df.columns]
    dropped = F.lit(False)
    for f in furniture:
        dropped = dropped | f
    return df.filter(F.col("name").isNotNull() | ~dropped)


def public_venues(df: DataFrame, checkins: DataFrame) -> DataFrame:
    """Venues that aren't homes, with their number of check-ins (0 for none)."""
    counts = checkins.groupBy("venue_id").agg(F.count("*").alias("checkins"))
    open_ = df.filter(~F.coalesce(F.col("category").isin(*PRIVATE_CATEGORIES), F.lit(False)))
    return open_.join(counts, "venue_id", "left").withColumn("checkins", F.coalesce("checkins", F.lit(0)))


def of_geometry(df: DataFrame, *kinds: str, column: str = "geometry_type") -> DataFrame:
    """The features whose geometry is one of kinds, alone or as several parts; all where the column is missing."""
    if column not in df.columns:
        return df
    return df.filter(F.col(column).isin(*kinds, *(f"Multi{k}" for k in kinds)))


def write_layer(df: DataFrame, path: str) -> None:
    """The layer as Parquet; what is there already stays as it is."""
    df.write.mode("ignore").parquet(path)


def boundaries(df: DataFrame, names: list[str]) -> DataFrame:
    """Municipal boundaries of these names (areas, where geometry_type says so); ValueError if one is missing."""
    found = of_geometry(df, "Polygon").filter((F.col("admin_level") == "8") & F.col("name").isin(*names))
    missing = set(names) - {r["name"] for r in found.select("name").distinct().collect()}
    if missing:
        raise ValueError(f"no boundary for {sorted(missing)}")
    return found


def zones_of(zones: DataFrame, comuna: str, names: list[str]) -> DataFrame:
    """Zones whose comuna is one of names, whatever its accents and case."""
    wanted = zones.sparkSession.createDataFrame([(n,) for n in names], "name string").select(normal_name(F.col("name")).alias("_wanted"))
    return zones.join(F.broadcast(wanted), normal_name(F.col(comuna)) == F.col("_wanted"), "left_semi")


def numbered_reports(df: DataFrame, *tie: str) -> DataFrame:
    """Reports with reporte_id, a six-digit place in the order of created_at, and fecha."""
    placed = positions(df, "created_at", *tie)
    return placed.withColumn("reporte_id", F.lpad(F.col("position").cast("string"), 6, "0")).withColumn("fecha", F.date_format("created_at", "yyyy-MM-dd")).drop("position")


#: Places of the night, and shops that sell alcohol.
NIGHT_PLACES, LIQUOR_SHOPS = ("bar", "pub", "nightclub"), ("alcohol",)


def count_kinds(places: DataFrame, venues: DataFrame, night: tuple[str, ...]) -> DataFrame:
    """One row: places of the night, liquor shops, and venues whose category is one of night."""
    here = places.agg(F.count_if(F.col("amenity").isin(*NIGHT_PLACES)).alias("nocturnos"), F.count_if(F.col("shop").isin(*LIQUOR_SHOPS)).alias("botillerias"))
    # two tables of one row each
    return here.crossJoin(venues.agg(F.count_if(F.col("category").isin(*night)).alias("venues_nocturnos")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Query files as archivo, numero (before the first hyphen), titulo (first comment line), explicacion (the others) and gql (the rest)."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("archivo"), "value")
    lines, is_comment = F.split("value", r"\r?\n"), lambda x: F.ltrim(x).startswith("--")
    said = F.transform(F.filter(lines, is_comment), lambda x: F.trim(F.regexp_replace(x, "^[- ]+", "")))
    rest = F.array_join(F.filter(lines, lambda x: ~is_comment(x)), "\n")
    found = files.select("archivo", said.alias("_said"), F.regexp_replace(rest, r"^\s+|\s+$", "").alias("gql"))
    stem = F.regexp_replace("archivo", r"\.[^.]*$", "")
    return found.select(
        "archivo",
        F.substring_index(stem, "-", 1).alias("numero"),
        F.coalesce(F.regexp_replace(F.try_element_at("_said", F.lit(1)), r"\.+$", ""), stem).alias("titulo"),
        F.array_join(F.slice("_said", F.lit(2), F.greatest(F.size("_said"), F.lit(1))), " ").alias("explicacion"),
        "gql",
    )


def split_header(text: str) -> tuple[list[str], str]:
    """(lines of the leading -- comment, the rest) of a query file."""
    lines = text.splitlines()
    head = []
    while lines and (lines[0].startswith("--") or not lines[0].strip()):
        line = lines.pop(0)
        if line.strip():
            head.append(line.removeprefix("--").strip())
    return head, "\n".join(lines).strip()
