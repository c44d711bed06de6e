"""Small text inputs: station lists, divisions, airport reports, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.functions.geo import Box
from verimet.operators.filters import in_box, states_of_box
from verimet.operators.setops import first_per_key
from verimet.schemas import AIRPORT_TEXT, INVENTORY


def read_csv(spark: SparkSession, path: str, schema: T.StructType, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; columns are taken by name, the schema gives types."""
    raw = spark.read.csv(path, header=True).withColumnsRenamed(rename or {})
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns])


def read_airport_text(spark: SparkSession, path: str) -> DataFrame:
    """Airport reports: '#' lines and header lines skipped, wherever files are split; 'M' is missing."""
    return parse_airport_lines(spark.read.text(path))


def parse_airport_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """The same for lines already in a column (header and '#' lines dropped)."""
    body = df.where(~F.col(line).startswith("#") & ~F.col(line).startswith("station,"))
    fields = F.from_csv(F.col(line), AIRPORT_TEXT.simpleString()[7:-1].replace(":", " "), {"nullValue": "M"})
    return body.withColumn("_r", fields).select(*[c for c in df.columns if c != line], "_r.*")


def inventory_rows(df: DataFrame, network: Column | str | None = None) -> DataFrame:
    """Feature collection -> station rows; a missing coordinate becomes null."""
    extra = [F.col(network) if isinstance(network, str) else network] if network is not None else []
    feature = df.select(F.explode("features").alias("f"), *[e.alias("network") for e in extra])
    at = F.col("f.geometry.coordinates")
    return feature.select(
        F.col("f.properties.sid").alias("station"),
        F.try_element_at(at, F.lit(2)).alias("lat"),
        F.try_element_at(at, F.lit(1)).alias("lon"),
        F.col("f.properties.elevation").alias("elev"),
        F.col("f.properties.sname").alias("name"),
        *(["network"] if extra else []),
    )


def read_inventory(spark: SparkSession, path: str, network: str) -> DataFrame:
    raw = spark.read.schema(INVENTORY).json(path, multiLine=True)
    return inventory_rows(raw, F.lit(network))


def networks_of_box(df: DataFrame, lat_min: str, lat_max: str, lon_min: str, lon_max: str) -> DataFrame:
    """One row per state that overlaps the row's box, with its network name."""
    states = states_of_box(F.col(lat_min), F.col(lat_max), F.col(lon_min), F.col(lon_max))
    return df.withColumn("state", F.explode(states)).withColumn("network", F.concat("state", F.lit("_ASOS")))


def stations_in_box(inventory: DataFrame, box: Box) -> DataFrame:
    """Stations inside the box, one row each, in id order."""
    return first_per_key(in_box(inventory, box), ["station"], ["network", "lat", "lon"]).orderBy("station")


def division_list(stations: DataFrame, division: str = "bbox_stations") -> DataFrame:
    """Station list in the division schema with one made-up division."""
    return stations.select(F.col("station").alias("stid"), F.lit(division).alias("climate_division_name"), "lat", "lon")
