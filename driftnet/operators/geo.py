"""Naming the place nearest to a photo's position."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cities that may be sent to every task: a bound on the table, checked, not assumed.
MOST_CITIES = 200_000


def distance2(lat: Column, lon: Column, city_lat: Column, city_lon: Column) -> Column:
    """Squared equirectangular distance in degrees; longitudes are compared across the date line."""
    dlon = F.pmod(city_lon - lon + 180.0, F.lit(360.0)) - 180.0
    dx, dy = dlon * F.cos(F.radians(lat)), city_lat - lat
    return dx * dx + dy * dy


def valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def nearest_place(points: DataFrame, cities: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with a column place: the nearest city's name, null where a coordinate is missing or out of range.

    Cities are a parameter table, brought to every task as arrays if within MOST_CITIES, else an error. Ties go to the first in
    order of latitude, longitude, name.
    """
    rows = cities.select("lat", "lon", "name").orderBy("lat", "lon", "name").limit(MOST_CITIES + 1).toPandas()
    if len(rows) > MOST_CITIES:
        raise ValueError(f"more than {MOST_CITIES} cities")
    sent = points.sparkSession.sparkContext.broadcast((rows["lat"].to_numpy(float), rows["lon"].to_numpy(float), rows["name"].to_numpy(object)))

    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(nearest_names(*sent.value, a.to_numpy(float), b.to_numpy(float)), dtype=object)

    return points.withColumn("place", F.pandas_udf(place, T.StringType())(F.col(lat).cast("double"), F.col(lon).cast("double")))


def nearest_names(lats: np.ndarray, lons: np.ndarray, names: np.ndarray, y: np.ndarray, x: np.ndarray, at_once: int = 2_000_000) -> list:
    """The nearest city's name of each point, None where a coordinate is missing or out of range."""
    out = np.full(len(y), None, dtype=object)
    good = np.flatnonzero((y >= -90) & (y <= 90) & (x >= -180) & (x <= 180)) if len(names) else np.zeros(0, np.int64)  # nan compares false
    for rows in np.array_split(good, max(1, len(good) * max(1, len(names)) // at_once)):
        dx = ((lons[None, :] - x[rows, None] + 180) % 360 - 180) * np.cos(np.radians(y[rows, None]))
        if len(rows):
            out[rows] = names[np.argmin(dx * dx + (lats[None, :] - y[rows, None]) ** 2, axis=1)]
    return out.tolist()


@lru_cache(maxsize=2)
def place_finder(path: str):
    """A function from latitude and longitude to the nearest city of a GeoNames table, which is read once in a process."""
    t = pd.read_csv(path, sep="\t", header=None, quoting=3, usecols=[1, 4, 5, 8], dtype={1: str, 8: str}, keep_default_na=False, na_values={4: "", 5: ""}).dropna()
    if len(t) > MOST_CITIES:
        raise ValueError(f"more than {MOST_CITIES} cities")
    names = (t[1] + ", " + t[8]).to_numpy(object)
    order = np.lexsort((names.astype(str), t[5], t[4]))
    lats, lons, names = t[4].to_numpy(float)[order], t[5].to_numpy(float)[order], names[order]
    return lambda lat, lon: nearest_names(lats, lons, names, np.array([lat], float), np.array([lon], float))[0]


def read_geonames(spark, path: str) -> DataFrame:
    """Cities from a GeoNames table (tab-separated, no header): lat, lon, "name, CC"."""
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(19))).csv(path, sep="\t", quote="")
    return raw.select(F.col("c4").cast("double").alias("lat"), F.col("c5").cast("double").alias("lon"), F.concat_ws(", ", "c1", "c8").alias("name")).where("lat is not null and lon is not null")
