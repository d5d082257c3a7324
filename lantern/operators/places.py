"""Places: roll-ups, grids, nearest cities and polygons."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators.filters import checked_precision
from lantern.session import written

EARTH_KM = 6371.0088


def place_summary(places: DataFrame) -> DataFrame:
    """(country, count, cover, cities): two-level counts; a null city counts for its country only.

    places(file_id, country, city, taken_at). Cities go by falling count, then name; the country's cover is that of its
    largest group, the null city's included.
    """
    newest = F.max_by("file_id", F.struct("taken_at", "file_id"))
    city = places.where("country is not null").groupBy("country", "city").agg(F.count("*").alias("n"), newest.alias("cover"))
    order = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("city").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("city"), F.col("cover"))))),
        lambda c: F.struct(c["city"].alias("city"), (-c["neg"]).alias("count"), c["cover"].alias("cover")),
    )
    biggest = F.max_by("cover", F.struct("n", F.col("city").isNull(), "cover"))
    return city.groupBy("country").agg(F.sum("n").alias("count"), biggest.alias("cover"), order.alias("cities"))


def grid_points(located: DataFrame, precision: int) -> DataFrame:
    """(lat, lon, count, city, country) per rounded coordinate; city and country are independent minima."""
    p = checked_precision(precision)
    return located.groupBy(F.round("gps_lat", p).alias("lat"), F.round("gps_lon", p).alias("lon")).agg(F.count("*").alias("count"), F.min("city").alias("city"), F.min("country").alias("country"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


LEAF, STEP, SPREAD = 64, 4096, 20_000


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=1)


class BallTree:
    """Cities in leaves of LEAF at most, each inside a ball of unit vectors; nodes are halved along their widest axis.

    A node's children are `first` and `first` + 1; a leaf has none (0) and its place in `members`.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.ids, self.at = ids, at
        spots = unit_vectors(at[:, 0], at[:, 1])
        nodes, first, leaf, leaves = [np.arange(len(ids))] if len(ids) else [], [], [], []
        centres, radii = [], []
        for own in nodes:  # which grows
            centres.append(spots[own].mean(axis=0))
            radii.append(np.sqrt(((spots[own] - centres[-1]) ** 2).sum(axis=1)).max())
            if len(own) <= LEAF:
                first.append(0)
                leaf.append(len(leaves))
                leaves.append(np.resize(np.sort(own), LEAF))  # short ones repeat
                continue
            axis = np.ptp(spots[own], axis=0).argmax()
            own = own[np.argsort(spots[own, axis], kind="stable")]
            first.append(len(nodes))
            leaf.append(-1)
            nodes += [own[: len(own) // 2], own[len(own) // 2 :]]
        self.centres, self.radii = np.array(centres).reshape(-1, 3), np.array(radii)
        self.first, self.leaf = np.array(first, int), np.array(leaf, int)
        self.members = np.array(leaves, int).reshape(-1, LEAF)

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The nearest city's place for each point, the smallest id of equal distances to 15 places."""
        out = np.zeros(len(lat), int)
        for i in range(0, len(lat), STEP):
            out[i : i + STEP] = self._block(lat[i : i + STEP], lon[i : i + STEP])
        return out

    def _low(self, spots: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """A lower bound of the squared half chord, which is the haversine's inside, from each spot to its node's cities."""
        gap = np.sqrt(((spots - self.centres[nodes]) ** 2).sum(axis=1)) - self.radii[nodes]
        return np.square(np.maximum(gap, 0) / 2) - 1e-12

    def _block(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        spots, p, q = unit_vectors(lat, lon), np.radians(lat), np.radians(lon)
        best, place = np.full(len(lat), np.inf), np.zeros(len(lat), int)

        def look(rows: np.ndarray, nodes: np.ndarray) -> None:
            """Compare points, each once, with the cities of a leaf each."""
            members = self.members[self.leaf[nodes]]
            c_lat, c_lon = np.radians(self.at[members]).transpose(2, 0, 1)
            apart = np.sin((c_lat - p[rows, None]) / 2) ** 2 + np.cos(p[rows, None]) * np.cos(c_lat) * np.sin((c_lon - q[rows, None]) / 2) ** 2
            apart = np.round(apart, 15)
            value = apart.min(axis=1)
            ids = np.where(apart == value[:, None], self.ids[members], np.iinfo(np.int64).max)
            found = members[np.arange(len(rows)), ids.argmin(axis=1)]
            better = (value < best[rows]) | ((value == best[rows]) & (self.ids[found] < self.ids[place[rows]]))
            best[rows[better]], place[rows[better]] = value[better], found[better]

        # down to one leaf by the nearer centre, for a bound; then down all branches that the bound leaves, level by level
        node = np.zeros(len(lat), int)
        while (inner := np.flatnonzero(self.first[node])).size:
            child = self.first[node[inner]]
            right = ((spots[inner] - self.centres[child + 1]) ** 2).sum(axis=1) < ((spots[inner] - self.centres[child]) ** 2).sum(axis=1)
            node[inner] = child + right
        look(np.arange(len(lat)), node)
        rows, nodes = np.arange(len(lat)), np.zeros(len(lat), int)
        while len(rows):
            kept = self._low(spots[rows], nodes) <= best[rows]
            rows, nodes = rows[kept], nodes[kept]
            end = self.first[nodes] == 0
            at, leaves = rows[end], nodes[end]
            while len(at):  # a point's leaves one after another
                _, once = np.unique(at, return_index=True)
                look(at[once], leaves[once])
                at, leaves = np.delete(at, once), np.delete(leaves, once)
            rows, nodes = rows[~end], self.first[nodes[~end]]
            rows, nodes = np.concatenate((rows, rows)), np.concatenate((nodes, nodes + 1))
        return place


def nearest_city(points: DataFrame, cities: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(id, city_id, km): the nearest city of each point, exact, the smallest city_id on ties.

    points(id, lat, lon), cities(city_id, lat, lon); rows without a place take no part, an empty gazetteer gives an
    empty result. Cities of one place count as the smallest of them, and a place that many points share is asked for once.
    One Arrow pass over these for every `most_bytes` of the gazetteer, whose ball tree is broadcast: branches are
    followed only while their ball may hold a nearer city. About SPREAD places are a task.
    """
    spark = points.sparkSession
    grid = cities.where("lat is not null and lon is not null").select(F.col("city_id").cast("long").alias("city_id"), F.col("lat").cast("double").alias("c_lat"), F.col("lon").cast("double").alias("c_lon"))
    grid = written(grid.groupBy("c_lat", "c_lon").agg(F.min("city_id").alias("city_id")), "gazetteer")
    located = points.where("lat is not null and lon is not null").select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    parts = max(1, -(-grid.count() * 24 // most_bytes))
    asked = written(located.select("lat", "lon").distinct(), "asked-places")
    asked = asked.repartition(max(1, -(-asked.count() // SPREAD)))
    best = None
    for part in range(parts):
        rows = grid.where(F.pmod(F.xxhash64("city_id"), F.lit(parts)) == part).orderBy("city_id", "c_lat", "c_lon").toPandas()  # `most_bytes` or so
        tree = spark.sparkContext.broadcast((rows["city_id"].to_numpy(np.int64), rows[["c_lat", "c_lon"]].to_numpy(np.float64)))

        def run(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, at = tree.value
            grown = BallTree(ids, at)
            for batch in batches:
                if len(ids) and batch.num_rows:
                    k = grown.nearest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[k]), pa.array(at[k, 0]), pa.array(at[k, 1])], names=["lat", "lon", "city_id", "c_lat", "c_lon"])

        found = asked.mapInArrow(run, "lat double, lon double, city_id long, c_lat double, c_lon double")
        km = haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
        found = found.select("lat", "lon", F.struct(F.round(km, 6).alias("_near"), "city_id", km.alias("km")).alias("best"))
        best = found if best is None else best.unionByName(found)
    best = best.groupBy("lat", "lon").agg(F.min("best").alias("best"))
    return located.join(best, ["lat", "lon"]).groupBy("id").agg(F.min("best").alias("best")).select("id", "best.city_id", "best.km")


POLYGONS = "place int, name string, rings array<array<struct<x:double,y:double>>>"


def topojson_polygons(spark: SparkSession, path: str, object_name: str, name: str = "name") -> DataFrame:
    """(place, name, rings) of an object's polygons in a TopoJSON file, rings as (x, y) in degrees; a multipolygon is one row.

    Arcs are decoded in columns: running sums of their steps, scaled and moved; a ring's arcs are joined by number, a
    negative one backwards, and each after the first without its first point. Other geometries have no row.
    """
    schema = "transform struct<scale:array<double>,translate:array<double>>, arcs array<array<array<double>>>, objects map<string,struct<geometries:array<string>>>"
    top = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("t")).select("t.*")
    zero = F.array(F.lit(0.0), F.lit(0.0))
    step = lambda s, d: F.concat(s, F.array(F.array(F.coalesce(F.element_at(s, -1)[0], F.lit(0.0)) + d[0], F.coalesce(F.element_at(s, -1)[1], F.lit(0.0)) + d[1])))
    start = F.slice(F.array(zero), 1, 0)
    arcs = top.select("transform", F.posexplode("arcs").alias("arc", "steps"))
    quantised = F.col("transform").isNotNull()
    at = lambda p, i: F.when(quantised, p[i] * F.col("transform.scale")[i] + F.col("transform.translate")[i]).otherwise(p[i])
    spots = F.when(quantised, F.aggregate("steps", start, lambda s, d: F.when(F.size(s) == 0, F.array(F.array(d[0], d[1]))).otherwise(step(s, d)))).otherwise(F.col("steps"))
    decoded = arcs.select("arc", F.transform(spots, lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y"))).alias("points"))
    shapes = top.select(F.posexplode(F.col("objects")[object_name]["geometries"]).alias("place", "g"))
    shapes = shapes.select("place", F.from_json("g", "type string, properties map<string,string>, arcs string").alias("g")).select("place", F.col("g.type").alias("type"), F.col("g.properties")[name].alias("name"), F.col("g.arcs").alias("arcs"))
    rings = shapes.select("place", "name", F.when(F.col("type") == "Polygon", F.from_json("arcs", "array<array<int>>")).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json("arcs", "array<array<array<int>>>"))).alias("rings"))
    parts = rings.select("place", "name", F.posexplode("rings").alias("ring", "arcs")).select("place", "name", "ring", F.posexplode("arcs").alias("nth", "i"))
    joined = parts.withColumn("arc", F.when(F.col("i") < 0, -F.col("i") - 1).otherwise(F.col("i"))).join(decoded, "arc")
    way = F.when(F.col("i") < 0, F.reverse("points")).otherwise(F.col("points"))
    joined = joined.withColumn("points", F.when(F.col("nth") == 0, way).otherwise(F.slice(way, F.lit(2), F.greatest(F.size(way) - 1, F.lit(0)))))
    ring = joined.groupBy("place", "name", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "points"))), lambda s: s["points"])).alias("points"))
    return ring.groupBy("place", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda s: s["points"]).alias("rings")).select(F.col("place").cast("int").alias("place"), "name", "rings")


def points_in_polygons(points: DataFrame, polygons: DataFrame | list[tuple[str, list[list[tuple[float, float]]]]], cell: float = 1.0) -> DataFrame:
    """points(id, lat, lon) with `name` of the first polygon that holds them, null if none; even-odd rule over a polygon's rings.

    polygons: rows (place, name, rings), or (name, rings of (lon, lat)) in order. An edge is a row for each row of
    cells of `cell` degrees that it crosses; what a polygon's edges span in a row covers the cells where it can hold a
    point. Points meet polygons by their cell, then those polygons' edges by the row: equi-joins, of any atlas's size.
    """
    spark = points.sparkSession
    if not isinstance(polygons, DataFrame):
        polygons = spark.createDataFrame([(i, name, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, (name, rings) in enumerate(polygons)], POLYGONS)
    own = points.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    ring = polygons.select("place", F.explode("rings").alias("r")).where(F.size("r") > 0)
    edge = ring.select("place", F.explode(F.arrays_zip(F.col("r").alias("p"), F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1)).alias("q"))).alias("e"))
    edge = edge.select("place", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    row = lambda v: F.floor(v / cell)
    edge = written(edge.withColumn("row", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2"))))), "polygon-edges")
    spans = edge.groupBy("place", "row").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"))
    cover = spans.select("place", "row", F.explode(F.sequence(row(F.col("w")), row(F.col("e")))).alias("column"))
    spot = own.where("lat is not null and lon is not null").withColumn("row", row(F.col("lat"))).withColumn("column", row(F.col("lon")))
    near = spot.join(cover, ["row", "column"]).select("id", "lat", "lon", "place", "row")
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    hits = near.join(edge, ["place", "row"]).where(crosses & east).groupBy("id", "place").agg(F.count("*").alias("n")).where("n % 2 = 1")
    first = hits.groupBy("id").agg(F.min("place").alias("place")).join(polygons.select("place", "name"), "place").select(F.col("id").alias("_id"), "name")
    return own.join(first, F.col("id") == F.col("_id"), "left").select("id", "lat", "lon", "name")


def visible_pins(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """points(lat, lon, n, ...) on the near side of a globe seen from above (lat, lon), with radius by count and fade near the rim."""
    away = haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) / EARTH_KM
    largest = points.agg(F.greatest(F.lit(1), F.max("n")).alias("_largest"))  # one row
    rows = points.withColumn("_away", away).crossJoin(largest).where(F.col("_away") <= math.pi / 2 - 0.03)
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.15), (math.pi / 2 - F.col("_away")) / 0.4))
    return rows.select(*points.columns, pin_radius(F.col("n"), F.col("_largest")).alias("radius"), fade.alias("fade"))


def pin_radius(count: Column, largest: Column) -> Column:
    return F.lit(3.5) + F.sqrt(count / largest) * 9
