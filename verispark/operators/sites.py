"""Merging station records into physical sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import chord_of_arc, haversine_km, unit_xyz
from ..session import cut_lineage
from .contracts import first_present


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) where the component is its smallest node id.

    Alternates two star contractions, which needs a logarithmic number of
    rounds.  Each round keeps only minima per node, so a hub of any degree is
    combined on the map side, and is checkpointed.
    """
    current = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    seal = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours move to the smallest node around u.
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours, and u itself, move to the smallest of them.
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        current = cut_lineage(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seal == tuple(state):
            return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
        seal = tuple(state)


# Marks a record without an elevation among the elevation bands.
NO_BAND = -(2 ** 31)


def _linkable(gap_low: Column, tolerance: float) -> Column:
    return gap_low.isNull() | (gap_low <= tolerance)


def site_links(stations: DataFrame, radius_km: float, elevation_tolerance_m: float,
               identifier: str | None = None, refine: int = 4) -> tuple[DataFrame, DataFrame]:
    """Group stations into cliques and list enough links between cliques to join up every site.

    Two records belong together when they lie within the radius and their
    elevations agree (a missing one cannot disagree).  Records in one small cube
    and elevation band always agree, so they form a clique without any pair
    being listed.  Between two cliques one true link suffices: finer boxes settle
    most clique pairs by their extent, and only pairs left open compare records.
    Returns ``(station_id, node)`` and the links ``(a, b)`` between nodes.
    """
    side = chord_of_arc(radius_km) / 3 ** 0.5 * (1 - 1e-9)
    x, y, z = unit_xyz(F.col("latitude"), F.col("longitude"))
    stations = stations.withColumn("altitude_m", F.nanvl(F.col("altitude_m").cast("double"), F.lit(None).cast("double")))
    placed = stations.select("station_id", "latitude", "longitude", "altitude_m",
                             *([identifier] if identifier else []), x.alias("x"), y.alias("y"), z.alias("z"))
    band = F.floor(F.col("altitude_m") / elevation_tolerance_m).cast("int")
    for axis in "xyz":
        placed = placed.withColumn(f"c{axis}", F.floor(F.col(axis) / side).cast("int"))
        placed = placed.withColumn(f"f{axis}", F.floor(F.col(axis) * refine / side).cast("int"))
    placed = placed.withColumn("band", band).withColumn("fband", F.floor(
        F.col("altitude_m") * refine / elevation_tolerance_m).cast("int"))
    node = F.concat_ws(":", F.lit("c"), "cx", "cy", "cz", F.coalesce(F.col("band").cast("string"), F.lit("none")))
    fine = F.concat_ws(":", "fx", "fy", "fz", F.coalesce(F.col("fband").cast("string"), F.lit("none")))
    placed = cut_lineage(placed.withColumn("node", node).withColumn("fine", fine))
    members = placed.select("station_id", "node")

    box = [F.min(c).alias(f"{c}_lo") for c in ("x", "y", "z", "altitude_m")]
    box += [F.max(c).alias(f"{c}_hi") for c in ("x", "y", "z", "altitude_m")]
    # Missing elevations have a band of their own, next to every other.
    boxes = placed.groupBy("node", "fine", "cx", "cy", "cz", F.coalesce("band", F.lit(NO_BAND)).alias("band")).agg(*box)
    boxes = cut_lineage(boxes)
    span = range(-2, 3)
    reach = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                      for i in span for j in span for k in span])
    # Which occupied cubes lie next to which: far fewer rows than boxes.
    cubes = boxes.select("cx", "cy", "cz").distinct()
    around = cubes.select(F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("cz").alias("a_cz"), F.inline(reach))
    around = around.select("a_cx", "a_cy", "a_cz", (F.col("a_cx") + F.col("i")).alias("cx"),
                           (F.col("a_cy") + F.col("j")).alias("cy"), (F.col("a_cz") + F.col("k")).alias("cz"))
    beside = around.join(cubes, ["cx", "cy", "cz"])
    b = F.col("a_band")
    bands = F.when(b == NO_BAND, F.array(F.lit(NO_BAND))).otherwise(F.array(b - 1, b, b + 1, F.lit(NO_BAND)))
    left = (boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns]).join(beside, ["a_cx", "a_cy", "a_cz"])
            .withColumn("band", F.explode(bands)))
    # Two banded boxes meet from both sides, a banded and an unbanded one only once.
    pairs = left.join(boxes, ["cx", "cy", "cz", "band"]).where(
        (F.col("a_node") < F.col("node")) | ((F.col("band") == NO_BAND) & (b != NO_BAND)))

    def gap(axis: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"a_{axis}_lo") - F.col(f"{axis}_hi"),
                          F.col(f"{axis}_lo") - F.col(f"a_{axis}_hi"))

    def stretch(axis: str) -> Column:
        return F.greatest(F.col(f"a_{axis}_hi") - F.col(f"{axis}_lo"), F.col(f"{axis}_hi") - F.col(f"a_{axis}_lo"))

    limit = chord_of_arc(radius_km)
    nearest = F.sqrt(sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0)))
    farthest = F.sqrt(sum((stretch(c) * stretch(c) for c in "xyz"), F.lit(0.0)))
    either_missing = F.col("altitude_m_lo").isNull() | F.col("a_altitude_m_lo").isNull()
    rise_low = F.when(~either_missing, gap("altitude_m"))
    rise_high = F.when(~either_missing, stretch("altitude_m"))
    possible = (nearest <= limit * (1 + 1e-9)) & _linkable(rise_low, elevation_tolerance_m)
    certain = (farthest <= limit * (1 - 1e-9)) & _linkable(rise_high, elevation_tolerance_m)
    judged = pairs.where(possible).select("a_node", "node", F.col("a_fine"), "fine", certain.alias("certain"))
    judged = cut_lineage(judged)
    settled = judged.where("certain").select("a_node", "node").distinct()
    doubtful = judged.where("NOT certain").join(settled, ["a_node", "node"], "left_anti")
    spots = placed.select("node", "fine", "latitude", "longitude", "altitude_m").distinct()
    a_spots = spots.select(*[F.col(c).alias(f"a_{c}") for c in spots.columns])
    distance = haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("latitude"), F.col("longitude"))
    rise = F.abs(F.col("a_altitude_m") - F.col("altitude_m"))
    proven = (doubtful.join(a_spots, ["a_node", "a_fine"]).join(spots, ["node", "fine"])
              .where((distance <= radius_km) & _linkable(rise, elevation_tolerance_m))
              .select("a_node", "node").distinct())
    links = settled.union(proven).toDF("a", "b")
    if identifier:
        named = placed.where(F.col(identifier).isNotNull() & (F.col(identifier) != ""))
        links = links.union(named.select("node", F.concat(F.lit("i:"), F.col(identifier))).distinct().toDF("a", "b"))
    return members, links


def build_sites(stations: DataFrame, radius_km: float = 1.0, elevation_tolerance_m: float = 30.0,
                network_priority: Sequence[str] = (), flagged_networks: Sequence[str] = (),
                identifier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites and their membership.

    ``stations`` has ``station_id, latitude, longitude, altitude_m, network``.
    Membership rows carry ``network_rank``; members are ordered by
    (network_rank, station_id).  A site takes, column by column, the first
    non-missing value of its members in that order.  A site is flagged when any
    member network is.
    """
    members, links = site_links(stations, radius_km, elevation_tolerance_m, identifier)
    components = connected_components(links)
    labelled = (members.join(components, members.node == components.node, "left")
                .select("station_id", F.coalesce("component", members.node).alias("_site")))
    names = labelled.groupBy("_site").agg(F.min("station_id").alias("site_id"))
    rank = F.lit(len(network_priority))
    for position, name in reversed(list(enumerate(network_priority))):
        rank = F.when(F.col("network") == name, F.lit(position)).otherwise(rank)
    known = stations.withColumn("network", F.coalesce("network", F.lit("unknown")))
    membership = (labelled.join(names, "_site").drop("_site").join(known, "station_id")
                  .withColumn("network_rank", rank.cast("int")))
    order = F.struct("network_rank", "station_id")
    extra = [c for c in stations.columns if c not in ("station_id", "network")]
    sites = membership.groupBy("site_id").agg(
        F.min_by("station_id", order).alias("station_id"), F.min_by("network", order).alias("network"),
        *[first_present(c, order).alias(c) for c in extra],
        F.count(F.lit(1)).alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("network")), "|").alias("networks"),
        F.avg("latitude").alias("mean_latitude"), F.avg("longitude").alias("mean_longitude"),
        F.max(F.col("network").isin(*flagged_networks) if flagged_networks else F.lit(False))
        .alias("potentially_assimilated"))
    return sites, membership.select("site_id", "station_id", "network_rank")
