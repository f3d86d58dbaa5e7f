"""Road graph: edges, stitching, components, least-cost paths.

Iterative steps store each round as a table in the shared folder, so plans stay short and a lost executor costs at
most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions import geo, risk
from frostline.operators.lookup import lookup
from frostline.operators.ordered import running_totals
from frostline.operators.spatial import near_twins, nearest_join
from frostline.session import RoundTables, cut_lineage, new_path

# Stitching and snapping distances, bearing change that counts as a turn.
STITCH_M = 15.0
SNAP_M = 1000.0
TURN_DEGREES = 30.0
DAYS = 7
# Rounds of a path search between renewals of its cost limits, and origins that share the rows of a search.
LIMIT_ROUNDS = 4
SLOTS = 16
# A round that improves less than this share of all rows is stored apart, for at most so many rounds.
FEW_ROWS = 1 / 8
APART_ROUNDS = 16
FORWARD_ONLY = ["yes", "true", "FT"]
BACKWARD_ONLY = ["TF"]


def road_edges(segments: DataFrame) -> DataFrame:
    """Directed edges of segments (objectid, coords, streetname, oneway, length_m); both ways unless one-way."""
    ends = segments.where(F.size("coords") >= 2)
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    length = F.when(F.col("length_m") > 0, F.col("length_m")).otherwise(geo.line_length_m(F.col("coords")))
    one = F.coalesce(F.col("oneway").cast("string"), F.lit(""))
    base = ends.select(
        F.col("objectid").alias("segment_id"), geo.node_key(first["lng"], first["lat"]).alias("_s"),
        geo.node_key(last["lng"], last["lat"]).alias("_e"), length.alias("length_m"),
        F.coalesce("streetname", F.lit("")).alias("streetname"), "coords",
        one.isin(BACKWARD_ONLY).alias("_no_fwd"), one.isin(FORWARD_ONLY).alias("_no_back"))

    def directed(src, dst, coords):
        return base.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "segment_id", "length_m", "streetname",
                           coords.alias("coords"), "_no_fwd", "_no_back")

    forward = directed("_s", "_e", F.col("coords")).where(~F.col("_no_fwd"))
    backward = directed("_e", "_s", F.reverse("coords")).where(~F.col("_no_back"))
    return forward.unionByName(backward).drop("_no_fwd", "_no_back")


def road_nodes(edges: DataFrame) -> DataFrame:
    """One row per node with the coordinate of one of its ends."""
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), first.alias("at")), F.struct(F.col("dst").alias("node"), last.alias("at"))
    )).alias("_x")).select("_x.*")
    lowest = F.min(F.struct(F.col("at")["lng"].alias("lng"), F.col("at")["lat"].alias("lat"))).alias("_p")
    return ends.groupBy("node").agg(lowest).select("node", "_p.lng", "_p.lat")


def stitch_edges(nodes: DataFrame, edges: DataFrame, radius_m: float = STITCH_M) -> DataFrame:
    """Edges both ways between near nodes that are not yet linked both ways; ids are negative."""
    near = near_twins(nodes, radius_m, "node")
    links = edges.select("src", "dst").distinct()
    linked = links.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).select(
        F.col("src").alias("a"), F.col("dst").alias("b"))
    fresh = near.join(linked, ["a", "b"], "left_anti").withColumn("pair", F.concat_ws("|", "a", "b")).withColumn(
        "one", F.lit(1).cast("bigint"))
    numbered = running_totals(fresh, [], "pair", ["one"]).withColumn("segment_id", -(F.col("one_before") + 1))

    def point(side):
        return F.struct(F.col(f"{side}_lng").alias("lng"), F.col(f"{side}_lat").alias("lat"))

    def directed(s, d):
        return numbered.select(
            F.col(s).alias("src"), F.col(d).alias("dst"), "segment_id", F.col("distance_m").alias("length_m"),
            F.lit("").alias("streetname"), F.array(point(s), point(d)).alias("coords"))

    return directed("a", "b").unionByName(directed("b", "a"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Weakly connected component of each node, named by its lowest node.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): every node is tied to the lowest node around
    it until each component is one star. The number of rounds grows with the logarithm of the graph, not with its
    diameter. Links run from the higher node to the lower. A node without a lower neighbour is its own minimum and has no
    row to be looked up, and nodes with a large part of all links are looked up apart, so no task gets the links of one.
    """
    rounds = RoundTables(nodes.sparkSession, "components", keep=4)
    high, low = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    star = rounds.store(edges.where(F.col("src") != F.col("dst")).select(high, low).distinct())
    for _ in range(max_rounds):
        # Large star: whatever hangs on a node moves to the lowest node around that node.
        lowest = rounds.store(_lowest(star)).withColumnRenamed("u", "v")
        large = rounds.store(lookup(star, lowest, ["v"]).select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: a node and all nodes below it move to the lowest of them.
        lowest = rounds.store(_lowest(large))
        small = lookup(large, lowest, ["u"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = rounds.store(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        two_parents = star.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if two_parents.isEmpty() and _parent_not_root(star).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(star.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m): the lowest node that each higher node is linked to."""
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _parent_not_root(star: DataFrame) -> DataFrame:
    """Nodes that are linked to and have a link of their own; each node is reduced to one row before it is joined."""
    parents = star.select(F.col("v").alias("u")).distinct()
    return parents.join(star.select("u").distinct(), "u")


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(parts: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties go to the lowest name."""
    order = F.struct((-F.col("nodes")).alias("size"), "component")
    named = component_sizes(parts).agg(F.min_by("component", order)).scalar()
    return parts.where(F.col("component") == named).select("node")


def snap(points: DataFrame, nodes: DataFrame, at: tuple[str, str], name: str) -> DataFrame:
    """Add the nearest node closer than a kilometre as ``name``; a near ring is searched first."""
    renamed = nodes.select(F.col("node").alias(name), F.col("lat").alias("_nlat"), F.col("lng").alias("_nlng"))
    return nearest_join(points, renamed, SNAP_M, name, [name], base_at=at, target_at=("_nlat", "_nlng"),
                        metric="sphere", strict=True, first_radius_m=SNAP_M / 16).drop("distance_m")


def _slots(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(SLOTS)]


def place_origins(origins: DataFrame, layers: int) -> DataFrame:
    """(origin, batch, slot): origins of one layer share batches of ``SLOTS``."""
    counted = origins.select("origin", (F.col("origin") % layers).alias("_layer"), F.lit(1).cast("bigint").alias("one"))
    number = F.col("one_before")
    return running_totals(counted, ["_layer"], "origin", ["one"]).select(
        "origin", (F.floor(number / SLOTS) * layers + F.col("_layer")).cast("bigint").alias("batch"), (number % SLOTS).cast("int").alias("slot"))


def _sent(costs: DataFrame, links: DataFrame) -> DataFrame:
    """(batch, node, n0, ...): what the nodes behind the links out of each row would cost."""
    return costs.join(links.withColumnRenamed("src", "node"), "node").selectExpr(
        "batch", "dst as node", *[f"c{i} + cost as n{i}" for i in range(SLOTS)])


def _limits(costs: DataFrame, targets: DataFrame) -> DataFrame:
    """(batch, l0, ...): the dearest target of each origin, null until all of its targets are reached."""
    found = targets.join(costs, ["batch", "node"], "left")
    return found.groupBy("batch").agg(*[
        F.expr(f"if(count_if(slot = {i} and c{i} is null) = 0, max(if(slot = {i}, c{i}, null)), null) as l{i}") for i in range(SLOTS)])


def least_cost(links: DataFrame, origins: DataFrame, wanted: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Least costs from each origin to the nodes around it, far enough to settle every wanted (origin, target).

    ``links`` has (src, dst, cost) with numbered nodes, one row per pair; ``origins`` are ``place_origins``. A row (batch, node, c0, ...)
    holds the costs of a node from all origins of a batch, so one row crosses a link for all of them. Each round sends what the
    round before improved over the links, takes the least per node and origin, and stores the costs with a bit mask of what it
    improved. A round with few improvements stores only those and looks up the costs of the nodes it has come to. Once all targets of an origin are reached, costs above the dearest of them are dropped, which is exact for costs
    that are not negative.
    """
    key, slots = ["batch", "node"], range(SLOTS)
    spark = links.sparkSession
    rounds = RoundTables(spark, "paths")
    targets = cut_lineage(wanted.select("origin", F.col("target").alias("node")).distinct().join(origins, "origin").select(
        "batch", "slot", "node"), "targets")
    state = rounds.store(origins.withColumnRenamed("origin", "node").groupBy(*key).agg(
        *[F.expr(f"min(if(slot = {i}, 0D, null)) as c{i}") for i in slots], F.expr("cast(sum(shiftleft(1, slot)) as int) as fresh")))
    # The expressions of a round, by slot.
    opened = [f"if(fresh & {1 << i} != 0, c{i}, null) as c{i}" for i in slots]
    within = [f"if(l{i} is null or n{i} <= l{i}, n{i}, null) as n{i}" for i in slots]
    reached = f"coalesce({', '.join(_slots('n'))}) is not null"
    least = [F.expr(f"min(n{i}) as n{i}") for i in slots]
    after = [f"least(c{i}, n{i}) as c{i}" for i in slots]
    fresh = " + ".join(f"if(n{i} is not null and (c{i} is null or n{i} < c{i}), {1 << i}, 0)" for i in slots)
    apart: list[str] = []

    def known(keys: DataFrame | None = None) -> DataFrame:
        """Costs found so far, of all nodes or of those in ``keys``."""
        costs = state.drop("fresh")
        if apart:
            costs = costs.unionByName(spark.read.schema(state.schema).parquet(*apart).drop("fresh"))
        if keys is not None:
            costs = costs.join(keys.select(*key).distinct(), key, "left_semi")
        return costs.groupBy(*key).agg(*[F.expr(f"min(c{i}) as c{i}") for i in slots]) if apart else costs

    limits, rows, last = None, state.count(), state
    fresh_rows = rows
    for number in range(1, max_rounds + 1):
        if number % LIMIT_ROUNDS == 1:
            # Older limits are only looser, so they need not be renewed each round.
            limits = cut_lineage(_limits(known(targets), targets), "limits")
        found = _sent(last.where("fresh != 0").selectExpr(*key, *opened), links)
        best = found.join(limits, "batch").selectExpr(*key, *within).where(reached).groupBy(*key).agg(*least)
        if fresh_rows < FEW_ROWS * rows and len(apart) < APART_ROUNDS:
            # The few rows are stored, so that their true size is known and the costs are not shuffled to meet them.
            best = cut_lineage(best, "best")
            improved = best.join(known(best), key, "left").selectExpr(*key, *after, f"{fresh} as fresh").where("fresh != 0")
            path = new_path(spark, "apart")
            improved.write.parquet(path)
            apart.append(path)
            last = spark.read.schema(state.schema).parquet(path)
        else:
            state = last = rounds.store(known().join(best, key, "full").selectExpr(*key, *after, f"{fresh} as fresh"))
            apart, rows = [], state.count()
        fresh_rows = last.where("fresh != 0").count()
        if not fresh_rows:
            return known()
    raise RuntimeError("paths did not settle")


def predecessors(settled: DataFrame, links: DataFrame) -> DataFrame:
    """(batch, node, p0, ...): the lowest node before each one on a least path from each origin of the batch."""
    sent = settled.withColumnRenamed("node", "src").join(links, "src").selectExpr(
        "batch", "src", "dst as node", "cost", *[f"c{i} as b{i}" for i in range(SLOTS)])
    # A link without cost leads back as well as forth, so it is used only where no other does.
    tight = [f"b{i} + cost = c{i}" for i in range(SLOTS)]
    picks = [F.expr(f"coalesce(min(if({t} and b{i} < c{i}, src, null)), min(if({t}, src, null))) as p{i}") for i, t in enumerate(tight)]
    return sent.join(settled, ["batch", "node"]).groupBy("batch", "node").agg(*picks)


def walk_back(before: DataFrame, origins: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges of each wanted path in order: (route_id, hop, src, dst, segment_id).

    All paths go back by one edge a round, each wanted (origin, target) once. A round looks up only the places it has come to
    and stores only their edges, so the rows stay those of the wanted paths.
    """
    spark = before.sparkSession
    folder = new_path(spark, "walk")
    row = "origin bigint, target bigint, batch bigint, slot int, src bigint, dst bigint"
    at = cut_lineage(wanted.select("origin", "target").distinct().join(origins, "origin").select(
        "origin", "target", "batch", "slot", F.col("target").alias("node")), "places")
    back = 0
    while not at.isEmpty():
        src = F.coalesce(*[F.when(F.col("slot") == i, F.col(p)) for i, p in enumerate(_slots("p"))])
        at.join(before, ["batch", "node"]).select("origin", "target", "batch", "slot", src.alias("src"), F.col("node").alias("dst")).where(
            F.col("src").isNotNull()).write.parquet(f"{folder}/back={back}")
        at = spark.read.schema(row).parquet(f"{folder}/back={back}").where(F.col("src") != F.col("origin")).select(
            "origin", "target", "batch", "slot", F.col("src").alias("node"))
        back += 1
    if not back:
        steps = spark.createDataFrame([], f"{row}, back int")
    else:
        steps = spark.read.schema(f"{row}, back int").parquet(folder)
    edges = wanted.join(steps, ["origin", "target"]).join(links.select("src", "dst", "segment_id"), ["src", "dst"])
    length = F.max("back").over(Window.partitionBy("route_id"))
    return edges.select("route_id", (length - F.col("back")).cast("bigint").alias("hop"), "src", "dst", "segment_id")


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Consecutive numbers for nodes in the order of their keys: (node, node_id)."""
    counted = nodes.select("node").withColumn("one", F.lit(1).cast("bigint"))
    return running_totals(counted, [], "node", ["one"]).select("node", F.col("one_before").alias("node_id"))


def with_node_ids(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges whose ends are node numbers."""
    for side in ("src", "dst"):
        ids = numbers.select(F.col("node").alias(side), F.col("node_id").alias("_id"))
        edges = edges.join(ids, side).drop(side).withColumnRenamed("_id", side)
    return edges


def safest_routes(requests: DataFrame, segments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Edges of the least-risk route of each request (route_id, from_lng, from_lat, to_lng, to_lat, day_offset).

    Returns (route_id, day_offset, hop, src, dst, segment_id, length_m, risk, streetname, coords). Requests whose ends
    do not reach the main component, or meet in one node, have no rows. Days are 0 to 6; costs depend on the day, so
    each node stands once per day in the search. The search runs on node numbers, which keeps its tables narrow.
    """
    roads = cut_lineage(road_edges(segments), "edges")
    places = cut_lineage(road_nodes(roads), "nodes")
    numbers = cut_lineage(number_nodes(places), "numbers")
    edges = cut_lineage(with_node_ids(roads.unionByName(stitch_edges(places, roads)), numbers).where(
        F.col("src") != F.col("dst")), "edges")
    nodes = cut_lineage(places.join(numbers, "node").select(F.col("node_id").alias("node"), "lng", "lat"), "nodes")
    main = cut_lineage(nodes.join(largest_component(cut_lineage(components(nodes, edges), "components")), "node",
                                  "left_semi"), "main")
    snapped = snap(snap(requests, main, ("from_lat", "from_lng"), "_from"), main, ("to_lat", "to_lng"), "_to")
    asked = cut_lineage(snapped.where(F.col("_from") != F.col("_to")).select("route_id", "day_offset", "_from", "_to"),
                        "requests")

    def on_day(node):
        return (F.col(node) * DAYS + F.col("day_offset")).cast("bigint")

    # At most one prediction per segment and day; an edge is repeated for the days asked for.
    day_list = asked.agg(F.collect_set("day_offset")).scalar()
    risks = predictions.select("day_offset", F.col("objectid").alias("segment_id"), F.col("risk_score").alias("risk"))
    dated = edges.select("src", "dst", "segment_id", "length_m").withColumn("day_offset", F.explode(day_list)).join(
        risks, ["segment_id", "day_offset"], "left")
    priced = dated.select(
        on_day("src").alias("src"), on_day("dst").alias("dst"), "segment_id",
        risk.edge_cost(F.col("length_m"), F.coalesce("risk", F.lit(0.0))).alias("cost"))
    wanted = asked.select("route_id", on_day("_from").alias("origin"), on_day("_to").alias("target"))
    links = cut_lineage(priced.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(
        F.min(F.struct("cost", "segment_id")).alias("_e")).select("src", "dst", "_e.cost", "_e.segment_id"), "links")
    wanted = cut_lineage(wanted.dropna(subset=["origin", "target"]), "wanted")
    origins = cut_lineage(place_origins(wanted.select("origin").distinct(), DAYS), "origins")
    settled = cut_lineage(least_cost(links, origins, wanted), "settled")
    before = cut_lineage(predecessors(settled, links), "before")
    hops = walk_back(before, origins, links, wanted).select(
        "route_id", (F.col("src") % DAYS).alias("day_offset"), "hop", F.floor(F.col("src") / DAYS).alias("src"),
        F.floor(F.col("dst") / DAYS).alias("dst"), "segment_id")
    detail = hops.join(edges, ["src", "dst", "segment_id"]).join(risks, ["segment_id", "day_offset"], "left")
    for side in ("src", "dst"):
        keys = numbers.select(F.col("node_id").alias(side), F.col("node").alias("_key"))
        detail = detail.join(keys, side).drop(side).withColumnRenamed("_key", side)
    return detail.select("route_id", "day_offset", "hop", "src", "dst", "segment_id", "length_m",
                         F.coalesce("risk", F.lit(0.0)).alias("risk"), "streetname", "coords")


def route_summary(hops: DataFrame) -> DataFrame:
    """Distance, duration and risk of each route."""
    agg = hops.groupBy("route_id", "day_offset").agg(
        F.sum("length_m").alias("_len"), F.avg("risk").alias("_avg"), F.max("risk").alias("_max"),
        F.count_distinct("segment_id").alias("matched_segments"))
    return agg.select(
        "route_id", "day_offset", F.round("_len").cast("bigint").alias("distance_m"),
        F.round(F.col("_len") / F.lit(risk.SPEED_M_PER_S)).cast("bigint").alias("duration_sec"),
        F.round("_avg", 3).alias("average_risk"), F.round(F.greatest("_max", F.lit(0.0)), 3).alias("max_risk"),
        risk.risk_category(F.col("_avg")).alias("risk_category"), "matched_segments")


def route_geometry(hops: DataFrame) -> DataFrame:
    """One line per route; the first point of each further edge is left out."""
    piece = F.when(F.col("hop") == 0, F.col("coords")).otherwise(F.slice("coords", 2, F.size("coords")))
    pieces = F.array_sort(F.collect_list(F.struct("hop", piece.alias("part"))))
    return hops.groupBy("route_id").agg(F.flatten(F.transform(pieces, lambda x: x["part"])).alias("coords"))


def route_steps(hops: DataFrame) -> DataFrame:
    """Turn-by-turn steps: a new one on a change of named street or a bearing change of more than 30 degrees.

    A step is worded by the turn at its end and its own street.
    """
    in_order = Window.partitionBy("route_id").orderBy("hop")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    df = hops.withColumn("bearing", geo.bearing_deg(first["lat"], first["lng"], last["lat"], last["lng"]))
    named = F.nullif("streetname", F.lit(""))
    df = df.withColumn("_street", F.coalesce(F.last(named, ignorenulls=True).over(before), F.lit(""))).withColumn(
        "_prev", F.lag("bearing").over(in_order))
    starts = (F.col("_prev").isNull() | ((F.col("streetname") != F.col("_street")) & (F.col("streetname") != ""))
              | F.coalesce(geo.angle_between(F.col("_prev"), F.col("bearing")) > TURN_DEGREES, F.lit(False)))
    df = df.withColumn("step", F.sum(F.when(starts, 1).otherwise(0)).over(
        in_order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).withColumn(
        "_now", F.when(F.col("streetname") != "", F.col("streetname")).otherwise(F.col("_street"))).withColumn(
        "_next", F.lead("bearing").over(in_order))
    steps = df.groupBy("route_id", "step").agg(
        F.sum("length_m").alias("_len"), F.avg("risk").alias("_risk"), F.min_by("_now", "hop").alias("streetname"),
        F.max_by(F.struct("bearing", "_next"), F.col("hop")).alias("_end"))
    turn = F.when(F.col("_end._next").isNull(), "Continue on").otherwise(
        geo.turn_phrase(F.col("_end.bearing"), F.col("_end._next")))
    road = F.when(F.col("streetname") == "", "road").otherwise(F.col("streetname"))
    return steps.where(F.col("_len") > 0).select(
        "route_id", "step", F.concat_ws(" ", turn, road).alias("instruction"), "streetname",
        F.round("_len").cast("bigint").alias("distance_m"), F.round("_risk", 3).alias("risk_score"),
        risk.risk_category(F.col("_risk")).alias("risk_category"))
