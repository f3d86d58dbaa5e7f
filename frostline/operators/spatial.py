"""Distance joins as equi-joins on grid cells.

Both sides are cut into square cells at least as wide as the radius, the *places* side is copied to its nine
neighbouring cells, and an equi-join on the cell followed by the exact distance test finds every pair once.
Nothing is broadcast by hint and no side is crossed with the other.

Two things keep a crowded cell from becoming one long task. Rows that share a position are collapsed before
the join (their number, or their lowest id, is all that matters) and are spread out again by an equi-join on
the position. Cells that would still test more than ``PAIRS_PER_TASK`` pairs are divided: the points in them get
a salt, and the places in them are copied once per salt.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions import geo
from frostline.session import cut_lineage

PAIRS_PER_TASK = 20_000_000
# A search for the nearest row begins with cells that hold about so many of the others around a row.
FIRST_CROWD = 16
# Points and places meet in blocks so many radii wide; blocks are halved while more than so many pairs lie in one.
BLOCK_RADII, PAIRS_PER_BLOCK = 8, 4_000_000_000


def _planar_cells(lat: Column, lng: Column, radius_m: float) -> tuple[Column, Column]:
    return F.floor(geo.metres_east(lng) / radius_m), F.floor(geo.metres_north(lat) / radius_m)


def _row_degrees(radius_m: float) -> float:
    return math.degrees(radius_m / geo.EARTH_RADIUS_M) * 1.001


def _sphere_row(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / _row_degrees(radius_m))


def _sphere_column(lng: Column, row: Column, radius_m: float) -> Column:
    """Column of a longitude in a row of cells; columns widen towards the poles so that one covers the radius."""
    height = _row_degrees(radius_m)
    furthest = F.least((F.abs(row + 0.5) + 1.5) * height, F.lit(89.9))
    return F.floor(lng / (F.lit(1.01 * height) / F.cos(F.radians(furthest))))


def _own_cell(df: DataFrame, lat: str, lng: str, radius_m: float, metric: str) -> DataFrame:
    if metric == "planar":
        cx, cy = _planar_cells(F.col(lat), F.col(lng), radius_m)
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    df = df.withColumn("_cy", _sphere_row(F.col(lat), radius_m))
    return df.withColumn("_cx", _sphere_column(F.col(lng), F.col("_cy"), radius_m))


def _nine_cells(df: DataFrame, lat: str, lng: str, radius_m: float, metric: str) -> DataFrame:
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    df = df.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    if metric == "planar":
        cx, cy = _planar_cells(F.col(lat), F.col(lng), radius_m)
        df = df.withColumn("_cx", cx + F.col("_dx")).withColumn("_cy", cy + F.col("_dy"))
    else:
        df = df.withColumn("_cy", _sphere_row(F.col(lat), radius_m) + F.col("_dy"))
        df = df.withColumn("_cx", _sphere_column(F.col(lng), F.col("_cy"), radius_m) + F.col("_dx"))
    return df.drop("_dx", "_dy")


def _divide_crowded(points: DataFrame, places: DataFrame, limit: int,
                    cell: tuple[str, ...] = ("_cx", "_cy")) -> tuple[DataFrame, DataFrame]:
    """Divide the cells whose pair count exceeds ``limit``; other cells keep the single salt 0.

    The larger side of a cell is cut into parts and the smaller one copied to each of them; where the smaller side is
    large too, it is cut as well. So every task gets at most about ``limit`` pairs, and few rows are copied.
    """
    cell = list(cell)
    a, b = F.col("_a"), F.col("_b")
    few, many = F.least(a, b), F.greatest(a, b)
    few_parts = F.ceil(few / F.lit(float(limit) ** 0.5))
    many_parts = F.ceil(many * F.ceil(few / few_parts) / F.lit(float(limit)))
    parts = _crowded(points, places, limit, cell, point_parts=F.when(a <= b, few_parts).otherwise(many_parts),
                     place_parts=F.when(a <= b, many_parts).otherwise(few_parts))
    if parts is None:
        return points.withColumn("_salt", F.lit(0)), places.withColumn("_salt", F.lit(0))
    own_points, own_places = F.coalesce("_point_parts", F.lit(1)), F.coalesce("_place_parts", F.lit(1))

    def own(df, count):
        return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in cell]), count).cast("int")

    # A salt stands for a part of the points and a part of the places.
    divided_points = points.join(parts, cell, "left").withColumn("_salt", F.explode(F.transform(
        F.sequence(F.lit(0), own_places - 1), lambda j: own(points, own_points) * own_places + j)))
    divided_places = places.join(parts, cell, "left").withColumn("_salt", F.explode(F.transform(
        F.sequence(F.lit(0), own_points - 1), lambda i: i * own_places + own(places, own_places))))
    return divided_points.drop("_point_parts", "_place_parts"), divided_places.drop("_point_parts", "_place_parts")


def _crowded(points: DataFrame, places: DataFrame, limit: int, cell: list[str], **parts: Column) -> DataFrame | None:
    """The cells with more than ``limit`` pairs and into how many parts they are cut; None if there are none.

    Counts are reduced before they are shuffled. The few crowded cells are stored, so that their true size is known and
    the rows are not shuffled once more to meet them.
    """
    a, b = F.col("_a"), F.col("_b")
    counts = points.groupBy(cell).agg(F.count("*").alias("_a")).join(places.groupBy(cell).agg(F.count("*").alias("_b")), cell)
    found = cut_lineage(counts.where(a * b > limit).select(*cell, *[c.cast("int").alias(f"_{name}") for name, c in parts.items()]), "crowded")
    return None if found.isEmpty() else found


def _meet(left: DataFrame, right: DataFrame, cell: list[str]) -> DataFrame:
    """Both sides shuffled by cell.

    Sizes are estimated before rows are copied to their cells, so the optimizer would take a side for small that is many
    times larger, and send it through the driver to every executor.
    """
    return left.hint("merge").join(right, cell)


def pairs_within(points: DataFrame, places: DataFrame, radius_m: float, *, point_at=("lat", "lng"),
                 place_at=("mid_lat", "mid_lng"), metric: str = "planar", strict: bool = False,
                 pairs_per_task: int | None = None) -> DataFrame:
    """All (point, place) rows no further apart than ``radius_m``, with ``distance_m``.

    ``metric`` is ``planar`` (flat projection) or ``sphere`` (great circle). Column names of the two sides must
    differ. Rows without a position match nothing.
    """
    points = points.dropna(subset=list(point_at))
    places = places.dropna(subset=list(place_at))
    points = _own_cell(points, *point_at, radius_m, metric)
    places = _nine_cells(places, *place_at, radius_m, metric)
    points, places = _divide_crowded(points, places, pairs_per_task or PAIRS_PER_TASK)
    joined = _meet(points, places, ["_cx", "_cy", "_salt"]).drop("_cx", "_cy", "_salt")
    plat, plng, qlat, qlng = (F.col(c) for c in (*point_at, *place_at))
    if metric == "planar":
        dx = geo.metres_east(plng) - geo.metres_east(qlng)
        dy = geo.metres_north(plat) - geo.metres_north(qlat)
        near = joined.withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= radius_m * radius_m)
        return near.withColumn("distance_m", F.sqrt("_d2")).drop("_d2")
    near = joined.withColumn("distance_m", geo.haversine_m(plat, plng, qlat, qlng))
    return near.where((F.col("distance_m") < radius_m) if strict else (F.col("distance_m") <= radius_m))


def sums_within(points: DataFrame, places: DataFrame, radius_m: float, place_id: str, keys: list[str], totals: dict, *,
                point_at=("lat", "lng"), place_at=("mid_lat", "mid_lng"), pairs_per_task: int = 50 * PAIRS_PER_TASK) -> DataFrame:
    """Totals of the points in reach of each place by the points' ``keys``: (place_id, keys, totals).

    ``totals`` maps columns of the points to the aggregate that adds them up. Points are copied to their nine cells, so
    that a place meets all of its points in one task and they are added up there: pairs are never shuffled, however many
    there are. Crowded cells are cut by their places only, for the same reason. Ids that stand at several places are added
    up once more.
    """
    cell = ["_cx", "_cy"]
    points = _nine_cells(points.dropna(subset=list(point_at)), *point_at, radius_m, "planar")
    places = _own_cell(places.dropna(subset=list(place_at)).select(place_id, *place_at), *place_at, radius_m, "planar")
    a, b = F.col("_a"), F.col("_b")
    parts = _crowded(places, points, pairs_per_task, cell, parts=F.least(a, F.ceil(a * b / F.lit(float(pairs_per_task)))))
    if parts is None:
        places, points = places.withColumn("_salt", F.lit(0)), points.withColumn("_salt", F.lit(0))
    else:
        own = F.coalesce("_parts", F.lit(1))
        places = places.join(parts, cell, "left").withColumn("_salt", F.pmod(F.xxhash64(place_id, *place_at), own).cast("int")).drop("_parts")
        points = points.join(parts, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
    plat, plng, qlat, qlng = (F.col(c) for c in (*point_at, *place_at))
    dx, dy = geo.metres_east(plng) - geo.metres_east(qlng), geo.metres_north(plat) - geo.metres_north(qlat)
    added = [add(name).alias(name) for name, add in totals.items()]
    near = _meet(points, places, [*cell, "_salt"]).where(dx * dx + dy * dy <= radius_m * radius_m)
    sums = near.groupBy(*cell, "_salt", place_id, *keys).agg(*added).select(place_id, *keys, *totals)
    if places.groupBy(place_id).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return sums
    return sums.groupBy(place_id, *keys).agg(*added)


def totals_within(points: DataFrame, places: DataFrame, radius_m: float, place_id: str, slot: str, value: str, *,
                  point_at=("lat", "lng"), place_at=("mid_lat", "mid_lng"), flags: bool = False, pairs_per_block: int | None = None) -> DataFrame:
    """Totals of the points in reach of each place by a whole number of the points, their ``slot``: (place_id, packed).

    A place with points in reach has one row; ``unpacked`` unfolds it to a row per slot. With ``flags`` a total is 1. Points are
    copied to the blocks of cells that their circle touches, fewer than two on average, and each block adds up all of its places at once: pairs are
    neither rows nor shuffled, and a place's totals travel as a few bytes a slot. Crowded blocks are cut by their places.
    """
    x, y = geo.metres_east(F.col(point_at[1])), geo.metres_north(F.col(point_at[0]))
    points = cut_lineage(points.dropna(subset=list(point_at)).select(
        x.alias("_x"), y.alias("_y"), F.col(slot).cast("bigint").alias("_slot"), F.col(value).cast("bigint").alias("_value")), "points")
    places = places.dropna(subset=list(place_at)).select(
        place_id, geo.metres_east(F.col(place_at[1])).alias("_px"), geo.metres_north(F.col(place_at[0])).alias("_py"))
    cell, limit = ["_cx", "_cy"], pairs_per_block or PAIRS_PER_BLOCK

    def laid(radii: int) -> tuple[DataFrame, DataFrame]:
        width, reach = radii * radius_m, radius_m * 1.001
        spans = [F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))) for c in ("_x", "_y")]
        return (points.withColumn("_cx", spans[0]).withColumn("_cy", spans[1]),
                places.withColumn("_cx", F.floor(F.col("_px") / width)).withColumn("_cy", F.floor(F.col("_py") / width)))

    radii = BLOCK_RADII
    near, here = laid(radii)
    pairs = F.col("_a").cast("double") * F.col("_b")
    crowd = near.groupBy(cell).agg(F.count("*").alias("_a")).join(here.groupBy(cell).agg(F.count("*").alias("_b")), cell).agg(
        (F.sum(pairs * pairs) / F.sum(pairs)).alias("crowd")).head()["crowd"] or 0.0
    while crowd > limit and radii > 1:
        radii, crowd = radii // 2, crowd / 8
    near, here = laid(radii)
    a, b = F.col("_a"), F.col("_b")
    parts = _crowded(here, near, 4 * limit, cell, parts=F.least(a, F.ceil(a * b / F.lit(float(limit)))))
    if parts is None:
        here, near = here.withColumn("_salt", F.lit(0)), near.withColumn("_salt", F.lit(0))
    else:
        own = F.coalesce("_parts", F.lit(1))
        here = here.join(parts, cell, "left").withColumn("_salt", F.pmod(F.xxhash64(place_id, "_px", "_py"), own).cast("int")).drop("_parts")
        near = near.join(parts, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
    key = [*cell, "_salt"]
    kind = here.schema[place_id].dataType.simpleString()
    return here.groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(
        _block_totals(radius_m, place_id, flags), f"`{place_id}` {kind}, packed binary")


def _block_totals(radius_m: float, place_id: str, flags: bool):
    """Totals of one block, as a function of its places and points; cells of half the radius tell which points to try."""
    import zlib

    def packed(slots: np.ndarray, totals: np.ndarray) -> bytes:
        steps = np.diff(slots, prepend=0)
        parts = [values.astype(np.min_scalar_type(values.max())) for values in (steps, totals)]
        head = bytes([part.dtype.itemsize for part in parts])
        return head + zlib.compress(b"".join(part.tobytes() for part in parts), 1)

    def met(places: pa.Table, points: pa.Table) -> pa.Table:
        ids, found, width, reach = [], [], radius_m / 2, 2
        if places.num_rows and points.num_rows:
            x, y, slot, value = (points.column(c).to_numpy() for c in ("_x", "_y", "_slot", "_value"))
            px, py = (places.column(c).to_numpy() for c in ("_px", "_py"))
            slots, slot = np.unique(slot, return_inverse=True)
            slot = slot.astype(np.min_scalar_type(len(slots)))
            cx, cy, pcx, pcy = (np.floor(v / width).astype(np.int64) for v in (x, y, px, py))
            left, low = min(cx.min(), pcx.min()) - reach, min(cy.min(), pcy.min()) - reach
            span = max(cx.max(), pcx.max()) - left + reach + 1
            key, place_key = (cy - low) * span + cx - left, (pcy - low) * span + pcx - left
            order = np.argsort(key, kind="stable")
            key, x, y, slot, value = key[order], x[order], y[order], slot[order], value[order]
            alike = bool((value == 1).all())
            place_order = np.argsort(place_key, kind="stable")
            cells, starts = np.unique(place_key[place_order], return_index=True)
            rows = cells[:, None] + np.arange(-reach, reach + 1) * span
            firsts, lasts = np.searchsorted(key, rows - reach), np.searchsorted(key, rows + reach, "right")
            for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(place_order)])):
                near = np.concatenate([np.arange(i, j) for i, j in zip(firsts[k], lasts[k])])
                if not len(near):
                    continue
                near = near[np.argsort(slot[near], kind="stable")]
                nx, ny, ns = x[near], y[near], slot[near]
                ends = np.flatnonzero(np.append(ns[1:] != ns[:-1], True))
                own = slots[ns[ends]]
                step = max(1, 2**18 // len(near))
                for at in range(start, end, step):
                    here = place_order[at:min(at + step, end)]
                    dx, dy = nx - px[here, None], ny - py[here, None]
                    hit = dx * dx + dy * dy <= radius_m * radius_m
                    run = np.cumsum(hit, axis=1, dtype=np.int32) if alike else np.cumsum(hit * value[near], axis=1)
                    totals = np.diff(run[:, ends], axis=1, prepend=0)
                    for place, total in zip(here, totals):
                        any_of = np.flatnonzero(total)
                        if len(any_of):
                            ids.append(place)
                            found.append(packed(own[any_of], np.minimum(total[any_of], 1) if flags else total[any_of]))
        taken = places.column(place_id).combine_chunks().take(pa.array(ids, pa.int64()))
        return pa.table({place_id: taken, "packed": pa.array(found, pa.binary())})

    return met


def unpacked_totals():
    """Slots and totals of one packed value; as an inner function it travels with the tasks."""
    import zlib

    def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = zlib.decompress(value[2:])
        count = len(data) // (value[0] + value[1])
        steps = np.frombuffer(data, f"u{value[0]}", count)
        return np.cumsum(steps, dtype=np.int64), np.frombuffer(data, f"u{value[1]}", count, count * value[0]).astype(np.int64)

    return unpacked


def unpacked(totals: DataFrame, place_id: str, slot: str, value: str) -> DataFrame:
    """(place_id, slot, value): a row per slot of each row of ``totals_within``."""
    unfold = unpacked_totals()
    schema = f"`{place_id}` {totals.schema[place_id].dataType.simpleString()}, `{slot}` bigint, `{value}` bigint"

    def rows(batches):
        for batch in batches:
            ids, values = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(values), 256):
                slots, sums = zip(*map(unfold, values[at:at + 256]))
                of = np.repeat(np.arange(at, at + len(slots)), [len(s) for s in slots])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(np.concatenate(slots)), pa.array(np.concatenate(sums))],
                                                 [place_id, slot, value])

    return totals.select(place_id, "packed").mapInArrow(rows, schema)


def distinct_positions(base: DataFrame, at: tuple[str, str] = ("mid_lat", "mid_lng")) -> DataFrame:
    """Positions of a table, to be stored once and handed to several joins on the same base."""
    return _positions(base, at)


def _positions(df: DataFrame, at: tuple[str, str], *aggregates: Column) -> DataFrame:
    """One row per position, under the names ``_lat`` and ``_lng``."""
    located = df.dropna(subset=list(at)).select(F.col(at[0]).alias("_lat"), F.col(at[1]).alias("_lng"), "*")
    if aggregates:
        return located.groupBy("_lat", "_lng").agg(*aggregates)
    return located.select("_lat", "_lng").distinct()


def _attach(base: DataFrame, at: tuple[str, str], by_position: DataFrame) -> DataFrame:
    """Left-join a table keyed by position to the rows at that position."""
    keyed = by_position.withColumnRenamed("_lat", "_klat").withColumnRenamed("_lng", "_klng")
    return base.join(
        keyed, (base[at[0]] == keyed["_klat"]) & (base[at[1]] == keyed["_klng"]), "left"
    ).drop("_klat", "_klng")


def radius_counts(base: DataFrame, targets: dict[str, DataFrame], radius_m: float, *, base_at=("mid_lat", "mid_lng"),
                  target_at=("latitude", "longitude"), positions: DataFrame | None = None) -> DataFrame:
    """Add one column per entry of ``targets``: how many of its rows lie within the radius of each base row.

    All tables share one distance join. ``positions`` are the base's ``distinct_positions`` when they are already at
    hand; then the base is read once.
    """
    kinds = [df.select(F.col(target_at[0]).alias("_tlat"), F.col(target_at[1]).alias("_tlng"), F.lit(name).alias("_kind"))
             for name, df in targets.items()]
    together = kinds[0]
    for kind in kinds[1:]:
        together = together.unionByName(kind)
    points = together.dropna().groupBy("_tlat", "_tlng").agg(*[
        F.count_if(F.col("_kind") == name).alias(name) for name in targets])
    if positions is None:
        positions = _positions(base, base_at)
    near = pairs_within(points, positions, radius_m, point_at=("_tlat", "_tlng"), place_at=("_lat", "_lng"))
    counts = near.groupBy("_lat", "_lng").agg(*[F.sum(name).alias(name) for name in targets])
    return _attach(base, base_at, counts).withColumns({
        name: F.coalesce(F.col(name), F.lit(0)).cast("bigint") for name in targets})


def radius_count(base: DataFrame, targets: DataFrame, radius_m: float, name: str, **at) -> DataFrame:
    """Add ``name``: how many targets lie within the radius of each base row."""
    return radius_counts(base, {name: targets}, radius_m, **at)


def radius_flags(base: DataFrame, targets: dict[str, DataFrame], radius_m: float, **at) -> DataFrame:
    """Add one boolean per entry of ``targets``: whether any of its rows lies within the radius."""
    return radius_counts(base, targets, radius_m, **at).withColumns({name: F.col(name) > 0 for name in targets})


def radius_flag(base: DataFrame, targets: DataFrame, radius_m: float, name: str, *, base_at=("mid_lat", "mid_lng"),
                target_at=("latitude", "longitude"), metric: str = "planar", carry: tuple[str, str] | None = None,
                positions: DataFrame | None = None) -> DataFrame:
    """Add ``name``: whether any target lies within the radius.

    ``carry=(column, order)`` also adds that column of the first target in reach, by ``order``.
    """
    aggregates = []
    if carry:
        aggregates = [F.min(F.struct(F.col(carry[1]).alias("_o"), F.col(carry[0]).alias("_v"))).alias("_first")]
    points = _positions(targets, target_at, *aggregates)
    points = points.withColumnRenamed("_lat", "_tlat").withColumnRenamed("_lng", "_tlng")
    if positions is None:
        positions = _positions(base, base_at)
    near = pairs_within(points, positions, radius_m, point_at=("_tlat", "_tlng"), place_at=("_lat", "_lng"), metric=metric)
    found = [F.lit(True).alias(name)] + ([F.min("_first").getField("_v").alias(carry[0])] if carry else [])
    if carry:
        hits = near.groupBy("_lat", "_lng").agg(*[F.first(found[0]).alias(name), found[1]])
    else:
        hits = near.select("_lat", "_lng").distinct().withColumn(name, F.lit(True))
    return _attach(base, base_at, hits).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _doubling_radii(places: DataFrame, radius_m: float, metric: str) -> list[float]:
    """Radii that double up to the given one; cells of the first hold about ``FIRST_CROWD`` places around a place."""
    cells = _own_cell(places, "_tlat", "_tlng", radius_m, metric).groupBy("_cx", "_cy").agg(F.count("*").cast("double").alias("n"))
    crowd = cells.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).head()["crowd"] or 0.0
    halvings = math.ceil(math.log(crowd / FIRST_CROWD, 4)) if crowd > FIRST_CROWD else 0
    return [radius_m / 2**k for k in range(halvings, -1, -1)]


def nearest_join(base: DataFrame, targets: DataFrame, radius_m: float, target_id: str, columns: list[str], *,
                 base_at=("mid_lat", "mid_lng"), target_at=("latitude", "longitude"), metric: str = "planar",
                 strict: bool = False, first_radius_m: float | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Add ``columns`` and ``distance_m`` of the nearest target within the radius; ties go to the lowest id.

    Looks in a small radius first and sends only what stays unmatched on to larger ones, up to the full one. The result is
    the same, but a row meets a bounded number of targets, however densely they lie. ``first_radius_m`` is the first
    of two radii; without it they double from one whose cells hold few targets.
    """
    if positions is None:
        positions = _positions(base, base_at)
    hits = nearest_rows(positions, targets, radius_m, target_id, columns, base_at=("_lat", "_lng"), target_at=target_at, metric=metric,
                        strict=strict, first_radius_m=first_radius_m)
    return _attach(base, base_at, hits)


def nearest_rows(points: DataFrame, targets: DataFrame, radius_m: float, target_id: str, columns: list[str], *,
                 base_at=("mid_lat", "mid_lng"), target_at=("latitude", "longitude"), metric: str = "planar", strict: bool = False,
                 first_radius_m: float | None = None, points_per_task: int | None = None) -> DataFrame:
    """Distinct points that have a target in reach, with ``columns`` and ``distance_m`` of the nearest; ties as in ``nearest_join``.

    A point stays in its cell and meets all targets around it in one task, so neither pairs nor points are shuffled to
    find the nearest. The least distance is a number, which is added up without sorting the pairs; the target
    at that distance is looked up in the same cells. Points without a target in reach go on to the next radius.
    """
    given = points.columns
    lowest = F.min(F.struct(F.col(target_id).alias("_id"), *[F.col(c).alias(f"_v_{c}") for c in columns]))
    places = cut_lineage(_positions(targets, target_at, lowest.alias("_best")).select(
        F.col("_lat").alias("_tlat"), F.col("_lng").alias("_tlng"), "_best"), "targets")
    if first_radius_m is None:
        reaches = _doubling_radii(places, radius_m, metric)
    else:
        reaches = [first_radius_m] * (first_radius_m < radius_m) + [radius_m]

    def search(rest: DataFrame, reach: float) -> DataFrame:
        cell = ["_cx", "_cy"]
        a, b = F.col("_a"), F.col("_b")
        here = _own_cell(rest, *base_at, reach, metric)
        around = _nine_cells(places, "_tlat", "_tlng", reach, metric)
        limit = points_per_task or PAIRS_PER_TASK
        parts = _crowded(here, around, limit, cell, parts=F.least(a, F.ceil(a * b / F.lit(float(limit)))))
        if parts is not None:
            own = F.coalesce("_parts", F.lit(1))
            here = here.join(parts, cell, "left").withColumn("_salt", F.pmod(F.xxhash64(*given), own).cast("int")).drop("_parts")
            around = around.join(parts, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
            cell = [*cell, "_salt"]
        apart, near = _distance(*base_at, "_tlat", "_tlng", reach, metric, strict)
        around = around.select(*[F.col(c).alias(f"_t{c}") for c in cell], "_tlat", "_tlng", "_best")

        def meeting(left: DataFrame, condition: Column) -> DataFrame:
            for c in cell:
                condition = (F.col(c) == F.col(f"_t{c}")) & condition
            return left.hint("merge").join(around, condition, "left")

        least = meeting(here, near).groupBy(*cell, *given).agg(F.min(F.when(F.col("_tlat").isNotNull(), apart)).alias("distance_m"))
        return meeting(least, near & (apart == F.col("distance_m"))).groupBy(*cell, *given, "distance_m").agg(
            F.min("_best").alias("_best")).drop(*cell)

    rest, hits = points.dropna(subset=list(base_at)), None
    for reach in reaches:
        found = cut_lineage(search(rest, reach), "hits")
        rest, close = found.where(F.col("distance_m").isNull()).select(*given), found.where(F.col("distance_m").isNotNull())
        hits = close if hits is None else hits.unionByName(close)
    return hits.select(*given, *[F.col("_best")[f"_v_{c}"].alias(c) for c in columns], "distance_m")


def _distance(plat: str, plng: str, qlat: str, qlng: str, radius_m: float, metric: str, strict: bool) -> tuple[Column, Column]:
    """The distance of two positions in metres, and whether it lies within the radius."""
    plat, plng, qlat, qlng = (F.col(c) for c in (plat, plng, qlat, qlng))
    if metric == "planar":
        dx = geo.metres_east(plng) - geo.metres_east(qlng)
        dy = geo.metres_north(plat) - geo.metres_north(qlat)
        return F.sqrt(dx * dx + dy * dy), dx * dx + dy * dy <= radius_m * radius_m
    apart = geo.haversine_m(plat, plng, qlat, qlng)
    return apart, (apart < radius_m) if strict else (apart <= radius_m)


def near_twins(nodes: DataFrame, radius_m: float, node_id: str, at=("lat", "lng")) -> DataFrame:
    """Pairs of different nodes within the radius, each once as (a, b) with a < b."""
    left = nodes.select(F.col(node_id).alias("a"), F.col(at[0]).alias("a_lat"), F.col(at[1]).alias("a_lng"))
    right = nodes.select(F.col(node_id).alias("b"), F.col(at[0]).alias("b_lat"), F.col(at[1]).alias("b_lng"))
    near = pairs_within(left, right, radius_m, point_at=("a_lat", "a_lng"), place_at=("b_lat", "b_lng"),
                        metric="sphere")
    return near.where(F.col("a") < F.col("b"))


# Levels of the box grids: cells of level 0 are the given ones, those of each further level twice as wide.
BOX_LEVELS = 16


def bbox_overlap(lines: DataFrame, boxes: DataFrame, cell_degrees: float = geo.GRID_DEGREES * 8,
                 pairs_per_task: int | None = None) -> DataFrame:
    """Lines whose bounding box meets a query box, one row per (box_id, line).

    Both sides carry ``min_lng, min_lat, max_lng, max_lat`` (boxes prefixed ``box_``). A box lies on the level of a
    hierarchy of grids whose cells are at least as wide and as high as it is, so it touches at most four of them, however
    large it is; only a box wider than a cell of the last level touches more. For each level of the boxes, the cells a line
    touches are put together to the fewest cells of that and coarser levels, in each direction: a number that grows with the
    logarithm of its size. A box is looked up in its cells and all cells around those, and finds each line that touches one of
    its cells once per such cell, and no other. A pair that shares several cells is kept in its lowest shared one, so no
    distinct is needed. Cells of lines without a box are dropped before the shuffle. Crowded cells are divided as in the
    other cell joins.
    """
    key = ["_level", "_x", "_cx", "_y", "_cy"]

    def cell(value: str, at: str) -> str:
        return f"cast(floor({value} / ({cell_degrees!r}D * pow(2D, {at}))) as bigint)"

    extent = "greatest(box_max_lng - box_min_lng, box_max_lat - box_min_lat, 0D)"
    # The ceiling of the logarithm, with room for its last bit.
    own = f"cast(least(ceil(log2(greatest({extent} / {cell_degrees!r}D, 1D)) + 1e-12D), {BOX_LEVELS - 1}) as int)"
    boxes = boxes.withColumn("_level", F.expr(own))
    # At most BOX_LEVELS numbers.
    used = sorted(r["_level"] for r in boxes.select("_level").distinct().collect() if r["_level"] is not None)
    widest = lines.agg(F.max(F.greatest(F.col("max_lng") - F.col("min_lng"), F.col("max_lat") - F.col("min_lat"))).alias("w")).head()["w"]
    cells = max(widest or 0.0, 0.0) / (cell_degrees * 2 ** min(used, default=0)) + 2
    steps = range(min(int(math.log2(cells)), 40) + 1)

    def pieces(axis: str) -> str:
        """The fewest whole cells of all levels that make up the touched ones."""
        found = []
        for k in steps:
            first, end = f"shiftright(_from_{axis} + {2**k - 1}L, {k})", f"shiftright(_to_{axis} + 1L, {k})"
            found += [f"if({first} < {end} and pmod({first}, 2) = 1, struct({k} as l, {first} as c), null)",
                      f"if({first} < {end} and pmod({end}, 2) = 1, struct({k} as l, {end} - 1L as c), null)"]
        return f"explode(array_compact(array({', '.join(found)})))"

    touched = [f"{cell(f'{side}_{axis}', '_level')} as _{name}_{axis}" for axis in ("lng", "lat") for side, name in (("min", "from"), ("max", "to"))]
    levels = F.explode(F.array(*[F.lit(v) for v in used]).cast("array<int>")).alias("_level")
    left = lines.select("*", levels).selectExpr("*", *touched).selectExpr("*", f"{pieces('lng')} as _px").selectExpr(
        "*", f"{pieces('lat')} as _py").selectExpr(*lines.columns, "_level", "_px.l as _x", "_px.c as _cx", "_py.l as _y", "_py.c as _cy")
    spans = [f"explode(sequence({cell(f'box_min_{axis}', '_level')}, {cell(f'box_max_{axis}', '_level')})) as _own_{name}" for axis, name in (("lng", "cx"), ("lat", "cy"))]
    right = boxes.selectExpr("*", spans[0]).selectExpr("*", spans[1])
    around = f"sequence(0, {len(steps) - 1})"
    right = right.selectExpr("*", f"explode({around}) as _x").selectExpr("*", f"explode({around}) as _y").selectExpr(
        "*", "shiftright(_own_cx, _x) as _cx", "shiftright(_own_cy, _y) as _cy")
    occupied = cut_lineage(right.select(*key).distinct(), "occupied")
    left = left.join(occupied, key, "left_semi")
    left, right = _divide_crowded(left, right, pairs_per_task or PAIRS_PER_TASK, tuple(key))
    return (
        _meet(left, right, [*key, "_salt"])
        .where((F.col("max_lng") >= F.col("box_min_lng")) & (F.col("min_lng") <= F.col("box_max_lng"))
               & (F.col("max_lat") >= F.col("box_min_lat")) & (F.col("min_lat") <= F.col("box_max_lat")))
        .where((F.col("_own_cx") == F.expr(cell("greatest(min_lng, box_min_lng)", "_level")))
               & (F.col("_own_cy") == F.expr(cell("greatest(min_lat, box_min_lat)", "_level"))))
        .drop(*key, "_salt", "_own_cx", "_own_cy")
    )
