"""Near duplicates by SetSketch registers (Ertl, 2021): banding, joint likelihood, and an exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.columns import given, quoted, whole_row
from frostline.llm.packing import text_chunks
from frostline.llm.shingles import mixed, shingle_sets
from frostline.operators.graph import components
from frostline.session import cut_lineage

SHINGLE, PERCENT = 5, 80
REGISTERS, ROWS = 256, 6  # a pair at 0.8 is missed by all 42 bands with probability 3e-6
BASE, RATE = 1.005, 20.0
MARGIN = 0.12  # over 5 standard deviations of the estimate
STARS = 1
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 6, 1000, 2_000_000


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (int16) of sets of 64-bit hashes, a row each; an empty set has zeros.

    Every element visits the registers in an order of its own with exponentially spaced, growing values; a register keeps
    the smallest and holds floor(1 - log_b(value)). An element is dropped once its value exceeds all minima of its set,
    so a large set costs little more than a pass over its elements. Registers of a union are the larger of both.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    least = np.full((len(sets), REGISTERS), np.inf)
    row = np.repeat(np.arange(len(sets)), sizes)
    h = mixed(np.concatenate(sets) if len(sets) else np.empty(0, np.uint64))
    first, stride = (h & np.uint64(0xFFFF)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) | 1
    value, flat = np.zeros(len(h)), least.reshape(-1)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            if not len(h):
                break
            h = mixed(h + np.uint64(0x9E3779B97F4A7C15))
            uniform = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
            value = value - np.log(uniform) / (RATE * (REGISTERS - j))
            np.minimum.at(flat, row * REGISTERS + ((first + j * stride) & (REGISTERS - 1)), value)
            alive = value < least.max(axis=1)[row]
            if not alive.all():
                row, h, value, first, stride = row[alive], h[alive], value[alive], first[alive], stride[alive]
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(least) / np.log(BASE))
    return np.where(np.isfinite(least), np.clip(out, 0, 32767), 0).astype(np.int16)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of known sizes, from the registers that are larger, smaller and equal.

    The logarithm of the likelihood is concave in the similarity, so the zero of its slope is found by halving.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    c = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-x * c) / np.log(BASE)

    def slope(j):
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        dx, dy = -v * c / (1 - x * c) / np.log(BASE), -u * c / (1 - y * c) / np.log(BASE)
        p, q = chance(x), chance(y)
        return more * dx / np.maximum(p, 1e-12) + less * dy / np.maximum(q, 1e-12) - same * (dx + dy) / np.maximum(
            1 - p - q, 1e-12)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(24):
        middle = (low + high) / 2
        up = slope(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def sketches(events: DataFrame, shingle: int, event_id: str, description: str) -> DataFrame:
    """event_id, digest (of the text), n_shingles, node (128-bit name of the set, null if empty), sketch, bands."""
    df = events.select(F.col(quoted(event_id)).cast("long").alias("event_id"), given(description).alias("text"))
    df = df.withColumn("digest", F.xxhash64("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "text", 4 << 20):
                sets = shingle_sets(batch.column("text"), shingle)
                kept = registers(sets)
                bands = REGISTERS // ROWS
                keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sets), axis=0)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + kept[:, r:bands * ROWS:ROWS].astype(np.uint64))
                full = [len(s) > 0 for s in sets]
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("event_id"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()), pa.array([k.tobytes() for k in kept], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands),
                                             pa.array(keys.astype(np.int64).reshape(-1)))],
                    ["event_id", "digest", "n_shingles", "node", "sketch", "bands"])

    return df.mapInArrow(
        sketch, "event_id long, digest long, n_shingles long, node binary, sketch binary, bands array<long>")


class _Search:
    """Candidate pairs, tested pairs and links between the distinct sets of one corpus."""

    def __init__(self, events: DataFrame, rows: DataFrame, shingle: int, percent: int, event_id: str, description: str):
        self.shingle, self.percent = shingle, percent
        self.texts = events.select(F.col(quoted(event_id)).cast("long").alias("event_id"), given(description).alias("text"))
        full = rows.where("node is not null")
        one = F.min(F.struct("event_id", "digest", "n_shingles", "sketch", "bands")).alias("of")
        # Copies of a set have one sketch: the sketch follows the node, so that any of them may be taken.
        self.classes = cut_lineage(full.groupBy("node").agg(one).select("node", "of.*"), "near-classes")
        bands = self.classes.select("node", "n_shingles", F.explode("bands").alias("band"))
        crowd = bands.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail")
        self.bands = cut_lineage(bands.join(crowd.select("band"), "band", "left_semi"), "near-bands")
        self.tested = self.links = None

    def may_link(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def test(self, pairs: DataFrame) -> None:
        """Estimate, then verify, pairs (a, b) that were not tested before; keep those that link."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs, "near-pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        known = self.classes.select("node", "n_shingles", "sketch")

        def side(name):
            return known.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                                F.col("sketch").alias(f"sketch_{name}"))

        floor = self.percent / 100 - MARGIN

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    left, right = (np.frombuffer(b"".join(batch.column(f"sketch_{s}").to_pylist()), np.int16).reshape(
                        -1, REGISTERS) for s in "ab")
                    sizes = [batch.column(f"n_{s}").to_numpy(zero_copy_only=False).astype(float) for s in "ab"]
                    keep = joint_similarity(left, right, *sizes) >= floor
                    yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

        likely_pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(self.may_link("n_a", "n_b")).mapInArrow(
            likely, "a binary, b binary, n_a long, n_b long")
        likely_pairs = cut_lineage(likely_pairs, "near-likely")
        sets = self.sets(likely_pairs.select(F.col("a").alias("node")).union(likely_pairs.select("b")).distinct())
        both = likely_pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        links = cut_lineage(both.where(100 * shared >= self.percent * (F.col("n_a") + F.col("n_b") - shared)).select(
            "a", "b"), "near-links")
        self.links = links if self.links is None else self.links.unionByName(links)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles): the full sets of the given nodes, from the text of one of their rows."""
        wanted = self.classes.join(nodes, "node").select("node", F.col("event_id").alias("of_id"), F.col("digest").alias("of"))
        df = self.texts.withColumn("digest", F.xxhash64("text")).join(
            wanted, F.col("event_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of"))).select("node", "text")
        shingle = self.shingle

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in text_chunks(whole, "text", 4 << 20):
                    found = shingle_sets(batch.column("text"), shingle)
                    bounds = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                    flat = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["node", "shingles"])

        return cut_lineage(df.mapInArrow(build, "node binary, shingles array<long>").dropDuplicates(["node"]), "near-sets")

    def parts(self) -> DataFrame:
        """(node, part) of the linked nodes."""
        ends = self.links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        nodes = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
        return cut_lineage(components(nodes, ends).withColumnRenamed("component", "part"), "near-parts")

    def in_parts(self, parts: DataFrame | None) -> DataFrame:
        """Rows of the bands with the part of their node."""
        if parts is None:
            return self.bands.withColumn("part", F.col("node"))
        return self.bands.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))

    def star(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each node with one node of its band, another one each turn."""
        by = F.xxhash64("node", F.lit(turn))
        heads = rows.groupBy("band").agg(F.min_by(F.struct("node", "part", "n_shingles"), by).alias("head"))
        return rows.join(heads, "band").where(
            (F.col("part") != F.col("head.part")) & self.may_link("n_shingles", "head.n_shingles")).select(
            F.col("node").alias("a"), F.col("head.node").alias("b"))

    def bands_apart(self, rows: DataFrame) -> DataFrame:
        """Rows of the bands that hold several parts, with the band's size, and whether they lie outside its largest part."""
        sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        bands = sizes.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("rows"),
                                          F.sum("s").alias("shingles_sum"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        return rows.join(bands, "band").withColumn("minor", F.col("part") != F.col("main"))

    def across(self, rows: DataFrame) -> DataFrame:
        """All pairs of different parts in bands of at most SMALL rows; the largest part is not paired with itself."""
        few = rows.where(F.col("rows") <= SMALL)
        minor = few.where("minor").select(
            "band", F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("n_shingles").alias("n_a"))
        return minor.join(few, "band").where((F.col("part_a") != F.col("part")) & self.may_link("n_a", "n_shingles")).select(
            "a", F.col("node").alias("b"))

    def link_blocks(self, rows: DataFrame) -> None:
        """Links of different parts in the larger bands, by blocks.

        The rows of a band are dealt to blocks of bounded size; each two blocks are one group, whose full sets are
        intersected at once. Only links leave a group.
        """
        many = rows.where(F.col("rows") > SMALL)
        if many.isEmpty():
            return
        blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("shingles_sum") / BLOCK_SHINGLES)).cast("int")
        many = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        as_right = F.transform(every, lambda j: F.struct(j.alias("l"), F.col("own").alias("r")))
        as_left = F.transform(F.filter(every, lambda j: j != F.col("own")), lambda j: F.struct(F.col("own").alias("l"), j.alias("r")))
        pairs = F.concat(as_right, F.when(F.col("minor"), as_left).otherwise(F.slice(as_left, 1, 0)))
        sets = self.sets(many.select("node").distinct())
        dealt = many.join(sets, "node").select("band", "node", "part", "minor", "own", "shingles", F.explode(pairs).alias("at")).select(
            "band", "at.*", "node", "part", "minor", "own", "shingles")
        percent = self.percent

        def link(table: pa.Table) -> pa.Table:
            left_block, right_block = table.column("l")[0].as_py(), table.column("r")[0].as_py()
            own = table.column("own").to_numpy()
            minor = table.column("minor").to_numpy(zero_copy_only=False)
            parts, nodes = table.column("part").to_pylist(), table.column("node").to_pylist()
            lists = table.column("shingles").combine_chunks()
            values, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            left, right = np.flatnonzero((own == left_block) & minor), np.flatnonzero(own == right_block)
            found = []
            if len(left) and len(right):
                shared = _intersections(values, bounds, left, right)
                size = np.diff(bounds)
                linked = 100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)
                found = [(nodes[left[i]], nodes[right[j]]) for i, j in zip(*np.nonzero(linked))
                         if parts[left[i]] != parts[right[j]]]
            return pa.table({"a": pa.array([min(f) for f in found], pa.binary()),
                             "b": pa.array([max(f) for f in found], pa.binary())})

        links = cut_lineage(dealt.groupBy("band", "l", "r").applyInArrow(link, "a binary, b binary").distinct(), "near-links")
        self.links = links if self.links is None else self.links.unionByName(links)


def _intersections(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Numbers of common values of each left with each right list, as a matrix, by products over slices of the values."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = np.unique(values, return_inverse=True)[1]
    place = np.full((2, len(bounds) - 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    here = [place[side, row] >= 0 for side in (0, 1)]
    both = np.zeros(code.max(initial=-1) + 1, bool)
    both[np.intersect1d(code[here[0]], code[here[1]])] = True
    column = np.cumsum(both) - 1
    sides = []
    for side in (0, 1):
        use = here[side] & both[code]
        order = np.argsort(column[code[use]], kind="stable")
        sides.append((place[side, row[use]][order], column[code[use]][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(both.sum()), width):
        dense = []
        for (rows, columns), n in zip(sides, (len(left), len(right))):
            a, b = np.searchsorted(columns, [start, start + width])
            part = np.zeros((n, width), np.float32)
            part[rows[a:b], columns[a:b] - start] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def near_duplicates(events: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, event_id: str = "event_id",
                    description: str = "description") -> DataFrame:
    """Groups of traffic events whose descriptions are near copies.

    Result, a row per event: event_id, digest (of the text), n_shingles, component_id (the smallest id linked by a chain)
    and kept (event_id equals it). A text's set holds its distinct runs of ``shingle`` words (without ASCII white space,
    A-Z lower-cased); fewer words form one shingle; a text without words is empty and linked with nothing. Two texts are
    linked if 100 * shared >= percent * united, which is checked on the full sets.

    Equal sets become one node first. Nodes that share a band of registers are candidates. Within a band every node is
    tried against one head, which ties a large group of copies together with as many pairs as nodes; after ``STARS`` such
    turns, all pairs of a band that still lie in different parts are tried, so no candidate link between parts is left
    out. Candidates pass the likelihood estimate with a wide margin before the exact check. In bands of more than
    ``SMALL`` rows that step compares blocks of bounded size exactly and returns links only. No group is collected.

    Ids are integers. Rows that repeat a text are linked; repeated ids are rows of their own; a null id is never a
    component's id unless no other is there. An empty table gives an empty result.
    """
    rows = cut_lineage(sketches(events, shingle, event_id, description), "near-sketches")
    search = _Search(events, rows, shingle, percent, event_id, description)
    parts = None
    for turn in range(STARS):
        search.test(search.star(search.in_parts(parts), turn))
        parts = search.parts()
    apart = cut_lineage(search.bands_apart(search.in_parts(parts)), "near-apart")
    if not apart.isEmpty():
        search.test(search.across(apart))
        search.link_blocks(apart)
        parts = search.parts()
    names = search.classes.select("node", F.col("event_id").alias("least"))
    if parts is None:
        named = names.select("node", F.col("least").alias("component_id"))
    else:
        joined = names.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        # Only parts of several nodes need a common name.
        common = joined.join(parts.select("node"), "node", "left_semi").groupBy("part").agg(F.min("least").alias("first"))
        named = joined.join(common, "part", "left").select("node", F.coalesce("first", "least").alias("component_id"))
    df = rows.select("event_id", "digest", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("event_id")).otherwise(F.col("component_id"))
    return df.select("event_id", "digest", "n_shingles", component.alias("component_id"),
                     F.col("event_id").eqNullSafe(component).alias("kept"))


def without_copies(events: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, event_id: str = "event_id",
                   description: str = "description") -> DataFrame:
    """The events with one of each group, the one with the smallest id; repeated rows of it leave one.

    All columns stay, whatever their names. Rows of one id and text count as repeated though other columns differ.
    """
    found = near_duplicates(events, shingle, percent, event_id, description)
    copies = cut_lineage(found.where("not kept").select(
        F.col("event_id").alias("copy_id"), F.col("digest").alias("copy_digest")).distinct(), "near-copies")
    again = found.where("kept and n_shingles > 0").groupBy("event_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    again = cut_lineage(again.select(F.col("event_id").alias("again_id"), F.col("digest").alias("again_digest")), "near-again")
    rows = events.select(whole_row(events), F.col(quoted(event_id)).cast("long").alias("key"),
                         F.xxhash64(given(description)).alias("text_digest"))
    left = rows.join(copies, F.col("key").eqNullSafe(F.col("copy_id")) & (F.col("text_digest") == F.col("copy_digest")), "left_anti")
    if not again.isEmpty():
        same = F.col("key").eqNullSafe(F.col("again_id")) & (F.col("text_digest") == F.col("again_digest"))
        once = left.join(again, same, "left_semi").dropDuplicates(["key", "text_digest"])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in events.columns])
