"""Segment graphs: line graphs, adjacency, propagation, profiles, components, fingerprints.

A segment table is ``(segment_id, u, v)``: directed edges of a multigraph.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.operators.ranks import numbered
from skein.runtime import drop_materialized, materialize


def nodes_of(segments: DataFrame) -> DataFrame:
    """Every end of a segment, with its in- and out-degree."""
    ends = segments.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        segments.select(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def line_edges(segments: DataFrame) -> DataFrame:
    """Directed pairs of segments that share a junction, the first ending where the second begins.

    Turning back is a pair like any other, and a segment from a node to itself precedes itself.
    One equi join on the junction; AQE splits crowded junctions.
    """
    into = segments.select(F.col("segment_id").alias("segment_id_from"), F.col("v").alias("junction"))
    out = segments.select(F.col("segment_id").alias("segment_id_to"), F.col("u").alias("junction"))
    return into.join(out, "junction").select("segment_id_from", "segment_id_to", "junction")


def line_degree(segments: DataFrame) -> DataFrame:
    """How many line edges each junction makes, without making them: in-degree times out-degree."""
    return nodes_of(segments).select("node", (F.col("n_in") * F.col("n_out")).alias("n_edges")).where("n_edges > 0")


def positions(ids: DataFrame, key: str) -> DataFrame:
    """``(key, pos)``: the place of each id in their order, from 0."""
    return numbered(ids.select(key).distinct(), key)


def edge_index(edges: DataFrame, order: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Edges as positions ``(src_pos, dst_pos)``."""
    a = order.select(F.col(key).alias(src), F.col("pos").alias("src_pos"))
    b = order.select(F.col(key).alias(dst), F.col("pos").alias("dst_pos"))
    return edges.join(a, src).join(b, dst).select("src_pos", "dst_pos")


def tiled(index: DataFrame, n_nodes: int, n_copies: int) -> DataFrame:
    """The disjoint union of copies of a graph: copy ``t`` is shifted by ``t * n_nodes``."""
    copies = index.sparkSession.range(n_copies).withColumnRenamed("id", "t")
    shift = F.col("t") * n_nodes
    return index.crossJoin(F.broadcast(copies)).select("t", (F.col("src_pos") + shift).alias("src_pos"), (F.col("dst_pos") + shift).alias("dst_pos"))


def adjacency(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, neighbour)`` in both directions, once each; a loop makes a node its own neighbour."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    return one.union(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour"))).distinct()


def flooded_neighbours(neighbours: DataFrame, flooded: DataFrame, key: str = "node") -> DataFrame:
    """Nodes with at least one neighbour in ``flooded``."""
    return neighbours.join(flooded.select(F.col(key).alias("neighbour")), "neighbour", "left_semi").select("node").distinct()


def propagate(
    state: DataFrame, neighbours: DataFrame, elevation: DataFrame, transitions: DataFrame, rain_over: float, low_up_to: float
) -> DataFrame:
    """One step of the propagation rule for each transition, from the true state.

    ``state (node, phase_id, y)``, ``transitions (phase_id, next_phase, intensity)``: a handful
    of rows, ``elevation (node, elevation)``. Rule A: the next phase's intensity is over
    ``rain_over``; every node is predicted. Rule B: a node at most ``low_up_to`` high with a
    flooded neighbour. A node without elevation is not low. Transitions that rule A decides
    skip the neighbour join.
    """
    pairs = F.broadcast(transitions.withColumn("rain", F.coalesce(F.col("intensity") > rain_over, F.lit(False))))
    rows = state.join(pairs, "phase_id").select("node", "phase_id", "next_phase", "rain", "y")
    wet = rows.where("y = 1 AND NOT rain").select(F.col("node").alias("neighbour"), "phase_id")
    near = wet.join(neighbours, "neighbour").select("node", "phase_id").distinct().withColumn("near", F.lit(True))
    low = elevation.select("node", (F.col("elevation") <= low_up_to).alias("low"))
    joined = rows.join(low, "node", "left").join(near, ["node", "phase_id"], "left")
    rule_b = F.coalesce("low", F.lit(False)) & F.coalesce("near", F.lit(False))
    return joined.select("node", "phase_id", "next_phase", (F.col("rain") | rule_b).cast("int").alias("y_pred"))


def neighbour_mean(neighbours: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """Each node's features and their means over its neighbours: one hop of graph convolution without weights."""
    theirs = features.select(F.col("node").alias("neighbour"), *columns)
    means = neighbours.join(theirs, "neighbour").groupBy("node").agg(*[F.avg(c).alias(f"{c}_near") for c in columns])
    return features.join(means, "node", "left")


def graph_profile(segments: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Counts of nodes, segments, isolated nodes, loops and dead ends."""
    degrees = nodes_of(segments)
    ends = all_nodes.select("node").distinct().join(degrees, "node", "left").fillna(0, ["n_in", "n_out"])
    nodes = ends.agg(
        F.count("*").alias("n_nodes"),
        F.count_if((F.col("n_in") + F.col("n_out")) == 0).alias("n_isolated"),
        F.count_if((F.col("n_in") > 0) & (F.col("n_out") == 0)).alias("n_dead_ends"),
    )
    edges = segments.agg(F.count("*").alias("n_segments"), F.count_if(F.col("u") == F.col("v")).alias("n_loops"))
    return nodes.crossJoin(F.broadcast(edges))


def weak_components(segments: DataFrame) -> DataFrame:
    """``(node, component)`` regardless of direction."""
    return connected_components(segments, "u", "v")


def component_sizes(components: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest components, their sizes and share of all nodes in per cent."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    total = F.broadcast(components.agg(F.count("*").alias("total")))
    share = F.round(F.col("size") * 100.0 / F.col("total"), 4)
    return sizes.join(total, F.lit(True)).select("component", "size", share.alias("pct")).orderBy(F.desc("size"), "component").limit(k)


def strong_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 200) -> DataFrame:
    """``(node, component)``: nodes that reach each other, named by the largest of them.

    Colouring: every node takes the largest node that reaches it; a node that keeps its own
    name is a root, and those of its colour that reach it are its component. They are removed
    and the rest is coloured again. Each sweep is a join and a partial aggregate, written to
    the shared folder.
    """
    e = materialize(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").distinct(), "scc")
    left = materialize(e.select(F.col("s").alias("node")).union(e.select("d")).distinct(), "scc")
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        colours = _spread(left.withColumn("colour", F.col("node")), e, "s", "d", max_rounds)
        inside = e.join(colours.select(F.col("node").alias("s"), F.col("colour").alias("cs")), "s").join(
            colours.select(F.col("node").alias("d"), F.col("colour").alias("cd")), "d"
        )
        inside = materialize(inside.where("cs = cd").select("s", "d"), "scc")
        roots = colours.where("node = colour")
        found = _reach(roots, inside, colours, max_rounds)
        done = found if done is None else materialize(done.unionByName(found), "scc")
        old = left, e, inside
        left = materialize(left.join(found, "node", "left_anti"), "scc")
        e = materialize(
            e.join(left.withColumnRenamed("node", "s"), "s", "left_semi").join(left.withColumnRenamed("node", "d"), "d", "left_semi"), "scc"
        )
        for table in old:
            drop_materialized(table)
    else:
        raise RuntimeError("strong components did not settle")
    return done if done is not None else left.withColumn("component", F.col("node"))


def _spread(colours: DataFrame, e: DataFrame, s: str, d: str, max_rounds: int) -> DataFrame:
    """Each node's largest reaching name, along the edges."""
    held = colours = materialize(colours, "scc")
    for _ in range(max_rounds):
        sent = e.join(colours.withColumnRenamed("node", s), s).groupBy(F.col(d).alias("node")).agg(F.max("colour").alias("sent"))
        new = colours.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("moved"))
        new = materialize(new, "scc")
        drop_materialized(held)
        held, colours = new, new.drop("moved")
        if new.where("moved").isEmpty():
            return colours
    raise RuntimeError("colours did not settle")


def _reach(roots: DataFrame, inside: DataFrame, colours: DataFrame, max_rounds: int) -> DataFrame:
    """Nodes that reach the root of their colour, along edges inside the colour."""
    found = materialize(roots.select("node", F.col("colour").alias("component")), "scc")
    front = found
    for _ in range(max_rounds):
        before = inside.join(front.select(F.col("node").alias("d"), "component"), "d").select(F.col("s").alias("node"), "component").distinct()
        front = materialize(before.join(found, "node", "left_anti"), "scc")
        if front.isEmpty():
            return found
        held, found = found, materialize(found.unionByName(front), "scc")
        drop_materialized(held)
    raise RuntimeError("components did not settle")


def fingerprint(ids: DataFrame, key: str) -> DataFrame:
    """Count and SHA-256 of the sorted distinct ids joined by ``|``.

    The digest is of one long text, so it is made in one place: parts of the range-partitioned
    ids stream through the driver as blocks, one part at a time, and none is held.
    """
    import hashlib

    def blocks(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                columns = [pa.array([own[0]]), pa.array([len(own)], pa.int64()), pa.array(["|".join(own).encode()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["first", "n", "joined"])

    text = ids.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    ordered = materialize(text.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(blocks, "first string, n long, joined binary"), "blocks")
    digest, n = hashlib.sha256(), 0
    for row in ordered.orderBy("first").toLocalIterator():
        digest.update((b"|" if n else b"") + bytes(row.joined))
        n += row.n
    return ids.sparkSession.createDataFrame([(n, digest.hexdigest())], "n long, sha256 string")


def key_consistency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys each side has alone and both share."""
    one = a.select(key).distinct().withColumn("a", F.lit(1))
    two = b.select(key).distinct().withColumn("b", F.lit(1))
    both = one.join(two, key, "full")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both")
    )


def key_differences(a: DataFrame, b: DataFrame, key: str, first: int = 10) -> DataFrame:
    """``(side, n, examples)``: how many distinct keys only one side has, and the ``first`` of them in order."""
    rows = None
    for side, one, two in (("missing", a, b), ("extra", b, a)):
        alone = one.select(key).distinct().join(two.select(key).distinct(), key, "left_anti")
        top = alone.orderBy(key).limit(first).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("examples"))
        row = alone.agg(F.count("*").alias("n")).join(F.broadcast(top), F.lit(True)).select(F.lit(side).alias("side"), "n", "examples")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def duplicates(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """For each named key, on its own: how many of its values repeat and how many rows hold one."""
    out = None
    for name, columns in keys.items():
        counted = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        row = counted.agg(F.count("*").alias("n_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("key"), "n_values", "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def edge_consistency(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Line edges whose first segment does not end, or whose second does not begin, at their junction; all are checked."""
    a = segments.select(F.col("segment_id").alias("segment_id_from"), F.col("v").alias("ends"))
    b = segments.select(F.col("segment_id").alias("segment_id_to"), F.col("u").alias("begins"))
    joined = edges.join(a, "segment_id_from", "left").join(b, "segment_id_to", "left")
    right = F.col("ends").eqNullSafe(F.col("junction")) & F.col("begins").eqNullSafe(F.col("junction"))
    return joined.agg(F.count("*").alias("n_edges"), F.count_if(~right).alias("n_wrong"))
