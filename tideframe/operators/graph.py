"""Graph aggregates that need no kernel: partitions, mixing, clustering, rich club, matching, null-model probabilities.

Edges are (w, i, j) with i < j; partitions are (node, comm) or (w, node, comm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import corr, div
from .network import degrees


def with_communities(edges: DataFrame, partition: DataFrame) -> DataFrame:
    on_w = "w" in partition.columns
    a = partition.withColumnsRenamed({"node": "i", "comm": "ci"})
    b = partition.withColumnsRenamed({"node": "j", "comm": "cj"})
    return edges.join(a, ["w", "i"] if on_w else "i").join(b, ["w", "j"] if on_w else "j")


def mixing_matrix(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(w, a, b, n_edges) for a <= b: edges between communities."""
    rows = with_communities(edges, partition)
    return rows.groupBy("w", F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"))


def modularity(mixing: DataFrame) -> DataFrame:
    """(w, q) from the mixing matrix alone: sum over communities of e / m - (d / 2m)^2."""
    ends = mixing.select("w", F.explode(F.array(F.struct(F.col("a").alias("c"), F.when(F.col("a") == F.col("b"), 2 * F.col("n_edges")).otherwise(F.col("n_edges")).alias("d"), F.when(F.col("a") == F.col("b"), F.col("n_edges")).otherwise(0).alias("e")), F.struct(F.col("b").alias("c"), F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n_edges")).alias("d"), F.lit(0).cast("long").alias("e")))).alias("x")).select("w", "x.*")
    per = ends.groupBy("w", "c").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    total = mixing.groupBy("w").agg(F.sum("n_edges").alias("m"))
    terms = per.join(total, "w")
    return terms.groupBy("w").agg(F.coalesce(F.sum(div(F.col("e"), F.col("m")) - F.pow(div(F.col("d"), 2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))


def relabel_by_size(partition: DataFrame) -> DataFrame:
    """(node, comm): communities numbered by size, largest first, ties by label."""
    sizes = partition.groupBy("comm").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.withColumn("new", (F.row_number().over(Window.orderBy(F.col("size").desc(), "comm")) - 1).cast("int"))
    return partition.join(ranked, "comm").select("node", F.col("new").alias("comm"))


def lagged(partitions: DataFrame, lag: int) -> DataFrame:
    """The partition of window w - lag, keyed by w."""
    return partitions.withColumn("w", F.col("w") + lag)


DECAY_LAGS = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500)


def decay(edges: DataFrame, partitions: DataFrame, lags: tuple[int, ...] = DECAY_LAGS) -> DataFrame:
    """(lag, q): mean modularity of the windows' graphs under partitions (w, node, comm) of `lag` windows before; lags longer than the series have no row."""
    steps = edges.sparkSession.createDataFrame([(k, v) for k, v in enumerate(lags)], "place int, lag int")
    size = len(lags)  # a graph for each window and lag
    aged = edges.crossJoin(F.broadcast(steps)).select((F.col("w") * size + F.col("place")).alias("w"), "i", "j")
    old = partitions.crossJoin(F.broadcast(steps)).select(((F.col("w") + F.col("lag")) * size + F.col("place")).alias("w"), "node", "comm")
    q = modularity(mixing_matrix(aged, old)).groupBy((F.col("w") % size).alias("place")).agg(F.avg("q").alias("q"))
    return q.join(F.broadcast(steps), "place").select("lag", "q")


def shuffled_labels(partition: DataFrame, seed: int) -> DataFrame:
    """The same labels dealt anew to the nodes, by the order of a hash: sizes stay."""
    by_hash = Window.orderBy(F.xxhash64("node", F.lit(seed)), "node")
    a = partition.select("node", F.row_number().over(by_hash).alias("r"))
    b = partition.select("comm", F.row_number().over(Window.orderBy("node")).alias("r"))
    return a.join(b, "r").select("node", "comm")


def block_probabilities(mixing: DataFrame, sizes: DataFrame) -> DataFrame:
    """(w, a, b, p): 2 e_aa / (s_a (s_a - 1)) or e_ab / (s_a s_b), within [0, 1]; single nodes have 0."""
    rows = mixing.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b")
    p = F.when(F.col("a") == F.col("b"), div(2 * F.col("n_edges"), F.col("sa") * (F.col("sa") - 1))).otherwise(div(F.col("n_edges"), F.col("sa") * F.col("sb")))
    return rows.select("w", "a", "b", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(p, F.lit(0.0)))).alias("p"))


def block_model_edges(probabilities: DataFrame, partition: DataFrame, draw) -> DataFrame:
    """(w, i, j): an independent coin for each pair of nodes; `draw(w, i, j)` is a uniform column."""
    a, b = partition.toDF("i", "ci"), partition.toDF("j", "cj")
    rows = a.join(b, F.col("i") < F.col("j")).withColumns({"a": F.least("ci", "cj"), "b": F.greatest("ci", "cj")})
    return rows.join(probabilities, ["a", "b"]).where(draw(F.col("w"), F.col("i"), F.col("j")) < F.col("p")).select("w", "i", "j")


def nmi(partition_a: DataFrame, partition_b: DataFrame) -> DataFrame:
    """Normalised mutual information of two partitions of the same nodes, by arithmetic mean of entropies."""
    both = partition_a.toDF("node", "x").join(partition_b.toDF("node", "y"), "node").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    whole = both.agg(F.sum("n").alias("t"))
    cells = both.crossJoin(F.broadcast(whole))
    ent = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n"), F.first("t").alias("t")).agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(f"h{c}"))
    joint = cells.agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias("hxy"))
    return joint.crossJoin(ent("x")).crossJoin(ent("y")).select(F.coalesce(div(2 * (F.col("hx") + F.col("hy") - F.col("hxy")), F.col("hx") + F.col("hy")), F.lit(1.0)).alias("nmi"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("w", F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("x")).select("w", "x.u", "x.v")


def assortativity(edges: DataFrame) -> DataFrame:
    deg = degrees(edges)
    rows = both_ways(edges).join(deg.toDF("w", "u", "du"), ["w", "u"]).join(deg.toDF("w", "v", "dv"), ["w", "v"])
    return rows.groupBy("w").agg(corr(F.col("du").cast("double"), F.col("dv").cast("double")).alias("assortativity"))


def triangles(edges: DataFrame) -> DataFrame:
    """(w, n): each edge with the edges that leave its ends upward."""
    bare = edges.select("w", "i", "j")
    a, b, c = bare, bare.toDF("w", "i", "k"), bare.toDF("w", "j", "k")
    return a.join(b, ["w", "i"]).where("j < k").join(c, ["w", "j", "k"]).groupBy("w").agg(F.count(F.lit(1)).alias("triangles"))


def transitivity(edges: DataFrame) -> DataFrame:
    triples = degrees(edges).groupBy("w").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    return triples.join(triangles(edges), "w", "left").select("w", F.coalesce(div(3 * F.col("triangles"), F.col("triples")), F.lit(0.0)).alias("transitivity"))


def rich_club(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(w, k, phi): density among nodes of degree above k, null below two of them."""
    deg = degrees(edges)
    top = deg.groupBy("w").agg(F.max("degree").alias("top"))
    ks = top.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))))
    nodes = deg.groupBy("w", "degree").agg(F.count(F.lit(1)).alias("n"))
    rich = ks.join(nodes, "w").where("degree > k").groupBy("w", "k").agg(F.sum("n").alias("n"))
    low = edges.join(deg.toDF("w", "i", "di"), ["w", "i"]).join(deg.toDF("w", "j", "dj"), ["w", "j"]).groupBy("w", F.least("di", "dj").alias("d")).agg(F.count(F.lit(1)).alias("m"))
    inside = ks.join(low, "w").where("d > k").groupBy("w", "k").agg(F.sum("m").alias("m"))
    rows = ks.join(rich, ["w", "k"], "left").join(inside, ["w", "k"], "left")
    return rows.select("w", "k", F.when(F.col("n") >= 2, div(2 * F.coalesce("m", F.lit(0)), F.col("n") * (F.col("n") - 1))).alias("phi"))


def rich_club_ratio(real: DataFrame, null: DataFrame) -> DataFrame:
    """(w, ratio): mean over k of phi / phi of the null, where both are there and the null's is positive."""
    rows = real.join(null.select("w", "k", F.col("phi").alias("phi0")), ["w", "k"]).where("phi IS NOT NULL AND phi0 > 0")
    return rows.groupBy("w").agg(F.avg(F.col("phi") / F.col("phi0")).alias("ratio"))


def matching_index(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(w, all_pairs, on_edges): means of shared neighbours over neighbours of either end, for all pairs and for edges.

    Pairs without a shared neighbour add 0, so only wedges are joined; a pair's
    own edge is left out of its union.
    """
    deg = degrees(edges)
    arcs = both_ways(edges)
    wedge = arcs.toDF("w", "k", "a").join(arcs.toDF("w", "k", "b"), ["w", "k"]).where("a < b").groupBy("w", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    linked = edges.select("w", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).alias("e"))
    rows = wedge.join(linked, ["w", "a", "b"], "full").join(deg.toDF("w", "a", "da"), ["w", "a"]).join(deg.toDF("w", "b", "db"), ["w", "b"])
    c, e = F.coalesce("c", F.lit(0)), F.coalesce("e", F.lit(0))
    union = F.col("da") + F.col("db") - c - 2 * e
    some = rows.select("w", e.alias("e"), F.coalesce(div(c, union), F.lit(0.0)).alias("m"), F.coalesce(div(c, F.col("da") + F.col("db") - 2 * e), F.lit(0.0)).alias("m_edge"))
    return some.groupBy("w").agg((F.sum("m") / (n_nodes * (n_nodes - 1) / 2)).alias("all_pairs"), F.avg(F.when(F.col("e") == 1, F.col("m_edge"))).alias("on_edges"))


def compression(k_values: DataFrame, n: int) -> DataFrame:
    """(k, cost, compresses, break_even): storing k sizes and k (k + 1) / 2 link counts against n nodes."""
    cost = F.col("k") + F.col("k") * (F.col("k") + 1) / 2
    return k_values.select("k", cost.alias("cost"), (cost < n).alias("compresses"), ((F.lit(-3.0) + F.sqrt(F.lit(9.0 + 8 * n))) / 2).alias("break_even"))


def half_life(curve: DataFrame) -> DataFrame:
    """Lag where q(lag) first falls to half of q(0), on the straight line between the lags around it."""
    order = Window.orderBy("lag")
    rows = curve.withColumns({"lag0": F.lag("lag").over(order), "q0": F.lag("q").over(order), "half": F.first("q").over(order.rowsBetween(Window.unboundedPreceding, 0)) / 2})
    cross = rows.where("q <= half AND q0 > half")
    at = F.col("lag0") + (F.col("q0") - F.col("half")) * (F.col("lag") - F.col("lag0")) / (F.col("q0") - F.col("q"))
    return cross.agg(F.min_by(at, "lag").alias("half_life"))
