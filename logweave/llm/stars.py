"""Links between documents that share buckets, without making all pairs of a bucket.

Candidates of a bucket are star-shaped: all members against one center, the member that shares most
buckets with others. Every candidate is confirmed on the full sets. A member that fails against the center may
still link with another one, so buckets are gone through again, with more centers from round to round, until
none has members of different components left to compare: used centers leave, buckets whose members have come
together leave, and centers come first from the smaller components, as the members of one component need no
comparison with each other. No bucket is capped: what a round leaves, a later one takes.

A pair is made only if it may link, which three exact bounds decide: by sizes; by the items a document shares with
anyone (``c`` of ``n``; two documents have at most the smaller ``c`` in common); and by the triangle inequality
over the distances to the first center.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.llm.components import components
from logweave.llm.shared import written

SLOTS = 16  # tasks that share the members of a bucket
ROUNDS = (1, 32, 512)  # centers a bucket may take in the first rounds; all later ones take the last number


def beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the ``columns`` of both nodes in ``table``, named ``<column>_a`` and ``<column>_b``.

    What belongs to a center goes to each of its pairs. A center with very many pairs is cut into slots of
    some hundred, its row repeated per slot, so no task gets all of them.
    """
    degree = pairs.groupBy("a").agg((F.count(F.lit(1)) / 256).cast("int").alias("last"))
    centers = degree.join(table.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns)), "a")
    centers = centers.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    slotted = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("slot"))
    half = slotted.join(centers, ["a", "slot"]).drop("slot")
    return half.join(table.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns)), "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, heads: Sequence[str]) -> DataFrame:
    """``pairs`` (a, b) that meet in every one of ``heads``, with ``common``, the exact size of the intersection, and both sizes."""
    common = F.size(F.array_intersect("items_a", "items_b")).cast("bigint")
    sizes = (F.size(f"items_{x}").cast("bigint").alias(f"size_{x}") for x in "ab")
    both = beside(pairs, sets, ["items", *heads])
    for name in heads:
        both = both.where(F.arrays_overlap(f"{name}_a", f"{name}_b"))
    return both.select("a", "b", common.alias("common"), *sizes)


def held_in_common(sets: DataFrame) -> DataFrame:
    """``(node, item, df)`` of the items of ``sets`` (node, items) that two nodes or more have."""
    rows = sets.select("node", F.explode("items").alias("item"))
    often = written(rows.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("item", "df"), "star-items")
    return rows.join(often, "item")


def may_link(n: Column, c: Column, other_n: Column, other_c: Column, percent: int) -> Column:
    """Whether the sizes, and what each shares with anyone, allow the similarity."""
    most = F.least(c, other_c)
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (100 * most >= percent * (n + other_n - most))


def _spokes(active: DataFrame, centers: DataFrame, percent: int) -> DataFrame:
    """``(node, c)``: every member with the centers of its buckets that it may link with, each once.

    Buckets of nearly the same members name nearly the same centers, so the lists of a member's
    buckets (of bounded length each) are united before rows are made of them. What
    the triangle inequality, |d(x, y) - d(x, z)| <= d(y, z) with d = 1 - similarity, rules out
    in one bucket is ruled out in all.
    """

    def other(c: Column) -> Column:
        apart = F.coalesce(F.col("component") != c["component"], F.lit(True))
        once = ~F.col("is_center") | (c["c"] > F.col("node"))  # two centers of a bucket meet once
        return (c["c"] != F.col("node")) & once & apart & may_link(F.col("n"), F.col("shared"), c["n"], c["shared"], percent)

    def too_far(c: Column) -> Column:
        return F.coalesce(F.abs(F.col("far") - c["far"]) > 1 - percent / 100 + 1e-9, F.lit(False))

    def named(test) -> Column:
        return F.transform(F.filter("centers", test), lambda c: c["c"])

    # Rows are few bytes but much work: dealt by count, not by size, a bucket's members over several tasks.
    width = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = active.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int")).repartition(width, "bucket", "slot")
    centers = centers.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).repartition(width, "bucket", "slot")
    met = members.join(centers.hint("merge"), ["bucket", "slot"]).withColumn("is_center", F.exists("centers", lambda c: c["c"] == F.col("node"))).select("node", named(other).alias("near"), named(too_far).alias("ruled_out"))
    lists = met.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("ruled_out")).alias("ruled_out"))
    return lists.select("node", F.explode(F.array_except("near", "ruled_out")).alias("c"))


def star_classes(active: DataFrame, sets: DataFrame, percent: int, links: DataFrame, heads: Sequence[str] = ()) -> DataFrame:
    """``(node, component)`` of nodes linked with any other, by ``100 * |intersection| >= percent * |union|``.

    ``active``: ``(bucket, node, n, shared)``, a node in its buckets with the size of its set and the number of its items that
    others have too. ``sets``: ``(node, items)``. ``links``: pairs ``(a, b)`` linked beforehand. ``heads`` names
    further array columns of ``sets``: candidates without a common member in each are dropped before full sets are compared.
    """
    active = active.where(100 * F.col("shared") >= percent * F.col("n"))  # else it links with nothing
    several = active.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi")
    active = written(active.join(several.select("bucket", "held"), "bucket").distinct(), "star-buckets")
    classes = components(links)
    if active.isEmpty():
        return classes
    # The member that meets most others comes first in each of its buckets.
    meets = active.groupBy("node").agg(F.sum("held").alias("meets"))
    own = classes.select("node", F.col("component").alias("own"))
    active = active.join(meets, "node").join(own, "node", "left").withColumn("component", F.coalesce("own", "node"))
    active = active.select("bucket", "node", "n", "shared", "meets", F.lit(None).cast("double").alias("far"), "component", F.lit(1).cast("bigint").alias("kin"))
    tried: DataFrame | None = None
    turn = 0
    while True:
        order = Window.partitionBy("bucket").orderBy("kin", F.desc("meets"), "node")
        ranked = active.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROUNDS[min(turn, len(ROUNDS) - 1)])
        center = F.struct(F.col("node").alias("c"), "n", "shared", "far", "component").alias("center")
        chosen = written(ranked.select("bucket", "rank", center), "star-centers")
        spokes = _spokes(active, chosen.groupBy("bucket").agg(F.collect_list("center").alias("centers")), percent)
        pairs = spokes.select(F.least("c", "node").alias("x"), F.greatest("c", "node").alias("y"), "c").groupBy("x", "y").agg(F.min("c").alias("a"))
        pairs = pairs.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, (F.least("a", "b") == tried.x) & (F.greatest("a", "b") == tried.y), "left_anti")
        pairs = written(pairs, "star-pairs")
        new = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = new if tried is None else tried.union(new)
        measured = written(_confirmed(pairs, sets, heads), "star-measured")
        union = F.col("size_a") + F.col("size_b") - F.col("common")
        linked = measured.where(100 * F.col("common") >= percent * union).select("a", "b")
        if not linked.isEmpty():
            classes = components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).union(linked))
        if turn == 0:
            measure = measured.groupBy("a", "b").agg(F.max(F.col("common") / union).alias("s"))
            both = measure.select(F.col("a").alias("c"), F.col("b").alias("node"), "s").union(measure.select(F.col("b").alias("c"), F.col("a").alias("node"), "s"))
            head = chosen.where("rank = 1").select("bucket", "center.c")
            active = active.join(head, "bucket").where("node <> c").join(both, ["c", "node"], "left").withColumn("far", 1 - F.col("s"))
        else:
            active = active.join(chosen.select("bucket", F.col("center.c").alias("node")), ["bucket", "node"], "left_anti")
        own = classes.select("node", F.col("component").alias("own"))
        active = active.join(own, "node", "left").withColumn("component", F.coalesce("own", "node"))
        active = written(active.select("bucket", "node", "n", "shared", "meets", "far", "component"), "star-members")
        kin = active.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("kin"))
        open_ = active.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        active = written(active.join(open_, "bucket", "left_semi").join(kin, ["bucket", "component"]), "star-active")
        turn += 1
        if active.isEmpty():
            return classes
