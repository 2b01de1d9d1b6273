"""Components of the graph of similar sets from candidate keys, without listing all pairs of a group.

Items that share a key may be alike. In keys of many items, most cannot be: a shingle that only one item
has lies in no intersection, so an item with many of those is too far from every set of the key. Such
items leave the key before any pair is made. First, in every key the item that shares most keys with others
(the hub) is compared with the rest, and the links found are merged into components. Most groups of
near copies are one component after that, and a key whose items share a component needs no further
look. In what remains, only items outside the key's largest component are compared with the items of
other components; having met them all, they leave the key. Rounds end when no key holds two components,
so every pair that could join two components has been tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, marked_by_sieve, sieve
from .components import components

FEW = 16  # keys with no more items than this are finished in the first round
HUBS = 1_000  # most hubs of a key in one round, which bounds the arrays; larger keys take more rounds


def shared_keys(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, item, ...) of keys that at least two different items have."""
    keys = postings.groupBy("key").agg(F.min("item").alias("_lo"), F.max("item").alias("_hi"))
    keys = scratch.write(keys.filter("_lo <> _hi").select("key"), "keys")
    near = marked_by_sieve(postings, sieve(keys, F.col("key")), F.col("key"), "_near").filter("_near").drop("_near")
    return scratch.write(near.join(keys, "key", "left_semi").distinct(), "members")


def _with_both(pairs: DataFrame, features: DataFrame, col: str) -> DataFrame:
    return pairs.join(features.select(F.col("item").alias("a"), F.col(col).alias("x")), "a").join(
        features.select(F.col("item").alias("b"), F.col(col).alias("y")), "b")


def linked_components(members: DataFrame, features: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (item, root) for all items of ``members`` (key, item, size), joined by the links found.

    ``features`` holds one row (item, sketch, whole) per item: the set of hashes, and its size followed by
    its parity bits. Two items link when their sets have 100 * intersection >= percent * union.
    """
    x, y = F.col("x"), F.col("y")
    # The Hamming distance of parity sketches is a lower bound on the number of differing shingles, which
    # in turn is at most (100 - percent) / (100 + percent) of the two sizes.
    def near_enough(a: Column, b: Column) -> Column:
        flips = F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(b, 2, F.size(b) - 1), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        differ = F.aggregate(flips, F.lit(0), lambda s, n: s + n)
        return differ * (100 + percent) <= (a[0] + b[0]) * (100 - percent)

    both = F.size(F.array_intersect("x", "y"))
    link = both * 100 >= (F.size("x") + F.size("y") - both) * percent
    mx, my = F.col("mx"), F.col("my")

    def fits_pair(size_x: Column, common_x: Column, size_y: Column, common_y: Column) -> Column:
        common = F.least(common_x, common_y)
        return common * 100 >= (size_x + size_y - common) * percent

    # Shingles are counted among the items of large keys. Next to an item outside of them, an item's own
    # shingles are not known, and only the sizes can rule the pair out.
    counted = mx["counted"] & my["counted"]
    may_link = F.when(counted, fits_pair(mx["size"], mx["common"], my["size"], my["common"])).otherwise(
        fits_pair(mx["size"], mx["size"], my["size"], my["size"]))

    sizes = scratch.write(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    popular = members.join(sizes, "key").groupBy("item").agg(F.sum("_n").alias("_pop"), F.max("_n").alias("_most"))
    popular = scratch.write(popular, "popular")
    roots = scratch.write(popular.select("item", F.col("item").alias("root")), "roots-0")
    alone = _own_shingles(features.join(popular.filter(F.col("_most") > FEW).select("item"), "item", "left_semi"))
    own = scratch.write(popular.join(alone, "item", "left").select(
        "item", "_pop", (F.col("_most") > FEW).alias("counted"), F.coalesce("_own", F.lit(0)).alias("_own")), "own")
    rows = members.join(sizes, "key").join(own, "item").withColumn("common", F.col("size") - F.col("_own")).drop("_own")
    me = F.struct("item", "size", "common", "counted")
    few = scratch.write(rows.filter(F.col("_n") <= FEW).select("key", me.alias("mx")), "few")
    left = scratch.write(rows.filter(F.col("_n") > FEW).drop("_n"), "many")
    # An item that even the smallest set of the key cannot match leaves the key.
    smallest = scratch.write(left.groupBy("key").agg(F.min("size").alias("_small")), "smallest")
    fits = F.col("common") * 100 >= (F.col("size") + F.greatest("_small", "common") - F.col("common")) * percent
    left = scratch.write(left.join(smallest, "key").filter(fits).drop("_small"), "left-0")

    hubs = left.groupBy("key").agg(F.max_by(me, F.struct("_pop", F.xxhash64("item"))).alias("my"))
    hubs = scratch.write(hubs, "hubs-0")
    # Every row meets the one hub of its key, once: the rows made are those of ``left`` without the hubs.
    met = scratch.write(left.join(hubs, "key").filter("item <> my.item"), "met-0")
    scratch.release("left-0")
    pairs = met.select(me.alias("mx"), "my").unionByName(
        few.join(few.select("key", F.col("mx").alias("my")), "key").select("mx", "my").filter("mx.item < my.item"))
    left = met.drop("my").join(features.select("item", "sketch"), "item")
    tried, turn, most = None, 0, min(16, HUBS)
    while True:
        turn += 1
        pairs = pairs.filter(F.col("mx.item") != F.col("my.item")).filter(may_link).select(
            F.least("mx.item", "my.item").alias("a"), F.greatest("mx.item", "my.item").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        near = scratch.write(_with_both(pairs, features, "sketch").filter(near_enough(x, y)).select("a", "b"), f"near-{turn}")
        links = scratch.write(_with_both(near, features, "whole").filter(link).select("a", "b"), f"links-{turn}")
        # Only the new links are merged, on top of the components found before.
        ends = links.join(roots.select(F.col("item").alias("a"), F.col("root").alias("ra")), "a").join(
            roots.select(F.col("item").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        merged = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        roots = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        roots = scratch.write(roots.select("item", F.coalesce("to", "root").alias("root")), f"roots-{turn}")

        left = scratch.write(left.drop("root").join(roots, "item"), f"rooted-{turn}")
        counts = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_m"))
        largest = counts.groupBy("key").agg(F.max_by("root", F.struct("_m", "root")).alias("_top"),
                                            (F.sum("_m") - F.max("_m")).alias("_strays")).filter("_strays > 0")
        left = scratch.write(left.join(scratch.write(largest, f"largest-{turn}"), "key"), f"left-{turn}")
        scratch.release(f"rooted-{turn}")
        if turn > 1:
            scratch.release(f"left-{turn - 1}")
        if left.isEmpty():
            return roots
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_pop"), "item"))
        stray = left.filter("root <> _top").withColumn("_nth", nth).filter(F.col("_nth") <= most)
        other = F.struct(me.alias("my"), "root", "sketch")
        hubs = scratch.write(stray.groupBy("key").agg(F.collect_list(other).alias("_hubs")), f"hubs-{turn}")
        met = left.join(hubs, "key")
        # Sizes and sketches rule out nearly all pairs before any row is made of them.
        fit = F.filter("_hubs", lambda h: (h["root"] != F.col("root")) & fits_pair(
            F.col("size"), F.col("common"), h["my"]["size"], h["my"]["common"]) & near_enough(F.col("sketch"), h["sketch"]))
        pairs = met.select(me.alias("mx"), F.explode(fit).alias("_h")).select("mx", F.col("_h.my").alias("my"))
        # A key whose strays were all hubs is finished. In others, items that have been a hub have met all and leave.
        left = left.filter(F.col("_strays") > most).join(hubs, "key").filter(
            ~F.array_contains(F.transform("_hubs", lambda h: h["my"]["item"]), F.col("item"))).drop("_hubs", "_top", "_strays")
        most = min(4 * most, HUBS)


def _own_shingles(features: DataFrame) -> DataFrame:
    """How many hashes of each item no other item has."""
    held = features.select("item", F.explode("whole").alias("h"))
    once = held.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min("item").alias("item")).filter("_n = 1")
    return once.groupBy("item").agg(F.count(F.lit(1)).alias("_own"))
