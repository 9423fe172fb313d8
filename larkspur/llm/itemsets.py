"""Closed frequent itemsets of baskets, and their rules.

Breadth-first closure extension.  A level holds candidates: a closed parent with one more item, the core.  Their occurrences
are joined to the baskets and items are counted for each candidate.  Items that all its baskets hold are absorbed: that is the
closure.  A candidate stays if its closure adds nothing below the core (prefix-preserving), so that each closed set comes up
once, from one parent.  Frequent items above the core are the next level's candidates.  Each level is written to the shared
folder, and the driver learns only whether there is another one.

What bounds a row.  An item is frequent from B / share baskets on, so there are at most share times the mean basket size
of them; baskets are cut down to frequent items before they become arrays, and equal ones are merged with a weight.  A
basket of many items meets its many candidates in as many parts as it has blocks of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Items of a basket for each part in which it meets its candidates.
BLOCK = 256


def _key(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def _meet(occurrences: DataFrame, baskets: DataFrame) -> DataFrame:
    """Occurrences (cid, bid, parts) with their basket's weight and items; a large basket is copied for each of its parts,
    and each of its candidates goes to one of them."""
    dealt = occurrences.withColumn("part", F.pmod(F.hash("cid"), "parts")).drop("parts")
    copies = baskets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(copies, ["bid", "part"])


def closed_itemsets(rows: DataFrame, basket: str = "sale_id", item: str = "item_id", min_support: int = 12, share: int = 10_000) -> DataFrame:
    """Closed itemsets and their support: items array<long> (ascending), support long, baskets long (B).

    Rows (basket, item) are taken as they come: repeated ones count once, and those with a null in either are left out.
    Support must reach *min_support* and B / *share*.

    Defined cases.  An empty table, or one where nothing is frequent, gives no rows.  Items that every basket holds are one
    itemset of their own.  Ties don't matter, as sets have no order.  Item ids are taken as long.  Other columns are not read.
    """
    pairs = rows.select(F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    n_baskets = pairs.select("basket").distinct().count()
    need = max(min_support, -(-n_baskets // share))
    pairs = saved(pairs.distinct(), "basket-items")
    singles = saved(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need), "items")
    # items of all baskets are the closure of nothing and belong to every closed set; the smallest basket has no fewer of them
    whole = sorted(r["item"] for r in singles.where(F.col("n") == n_baskets).collect())
    parent = F.array(*map(F.lit, whole)).cast("array<bigint>")

    held = pairs.join(singles.select("item"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    alike = held.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))
    parts = F.ceil(F.size("items") / F.lit(float(BLOCK))).cast("int")
    baskets = saved(alike.select(F.monotonically_increasing_id().alias("bid"), "weight", "items", parts.alias("parts")), "baskets")
    discard(pairs)

    first = singles.where(F.col("n") < n_baskets)
    frontier = saved(first.select(F.col("item").alias("cid"), F.col("item").alias("core"), parent.alias("parent")), "frontier")
    seen = saved(baskets.select(F.explode("items").alias("cid"), "bid", "parts").join(first.select(F.col("item").alias("cid")), "cid"), "occurrences")
    out = singles.where(F.col("n") == n_baskets).groupBy(F.col("n").alias("support")).agg(F.sort_array(F.collect_list("item")).alias("items")).select("items", "support")
    while True:
        counted = _meet(seen, baskets).select("cid", "weight", F.explode("items").alias("item")).groupBy("cid", "item").agg(F.sum("weight").alias("n"))
        # a candidate's own items are in all its baskets: the largest count is its support
        level = counted.where(F.col("n") >= need).groupBy("cid").agg(F.max("n").alias("support"), F.sort_array(F.collect_list(F.struct("item", "n"))).alias("found"))
        level = level.join(frontier, "cid").select(
            "cid",
            "core",
            "parent",
            "support",
            F.expr("transform(filter(found, x -> x.n = support), x -> x.item)").alias("items"),
            F.expr("transform(filter(found, x -> x.n < support AND x.item > core), x -> x.item)").alias("more"),
        )
        level = saved(level.where(F.expr("size(array_except(filter(items, x -> x < core), parent)) = 0")).select("cid", "items", "support", "more"), "level")
        discard(frontier)
        out = out.unionByName(level.select("items", "support"))
        children = level.select(F.col("cid").alias("of"), F.explode("more").alias("core"), F.col("items").alias("parent"))
        frontier = saved(children.select(F.monotonically_increasing_id().alias("cid"), "of", "core", "parent"), "frontier")
        if frontier.limit(1).count() == 0:
            discard(frontier)
            discard(seen)
            break
        to = frontier.select(F.col("of").alias("cid"), F.col("core").alias("item"), F.col("cid").alias("child"))
        reached = _meet(seen, baskets.withColumn("n_parts", F.col("parts"))).select("cid", "bid", "n_parts", F.explode("items").alias("item"))
        after = saved(reached.join(to, ["cid", "item"]).select(F.col("child").alias("cid"), "bid", F.col("n_parts").alias("parts")), "occurrences")
        discard(seen)
        seen = after
    discard(baskets)
    return out.select("items", "support", F.lit(n_baskets).cast("long").alias("baskets"))


def rules(itemsets: DataFrame, min_percent: int = 30) -> DataFrame:
    """Rules of closed itemsets: items, support, rules array<struct(c long, a long, s long)>, in ascending order of c.

    c is a rule of an itemset of two or more if support / a reaches *min_percent* per cent and exceeds s / B, where a is the
    support of the rest and s that of c.

    The rest of a closed set without c is either closed itself, or its closure is the set: what all its baskets hold besides
    is in all baskets of the set too, so it is in the set, and only c is not in the rest.  So a is found by an equality join
    on the sets, and where there is no match it is the set's own support.  The same holds for the closure of c alone if the
    set has two items; in larger sets s comes from the smallest closed set with c, that is, the one of largest support.
    """
    one = itemsets.select(F.explode("items").alias("c"), F.col("support").alias("s")).groupBy("c").agg(F.max("s").alias("s"))
    known = itemsets.select(_key(F.col("items")).alias("rest"), F.col("support").alias("rest_support"))
    each = itemsets.where(F.size("items") >= 2).select("items", "support", "baskets", F.explode("items").alias("c"))
    each = each.withColumn("rest", _key(F.array_remove("items", F.col("c")))).join(known, "rest", "left").join(one, "c")
    each = each.withColumn("a", F.coalesce("rest_support", "support"))
    each = each.where((F.lit(100) * F.col("support") >= F.lit(min_percent) * F.col("a")) & (F.col("support") * F.col("baskets") > F.col("a") * F.col("s")))
    found = each.groupBy(_key(F.col("items")).alias("key")).agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))
    none = F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")
    return itemsets.withColumn("key", _key(F.col("items"))).join(found, "key", "left").select("items", "key", "support", F.coalesce("rules", none).alias("rules"))


def basket_rules(lines: DataFrame, min_support: int = 12, share: int = 10_000, min_percent: int = 30) -> DataFrame:
    """The report on sale lines: items string, n_items, support, n_rules, best_item (null without rules), rules_sha256.

    Lines of any flag but 'returned' count, those without a flag too.  best_item is, among the rules, the c with the
    smallest a, then the smallest c.
    """
    bought = lines.where(~F.col("flag").eqNullSafe(F.lit("returned"))).select("sale_id", "item_id")
    sets = saved(closed_itemsets(bought, "sale_id", "item_id", min_support, share), "closed")
    best = F.expr("array_min(transform(rules, r -> struct(r.a AS a, r.c AS c))).c")
    digest = F.sha2(F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";"), 256)
    return rules(sets, min_percent).select(
        F.col("key").alias("items"), F.size("items").alias("n_items"), "support", F.size("rules").alias("n_rules"), best.alias("best_item"), digest.alias("rules_sha256")
    )
