"""Distributed union-find over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.store import drop, written


#: Members of a posting list above which the last step compares blocks in place of pairs of rows.
LONG = 64


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest reachable id of every linked node: rows (node, component_id), without the smallest nodes themselves.

    Alternating large-star and small-star steps turn the links into stars round the smallest id in about log(n) rounds. Each
    step is one aggregate with map-side combine and one equi-join that adaptive execution can split, so a node holding a third
    of all links stays distributed. Every round is written to the shared folder. Self-links, repeated links and links with a
    null end are ignored; an empty table gives no rows.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = written(e.where("u <> v").distinct(), "links")
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        new = written(small.select("s.u", "s.v").where("u <> v").distinct(), "links")
        drop(e)
        e, last = new, seen
        seen = _mark(e)
        if seen == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def merged_components(label: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``label``, rows (node, component_id) as of ``connected_components``, after more links: only the components that these links touch are joined anew."""
    for side in (a, b):
        of = label.select(F.col("node").alias("__node"), F.col("component_id").alias("__component"))
        links = links.join(of, F.col(side) == F.col("__node"), "left").withColumn(side, F.coalesce("__component", side)).drop("__node", "__component")
    moved = connected_components(links, a, b)
    to = moved.select(F.col("node").alias("__node"), F.col("component_id").alias("__component"))
    kept = label.join(to, F.col("component_id") == F.col("__node"), "left").select("node", F.coalesce("__component", "component_id").alias("component_id"))
    return written(kept.unionByName(moved), "components")


def linked_postings(post: DataFrame, verified, rounds: int = 2, across: bool = True, dense=None, screen=None) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) among the rows (cid, token) of ``post``; they connect exactly what all verified pairs sharing a token connect.

    Members of one posting list first meet a leader of the list (star rounds with different leaders), so a list of any length gives as
    many pairs as rows. What is still apart after that meets pair by pair, but only across components: members outside the largest
    component of a list meet all others of it. Lists whose members are all in one component are left out of later steps, and lists of two, whose only pair
    the first step tests. Lists of more than ``LONG`` members then go to ``dense``, which maps their rows (token, cid,
    component) to links without emitting pairs, if it is given. Without ``across`` that last step is left out, pairs stay linear in the rows whatever lists
    hold, and a link is found unless its ends are both unlike the leaders of all lists and rounds that they share. ``verified`` maps distinct pairs (a, b) to those that are links.
    ``screen``, if given, is a table with more columns of each cid and a condition that all links meet, on two functions from a column's name to the column
    of one end: pairs of the last step that fail it are not emitted. Tables that only this function reads are deleted. Also gives
    the components of the links where they are known already. (None, None): no pair shares a token.
    """
    found, tested, label = None, None, None
    spent = []

    def ended(label: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        for table in spent:
            drop(table)
        return found, label

    for step in range(rounds + across):
        here = post.withColumn("component", F.col("cid")) if label is None else (
            post.join(label, post.cid == label.node, "left").select("cid", "token", F.coalesce("component_id", "cid").alias("component")))
        split = here.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"),
                                          F.min(F.struct(F.xxhash64(F.lit(step), "cid").alias("h"), "cid", "component")).alias("lead"))
        split = split.where("lo <> hi" if step == 0 else "lo <> hi and members > 2")
        if step < rounds:
            led = here.join(split.select("token", "lead"), "token")
            if step:
                led = written(led, "led")
                spent.append(led)
                post = led.select("cid", "token")
            pairs = led.where("component <> lead.component").select(
                F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b"))
        else:
            apart = here.join(split.select("token"), "token")
            largest = (apart.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token")
                       .agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"))
                       .select("token", F.col("m.component").alias("largest"), "n"))
            apart = written(apart.join(largest, "token"), "apart")
            spent.append(apart)
            if dense is not None:
                more = written(dense(apart.where(F.col("n") > LONG).select("token", "cid", "component")), "dense")
                found = more if found is None else found.unionByName(more)
                apart = apart.where(F.col("n") <= LONG)
            if screen is not None:
                apart = apart.drop("n").join(screen[0], "cid")
            few = apart.where("component <> largest").select("token", *[F.col(c).alias(f"{c}_x") for c in apart.columns if c != "token"])
            pairs = few.join(apart, "token").where("component <> component_x and (component = largest or cid_x < cid)")
            if screen is not None:
                pairs = pairs.where(screen[1](F.col, lambda c: F.col(f"{c}_x")))
            pairs = pairs.select(F.least("cid", "cid_x").alias("a"), F.greatest("cid", "cid_x").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            if step == rounds:
                return ended(None)
            if split.isEmpty():  # no list spans two components
                break
            continue  # the leaders' pairs were tested in an earlier round; other members may still be apart
        new = written(verified(pairs), "links")
        found, tested = (new, pairs) if found is None else (found.unionByName(new), tested.unionByName(pairs))
        if step == rounds:  # links of long lists are in found, not in the label; nobody asks for components after the last step
            return ended(None)
        if label is None or not new.isEmpty():
            label = connected_components(new, "a", "b") if label is None else merged_components(label, new, "a", "b")
    return ended(label)
