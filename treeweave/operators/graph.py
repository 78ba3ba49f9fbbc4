"""Commit graphs, stored as chains with generations, and merge bases found on them.

A chain is a line of commits, each the first parent of the next; every commit is on one. Its generation is larger than those
of its parents: the time of the commit, put forward where clocks disagree. So what a commit reaches on a chain is all of the chain
up to some generation, one row whatever the length of the history. The other edges lead from chain to chain.

A merge base is found from both sides at once, in windows of generations that fall from the older of the two commits: only edges within the
window are looked at, and a pair is done once nothing that just one side reaches lies below its window. History behind the
meeting point is never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from treeweave.session import kept

# Generations of the first window at least, and how many times larger each next one is.
SPAN = 3_600
GROWTH = 8
# Steps from chain to chain between two looks at what is new.
ROUNDS = 4


@dataclass(frozen=True)
class CommitGraph:
    """`nodes` (repo_url, sha, chain, place, generation, committed_at) and `sides` (repo_url, chain, generation, to_chain, to_generation, to_bottom).

    `place` counts along a chain from 0 at its bottom, whose generation is `to_bottom`.
    """

    nodes: DataFrame
    sides: DataFrame

    def write(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        self.sides.write.parquet(f"{path}/sides")

    @staticmethod
    def read(spark: SparkSession, path: str) -> CommitGraph:
        return CommitGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/sides"))


def commit_graph(commits: DataFrame, parents: DataFrame) -> CommitGraph:
    """The graph of `commits` (repo_url, sha, committed_at) and `parents` (repo_url, sha, parent_ord, parent_sha).

    Commits that are only named as a parent or a child take part, without a time. Chains are labelled by doubling, so rounds grow
    with the logarithm of the longest chain. Meant to be written once per snapshot of the history.
    """
    edges = kept(parents.select("repo_url", "sha", "parent_ord", "parent_sha").distinct(), "edges")
    named = edges.select("repo_url", "sha").union(edges.select("repo_url", "parent_sha")).withColumn("committed_at", F.lit(None).cast("long"))
    known = commits.select("repo_url", "sha", F.col("committed_at").cast("long").alias("committed_at"))
    times = kept(known.union(named).groupBy("repo_url", "sha").agg(F.max("committed_at").alias("committed_at")), "commits")

    # Of several children one, the newest, continues the chain of its first parent.
    first = edges.where("parent_ord = 0").join(times, ["repo_url", "sha"])
    child = first.groupBy("repo_url", F.col("parent_sha").alias("below")).agg(F.max(F.struct("committed_at", "sha")).alias("best"))
    down = child.select("repo_url", F.col("best.sha").alias("sha"), "below")
    down = down.groupBy("repo_url", "sha").agg(F.max("below").alias("below"))
    chained = kept(
        times.join(down, ["repo_url", "sha"], "left").select(
            "repo_url", "sha", "below", "committed_at", F.coalesce("below", "sha").alias("chain"),
            F.when(F.col("below").isNull(), 0).otherwise(1).cast("long").alias("place"),
            F.coalesce("committed_at", F.lit(-1)).cast("long").alias("generation"),
        ),
        "chains",
    )
    reach = 1
    while True:
        # What holds for the commit `place` steps below holds here, that many generations later.
        further = chained.select(
            "repo_url", F.col("sha").alias("chain"), F.col("chain").alias("_chain"), F.col("place").alias("_place"),
            F.col("generation").alias("_generation"),
        )
        chained = chained.join(further, ["repo_url", "chain"]).select(
            "repo_url", "sha", "below", "committed_at", F.col("_chain").alias("chain"), (F.col("place") + F.col("_place")).alias("place"),
            F.greatest("generation", F.col("_generation") + F.col("place")).alias("generation"),
        )
        chained = kept(chained, "chains")
        reach *= 2
        if (chained.agg(F.max("place")).first()[0] or 0) < reach:
            break
    rest = edges.select("repo_url", "sha", "parent_sha").distinct().join(
        chained.select("repo_url", "sha", F.col("below").alias("parent_sha")), ["repo_url", "sha", "parent_sha"], "left_anti"
    )
    nodes = chained.drop("below")
    while True:
        here = nodes.select("repo_url", "sha", "chain", "place", "generation")
        there = nodes.select(
            "repo_url", F.col("sha").alias("parent_sha"), F.col("chain").alias("to_chain"), F.col("generation").alias("to_generation")
        )
        bottoms = nodes.where("place = 0").select("repo_url", F.col("chain").alias("to_chain"), F.col("generation").alias("to_bottom"))
        joined = rest.join(here, ["repo_url", "sha"]).join(there, ["repo_url", "parent_sha"]).join(bottoms, ["repo_url", "to_chain"])
        joined = kept(joined.drop("sha", "parent_sha"), "sides")
        late = joined.where("generation <= to_generation")
        if late.isEmpty():
            break
        # A commit that is not later than a parent on another chain moves up, and with it what its own chain has above.
        lifts = late.groupBy("repo_url", "chain", "place").agg((F.max("to_generation") + 1).alias("lift"))
        above = W.partitionBy("repo_url", "chain").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
        moved = nodes.join(lifts.select("repo_url", "chain").distinct(), ["repo_url", "chain"], "left_semi")
        lifted = moved.join(lifts, ["repo_url", "chain", "place"], "left").withColumn(
            "generation", F.greatest("generation", F.max(F.col("lift") - F.col("place")).over(above) + F.col("place"))
        )
        same = nodes.join(lifts.select("repo_url", "chain").distinct(), ["repo_url", "chain"], "left_anti")
        nodes = kept(same.unionByName(lifted.drop("lift")), "chains")
    return CommitGraph(nodes, joined.drop("place"))


def _spread(reached: DataFrame, sides: DataFrame) -> DataFrame:
    """`reached` (pair, low, repo_url, chain, bottom, base, head) with what the edges from `low` on add; `fresh` tells what is new."""
    reached = reached.drop("fresh")
    open_ = reached.withColumn("top", F.greatest("base", "head"))
    edges = sides.select("repo_url", "chain", F.col("generation").alias("from"), "to_chain", "to_generation", "to_bottom")
    led = open_.join(edges, ["repo_url", "chain"]).where("from >= low AND from <= top").select(
        "pair", "low", "repo_url", F.col("to_chain").alias("chain"), F.col("to_bottom").alias("bottom"),
        F.when(F.col("from") <= F.col("base"), F.col("to_generation")).alias("base"),
        F.when(F.col("from") <= F.col("head"), F.col("to_generation")).alias("head"), F.lit(False).alias("own"),
    )
    before = lambda side: F.max(F.when(F.col("own"), F.col(side)))
    return reached.withColumn("own", F.lit(True)).unionByName(led).groupBy("pair", "low", "repo_url", "chain").agg(
        F.min("bottom").alias("bottom"), F.max("base").alias("base"), F.max("head").alias("head"),
        before("base").alias("base_before"), before("head").alias("head_before"),
    ).withColumn("fresh", ~(F.col("base").eqNullSafe(F.col("base_before")) & F.col("head").eqNullSafe(F.col("head_before")))).drop(
        "base_before", "head_before"
    )


def _judged(reached: DataFrame, sides: DataFrame) -> DataFrame:
    """Per pair `low`, the `tops`: best common generation of each chain not reached from another one, and whether it is `done`."""
    common = reached.withColumn("common", F.when(F.col("base").isNotNull() & F.col("head").isNotNull(), F.least("base", "head")))
    edges = sides.select("repo_url", "chain", F.col("generation").alias("from"), F.col("to_chain"), "to_generation")
    behind = common.where("common IS NOT NULL").join(edges, ["repo_url", "chain"]).where(
        "from >= low AND from <= common"
    ).groupBy("pair", F.col("to_chain").alias("chain")).agg(F.max("to_generation").alias("behind"))
    chains = common.join(behind, ["pair", "chain"], "left")
    best = F.col("common").isNotNull() & (F.col("behind").isNull() | (F.col("common") > F.col("behind")))
    # The lowest generation that one side alone may reach on a chain, if any.
    alone = F.when(F.col("common").isNull() | (F.greatest("base", "head") > F.col("common")), F.coalesce("common", "bottom"))
    folded = chains.groupBy("pair", "low", "repo_url").agg(
        F.min(alone).alias("alone"), F.collect_list(F.when(best, F.struct("chain", F.col("common").alias("generation")))).alias("tops")
    )
    lowest = F.array_min(F.transform("tops", lambda t: t["generation"]))
    return folded.withColumn(
        "done",
        (F.col("alone").isNull() | (F.col("low") <= F.col("alone"))) & ((F.size("tops") <= 1) | (F.col("low") <= lowest)),
    )


def graph_merge_bases(pairs: DataFrame, graph: CommitGraph) -> DataFrame:
    """(repo_url, base_sha, head_sha) with `merge_base`, the best common ancestor, null if there is none or a commit is unknown.

    A common ancestor is best if no other one descends from it; of several, the newest, then the largest sha.
    """
    asked = kept(pairs.select("repo_url", "base_sha", "head_sha").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    nodes, sides = graph.nodes, graph.sides
    starts = asked.select("pair", "repo_url", F.explode(F.array(
        F.struct(F.lit(True).alias("is_base"), F.col("base_sha").alias("sha")), F.struct(F.lit(False).alias("is_base"), F.col("head_sha").alias("sha"))
    )).alias("end")).select("pair", "repo_url", "end.*").join(nodes, ["repo_url", "sha"])
    bottoms = nodes.where("place = 0").select("repo_url", "chain", F.col("generation").alias("bottom"))
    starts = kept(starts.join(bottoms, ["repo_url", "chain"]).select("pair", "repo_url", "chain", "bottom", "generation", "is_base"), "starts")
    own = lambda side: F.max(F.when(F.col("is_base") == F.lit(side), F.col("generation")))
    ends = starts.groupBy("pair").agg(own(True).alias("base"), own(False).alias("head")).where("base IS NOT NULL AND head IS NOT NULL")
    # The first window reaches below the older commit by their distance, the next ones by `GROWTH` times as much.
    span = F.greatest(F.abs(F.col("base") - F.col("head")), F.lit(SPAN))
    windows = kept(ends.select("pair", F.least("base", "head").alias("older"), span.alias("span")), "windows")
    reached = starts.join(windows.select("pair", (F.col("older") - F.col("span")).alias("low")), "pair").groupBy(
        "pair", "low", "repo_url", "chain"
    ).agg(F.min("bottom").alias("bottom"), own(True).alias("base"), own(False).alias("head"))
    found, scale = None, 1
    while True:
        while True:
            for _ in range(ROUNDS):
                reached = _spread(reached, sides)
            reached = kept(reached, "reached")
            if reached.where("fresh").isEmpty():
                break
        judged = kept(_judged(reached, sides), "judged")
        tops = judged.where("done").select("pair", "repo_url", F.explode("tops").alias("top")).select("pair", "repo_url", "top.*")
        found = tops if found is None else found.unionByName(tops)
        left = judged.where("NOT done")
        if left.isEmpty():
            break
        scale *= GROWTH
        lower = left.select("pair").join(windows, "pair").select("pair", (F.col("older") - F.col("span") * scale).alias("low"))
        reached = reached.drop("low", "fresh").join(lower, "pair")
    chosen = found.join(nodes, ["repo_url", "chain", "generation"]).groupBy("pair").agg(
        F.max(F.struct("committed_at", "sha")).getField("sha").alias("merge_base")
    )
    return asked.join(chosen, "pair", "left").drop("pair")
