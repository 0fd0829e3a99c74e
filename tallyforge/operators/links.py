"""Link graphs: scoring, path patterns, first occurrences, breadth-first scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..runtime import cut

# What an anchor scores by the zone it stands in.
ZONE_SCORES = {"nav": 4, "header": 3, "menu": 3, "navclass": 3, "footer": 2, "sidebar": 2, "page": 1}


def category_scores(anchors: DataFrame, page: str, url: str, zone: str, base: str) -> DataFrame:
    """(page, url, score) of internal links: zone scores and product bonuses add up over all anchors of an address, and frequent path patterns add twice their frequency."""
    zone_score = F.coalesce(*[F.when(F.col(zone) == z, s) for z, s in ZONE_SCORES.items()], F.lit(1))
    inside = anchors.where(F.col(url).isNotNull() & (U.host_key(U.authority(F.col(url))) == U.host_key(U.authority(F.col(base)))) & ~U.is_skipped(F.col(url)) & (F.regexp_replace(url, "/$", "") != F.regexp_replace(base, "/$", "")))
    each = F.lit(0) + zone_score + F.when(U.path(F.col(url)).rlike(U.PRODUCT_PATTERN), 5).otherwise(0)
    summed = inside.groupBy(page, url).agg(F.sum(each).alias("score"))
    return boosted(summed, page, url).where("score >= 2").select(page, url, "score")


def boosted(scored: DataFrame, page: str, url: str) -> DataFrame:
    """``score`` plus twice the frequency of the address's path pattern on its page, from a frequency of 2 on.

    The frequencies are counted apart and joined, not taken from a window, so
    that a page with most of the links is aggregated before it is shuffled.
    """
    shaped = scored.withColumn("pattern", U.path_pattern(F.col(url)))
    freq = shaped.groupBy(page, "pattern").agg(F.count("*").alias("freq"))
    return shaped.join(freq, [page, "pattern"]).withColumn("score", F.col("score") + F.when(F.col("freq") >= 2, 2 * F.col("freq")).otherwise(0))


def top_links(scored: DataFrame, page: str, url: str, k: int = 40) -> DataFrame:
    """The best k links of each page, then one per cleaned address; the best-ranked stays."""
    ranked = scored.withColumn("place", F.row_number().over(W.partitionBy(page).orderBy(F.desc("score"), url))).where(F.col("place") <= k)
    return first_of(ranked.withColumn("clean", U.cleaned(F.col(url))), [page, "clean"], "place").select(page, url, "score", "place")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` for each key."""
    columns = rows.columns
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("r")).select("r.*")


def link_scores(links: DataFrame, page: str, url: str, base: str) -> DataFrame:
    """(page, url, score): the greatest score of each cleaned address, zero left out."""
    scored = links.select(page, U.cleaned(F.col(url)).alias(url), U.link_score(F.col(url), F.col(base)).alias("score")).where("score > 0")
    return scored.groupBy(page, url).agg(F.max("score").alias("score"))


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level): every node within ``depth`` steps of the seeds, with its first level.

    ``edges`` has src and dst, ``seeds`` has node.  Each level joins the
    frontier with the edges and keeps what was not seen; levels are
    materialised in the shared folder, so lineage does not grow and the work
    survives lost executors.  Nothing is collected but whether a frontier is empty.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(seeds.select("node").where("node is not null").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def best_candidates(candidates: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """The candidate of each group with the greatest keys; the first by ``order`` wins ties."""
    columns = candidates.columns
    rank = F.struct(*[F.col(k) for k in keys], (-F.col(order)).alias("__first"))
    return candidates.groupBy(group).agg(F.max_by(F.struct(*columns), rank).alias("r")).select("r.*")
