"""Sources mixed to target weights.

Every source gets its share of the total as a token budget.  Whole epochs of a
source come first; the rest of its budget is a weighted sample without
replacement after Efraimidis and Spirakis: each text draws an exponential key
divided by its quality weight, texts are taken in order of their keys, and the
prefix sums of their tokens end at the budget.  The order is never sorted as a
whole: keys fall into bins, bins below the one where the budget ends are taken,
and only that one is sorted.  There are as many bins as keep a bin small, so a
source that holds a third of all texts is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import cut

BINS, IN_BIN = 1 << 14, 20_000


def letter_share(text: Column) -> Column:
    """Letters among the characters of a text."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))
    return letters / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))


def quality(letters: Column, tokens: Column) -> Column:
    """Weight of a text between 0.1 and 1: its share of letters, and less for texts of a few tokens."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters) * F.least(F.lit(1.0), tokens / 32.0))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn by the id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def budgets(stats: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[dict[str, tuple[float, int, float]], float]:
    """({source: (budget, whole epochs, tokens of the partial epoch)}, total).

    Without a total, the largest one is taken at which every source that is
    there reaches its share.  A source that is too short for its budget gives
    all it may; its deficit goes to no other source and shows in the report.
    """
    have = dict(stats)
    wanted = {s: (share, max(0, repeats)) for s, share, repeats in targets if s is not None and share and share > 0 and repeats is not None}
    present = {s: x for s, x in wanted.items() if have.get(s, 0) > 0 and x[1] > 0}
    if total is None:
        total = min((have[s] * r / share for s, (share, r) in present.items()), default=0.0)
    out = {}
    for s, (share, repeats) in present.items():
        budget = min(share * total, float(have[s]) * repeats)
        whole = min(repeats, int(budget / have[s] + 1e-9))
        rest = budget - whole * have[s] if whole < repeats else 0.0
        out[s] = (budget, whole, max(0.0, rest))
    return out, total


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mix (source, doc_id, times, tokens) and its report.

    ``docs`` has doc_id, source, tokens and weight.  Texts without tokens take
    no part.  The report (source, target_share, n_texts, tokens, share,
    epochs) has a row per target; absent sources show zero.
    """
    spark = docs.sparkSession
    # the targets are a fixed list; sources outside it are not read on
    rows = [tuple(r) for r in targets.where("source_name is not null").groupBy("source_name").agg(F.max("target_share"), F.max("max_repeats")).collect()]
    listed = [r[0] for r in rows]
    own = cut(docs.where(F.col("source").isin(listed) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens", exponential_key(F.col("doc_id"), F.col("weight"), seed).alias("key")))
    sizes = own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    stats = [(r["source"], r["tokens"]) for r in sizes]
    bins = max(BINS, *(r["n"] // IN_BIN for r in sizes), 0)
    binned = own.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * bins).cast("long"))
    budget, _ = budgets(stats, rows, total)
    plan = spark.createDataFrame([(s, w, r) for s, (_, w, r) in budget.items()], "source string, whole int, rest double")
    # bins x sources rows at most
    sums = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("in_bin"))
    ends = sums.withColumn("upto", F.sum("in_bin").over(W.partitionBy("source").orderBy("bin"))).join(F.broadcast(plan), "source")
    edge = ends.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min("bin").alias("edge"), F.min_by(F.col("upto") - F.col("in_bin"), "bin").alias("before"))
    known = binned.join(F.broadcast(plan), "source").join(F.broadcast(edge), "source", "left")
    inside = known.where(F.col("edge").isNull() | (F.col("bin") != F.col("edge"))).select("source", "doc_id", "tokens", "whole", (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))).cast("int").alias("once"))
    upto = F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    # the text that crosses the budget is taken when more than half of it fits
    at_edge = known.where(F.col("bin") == F.col("edge")).withColumn("upto", upto).select("source", "doc_id", "tokens", "whole", (F.col("upto") - F.col("tokens") / 2.0 <= F.col("rest")).cast("int").alias("once"))
    mixed = inside.unionByName(at_edge).withColumn("times", F.col("whole") + F.col("once")).where("times > 0").select("source", "doc_id", "times", "tokens")
    reached = mixed.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_repeats"))
    want = spark.createDataFrame([(s, float(t) if t is not None else None, m) for s, t, m in rows], "source string, target_share double, max_repeats int")
    every = F.sum("tokens").over(W.partitionBy())
    report = want.join(reached, "source", "left").fillna(0, ["n_texts", "tokens", "most_repeats"]).withColumn("share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0))
    return mixed, report.select("source", "target_share", "share", "n_texts", "tokens", "most_repeats", "max_repeats")
