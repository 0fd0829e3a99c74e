"""Queries of the operators for text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import abuse, boilerplate, canonical, linkage, mixing, packing, survivors, tokens, truncation


def _brands(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return canonical.entries_of(table(spark, sf_dir, "brand_ref"), "brand_id", "brand_name", "aliases")


def _types(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return canonical.entries_of(table(spark, sf_dir, "type_ref"), "type_id", "type_name", "synonyms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"brand": ("brand", _brands(spark, sf_dir)), "type": ("machine_type", _types(spark, sf_dir))}
    return canonical.map_values(table(spark, sf_dir, "machines"), "id", fields)


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry, with their number of rows; each distinct value is matched once."""
    rows = table(spark, sf_dir, "machines")
    values = F.array(F.struct(F.lit("brand").alias("field"), F.col("brand").alias("value")), F.struct(F.lit("type").alias("field"), F.col("machine_type").alias("value")))
    counts = rows.where("id is not null").select(F.explode(values).alias("v")).groupBy("v.field", "v.value").agg(F.count("*").alias("n_rows"))
    return canonical.matched(counts, {"brand": _brands(spark, sf_dir), "type": _types(spark, sf_dir)}, "field", "value", ["n_rows"]).where("ref_id = -1").select("field", "value", "n_rows")


def p2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within reach of each distinct value, with its distance; the nearest one is that of ``p2_found``."""
    rows = table(spark, sf_dir, "machines")
    values = F.array(F.struct(F.lit("brand").alias("field"), F.col("brand").alias("value")), F.struct(F.lit("type").alias("field"), F.col("machine_type").alias("value")))
    distinct = rows.select(F.explode(values).alias("v")).select("v.field", "v.value").distinct()
    return canonical.within(distinct, {"brand": _brands(spark, sf_dir), "type": _types(spark, sf_dir)}, "field", "value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, sf_dir, "machines"))


def p3_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, main_text) of every description."""
    return boilerplate.main_bodies(table(spark, sf_dir, "machines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.score(table(spark, sf_dir, "machines")).where("p >= 0.5").select("id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each website_source truncates: (website_source, n_texts, n_truncated, share)."""
    scored = truncation.score(table(spark, sf_dir, "machines"), group_col="website_source").withColumnRenamed("grp", "website_source")
    out = scored.groupBy("website_source").agg(F.count("*").alias("n_texts"), F.count_if(F.col("p") >= 0.5).alias("n_truncated"))
    return out.withColumn("share", F.col("n_truncated") / F.col("n_texts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(table(spark, sf_dir, "machines"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that provides each bundle of the survivor of each key."""
    return survivors.survivors(table(spark, sf_dir, "machines"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.products(linkage.parsed(table(spark, sf_dir, "machines"), _brands(spark, sf_dir), _types(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.links(_products(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing that states a model, with its product and number of links."""
    return linkage.classes(_products(spark, sf_dir))


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [tuple(r) for r in table(spark, sf_dir, "container_sizes").select("container_name", "capacity_tokens").collect()]


def p8_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of every capacity."""
    return packing.pack(tokens.with_tokens(table(spark, sf_dir, "documents"), ["doc_id"]), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_rates(p8_assignments(spark, sf_dir), _capacities(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    sized = tokens.with_tokens(docs.withColumn("letters", mixing.letter_share(F.col("text"))), ["doc_id", "source", "letters"])
    return mixing.mix(sized.withColumn("weight", mixing.quality(F.col("letters"), F.col("tokens"))), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: which text is used how many times."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, beside the targets."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents")).where("p_any >= 0.5").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity."""
    return abuse.scores(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents for each source."""
    scored = abuse.scores(table(spark, sf_dir, "documents"), group_col="source").withColumnRenamed("grp", "source")
    hit = (F.col("p_any") >= 0.5).cast("int")
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_found"), F.avg(hit).alias("rate"), F.avg("severity").alias("mean_severity"))


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p2_within, p3_found, p3_main_body, p4_found, p4_rates, p5_found, p5_survivors, p6_found, p6_classes,
                                   p8_assignments, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}
ORACLE_SQL: dict[str, str] = {}
