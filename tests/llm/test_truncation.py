import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import truncation


def test_template_lengths_do_not_push_a_limit_out(spark):
    n = 210
    templates = spark.range(12 * n).select(F.repeat(F.lit("x"), (1051 + F.col("id") % n * 5).cast("int")).alias("t"))
    limited = spark.range(8).select(F.repeat(F.lit("x"), F.lit(255)).alias("t"))
    assert truncation.field_limits(templates.unionByName(limited), "t") == [255]


def test_lengths_beside_limits():
    assert [truncation.length_features(n, [255, 256, 300])[0] for n in (251, 252, 255, 256, 257, 297, 300, 301)] == ["free", "near limit", "at limit", "at limit", "free", "near limit", "at limit", "free"]


def test_rates_count_every_text(spark, data):
    whole, cut = "Norvikson QX 4410 Panel Saw\nBuilt in 2001, commissioned a few months later in Norbury.", "Norvikson QX 4410 Panel Saw\nBuilt in 2001, commissioned a few mon..."
    rows = [{"id": k, "website_source": "a" if k % 3 else "b", "description": cut if k % 4 == 0 else whole} for k in range(120)]
    rows += [{"id": 200, "website_source": None, "description": ""}, {"id": 201, "website_source": "a", "description": None}, {"id": None, "website_source": "a", "description": whole}, {"id": 0, "website_source": "b", "description": cut}]
    from tallyforge.llm.queries import QUERIES

    d = data.put("machines", rows, "line string, full string, grp string").rest()
    found = {r.id for r in QUERIES["p4_found"](spark, d).collect()}
    got = {r.website_source: (r.n_texts, r.n_truncated) for r in QUERIES["p4_rates"](spark, d).collect()}
    n = lambda s: sum(r["website_source"] == s and r["description"] is not None for r in rows)
    texts = {r["description"] for r in rows if r["id"] in found}  # a row without an id counts by its text
    c = lambda s: sum(r["website_source"] == s and r["description"] in texts for r in rows)
    assert got == {"a": (n("a"), c("a")), "b": (n("b"), c("b")), None: (1, 0)}


def test_a_spike_is_measured_by_its_own_variation(spark):
    for times in (1, 30):  # the same shape at two sizes of the table
        flat = spark.range(400 * times).select(F.repeat(F.lit("x"), (F.col("id") % 20 + 100).cast("int")).alias("t"))
        limited = spark.range(90 * times).select(F.repeat(F.lit("x"), F.lit(110)).alias("t"))
        assert truncation.field_limits(flat.unionByName(limited), "t") == [110]


def test_sampled_endings_bear_a_limit_out():
    texts, p = ["a" * 253] * 5 + ["b" * 300] * 4 + ["c" * 15] * 9 + ["d" * 77] * 2, np.array([0.9] * 5 + [0.8, 0.9, 0.2, 0.7] + [0.1] * 9 + [0.9] * 2)
    assert truncation.borne_out([15, 77, 253, 300], texts, p) == ([253, 300], [15])


def test_the_model_is_fitted_on_every_text(spark):
    """More texts than the model once was fitted on, and one of its own kind."""
    n = 9_000
    texts = spark.range(n).select(F.concat(F.lit("Line of the text "), F.col("id").cast("string"), F.lit(" ends here.\nLast line.")).alias("t"))
    odd = spark.range(1).select(F.lit("Zweite Zeile Nr. 5 endet so!\nLast line.").alias("t"))
    got = truncation.line_examples(texts.unionByName(odd), "t").groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    assert {r.y: r.n for r in got} == {0.0: n + 1, 1.0: n + 1}
    assert {r.y: r.rows for r in got}[0.0] == 5  # numbers of one to four digits, and the odd one
    kept = truncation.text_examples(texts.unionByName(odd), "t", lambda ends: np.zeros(len(ends)), [])
    assert {r.y: r.n for r in kept.groupBy("y").agg(F.sum("n").alias("n")).collect()} == {0.0: 2 * (n + 1), 1.0: 2 * (n + 1)}


def test_limits_are_borne_out_by_all_texts_of_a_length(spark):
    texts = spark.range(9_000).select(F.when(F.col("id") < 4, F.concat(F.lit("a\n"), F.repeat(F.lit("c"), 251))).when(F.col("id") < 9, F.lit("b" * 300)).otherwise(F.lit("a\nwhole")).alias("t"))
    cut = truncation.hashed(truncation.ending_features("c" * 251))
    ends = truncation.ends_at(texts, "t", {253, 300}, lambda ends: np.array([0.9 if e == cut else 0.1 for e in ends]))
    assert ends == {253: (4, 4), 300: (5, 0)} and truncation.by_share(ends) == ([253], [300])


def test_every_partition_moves_the_weights(spark):
    from tallyforge.llm.hashed import EXAMPLES, fit_everywhere

    at = lambda *buckets: bytearray(np.array(buckets, np.int32).tobytes())
    rows = [(at(k % 7, 20 + k % 2), float(k % 2), 1 + k % 3, k) for k in range(900)] + [(at(40), 1.0, 9, 1000), (at(41), 0.0, 9, 1001)]
    w = fit_everywhere(spark.createDataFrame(rows, EXAMPLES).repartition(5), 6)
    assert w[21] > 0.5 and w[20] < -0.5 and w[40] > 0 and w[41] < 0 and w[50] == 0
    assert not fit_everywhere(spark.createDataFrame([], EXAMPLES), 6).any()
    assert (fit_everywhere(spark.createDataFrame([], EXAMPLES), 6, w) == w).all()
    small = fit_everywhere(spark.createDataFrame(rows, EXAMPLES).coalesce(1), 6, most=64)  # many stretches
    assert small[21] > 0.5 and small[20] < -0.5 and small[40] > 0
