"""The statistical operators, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.cohort import OBS, SURVIVAL, observations, survival, table, with_ctes, with_recursive_ctes
from catalog.registry import query
from catalog.sqlkit import (bh, box, chisq, chisq_raw, concordance_cte, cox, cox_ctes, cox_summary, feistel_ctes, km, kruskal, line_band, line_band_ctes, log_rank,
                            median_survival, order_ways,
                            r6, random_effects, rank_sum, rp, reml, reml_ctes, residual_summary, risk_table, signed_rank, spearman, spearman_exact, subset_ways, tidy, welch)
from cohortry.operators import adjust, contingency, mixed, moments, permute, ranks, selection
from cohortry.operators import survival as surv
from cohortry.operators.running import Run, clean, cut_ranges, running, settle

BASE = with_ctes(OBS)


def cells(spark, d, event="event"):
    """Distinct patients per (event, locus, allele) with and without the event."""
    obs = observations(spark, d, event, "locus", "allele", "patient")
    hits = obs.groupBy(event, "locus", "allele").agg(F.count_distinct("patient").alias("hit"))
    whole = obs.groupBy("allele").agg(F.count_distinct("patient").alias("total"))
    return hits.join(whole, "allele").withColumn("miss", F.col("total") - F.col("hit"))


def cells_sql(event="event"):
    return (f"cells AS (SELECT {event}, locus, allele, hit, total - hit AS miss FROM (SELECT {event}, locus, allele, "
            f"count(DISTINCT patient) AS hit FROM obs GROUP BY ALL) JOIN (SELECT allele, count(DISTINCT patient) AS total "
            f"FROM obs GROUP BY ALL) USING (allele))")


@query("t1_chi_square", with_ctes(OBS, cells_sql("gene")) + chisq("cells", ["gene", "locus"], "hit", "miss"))
def _(spark, d):
    return contingency.chisq_by(cells(spark, d, "gene"), ["gene", "locus"], "hit", "miss")


@query("t1_chi_square_sparse", with_ctes(OBS, cells_sql()) + chisq("cells", ["event", "locus"], "hit", "miss"))
def _(spark, d):
    return contingency.chisq_by(cells(spark, d), ["event", "locus"], "hit", "miss")


@query("t1_chi_square_languages", """WITH pairs AS (SELECT lang, count_if(quality = 1) AS good, count_if(quality = 0) AS bad
FROM documents JOIN labels USING (doc_id) GROUP BY 1)
""" + chisq("pairs", [], "good", "bad"))
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"),
                                      F.count_if(F.col("quality") == 0).alias("bad"))
    return contingency.chisq_by(counts, [], "good", "bad")


TESTED = bh(chisq_raw("cells", ["event", "locus"], "hit", "miss"))


@query("t2_false_discovery", with_ctes(OBS, cells_sql()) +
       tidy(TESTED, ["event", "locus", "n_rows", "dof"], ["statistic", "p_value", "p_adj"]))
def _(spark, d):
    return adjust.p_adjust_bh(contingency.chisq_by(cells(spark, d), ["event", "locus"], "hit", "miss"))


@query("t3_significant_rows", with_ctes(OBS, cells_sql()) +
       f"""SELECT event, locus, count(*) AS n, {rp('max(p_adj)')} AS p_adj FROM obs JOIN
(SELECT event, locus, p_adj FROM ({bh(chisq_raw("cells", ["event", "locus"], "hit", "miss"))}) WHERE p_adj < 0.05)
USING (event, locus) GROUP BY ALL""")
def _(spark, d):
    tests = adjust.p_adjust_bh(contingency.chisq_by(cells(spark, d), ["event", "locus"], "hit", "miss"))
    hits = adjust.significant_rows(observations(spark, d, "event", "locus"), tests)
    return hits.groupBy("event", "locus").agg(F.count("*").alias("n"), F.max("p_adj").alias("p_adj"))


@query("t4_spearman", BASE + spearman("obs", ["mut_type"], "level", "ba"))
def _(spark, d):
    return ranks.spearman_by(observations(spark, d, "mut_type", "level", "ba"), ["mut_type"], "level", "ba")


@query("t5_rank_sum", BASE + rank_sum("obs", ["mut_type"], "immune", "ba", ("'cold'", "'hot'")))
def _(spark, d):
    return ranks.rank_sum_by(observations(spark, d, "mut_type", "immune", "ba"), ["mut_type"], "immune", "ba",
                             ("cold", "hot"))


@query("t5_rank_sum_one_panel", BASE + rank_sum("obs", [], "sample_type", "level", ("'normal'", "'tumour'")))
def _(spark, d):
    return ranks.rank_sum_by(observations(spark, d, "sample_type", "level"), [], "sample_type", "level",
                             ("normal", "tumour"))


@query("t6_kruskal", BASE + kruskal("obs", ["sample_type"], "histology", "ba"))
def _(spark, d):
    return ranks.kruskal_by(observations(spark, d, "sample_type", "histology", "ba"), ["sample_type"], "histology", "ba")


PAIRED = """paired AS (SELECT patient, mut_type, sample_type, avg(level) AS level FROM obs GROUP BY ALL)"""


@query("t7_signed_rank", with_ctes(OBS, PAIRED) +
       signed_rank("paired", ["mut_type"], "patient", "sample_type", "level", ("'tumour'", "'normal'")))
def _(spark, d):
    means = observations(spark, d, "patient", "mut_type", "sample_type", "level").groupBy(
        "patient", "mut_type", "sample_type").agg(F.avg("level").alias("level"))
    return ranks.signed_rank_by(means, ["mut_type"], "patient", "sample_type", "level", ("tumour", "normal"))


SAMPLE_MEANS = "sample_means AS (SELECT patient, sample, immune, avg(ba) AS ba, avg(level) AS level FROM obs GROUP BY ALL)"
GENE_MEANS = "gene_means AS (SELECT patient, gene, immune, avg(ba) AS ba FROM obs GROUP BY ALL)"


def sample_means(spark, d):
    return observations(spark, d, "patient", "sample", "immune", "ba", "level").groupBy("patient", "sample", "immune").agg(
        F.avg("ba").alias("ba"), F.avg("level").alias("level"))


@query("t4_spearman_exact", with_recursive_ctes(OBS, SAMPLE_MEANS, order_ways(9)) + spearman_exact("sample_means", ["patient"], "level", "ba"))
def _(spark, d):
    """Level against affinity over the samples of each patient, a dozen or so."""
    return ranks.spearman_by(sample_means(spark, d), ["patient"], "level", "ba", exact=True)


@query("t5_rank_sum_exact", with_recursive_ctes(OBS, SAMPLE_MEANS, subset_ways(40)) +
       rank_sum("sample_means", ["patient"], "immune", "ba", ("'cold'", "'hot'"), exact=True))
def _(spark, d):
    """Cold against hot samples of each patient."""
    return ranks.rank_sum_by(sample_means(spark, d), ["patient"], "immune", "ba", ("cold", "hot"), exact=True)


@query("t7_signed_rank_exact", with_recursive_ctes(OBS, GENE_MEANS, subset_ways(25)) +
       signed_rank("gene_means", ["patient"], "gene", "immune", "ba", ("'cold'", "'hot'"), exact=True))
def _(spark, d):
    """Cold against hot means of the genes of each patient."""
    means = observations(spark, d, "patient", "gene", "immune", "ba").groupBy("patient", "gene", "immune").agg(F.avg("ba").alias("ba"))
    return ranks.signed_rank_by(means, ["patient"], "gene", "immune", "ba", ("cold", "hot"), exact=True)


@query("t8_welch_t", BASE + welch("obs", ["locus"], "immune", "ba", ("'cold'", "'hot'")))
def _(spark, d):
    return moments.welch_t_by(observations(spark, d, "locus", "immune", "ba"), ["locus"], "immune", "ba", ("cold", "hot"))


@query("t9_star_label", BASE + "SELECT mut_type, CASE WHEN p_value <= 0.0001 THEN '****' WHEN p_value <= 0.001 THEN '***' "
       "WHEN p_value <= 0.01 THEN '**' WHEN p_value <= 0.05 THEN '*' WHEN p_value IS NOT NULL THEN 'ns' END AS stars FROM ("
       + rank_sum("obs", ["mut_type"], "immune", "ba", ("'cold'", "'hot'")) + ")")
def _(spark, d):
    tested = ranks.rank_sum_by(observations(spark, d, "mut_type", "immune", "ba"), ["mut_type"], "immune", "ba",
                               ("cold", "hot"))
    return tested.select("mut_type", adjust.stars("p_value").alias("stars"))


@query("t10_straight_line", BASE + "SELECT mut_type, CAST(n AS BIGINT) AS n, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ("slope", "intercept", "r2")) + """ FROM (SELECT mut_type, regr_count(ba, level) AS n,
regr_slope(ba, level) AS slope, regr_intercept(ba, level) AS intercept, regr_r2(ba, level) AS r2 FROM obs GROUP BY 1)""")
def _(spark, d):
    return moments.ols_by(observations(spark, d, "mut_type", "level", "ba"), ["mut_type"], "level", "ba")


@query("t10_line_band", with_recursive_ctes(OBS, *line_band_ctes("obs", ["mut_type"], "level", "ba")) + line_band(["mut_type"]))
def _(spark, d):
    return moments.line_band(observations(spark, d, "mut_type", "level", "ba"), ["mut_type"], "level", "ba")


def burden_by_class(spark, d):
    obs = observations(spark, d, "immune", "tumour", "sample", "event").filter("immune is not null and tumour is not null")
    return obs.groupBy("immune", "tumour", "sample").agg(F.count_distinct("event").alias("burden")).withColumn(
        "is_hot", (F.col("immune") == "hot").cast("double"))


def four_decimals(fit):
    """The search stops at a finite precision; compare well above it."""
    digits = {"dof": 0, "t": 2}
    return fit.drop("converged").withColumns({c: F.round(F.col(c) + F.lit(0.0 if c in ("dof", "p_value") else 1e-10), digits.get(c, 4))
                            for c in ("estimate", "std_err", "dof", "t", "sigma", "group_sd", "p_value")})


CLASS_BURDEN = """class_burden AS (SELECT tumour, count(DISTINCT event) AS burden, CASE WHEN immune = 'hot' THEN 1 ELSE 0 END AS is_hot
FROM obs WHERE immune IS NOT NULL AND tumour IS NOT NULL GROUP BY immune, tumour, sample)"""


@query("t11_random_intercept", with_ctes(OBS, CLASS_BURDEN, *reml_ctes("class_burden", "burden", "is_hot", "tumour")) + reml("is_hot"))
def _(spark, d):
    return four_decimals(mixed.random_intercept(burden_by_class(spark, d), "burden", "is_hot", "tumour"))


def digits(df, n, *columns):
    """Both sides find the variance ratio to some eight digits; compare well above that."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(0.0 if c == "reml_criterion" else 1e-9), n) for c in columns})


@query("t11_random_effects", with_ctes(OBS, CLASS_BURDEN, *reml_ctes("class_burden", "burden", "is_hot", "tumour")) + random_effects("tumour"))
def _(spark, d):
    return digits(mixed.random_effects(burden_by_class(spark, d), "burden", "is_hot", "tumour"), 3, "effect")


@query("t11_residuals", with_ctes(OBS, CLASS_BURDEN, *reml_ctes("class_burden", "burden", "is_hot", "tumour")) + residual_summary())
def _(spark, d):
    row = digits(mixed.residual_summary(burden_by_class(spark, d), "burden", "is_hot", "tumour"), 4, "reml_criterion", "fixed_correlation")
    return digits(row, 3, "lowest", "q1", "median", "q3", "highest")


COVARIATES = ["burden", "mean_level"]
COX_TABLE = """burdens AS (SELECT * FROM (SELECT patient, count(DISTINCT event) AS burden, avg(level) * 100 AS mean_level FROM obs GROUP BY 1)
JOIN survival USING (patient))"""


@query("t12_cox", with_ctes(OBS, SURVIVAL, COX_TABLE, *cox_ctes("burdens", "os_time", "cens_os", COVARIATES)) + cox())
def _(spark, d):
    burden = observations(spark, d, "patient", "event", "level").groupBy("patient").agg(
        F.count_distinct("event").alias("burden"), (F.avg("level") * 100).alias("mean_level"))
    return surv.cox_ph(burden.join(survival(spark, d), "patient"), "os_time", "cens_os", COVARIATES)


@query("t12_cox_summary", with_ctes(OBS, SURVIVAL, COX_TABLE, *cox_ctes("burdens", "os_time", "cens_os", COVARIATES), concordance_cte("burdens", "os_time", "cens_os", COVARIATES)) + cox_summary())
def _(spark, d):
    burden = observations(spark, d, "patient", "event", "level").groupBy("patient").agg(
        F.count_distinct("event").alias("burden"), (F.avg("level") * 100).alias("mean_level"))
    return surv.cox_summary(burden.join(survival(spark, d), "patient"), "os_time", "cens_os", COVARIATES)


SURV = with_ctes(SURVIVAL)


@query("t13_kaplan_meier", SURV + km("survival", ["stage"], "dfs_time", "cens_dfs"))
def _(spark, d):
    return surv.kaplan_meier(survival(spark, d), "dfs_time", "cens_dfs", ["stage"])


RISK_DAYS = [0, 365, 730, 1095, 1460, 1825, 2190, 4000]


@query("t13_risk_table", SURV + risk_table("survival", ["stage"], "dfs_time", "cens_dfs", RISK_DAYS))
def _(spark, d):
    return surv.risk_table(survival(spark, d), "dfs_time", "cens_dfs", RISK_DAYS, ["stage"])


@query("t13_median", SURV + median_survival("survival", ["stage", "sex"], "os_time", "cens_os"))
def _(spark, d):
    return surv.median_survival(survival(spark, d), "os_time", "cens_os", ["stage", "sex"])


@query("t14_log_rank", SURV + log_rank("survival", [], "os_time", "cens_os", "sex", ("'Female'", "'Male'"), ("Female", "Male")))
def _(spark, d):
    return surv.log_rank(survival(spark, d), "os_time", "cens_os", "sex", levels=["Female", "Male"])


@query("t15_log_rank_per_stage",
       SURV + log_rank("survival", ["stage"], "dfs_time", "cens_dfs", "sex", ("'Female'", "'Male'"), ("Female", "Male")))
def _(spark, d):
    return surv.log_rank(survival(spark, d), "dfs_time", "cens_dfs", "sex", by=["stage"], levels=["Female", "Male"])


@query("t15_curve_per_stage_and_sex", SURV + km("survival", ["stage", "sex"], "os_time", "cens_os"))
def _(spark, d):
    return surv.kaplan_meier(survival(spark, d), "os_time", "cens_os", ["stage", "sex"])


@query("t16_median_split", BASE + """SELECT sample, n > (SELECT median(n) FROM (SELECT count(DISTINCT event) AS n FROM obs
GROUP BY sample)) AS above_median, n FROM (SELECT sample, count(DISTINCT event) AS n FROM obs GROUP BY 1)""")
def _(spark, d):
    burden = observations(spark, d, "sample", "event").groupBy("sample").agg(F.count_distinct("event").alias("n"))
    return moments.median_split(burden, "n")


def shuffle_rows(spark, d, label="allele", key="gene"):
    """Distinct tumour rows with a unique name each."""
    rows = observations(spark, d, "event", key, "sample", "tumour", "locus", "allele").filter(
        "tumour is not null").distinct()
    return rows.withColumn("row_id", F.concat_ws("|", "event", "sample", "allele"))


SHUFFLE = ["""base AS (SELECT *, concat_ws('|', event, sample, allele) AS id FROM (
  SELECT DISTINCT event, gene, sample, tumour, locus, allele FROM obs WHERE tumour IS NOT NULL))""",
           *feistel_ctes("base", "allele", 123, 100, "gene, tumour")]


RANKED = f"""{SHUFFLE[0]},
labels AS (SELECT allele, row_number() OVER (ORDER BY md5(concat_ws('|', 123, 0, id)), id) AS place FROM base),
shuffled AS (SELECT rep, gene, tumour, place FROM (SELECT rep, gene, tumour, row_number() OVER (PARTITION BY rep
  ORDER BY md5(concat_ws('|', 123, rep, id)), id) AS place FROM base, range(1, 101) t(rep)))"""


@query("t17_permute_label", with_ctes(OBS, RANKED) + """SELECT rep, gene, labels.allele, count(*) AS n
FROM shuffled JOIN labels USING (place) GROUP BY ALL""")
def _(spark, d):
    out = permute.permute_label(shuffle_rows(spark, d), "row_id", "allele", 100, carry=["gene"], ranked=True)
    return out.groupBy(F.col("rep").cast("long").alias("rep"), "gene", "allele").agg(F.count("*").alias("n"))


@query("t18_permutation_null", with_recursive_ctes(OBS, *SHUFFLE) + f"""SELECT gene, allele, {r6('median(n)')}
AS null_median FROM (SELECT rep, gene, allele, count(DISTINCT tumour) AS n FROM shuffled GROUP BY ALL) GROUP BY ALL""")
def _(spark, d):
    return permute.permutation_null(shuffle_rows(spark, d), "row_id", "allele", ["gene"], "tumour", reps=100)


@query("t19_box_statistics", BASE + box("obs", ["locus", "sample_type"], "ba"))
def _(spark, d):
    return moments.box_stats_by(observations(spark, d, "locus", "sample_type", "ba"), ["locus", "sample_type"], "ba")


@query("t19_box_selected", BASE + box("obs", ["locus", "sample_type"], "ba"))
def _(spark, d):
    return selection.selected_boxes(observations(spark, d, "locus", "sample_type", "ba"), ["locus", "sample_type"], "ba")


@query("t20_slice_positions", BASE + f"""SELECT gene, n, CAST(total AS BIGINT) AS total, {r6('share')} AS share, {r6('stacked')} AS stacked,
{r6('share * 50 + coalesce(lead(stacked) OVER (ORDER BY share, gene), 0)')} AS position,
printf('%.1f%%', round(share * 100 + 1e-9, 1)) AS label FROM (SELECT *, sum(share * 100) OVER (ORDER BY share DESC, gene DESC) AS stacked
FROM (SELECT gene, count(DISTINCT event) AS n, sum(count(DISTINCT event)) OVER () AS total,
n / CAST(total AS DOUBLE) AS share FROM obs GROUP BY 1))""")
def _(spark, d):
    sizes = observations(spark, d, "gene", "event").groupBy("gene").agg(F.count_distinct("event").alias("n"))
    return moments.slice_positions(sizes, "gene", "n")


@query("w7_midrank", BASE + f"""SELECT mut_type, ba, count(*) AS n, {r6('avg(mid)')} AS midrank,
max(size) AS n_panel FROM (SELECT mut_type, ba, count(*) OVER (PARTITION BY mut_type) AS size,
rank() OVER (PARTITION BY mut_type ORDER BY ba) + (count(*) OVER (PARTITION BY mut_type, ba) - 1) / 2.0 AS mid
FROM lines WHERE ba IS NOT NULL) GROUP BY ALL""".replace("SELECT mut_type, ba,", f"SELECT mut_type, {r6('ba')} AS ba,", 1)
       .replace("GROUP BY ALL", "GROUP BY mut_type, ba"))
def _(spark, d):
    rows = observations(spark, d, "mut_type", "ba").filter("ba is not null")
    return ranks.midranks(rows.groupBy("mut_type", "ba").agg(F.count("*").alias("n")), ["mut_type"], "ba")


@query("w8_at_risk", SURV + """SELECT sex, os_time AS time, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY sex
ORDER BY os_time DESC) AS BIGINT) AS n_risk FROM survival GROUP BY sex, os_time""")
def _(spark, d):
    counts = survival(spark, d).groupBy("sex", F.col("os_time").alias("time")).agg(F.count("*").alias("n"))
    counts, buckets = settle(counts, ["sex"])
    cut = cut_ranges(counts, ["sex"], "time", buckets, used=["n"])
    return clean(running(cut, "time", [Run("n_risk", "n", reverse=True)]))
