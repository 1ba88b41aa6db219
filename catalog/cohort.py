"""The given tables in the roles of a cohort, as DataFrames and as SQL.

``observations`` joins only the tables that the asked columns need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.nullrules import paste0

CLASS_ONE = ["A", "B", "C"]
GENES = [f"Brand#{i}" for i in range(1, 26)]
CELL_TYPES = ["click", "error", "purchase", "signup", "view"]
LOCI = {0: "A", 1: "B", 2: "C", 3: "DRB1", 4: "DQB1"}
ALLELES = [f"HLA-{LOCI[i % 5]}*{i:02d}:01" for i in range(25)]

FROM_ORDERS = ["patient", "tumour", "sample_code", "sample_type", "status", "immune", "purity"]
FROM_SUPPLIER = ["locus", "allele", "combine"]
FROM_LINES = ["event", "sample", "mut_type", "effect", "level", "coverage", "var_count",
              "in_normal", "el", "el_wt", "ba"]
ALL = [*FROM_LINES, *FROM_ORDERS, *FROM_SUPPLIER, "gene", "histology"]


# Declared, so that opening a table costs no inference job.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(c, mapping: dict, otherwise=None):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if otherwise is None else out.otherwise(otherwise)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    scored = F.col("l_linenumber") < 7
    return li.select(
        F.col("l_partkey").alias("event"), F.col("l_orderkey").alias("sample"), "l_suppkey",
        pick(F.col("l_returnflag"), {"A": "A>G", "N": "C>T"}, "T>C").alias("mut_type"),
        F.when(F.col("l_linestatus") == "O", "nonsynonymous").otherwise("synonymous").alias("effect"),
        F.col("l_discount").alias("level"), (F.col("l_quantity") * 2).cast("long").alias("coverage"),
        F.col("l_linenumber").cast("long").alias("var_count"),
        (F.col("l_linenumber") == 1).alias("in_normal"),
        F.when(scored, F.col("l_tax") * 2).alias("el"),
        F.when(scored, F.col("l_discount") * 2).alias("el_wt"),
        F.when(scored, F.col("l_extendedprice") / 1000).alias("ba"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, state, rank = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    code = (F.when(state == "P", "SU_N1")
            .when(state == "F", F.when(key % 2 == 0, "SU_T1-R1").otherwise("SU_LN1"))
            .otherwise(pick(key % 3, {0: "BR1", 1: "BP1"}, "MR1")))
    return o.select(
        key.alias("sample"), F.col("o_custkey").alias("patient"),
        F.when(state != "P", F.concat(F.col("o_custkey").cast("string"), F.lit("_"),
                                      F.year("o_orderdate").cast("string"))).alias("tumour"),
        code.alias("sample_code"),
        F.when(state == "P", "normal").otherwise("tumour").alias("sample_type"),
        F.when(state == "P", None).when(state == "F", "Primary").otherwise("Meta_recur").alias("status"),
        F.when(rank.isin("1", "2"), "hot").when(rank.isin("3", "5"), "cold").alias("immune"),
        F.when(rank != "4", F.col("o_totalprice") / 600000).alias("purity"))


def _typed(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` of suppliers with their ``locus`` and ``allele``."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    locus = pick(F.col("r_regionkey"), LOCI)
    return rows.join(n, rows.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumns(
        {"locus": locus, "allele": F.concat(
            F.lit("HLA-"), locus, F.lit("*"),
            F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(":01"))})


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(table(spark, sf_dir, "supplier"), spark, sf_dir).select("s_suppkey", "locus", "allele")


def observations(spark: SparkSession, sf_dir: str, *columns: str, **flags: str) -> DataFrame:
    """The lazy observation table, with only the joins that the columns need.

    ``flags`` are conditions on columns of the lines, told before the joins so that those columns need not move.
    """
    return _observations(spark, sf_dir, list(columns or ALL), flags)


def _observations(spark: SparkSession, sf_dir: str, columns: list[str], flags: dict[str, str]) -> DataFrame:
    unknown = set(columns) - set(ALL)
    if unknown:
        raise ValueError(f"no such role: {sorted(unknown)}")
    out = lines(spark, sf_dir).withColumns({name: F.expr(test) for name, test in flags.items()})
    wants_customer = "histology" in columns
    if wants_customer or set(columns) & set(FROM_ORDERS):
        out = out.join(samples(spark, sf_dir), "sample")
    if set(columns) & set(FROM_SUPPLIER):
        # One table after the other: the size of a join of small tables is overestimated, and then the lines move for it.
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        out = _typed(out.join(s, out.l_suppkey == s.s_suppkey), spark, sf_dir).withColumn(
            "combine", F.concat(F.col("event").cast("string"), F.lit("_"), F.col("allele")))
    if "gene" in columns:
        p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene"))
        out = out.join(p, out.event == p.p_partkey)
    if wants_customer:
        c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("histology"))
        out = out.join(c, out.patient == c.c_custkey)
    return out.select(*columns, *flags)


OBS = """
lines AS (
  SELECT l_partkey AS event, l_orderkey AS sample, l_suppkey,
    CASE l_returnflag WHEN 'A' THEN 'A>G' WHEN 'N' THEN 'C>T' ELSE 'T>C' END AS mut_type,
    CASE WHEN l_linestatus = 'O' THEN 'nonsynonymous' ELSE 'synonymous' END AS effect,
    l_discount AS level, CAST(l_quantity * 2 AS BIGINT) AS coverage,
    CAST(l_linenumber AS BIGINT) AS var_count, l_linenumber = 1 AS in_normal,
    CASE WHEN l_linenumber < 7 THEN l_tax * 2 END AS el,
    CASE WHEN l_linenumber < 7 THEN l_discount * 2 END AS el_wt,
    CASE WHEN l_linenumber < 7 THEN l_extendedprice / 1000 END AS ba
  FROM lineitem),
samples AS (
  SELECT o_orderkey AS sample, o_custkey AS patient,
    CASE WHEN o_orderstatus <> 'P'
      THEN CAST(o_custkey AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) END AS tumour,
    CASE WHEN o_orderstatus = 'P' THEN 'SU_N1'
      WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'SU_T1-R1' ELSE 'SU_LN1' END
      WHEN o_orderkey % 3 = 0 THEN 'BR1' WHEN o_orderkey % 3 = 1 THEN 'BP1' ELSE 'MR1' END AS sample_code,
    CASE WHEN o_orderstatus = 'P' THEN 'normal' ELSE 'tumour' END AS sample_type,
    CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'Primary' ELSE 'Meta_recur' END AS status,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'hot'
      WHEN o_orderpriority[1] IN ('3', '5') THEN 'cold' END AS immune,
    CASE WHEN o_orderpriority[1] <> '4' THEN o_totalprice / 600000 END AS purity
  FROM orders),
alleles AS (
  SELECT s_suppkey, locus, 'HLA-' || locus || '*' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ':01' AS allele
  FROM (SELECT s_suppkey, n_nationkey, CASE r_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C'
          WHEN 3 THEN 'DRB1' WHEN 4 THEN 'DQB1' END AS locus
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
obs AS (
  SELECT lines.* EXCLUDE (l_suppkey), samples.* EXCLUDE (sample), locus, allele,
    CAST(event AS VARCHAR) || '_' || allele AS combine, p_brand AS gene, c_mktsegment AS histology
  FROM lines JOIN samples USING (sample) JOIN alleles ON l_suppkey = s_suppkey
    JOIN part ON event = p_partkey JOIN customer ON patient = c_custkey)"""


# Per-patient expression of 25 genes, one row per patient and gene.
def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    gene = F.concat(F.lit("Brand#"), (F.col("event_id") % 25 + 1).cast("string"))
    return (table(spark, sf_dir, "events").select(F.col("user_id").alias("patient"),
                                                   gene.alias("gene"), "value")
            .groupBy("patient", "gene").agg(F.avg("value").alias("expression")))


EXPRESSION = """
expression AS (
  SELECT user_id AS patient, 'Brand#' || CAST(event_id % 25 + 1 AS VARCHAR) AS gene, avg(value) AS expression
  FROM events GROUP BY ALL)"""


def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("patient"), F.col("event_type").alias("cell_type"))
        .agg(F.avg("value").alias("score")))


CELLS = """
cells AS (SELECT user_id AS patient, event_type AS cell_type, avg(value) AS score FROM events GROUP BY ALL)"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient: days from first to last order, and how it ended."""
    o = table(spark, sf_dir, "orders")
    span = o.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
        F.max(F.struct("o_orderdate", F.col("o_orderstatus") == "F")).alias("end"),
        F.max(F.struct("o_orderdate", F.col("o_orderstatus") == "O")).alias("end_os"))
    c = table(spark, sf_dir, "customer")
    days = F.datediff("last", "first").cast("double")
    return span.join(c, span.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("patient"), days.alias("dfs_time"),
        F.col("end.col2").cast("int").alias("cens_dfs"),
        (days + F.col("c_nationkey")).alias("os_time"),
        F.col("end_os.col2").cast("int").alias("cens_os"),
        F.col("c_mktsegment").alias("stage"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("sex"))


SURVIVAL = """
survival AS (
  SELECT o_custkey AS patient, CAST(date_diff('day', first, last) AS DOUBLE) AS dfs_time, cens_dfs,
    CAST(date_diff('day', first, last) + c_nationkey AS DOUBLE) AS os_time, cens_os,
    c_mktsegment AS stage, CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex
  FROM (SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1)
  JOIN (SELECT o.o_custkey AS k, CAST(bool_or(o_orderstatus = 'F') AS INT) AS cens_dfs,
          CAST(bool_or(o_orderstatus = 'O') AS INT) AS cens_os
        FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) m
          ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.last GROUP BY 1) ON k = o_custkey
  JOIN customer ON c_custkey = o_custkey)"""


# Allele loss: one row per sample and locus, allele names in lower-case file form.
def loh(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir, "sample", "patient", "tumour", "locus", "allele", "coverage")
    raw = F.lower(F.regexp_replace(F.col("allele"), "[-*:]", "_"))
    return (obs.filter("tumour is not null").withColumn("raw", raw)
            .groupBy("sample", "patient", "tumour", "locus").agg(
                F.min("raw").alias("allele1"), F.max("raw").alias("allele2"),
                (F.min("coverage") / 50).alias("cn1"), (F.max("coverage") / 100).alias("cn2"),
                (F.min("coverage") < 30).alias("loh"), (F.max("coverage") > 20).alias("passed")))


LOH = """
loh_raw AS (
  SELECT sample, patient, tumour, locus, min(raw) AS allele1, max(raw) AS allele2,
    min(coverage) / 50.0::DOUBLE AS cn1, max(coverage) / 100.0::DOUBLE AS cn2,
    min(coverage) < 30 AS loh, max(coverage) > 20 AS passed
  FROM (SELECT *, lower(regexp_replace(allele, '[-*:]', '_', 'g')) AS raw FROM obs WHERE tumour IS NOT NULL)
  GROUP BY ALL)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def with_recursive_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"
