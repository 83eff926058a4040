"""Queries over the driver's tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.labelers import labeler, metrics, models, processors
from plumbline.operators import categorical, compare, dates, graph, labels, matrices, numeric, order, rows, text, validate
from plumbline.plans import graphs, profile
from plumbline.plans import text as text_profile
from plumbline.plans.options import Options, Structured
from plumbline.sources import avro, files
from plumbline.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(table: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers a function of one table under its own name."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(_t(spark, sf_dir, table))
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(columns: list[str], body: str, table: str) -> str:
    """One SELECT for each column, where body speaks of x and of the name as {c}."""
    return " UNION ALL ".join(body.format(c=c, t=f"(SELECT {c} AS x FROM {table})") for c in columns)


MOMENT_PLACES = {"sum": 2, "mean": 6, "variance": 2, "stddev": 4, "skewness": 6, "kurtosis": 6}
_MOMENTS = (
    "SELECT '{c}' AS column_name, count(*) AS n_rows, count(x) AS n_values, count(*) - count(x) AS null_count, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, round(sum(x)::DOUBLE, 2) AS sum, round(avg(x), 6) AS mean, "
    "round(var_samp(x), 2) AS variance, round(stddev_samp(x), 4) AS stddev, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis, count(*) FILTER (x = 0) AS num_zeros, count(*) FILTER (x < 0) AS num_negatives FROM {t}"
)


@_query("lineitem", _each(LINE, _MOMENTS, "lineitem"))
def numeric_moments(df: DataFrame) -> DataFrame:
    return _round(numeric.moments(df, LINE), **MOMENT_PLACES)


@_query("customer", _each(["c_acctbal"], _MOMENTS, "customer"))
def zeros_negatives(df: DataFrame) -> DataFrame:
    return _round(numeric.moments(df, ["c_acctbal"]), **MOMENT_PLACES)


SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]


@_query("orders", "WITH s AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS share) SELECT 'o_totalprice' AS column_name, share::DOUBLE AS share, round(CASE share WHEN 0.01 THEN quantile_cont(o_totalprice, 0.01) WHEN 0.25 THEN quantile_cont(o_totalprice, 0.25) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) WHEN 0.75 THEN quantile_cont(o_totalprice, 0.75) ELSE quantile_cont(o_totalprice, 0.99) END, 4) AS value FROM orders, s GROUP BY share")
def quantiles_exact(df: DataFrame) -> DataFrame:
    return _round(numeric.quantiles(df, ["o_totalprice"], SHARES), value=4)


@_query("orders")
def quantiles_sketched(df: DataFrame) -> DataFrame:
    return numeric.quantiles_sketched(df, ["o_totalprice"], SHARES)


@_query("lineitem", _each(["l_extendedprice", "l_quantity"], "SELECT '{c}' AS column_name, round(median(x), 4) AS median, round(mad(x), 4) AS mad FROM {t}", "lineitem"))
def median_deviation(df: DataFrame) -> DataFrame:
    return _round(numeric.median_deviation(df, ["l_extendedprice", "l_quantity"]), median=4, mad=4)


_HIST = "(SELECT x, lo, hi, least(floor((x - lo) / (hi - lo) * {n}), {n} - 1)::INT AS bin FROM (SELECT {c}::DOUBLE AS x, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM {t}))"


@_query("orders", f"SELECT 'o_totalprice' AS column_name, bin, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 100), 4) AS low_edge, round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 100), 4) AS high_edge, count(*) AS n FROM {_HIST.format(n=100, c='o_totalprice', t='orders')} GROUP BY bin")
def histogram_equal_width(df: DataFrame) -> DataFrame:
    return _round(numeric.histogram(df, ["o_totalprice"], 100), low_edge=4, high_edge=4)


@_query("lineitem", f"SELECT 'l_quantity' AS column_name, round(lo + (bin + 0.5) * (hi - lo) / 25, 4) AS mode, n FROM (SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r, row_number() OVER (ORDER BY count(*) DESC, bin) AS i FROM {_HIST.format(n=25, c='l_quantity', t='lineitem')} GROUP BY bin) WHERE r = 1 AND i <= 5")
def mode_bins_topk(df: DataFrame) -> DataFrame:
    return _round(numeric.mode_bins(df, ["l_quantity"], 25), mode=4)


@_query("lineitem", f"SELECT 'l_quantity' AS column_name, round(sum(e), 3) AS bin_error, round(sum(v), 4) AS bin_variance FROM (SELECT bin, sum(pow(x - (lo + (bin + 0.5) * (hi - lo) / 20), 2)) AS e, var_pop(x) AS v FROM {_HIST.format(n=20, c='l_quantity', t='lineitem')} GROUP BY bin)")
def histogram_errors(df: DataFrame) -> DataFrame:
    return _round(numeric.bin_errors(df, ["l_quantity"], 20), bin_error=3, bin_variance=4)


@_query("orders", f"SELECT 'o_totalprice' AS column_name, round(sum(x * n) / sum(n), 4) AS mean, round((sum(x * x * n) / sum(n) - pow(sum(x * n) / sum(n), 2)) / 1e6, 4) AS variance FROM (SELECT any_value(lo) + (bin + 0.5) * (any_value(hi) - any_value(lo)) / 50 AS x, count(*) AS n FROM {_HIST.format(n=50, c='o_totalprice', t='orders')} GROUP BY bin)")
def histogram_estimates(df: DataFrame) -> DataFrame:
    got = numeric.histogram_estimates(df, ["o_totalprice"], 50).withColumn("variance", F.col("variance") / 1e6)
    return _round(got, mean=4, variance=4)


@_query("orders", """WITH s AS (SELECT count(*)::DOUBLE AS n, max(o_totalprice) - min(o_totalprice) AS span, stddev_pop(o_totalprice) AS sd, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr,
 skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS g FROM orders), w AS (SELECT span, unnest([
 {'method': 'sqrt', 'w': span / sqrt(n)}, {'method': 'sturges', 'w': span / (log2(n) + 1)}, {'method': 'rice', 'w': span / (2 * pow(n, 1.0::DOUBLE / 3))}, {'method': 'scott', 'w': pow(24 * sqrt(pi()) / n, 1.0::DOUBLE / 3) * sd}, {'method': 'fd', 'w': 2 * iqr * pow(n, -1.0::DOUBLE / 3)},
 {'method': 'doane', 'w': span / (1 + log2(n) + log2(1 + abs(g) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))))}, {'method': 'auto', 'w': least(2 * iqr * pow(n, -1.0::DOUBLE / 3), span / (log2(n) + 1))}]) AS m FROM s)
 SELECT 'o_totalprice' AS column_name, m.method AS method, ceil(span / m.w)::BIGINT AS bins FROM w""")
def bin_count_estimators(df: DataFrame) -> DataFrame:
    return numeric.bin_counts(df, ["o_totalprice"])


_CATS = [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus")]
_CAT_SQL = _each([c for _, c in _CATS], "SELECT '{c}' AS column_name, x AS value, count(*) AS n FROM {t} GROUP BY x", "lineitem")


@_query("lineitem", _CAT_SQL)
def category_counts(df: DataFrame) -> DataFrame:
    return categorical.counts(df, ["l_returnflag", "l_linestatus"])


@_query("orders", f"SELECT column_name, sum(n)::BIGINT AS sample_size, count(*) AS unique_count, round(count(*) / sum(n), 6) AS unique_ratio, count(*) <= 10 OR count(*) / sum(n) <= 0.2 AS categorical, round(1 - sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)), 6) AS gini_impurity, round((sum(n)::DOUBLE * sum(n) - sum(n::DOUBLE * n)) / (sum(n)::DOUBLE * sum(n) - sum(n)), 6) AS unalikeability FROM ({_each(['o_orderpriority', 'o_orderstatus', 'o_custkey'], 'SELECT {c!r} AS column_name, x::VARCHAR AS value, count(*) AS n FROM {t} GROUP BY x', 'orders')}) GROUP BY column_name")
def category_summary(df: DataFrame) -> DataFrame:
    return _round(categorical.summary(df, ["o_orderpriority", "o_orderstatus", "o_custkey"]), unique_ratio=6, gini_impurity=6, unalikeability=6)


@_query("part", "SELECT * FROM (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand)::INT AS place FROM part GROUP BY p_brand) WHERE place <= 10")
def top_k_categories(df: DataFrame) -> DataFrame:
    return categorical.top(df, ["p_brand"], 10)


@_query("orders", "SELECT o_custkey::VARCHAR AS value, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= (SELECT count(*) FROM orders) / 1000")
def heavy_hitters(df: DataFrame) -> DataFrame:
    return categorical.heavy_hitters(df, "o_custkey", 1000)


@_query("orders", "WITH o AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS pa, o_totalprice AS b, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS pb FROM orders) SELECT 'o_orderkey' AS column_name, CASE WHEN bool_and(a = pa) THEN 'constant value' WHEN bool_and(a >= pa) THEN 'ascending' WHEN bool_and(a <= pa) THEN 'descending' ELSE 'random' END AS data_order FROM o UNION ALL SELECT 'o_totalprice', CASE WHEN bool_and(b = pb) THEN 'constant value' WHEN bool_and(b >= pb) THEN 'ascending' WHEN bool_and(b <= pb) THEN 'descending' ELSE 'random' END FROM o")
def order_detection(df: DataFrame) -> DataFrame:
    return order.detect(df, ["o_orderkey", "o_totalprice"], "o_orderkey")


@_query("events", "WITH e AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events) SELECT 'ts' AS column_name, CASE WHEN bool_and(ts = p) THEN 'constant value' WHEN bool_and(ts >= p) THEN 'ascending' WHEN bool_and(ts <= p) THEN 'descending' ELSE 'random' END AS data_order FROM e")
def order_detection_events(df: DataFrame) -> DataFrame:
    return order.detect(df, ["ts"], "event_id")


@_query("orders", "SELECT 'd' AS column_name, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max, '%Y-%m-%d' AS formats FROM orders")
def datetime_profile(df: DataFrame) -> DataFrame:
    return dates.profile(df.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), ["d"])


@_query("lineitem", "SELECT 'd' AS column_name, count(*) AS n, arg_min(s, d) AS min, arg_max(s, d) AS max, '%m/%d/%Y' AS formats FROM (SELECT strftime(l_shipdate, '%m/%d/%Y') AS s, date_trunc('day', l_shipdate) AS d FROM lineitem)")
def datetime_us_format(df: DataFrame) -> DataFrame:
    return dates.profile(df.select(F.date_format("l_shipdate", "MM/dd/yyyy").alias("d")), ["d"])


@_query("events", "SELECT column_name, count(*) AS n, 0.0::DOUBLE AS datetime, round(avg((d = floor(d))::INT), 6) AS int, round(count(d) / count(*), 6) AS float, 1.0::DOUBLE AS text, CASE WHEN avg((d = floor(d))::INT) = 1 AND count(d) = count(*) THEN 'int' WHEN count(d) = count(*) THEN 'float' WHEN max(length(x)) > 255 THEN 'text' ELSE 'string' END AS data_type FROM (SELECT column_name, x, coalesce(try_cast(x AS DOUBLE), NULL) AS d FROM (" + _each(["event_type", "value", "user_id"], "SELECT '{c}' AS column_name, x::VARCHAR AS x FROM {t} WHERE x IS NOT NULL", "events") + ")) GROUP BY column_name")
def type_ratios(df: DataFrame) -> DataFrame:
    got = numeric.type_ratios(df, ["event_type", "value", "user_id"])
    return _round(got.withColumn("int", F.when(F.col("float") > 0, F.col("int"))), int=6, float=6)


@_query("events", _each(["user_id", "value", "event_type", "props"], "SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (x IS NULL OR regexp_full_match(x::VARCHAR, '(?i)(|nan|none|null| +|-+|_+)'))::BIGINT AS null_count, round(avg((x IS NULL OR regexp_full_match(x::VARCHAR, '(?i)(|nan|none|null| +|-+|_+)'))::INT), 6) AS null_ratio FROM {t}", "events"))
def null_stats(df: DataFrame) -> DataFrame:
    return _round(rows.null_counts(df, ["user_id", "value", "event_type", "props"]), null_ratio=6)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _t(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "n_chars", "lang", "quality", "toxic")


_LABELLED = "(SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
_queries["row_null_ratios"] = lambda spark, sf_dir: _round(rows.row_nulls(_labelled(spark, sf_dir)), row_has_null_ratio=6, row_is_null_ratio=6)
_sql["row_null_ratios"] = f"SELECT count(*) AS n_rows, round(avg((quality IS NULL OR toxic IS NULL)::INT), 6) AS row_has_null_ratio, 0.0::DOUBLE AS row_is_null_ratio FROM {_LABELLED}"
_queries["null_types"] = lambda spark, sf_dir: rows.null_types(_labelled(spark, sf_dir), ["quality", "lang"])
_sql["null_types"] = f"SELECT 'quality' AS column_name, 'NULL' AS token, count(*) AS n FROM {_LABELLED} WHERE quality IS NULL HAVING count(*) > 0"
_queries["null_types_index"] = lambda spark, sf_dir: rows.null_rows(_labelled(spark, sf_dir), ["quality", "lang"], "doc_id")
_sql["null_types_index"] = f"SELECT 'quality' AS column_name, 'NULL' AS token, doc_id AS row_id FROM {_LABELLED} WHERE quality IS NULL"
_queries["null_runs"] = lambda spark, sf_dir: rows.null_runs(_labelled(spark, sf_dir), "quality", "doc_id")
_sql["null_runs"] = f"SELECT min(doc_id) AS start, max(doc_id) AS stop, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM {_LABELLED} WHERE quality IS NULL) GROUP BY g"
_queries["null_replication"] = lambda spark, sf_dir: _round(matrices.null_replication(_labelled(spark, sf_dir), ["quality", "toxic", "n_chars"]), null_prior=6, mean_null=6, mean_there=6).drop("n_null", "n_there")
_sql["null_replication"] = " UNION ALL ".join(
    f"SELECT '{a}' AS column_name, '{b}' AS other, round(avg(({a} IS NULL)::INT), 6) AS null_prior, sum({b}) FILTER ({a} IS NULL)::DOUBLE AS sum_null, sum({b}) FILTER ({a} IS NOT NULL)::DOUBLE AS sum_there, round(avg({b}) FILTER ({a} IS NULL), 6) AS mean_null, round(avg({b}) FILTER ({a} IS NOT NULL), 6) AS mean_there FROM {_LABELLED}"
    for a in ("quality", "toxic") for b in ("quality", "toxic", "n_chars") if a != b
)


@_query("documents", "SELECT count(*) AS n_rows, count(DISTINCT (text, lang)) AS unique_rows, round(count(DISTINCT (text, lang)) / count(*), 6) AS unique_row_ratio, count(*) - count(DISTINCT (text, lang)) AS duplicate_rows FROM documents")
def unique_rows(df: DataFrame) -> DataFrame:
    return _round(rows.unique_rows(df, ["text", "lang"]), unique_row_ratio=6)


@_query("lineitem")
def unique_rows_sketched(df: DataFrame) -> DataFrame:
    return rows.unique_rows_sketched(df)


@_query("lineitem", " UNION ALL ".join(f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in LINE for b in LINE if a != b) + " UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), 1.0")
def correlation_matrix(df: DataFrame) -> DataFrame:
    return _round(matrices.correlation(df, LINE), correlation=6)


def _chi2_sql(columns: list[str], table: str) -> str:
    long = _each(columns, "SELECT '{c}' AS c, x::VARCHAR AS v, count(*) AS n FROM {t} GROUP BY x", table)
    return f"""WITH k AS ({long}), s AS (SELECT c, sum(n) AS n FROM k GROUP BY c), p AS (SELECT a.c AS column_1, b.c AS column_2, a.n AS n1, b.n AS n2 FROM s a JOIN s b ON a.c < b.c),
 v AS (SELECT DISTINCT column_1, column_2, n1, n2, v FROM p JOIN k ON k.c IN (column_1, column_2)),
 o AS (SELECT v.*, coalesce(x.n, 0) AS c1, coalesce(y.n, 0) AS c2 FROM v LEFT JOIN k x ON x.c = column_1 AND x.v = v.v LEFT JOIN k y ON y.c = column_2 AND y.v = v.v)
 SELECT column_1, column_2, round(sum(pow(c1 - n1 * (c1 + c2) / (n1 + n2), 2) / (n1 * (c1 + c2) / (n1 + n2)) + pow(c2 - n2 * (c1 + c2) / (n1 + n2), 2) / (n2 * (c1 + c2) / (n1 + n2))), 4) AS statistic, count(*) - 1 AS freedom FROM o GROUP BY column_1, column_2"""


@_query("orders", _chi2_sql(["o_orderstatus", "o_orderpriority"], "orders"))
def chi2_homogeneity(df: DataFrame) -> DataFrame:
    return _round(matrices.homogeneity(df, ["o_orderstatus", "o_orderpriority"]), statistic=4)


@_query("lineitem", f"SELECT *, CASE WHEN statistic > 2000 THEN 0.0::DOUBLE END AS p_value FROM ({_chi2_sql(['l_returnflag', 'l_linestatus', 'l_linenumber'], 'lineitem')})")
def chi2_matrix(df: DataFrame) -> DataFrame:
    """These columns are nothing alike: the chance of such statistics is 0 to any number of digits."""
    return _round(matrices.chi2_matrix(df, ["l_returnflag", "l_linestatus", "l_linenumber"]), statistic=4, p_value=12)


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    early = F.pmod("o_orderkey", F.lit(2)) == 0
    return df.filter(early), df.filter(~early)


@_query("orders", """WITH b AS (SELECT o_totalprice AS x, o_orderkey % 2 = 0 AS e, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders),
 c AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9) AS k, count(*) FILTER (e) AS a, count(*) FILTER (NOT e) AS z FROM b GROUP BY ALL), n AS (SELECT sum(a) AS na, sum(z) AS nz FROM c)
 SELECT round(sum((z / nz - a / na) * ln((z / nz) / (a / na))), 6) AS psi FROM c, n WHERE a > 0 AND z > 0""")
def psi_numeric(df: DataFrame) -> DataFrame:
    return _round(compare.psi(*_halves(df), "o_totalprice"), psi=6)


@_query("orders", """WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 <> 0) AS z FROM orders GROUP BY ALL), n AS (SELECT sum(a) AS na, sum(z) AS nz FROM c)
 SELECT round(sum((z / nz - a / na) * ln((z / nz) / (a / na))), 6) AS psi FROM c, n WHERE a > 0 AND z > 0""")
def psi_categorical(df: DataFrame) -> DataFrame:
    one, two = (categorical.counts(x, ["o_orderpriority"]) for x in _halves(df))
    return _round(categorical.psi(one, two), psi=6)


@_query("orders", """WITH s AS (SELECT avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS m1, avg(o_totalprice) FILTER (o_orderkey % 2 <> 0) AS m2, var_samp(o_totalprice) FILTER (o_orderkey % 2 = 0) AS s1, var_samp(o_totalprice) FILTER (o_orderkey % 2 <> 0) AS s2,
 count(*) FILTER (o_orderkey % 2 = 0)::DOUBLE AS n1, count(*) FILTER (o_orderkey % 2 <> 0)::DOUBLE AS n2 FROM orders)
 SELECT 'o_totalprice' AS column_name, round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 6) AS t, least(n1, n2) - 1 AS conservative_freedom, round(pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)), 3) AS welch_freedom FROM s""")
def t_test(df: DataFrame) -> DataFrame:
    return _round(compare.t_statistics(*_halves(df), ["o_totalprice"]), t=6, welch_freedom=3)


@_query("orders", "SELECT o_orderpriority AS value, count(*) FILTER (o_orderkey % 2 = 0) AS n1, count(*) FILTER (o_orderkey % 2 <> 0) AS n2, count(*) FILTER (o_orderkey % 2 = 0) - count(*) FILTER (o_orderkey % 2 <> 0) AS diff FROM orders GROUP BY ALL")
def category_diff(df: DataFrame) -> DataFrame:
    one, two = (categorical.counts(x, ["o_orderpriority"]) for x in _halves(df))
    return compare.count_diff(one, two, "value")


@_query("orders", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def merged_counts(df: DataFrame) -> DataFrame:
    one, two = (categorical.counts(x, ["o_orderpriority"]).drop("column_name") for x in _halves(df))
    return categorical.merge_counts(one, two)


@_query("documents", "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents WHERE NOT regexp_full_match(text, '\\s*')) WHERE char <> '' GROUP BY char")
def vocab_count(df: DataFrame) -> DataFrame:
    return text.char_counts(df, "text")


_PUNCT = r"[!-/:-@\[-`{-~]+"
_COMMON = """’ve ’s ’re ’m ’ll ’d ‘ve ‘s ‘re ‘m ‘ll ‘d youve yourselves yourself yours youre your you've you're you'll you'd you yet y wouldnt wouldn't wouldn would wont won't won without within with
    will why whose whom whole whoever who whither while which whether wherever whereupon wherein whereby whereas whereafter where whenever whence when whatever what werent weren't weren were
    well we wasnt wasn't wasn was via very ve various using used us upon up until unless under two twenty twelve towards toward top too together to thus thru throughout through three though
    those this third they these thereupon therein therefore thereby thereafter there thence then themselves them theirs their the thatllwas that'll that than ten take t such still somewhere
    sometimes sometime something someone somehow some so sixty six since side show shoulve shouldve shouldnt shouldn't shouldn should've should shes she's she shan't shan several serious seems
    seeming seemed seem see say same s regarding really re rather quite put please perhaps per part own over out ourselves ours our otherwise others other or onto only one once on often off of o
    n’t n‘t nowhere now nothing not nor noone none nobody no nine next nevertheless never neither neednt needn't needn namely n't myself my mustn't mustn must much move mostly most moreover more
    mine mightve mightnt mightn't mightn might meanwhile me may many make made ma m ll less least latterly latter last keep just itself its it's it isnt isn't isn is into indeed in if i hundred
    however how his himself him hes herself hers hereupon herein hereby hereafter here her hence he having havent haven't haven have hasnt hasn't hasn has hadn't hadn had go give get further
    full front from four forty formerly former for five first fifty fifteen few except everywhere everything everyone every ever even enough empty elsewhere else eleven either eight each during
    due down dont done don't don doing doesn't doesn does do didnt didn't didn did d couldnt couldn't couldn could cant cannot can call ca by but bottom both beyond between besides beside below
    being behind beforehand before been becoming becomes become because became be back at as around aren't aren are anywhere anyway anything anyone anyhow any another and an amount amongst among
    am always although also already along alone almost all ain against again afterwards after across above about a 've 's 're 'm 'll 'd"""  # the words that don't count, backwards, as the SQL's own list
_STOP = ", ".join("'{}'".format(w.replace("'", "''")) for w in _COMMON.split())


@_query("documents", f"SELECT word, count(*) AS n FROM (SELECT regexp_replace(w, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS word FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)) WHERE word <> '' AND lower(word) NOT IN ({_STOP}) GROUP BY word")
def word_count(df: DataFrame) -> DataFrame:
    return text.word_counts(df, "text")


@_query("conversations", f"SELECT word, count(*) AS n FROM (SELECT regexp_replace(w, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations)) WHERE word <> '' AND lower(word) NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def top_k_words(df: DataFrame) -> DataFrame:
    return text.top(text.word_counts(df, "text", case_sensitive=False), "word", 50)


@_query("conversations", "SELECT count(*) AS n_lines, count(*) FILTER (text IS NULL OR regexp_full_match(text, '\\s*')) AS empty_lines, round(sum(strlen(text)) / 1048576.0, 6) AS memory_mb FROM conversations")
def text_summary(df: DataFrame) -> DataFrame:
    return _round(text.summary(df, "text"), memory_mb=6)


@_query("part", "SELECT DISTINCT 'p_type' AS column_name, unnest(string_split(p_type, '')) AS char FROM part")
def text_vocabulary(df: DataFrame) -> DataFrame:
    return text.vocabulary(df, ["p_type"])


@_query("documents", _each(["text"], _MOMENTS, "(SELECT length(text) AS text FROM documents)").replace(", count(*) FILTER (x = 0) AS num_zeros, count(*) FILTER (x < 0) AS num_negatives", "").replace("2) AS variance", "1) AS variance"))
def text_length_stats(df: DataFrame) -> DataFrame:
    return _round(numeric.text_lengths(df, ["text"]), **(MOMENT_PLACES | {"variance": 1}))


@_query("part", """WITH d AS (SELECT length(regexp_replace(CASE WHEN contains(s, '.') AND s NOT LIKE '%.0' THEN rtrim(s, '0') WHEN s LIKE '%.0' THEN rtrim(replace(s, '.0', ''), '0') ELSE rtrim(s, '0') END, '^[-+0.]+|\\.', '', 'g')) AS d FROM (SELECT format('{:.2f}', p_retailprice) AS s FROM part) t(s0), LATERAL (SELECT s0 AS s))
 SELECT 'p' AS column_name, min(d)::INT AS min, max(d)::INT AS max, round(avg(d), 6) AS mean, round(var_samp(d), 6) AS var, round(stddev_samp(d), 6) AS std, count(*) AS sample_size, round(3.291 * stddev_samp(d) / sqrt(count(*)), 6) AS margin_of_error, 0.999::DOUBLE AS confidence_level FROM d""")
def float_precision(df: DataFrame) -> DataFrame:
    return _round(numeric.precision(df.select(F.format_string("%.2f", "p_retailprice").alias("p")), ["p"]), mean=6, var=6, std=6, margin_of_error=6)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers and suppliers to their nations, each kind of node with numbers of its own."""
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("s"), F.col("c_nationkey").cast("bigint").alias("t"))
    s = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 9_000_000_000).alias("s"), F.col("s_nationkey").cast("bigint").alias("t"))
    return graph.edges(c.unionByName(s), "s", "t")


_TRADE = "(SELECT c_custkey + 1000000 AS s, c_nationkey::BIGINT AS t FROM customer UNION SELECT s_suppkey + 9000000000, s_nationkey FROM supplier)"
_queries["graph_summary"] = lambda spark, sf_dir: _round(graph.summary(_trade(spark, sf_dir)), avg_node_degree=6)
_sql["graph_summary"] = f"SELECT count(DISTINCT n) AS num_nodes, (count(*) / 2)::BIGINT AS num_edges, round(count(*) / count(DISTINCT n), 6) AS avg_node_degree FROM (SELECT s AS n FROM {_TRADE} UNION ALL SELECT t FROM {_TRADE})"
_queries["graph_degrees"] = lambda spark, sf_dir: graph.degrees(_trade(spark, sf_dir))
_sql["graph_degrees"] = f"SELECT n AS node, count(*) AS degree FROM (SELECT s AS n FROM {_TRADE} UNION ALL SELECT t FROM {_TRADE}) GROUP BY n"
_queries["graph_components"] = lambda spark, sf_dir: graph.components(_trade(spark, sf_dir))
_sql["graph_components"] = f"SELECT s AS node, t AS component FROM {_TRADE} UNION SELECT t, t FROM {_TRADE}"
_queries["graph_largest_component"] = lambda spark, sf_dir: graph.largest_component(_trade(spark, sf_dir))
_sql["graph_largest_component"] = f"SELECT count(*) + 1 AS n_nodes, count(*) AS n_edges FROM {_TRADE} GROUP BY t ORDER BY n_nodes DESC, t LIMIT 1"


@_query("lineitem", "SELECT 'l_quantity' AS column_name, 'range' AS rule, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 UNION ALL SELECT 'l_discount', 'list', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_discount IN (0.0, 0.1)")
def validator_rules(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return validate.Validator().validate(keyed, {"l_quantity": {"range": {"start": 10, "end": 12}}, "l_discount": {"list": [0.0, 0.1]}}, "row")


@_query("events", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR || ':7'), event_id LIMIT 100")
def row_sample(df: DataFrame) -> DataFrame:
    """A seeded sample: the feature is the limit."""
    return rows.reservoir(df, 100, 7, "event_id").select("event_id")


@_query("labels", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@_query("documents")
def entity_counts(df: DataFrame) -> DataFrame:
    """Kinds of entities in all texts; DuckDB's patterns lack look-around, so a test holds it against Python's."""
    return labels.entity_counts(df, "text")


# ---- whole profiles

_LINEITEM = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "int", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime"}
_EVENTS = {"event_id": "int", "ts": "string", "user_id": "int", "event_type": "string", "value": "float", "props": "string"}
_DOCUMENTS = {"doc_id": "int", "text": "text", "lang": "string", "source": "string", "n_chars": "int"}
FIGURES = "column_name string, data_type string, n_rows bigint, null_count bigint, unique_count bigint, low string, high string, mean double, stddev double, skewness double, kurtosis double, categorical boolean"


def _figures(spark: SparkSession, p: profile.Profile) -> DataFrame:
    """One small row for each column of a profile: of numbers, or of texts' lengths, or the range of dates."""
    out = []
    for c, s in p.columns.items():
        m = s.numbers if s.data_type in ("int", "float") else s.lengths
        n = m.moments
        low, high = (s.dates.low[1], s.dates.high[1]) if s.data_type == "datetime" else (None, None)
        figures = (n.mean, n.stddev(), n.skewness(), n.kurtosis()) if n.n and s.data_type != "datetime" else (None,) * 4
        out.append((c, s.data_type, s.n_rows, s.null_count, s.counts.unique, low, high, *figures, s.counts.categorical))
    got = _round(spark.createDataFrame(out, FIGURES), mean=8, stddev=3, skewness=5, kurtosis=5)
    return got.withColumn("skewness", F.col("skewness") + 0.0)  # no negative zeros


def _profile_sql(table: str, kinds: dict[str, str]) -> str:
    parts = []
    for c, k in kinds.items():
        x = {"string": f"length({c})", "text": f"length({c})"}.get(k, c)
        if k == "datetime" or c == "ts":
            low, high, figures = f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')", f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')", "NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev, NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis"
            if c == "ts":
                low = high = "NULL::VARCHAR"
        else:
            low = high = "NULL::VARCHAR"
            figures = f"round(avg({x}), 8) AS mean, round(stddev_samp({x}), 3) AS stddev, round(CASE WHEN var_pop({x}) = 0 THEN 0 ELSE skewness({x}) END, 5) + 0.0::DOUBLE AS skewness, round(CASE WHEN var_pop({x}) = 0 THEN -3 * pow(count({x}) - 1, 2) / ((count({x}) - 2) * (count({x}) - 3)) ELSE kurtosis({x}) END, 5) AS kurtosis"
        parts.append(f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {low} AS low, {high} AS high, {figures}, count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count({c}) <= 0.2 AS categorical FROM {table}")
    return " UNION ALL ".join(parts)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


for _table, _columns in (("lineitem", _LINEITEM), ("events", _EVENTS), ("documents", _DOCUMENTS)):
    _add(f"profile_{_table}", lambda spark, sf_dir, t=_table: _figures(spark, profile.of(_t(spark, sf_dir, t))), _profile_sql(_table, _columns))

_ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"}


def _half_profiles(spark: SparkSession, sf_dir: str, options: Structured | None = None) -> tuple[profile.Profile, profile.Profile]:
    return tuple(profile.of(x, options) for x in _halves(_t(spark, sf_dir, "orders")))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of two halves of a table, saved, loaded and added up: what the profile of the whole says."""
    one, two = _half_profiles(spark, sf_dir)
    whole = profile.merged([one, profile.Profile.from_json(two.to_json())])
    return _figures(spark, whole).drop("unique_count", "categorical")


_add("profile_merge", _merged, f"SELECT * EXCLUDE (unique_count, categorical) FROM ({_profile_sql('orders', _ORDERS)})")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that two profiles' difference gives for a table's halves."""
    d = _half_profiles(spark, sf_dir)
    got = d[0].diff(d[1])["data_stats"]
    number = lambda x: 0.0 if x == "unchanged" else float(x)
    out = [(c, k, round(number(got[c]["statistics"][k]), 3)) for c in ("o_custkey", "o_totalprice") for k in ("sample_size", "min", "max", "mean", "stddev")]
    out += [(c, k, round(number(got[c]["statistics"][k]), 6)) for c in ("o_orderstatus", "o_orderpriority") for k in ("unique_count", "gini_impurity", "unalikeability", "psi")]
    return spark.createDataFrame(out, "column_name string, figure string, diff double")


_EVEN, _ODD = "FILTER (o_orderkey % 2 = 0)", "FILTER (o_orderkey % 2 <> 0)"
_DIFF_NUMBERS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS figure, round(({f.format(x=c)} {_EVEN} - {f.format(x=c)} {_ODD})::DOUBLE, 3) AS diff FROM orders"
    for c in ("o_custkey", "o_totalprice") for k, f in (("sample_size", "count({x})"), ("min", "min({x})"), ("max", "max({x})"), ("mean", "avg({x})"), ("stddev", "stddev_samp({x})"))
)
_DIFF_VALUES = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, unnest(['unique_count', 'gini_impurity', 'unalikeability', 'psi']) AS figure, unnest([u, g, n, psi]) AS diff FROM (
 SELECT round((count(*) FILTER (a > 0) - count(*) FILTER (z > 0))::DOUBLE, 6) AS u, round(sum(pow(z / nz, 2)) - sum(pow(a / na, 2)), 6) AS g,
 round((na * na - sum(a * a)) / (na * na - na) - (nz * nz - sum(z * z)) / (nz * nz - nz), 6) AS n, round(sum(CASE WHEN a > 0 AND z > 0 THEN (z / nz - a / na) * ln((z / nz) / (a / na)) END), 6) AS psi
 FROM (SELECT *, sum(a) OVER () AS na, sum(z) OVER () AS nz FROM (SELECT (count(*) {_EVEN})::DOUBLE AS a, (count(*) {_ODD})::DOUBLE AS z FROM orders GROUP BY {c})) GROUP BY na, nz)"""
    for c in ("o_orderstatus", "o_orderpriority")
)
_add("profile_diff", _differences, f"{_DIFF_NUMBERS} UNION ALL {_DIFF_VALUES}")


def _merged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Structured(columns=tuple(LINE)).set({"correlation.enabled": True, "category.enabled": False, "chi2.enabled": False, "rows.enabled": False, "order.enabled": False})
    df = _t(spark, sf_dir, "lineitem")
    one, two = (profile.of(x, own) for x in (df.filter("l_orderkey % 3 = 0"), df.filter("l_orderkey % 3 <> 0")))
    return spark.createDataFrame([(a, b, round(r, 6)) for (a, b), r in (one + two).correlation.items()], "column_1 string, column_2 string, correlation double")


_add("correlation_merge", _merged_correlation, _sql["correlation_matrix"])
_add("profile_preset_types", lambda spark, sf_dir: spark.createDataFrame([(c, s.data_type) for c, s in profile.of(_t(spark, sf_dir, "customer"), Options.preset("data_types")).columns.items()], "column_name string, data_type string"), "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name, unnest(['int', 'string', 'int', 'float', 'string']) AS data_type")
_add("profile_by_group", lambda spark, sf_dir: _round(profile.grouped(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"]), mean=6, stddev=6), " UNION ALL ".join(f"SELECT l_returnflag AS \"group\", '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY l_returnflag" for c in ("l_quantity", "l_tax")))


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset that sketches: rows are estimated, columns of mostly different values have a sketch alone."""
    p = profile.of(_t(spark, sf_dir, "orders"), Options.preset("lower_memory_sketching"))
    return spark.createDataFrame([(c, s.counts.unique, s.counts.estimated, p.rows["unique_rows"]) for c, s in p.columns.items()], "column_name string, unique_count bigint, estimated boolean, unique_rows bigint")


_add("profile_sketched", _sketched)


def _row_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(rows.row_figures(_labelled(spark, sf_dir)), row_has_null_ratio=6, row_is_null_ratio=6, unique_row_ratio=6)


_add("row_figures", _row_figures, f"SELECT count(*) AS n_rows, round(avg((quality IS NULL OR toxic IS NULL)::INT), 6) AS row_has_null_ratio, 0.0::DOUBLE AS row_is_null_ratio, count(DISTINCT doc_id) AS unique_rows, round(count(DISTINCT doc_id) / count(*), 6) AS unique_row_ratio, count(*) - count(DISTINCT doc_id) AS duplicate_rows FROM {_LABELLED}")


def _merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two ranges of rows, put together without knowing which came first."""
    df = _t(spark, sf_dir, "orders")
    middle = df.agg(F.avg("o_orderkey")).first()[0]
    out = []
    for c in ("o_orderkey", "o_totalprice"):
        parts = [order.runs(x.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), [c])[c] for x in (df.filter(F.col("o_orderkey") > middle), df.filter(F.col("o_orderkey") <= middle))]
        out.append((c, parts[0].merged(parts[1]).order))
    return spark.createDataFrame(out, "column_name string, data_order string")


_add("order_merge", _merged_order, _sql["order_detection"])
_add("order_of_texts", lambda spark, sf_dir: order.detect(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), "o_orderpriority"), ["key", "o_orderpriority"], "o_orderkey"), "SELECT unnest(['key', 'o_orderpriority']) AS column_name, unnest(['ascending', 'random']) AS data_order")


def _superset(df: DataFrame) -> DataFrame:
    one, two = (categorical.counts(x, ["o_clerk"]) for x in (df.filter("o_orderkey % 3 = 0"), df.filter("o_orderkey % 3 = 1")))
    return categorical.superset(one, two)


_add("category_superset", lambda spark, sf_dir: _superset(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("o_clerk"))), "SELECT o_custkey::VARCHAR AS value, count(*) FILTER (o_orderkey % 3 = 0) AS n1, count(*) FILTER (o_orderkey % 3 = 1) AS n2 FROM orders WHERE o_orderkey % 3 <= 1 GROUP BY ALL")


def _merged_hitters(df: DataFrame) -> DataFrame:
    one, two = (categorical.counts(x, ["o_custkey"]).drop("column_name") for x in _halves(df))
    return categorical.merged_heavy_hitters(one, two, df.count(), 1000)


_add("heavy_hitters_merge", lambda spark, sf_dir: _merged_hitters(_t(spark, sf_dir, "orders")), _sql["heavy_hitters"])


def _sketched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two merged sketches beside the exact ones, which they never fall below."""
    df = _t(spark, sf_dir, "orders")
    both = categorical.merged_sketches(spark, *(categorical.sketch(x, "o_orderpriority", 0.99, 0.001) for x in _halves(df)))
    exact = categorical.counts(df, ["o_orderpriority"]).collect()
    return spark.createDataFrame([(r["value"], r["n"], categorical.sketched_count(spark, both, r["value"])) for r in exact], "value string, n bigint, estimate bigint")


_add("count_min_merge", _sketched_counts, "SELECT o_orderpriority AS value, count(*) AS n, count(*) AS estimate FROM orders GROUP BY ALL")


def _flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's figures by their joined keys."""
    flat = profile.of(_t(spark, sf_dir, "customer")).report("flat")
    names = [f"data_stats_c_acctbal_statistics_{k}" for k in ("min", "max", "mean", "stddev", "num_negatives", "null_count", "precision_max")] + ["global_stats_n_rows", "global_stats_unique_rows", "data_stats_c_name_statistics_unique_count"]
    return spark.createDataFrame([(k, round(float(flat[k]), 4)) for k in names], "key string, value double")


_add("report_flat", _flat_report, "SELECT unnest(['data_stats_c_acctbal_statistics_min', 'data_stats_c_acctbal_statistics_max', 'data_stats_c_acctbal_statistics_mean', 'data_stats_c_acctbal_statistics_stddev', 'data_stats_c_acctbal_statistics_num_negatives', 'data_stats_c_acctbal_statistics_null_count', 'data_stats_c_acctbal_statistics_precision_max', 'global_stats_n_rows', 'global_stats_unique_rows', 'data_stats_c_name_statistics_unique_count']) AS key, unnest([min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4), round(stddev_samp(c_acctbal), 4), count(*) FILTER (c_acctbal < 0), 0, max(length(ltrim(replace(replace(c_acctbal::VARCHAR, '-', ''), '.', ''), '0')) - CASE WHEN c_acctbal = floor(c_acctbal) THEN 1 ELSE 0 END), count(*), count(*), count(DISTINCT c_name)]::DOUBLE[]) AS value FROM customer")


def _set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two lists have alone and in common."""
    one, two = ([r[0] for r in x.select("o_custkey").distinct().collect()] for x in _halves(_t(spark, sf_dir, "orders")))
    parts = compare.lists(one, two)
    return spark.createDataFrame([(name, v) for name, part in zip(("first", "both", "second"), parts, strict=True) for v in part], "part string, value bigint")


_add("diff_lists", _set_diff, "SELECT CASE WHEN z = 0 THEN 'first' WHEN a = 0 THEN 'second' ELSE 'both' END AS part, o_custkey AS value FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 <> 0) AS z FROM orders GROUP BY o_custkey)")


def _dict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both sides by key, with those that one side lacks."""
    df = _t(spark, sf_dir, "events")
    one, two = (dict(df.filter(f"user_id % 50 = {k}").groupBy("user_id").count().select((F.col("user_id") / 50).cast("int").cast("string"), "count").collect()) for k in (0, 1))
    got = compare.dicts(one, two)
    got = {} if got == compare.UNCHANGED else got
    cell = lambda x: (None, None, 0) if x == compare.UNCHANGED else (x[0], x[1], None) if isinstance(x, list) else (None, None, x)
    return spark.createDataFrame([(k, *cell(v)) for k, v in got.items()], "key string, only_first bigint, only_second bigint, diff bigint")


_add("diff_dicts", _dict_diff, "SELECT k AS key, CASE WHEN z = 0 THEN a END AS only_first, CASE WHEN a = 0 THEN z END AS only_second, CASE WHEN a > 0 AND z > 0 THEN a - z END AS diff FROM (SELECT floor(user_id / 50)::INT::VARCHAR AS k, count(*) FILTER (user_id % 50 = 0) AS a, count(*) FILTER (user_id % 50 = 1) AS z FROM events WHERE user_id % 50 <= 1 GROUP BY ALL)")


def _date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time between the last orders of two halves, signed, and the statistics' difference of whole profiles by date."""
    one, two = (x.agg(F.max("o_orderdate")).first()[0] for x in _halves(_t(spark, sf_dir, "orders")))
    return spark.createDataFrame([(compare.dates(one, two), compare.dates(two, one) == compare.UNCHANGED)], "diff string, same boolean")


_add("diff_dates", _date_diff, "SELECT CASE WHEN a = z THEN 'unchanged' ELSE CASE WHEN a > z THEN '+' ELSE '-' END || CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day, ' ELSE d || ' days, ' END || '0:00:00' END AS diff, a = z AS same FROM (SELECT a, z, abs(date_diff('day', z, a)) AS d FROM (SELECT max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS a, max(o_orderdate) FILTER (o_orderkey % 2 <> 0) AS z FROM orders))")


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator's own lists, as rows."""
    v = validate.Validator()
    v.validate(_t(spark, sf_dir, "customer"), {"c_acctbal": {"range": {"start": -1000, "end": 0}}, "c_nationkey": {"list": [3, 7]}}, "c_custkey")
    return spark.createDataFrame([(c, r, i) for c, rules in v.get().items() for r, ids in rules.items() for i in ids], "column_name string, rule string, row_id bigint")


_add("validator_lists", _anomalies, "SELECT 'c_acctbal' AS column_name, 'range' AS rule, c_custkey AS row_id FROM customer WHERE c_acctbal BETWEEN -1000 AND 0 UNION ALL SELECT 'c_nationkey', 'list', c_custkey FROM customer WHERE c_nationkey IN (3, 7)")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that a stream of a table's parts keeps up to date."""
    folder = runtime.new_path(spark, "stream")
    df = _t(spark, sf_dir, "orders")
    files = max(1, spark.sparkContext.defaultParallelism)  # of each of three batches, so that all cores read one
    df.repartition(3 * files).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = incremental.start(stream, f"{folder}/states", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return _figures(spark, incremental.current(spark, f"{folder}/states")).drop("unique_count", "categorical")


_add("profile_stream", _streamed, _sql["profile_merge"])
_add("column_label_votes", lambda spark, sf_dir: _round(labels.column_labels(_t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit("@mail.org"))).otherwise(F.col("event_type")).alias("who")), ["who"]), share=6), "SELECT 'who' AS column_name, unnest(['UNKNOWN', 'EMAIL_ADDRESS']) AS label, unnest([n - e, e]) AS n, unnest([round((n - e) / n, 6), round(e / n, 6)]) AS share, unnest([1, 2]) AS place FROM (SELECT count(*) FILTER (event_id % 4 = 0 AND user_id IS NOT NULL) AS e, count(*) FILTER (event_id % 4 = 0 AND user_id IS NOT NULL OR event_id % 4 <> 0 AND event_type IS NOT NULL) AS n FROM events)")


# ---- texts and graphs

_WORD_SQL = "(SELECT {key}regexp_replace(w, '^{p}|{p}$', '', 'g') AS word FROM (SELECT {key}unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations {where}))"


def _text_halves(spark: SparkSession, sf_dir: str) -> tuple[text_profile.TextProfile, text_profile.TextProfile]:
    df = _t(spark, sf_dir, "conversations")
    return text_profile.of(df.filter("role = 'user'").select("text")), text_profile.of(df.filter("role <> 'user'").select("text"))


def _merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _text_halves(spark, sf_dir)
    both = one + two
    chars = spark.createDataFrame([("char", c, n) for c, n in both.vocab_count.items()], "kind string, key string, n bigint")
    return chars.unionByName(both.word_frame.select(F.lit("word").alias("kind"), F.col("word").alias("key"), "n"))


_add("text_profile_merge", _merged_text, f"SELECT 'word' AS kind, word AS key, count(*) AS n FROM {_WORD_SQL.format(key='', p=_PUNCT, where='')} WHERE word <> '' AND lower(word) NOT IN ({_STOP}) GROUP BY word UNION ALL SELECT 'char', c, count(*) FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations WHERE NOT regexp_full_match(text, '\\s*')) WHERE c <> '' GROUP BY c")
_add("text_profile_diff", lambda spark, sf_dir: (lambda p: p[0].word_diff(p[1]))(_text_halves(spark, sf_dir)), f"SELECT word, nullif(count(*) FILTER (u), 0) AS n1, nullif(count(*) FILTER (NOT u), 0) AS n2, count(*) FILTER (u) - count(*) FILTER (NOT u) AS diff FROM (SELECT u, word FROM {_WORD_SQL.format(key='u, ', p=_PUNCT, where='').replace('FROM conversations', 'FROM (SELECT text, role = ' + chr(39) + 'user' + chr(39) + ' AS u FROM conversations)').replace('SELECT u, unnest', 'SELECT u, unnest')}) WHERE word <> '' AND lower(word) NOT IN ({_STOP}) GROUP BY word")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and suppliers with their last line's price and number."""
    line = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1_000_000).alias("s"), F.col("l_suppkey").alias("t"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").cast("double").alias("number"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("at"))
    return graph.edges(line, "s", "t", ["price", "number"], "at")


def _graph_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graphs.of(_weighted(spark, sf_dir).withColumn("price", F.col("price") + 0.5))
    mean, variance, *_ = p.continuous_distribution["price"]["properties"]
    return spark.createDataFrame([(p.num_nodes, p.num_edges, round(p.avg_node_degree, 6), round(mean, 3), round(variance / 1e6, 4), sum(p.categorical_distribution["number"]["bin_counts"]))], "num_nodes bigint, num_edges bigint, avg_node_degree double, mean double, variance double, numbered bigint")


_EDGES = "(SELECT s, t, arg_max(price, seq) AS price FROM (SELECT l_partkey + 1000000 AS s, l_suppkey AS t, l_extendedprice + 0.5 AS price, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice} AS seq FROM lineitem) GROUP BY s, t)"
_add("graph_profile", _graph_profile, f"SELECT (SELECT count(*) FROM (SELECT s FROM {_EDGES} UNION SELECT t FROM {_EDGES})) AS num_nodes, count(*) AS num_edges, round(2 * count(*) / (SELECT count(*) FROM (SELECT s FROM {_EDGES} UNION SELECT t FROM {_EDGES})), 6) AS avg_node_degree, round(avg(price), 3) AS mean, round(var_pop(price) / 1e6, 4) AS variance, count(*) AS numbered FROM {_EDGES}")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in a row: components that are long paths."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id").filter("user_id is not null")
    after = e.select(F.col("event_id").alias("s"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("t")).filter("t is not null")
    return graph.components(after.select(F.col("s").alias("u"), F.col("t").alias("v")))  # a user's edges stay where they are


_add("graph_path_components", _paths, "SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id) AS component FROM events WHERE user_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id) > 1")


# ---- readers and records

def _written(spark: SparkSession, name: str, data: bytes) -> str:
    path = runtime.new_path(spark, name)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    return path


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [tuple(map(str, r)) for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]


_NATION_SQL = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


def _csv_text(rows: list[tuple], delimiter: str, title: str = "") -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_NONNUMERIC).writerows([("n_nationkey", "n_name", "n_regionkey"), *rows])
    return title + out.getvalue()


_add("csv_source", lambda spark, sf_dir: files.Source(spark, _written(spark, "csv", _csv_text(_nations(spark, sf_dir), ";").encode("utf-16"))).data, _NATION_SQL)
_add("csv_source_titled", lambda spark, sf_dir: files.Source(spark, _written(spark, "csv", _csv_text([(a, f"{b}\nof old", c) for a, b, c in _nations(spark, sf_dir)], "|", "All nations\r\n").encode())).data, _NATION_SQL.replace("n_name AS", "n_name || chr(10) || 'of old' AS"))
_add("json_source", lambda spark, sf_dir: files.Source(spark, _written(spark, "json", "".join(json.dumps({"n_nationkey": int(a), "n": {"name": b, "regionkey": c}}) + "\n" for a, b, c in _nations(spark, sf_dir)).encode())).data, _NATION_SQL.replace("AS n_name", 'AS "n.name"').replace("AS n_regionkey", 'AS "n.regionkey"'))
_add("json_payload", lambda spark, sf_dir: files.Source(spark, _written(spark, "json", json.dumps({"count": 25, "data": [{"key": a, "at": {"name": b}} for a, b, _ in _nations(spark, sf_dir)]}, indent=1).encode())).data_and_metadata.select(F.col("`data.key`"), F.col("`data.at.name`")), 'SELECT n_nationkey::VARCHAR AS "data.key", n_name AS "data.at.name" FROM nation')
_add("avro_source", lambda spark, sf_dir: files.Source(spark, _written(spark, "avro", avro.packed([{"n_nationkey": a, "n": {"name": b}} for a, b, _ in _nations(spark, sf_dir)]))).data, 'SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS "n.name" FROM nation')
_add("parquet_source", lambda spark, sf_dir: files.Source(spark, f"{sf_dir}/nation.parquet").data, _NATION_SQL)
_add("text_source", lambda spark, sf_dir: files.Source(spark, _written(spark, "text", "".join(f"the nation is {b}\n" for _, b, _ in _nations(spark, sf_dir)).encode("latin-1")), options=files.ReadOptions("text")).data, "SELECT 'the nation is ' || n_name AS value FROM nation")
_add("graph_source", lambda spark, sf_dir: files.Source(spark, _written(spark, "graph", ("node_id_src,node_id_dst,weight\n" + "".join(f"{int(a) + 100},{c},{a}.5\n" for a, _, c in _nations(spark, sf_dir))).encode())).edges(), "SELECT least((n_nationkey + 100)::VARCHAR, n_regionkey::VARCHAR) AS u, greatest((n_nationkey + 100)::VARCHAR, n_regionkey::VARCHAR) AS v, n_nationkey + 0.5::DOUBLE AS weight FROM nation")
_add("json_records", lambda spark, sf_dir: files.Source(spark, f"{sf_dir}/nation.parquet").records(), "SELECT to_json({'n_nationkey': n_nationkey::VARCHAR, 'n_name': n_name, 'n_regionkey': n_regionkey::VARCHAR})::VARCHAR AS value FROM nation")
_add("csv_records", lambda spark, sf_dir: files.Source(spark, None, _t(spark, sf_dir, "nation")).records(), "SELECT 'n_nationkey,n_name,n_regionkey' AS value UNION ALL SELECT n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation")
_add("text_pieces", lambda spark, sf_dir: files.Source(spark, None, _t(spark, sf_dir, "documents").select("text"), files.ReadOptions(samples_per_line=500)).text(), "SELECT substr(text, (k * 500 + 1)::BIGINT, 500) AS value FROM (SELECT text, unnest(range(0, greatest(1, ceil(length(text) / 500))::BIGINT)) AS k FROM documents)")
_add("json_flatten", lambda spark, sf_dir: rows.flatten_json(_t(spark, sf_dir, "events"), "props", {"k": "bigint", "none": "string"}, ["event_id"]), "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")


# ---- labelers

def _digits() -> labeler.Labeler:
    model = models.RegexModel(None, {"patterns": {"NUMBER": ["[0-9]{4,}"]}, "before": "", "after": ""})
    return labeler.Labeler.from_components(processors.DirectPass(), model, processors.RegexPostprocessor())


_add("labeler_entities", lambda spark, sf_dir: _digits().entities(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "label", "entity"), "SELECT doc_id, 'NUMBER' AS label, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS entity FROM documents")
_add("labeler_cells", lambda spark, sf_dir: labeler.Labeler.from_library("structured_regex").cells(_t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus"), ["day", "o_orderstatus"]).groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n")), "SELECT unnest(['day', 'o_orderstatus']) AS column_name, unnest(['DATETIME', 'UNKNOWN']) AS label, count(*) AS n FROM orders")
_add("entity_levels", lambda spark, sf_dir: text_profile.entity_levels(_t(spark, sf_dir, "documents"), "text", _digits()).filter("label = 'NUMBER'"), "SELECT unnest(['word_count', 'true_char_count', 'postprocess_char_count']) AS level, 'NUMBER' AS label, unnest([count(*), sum(length(x)), sum(length(x))])::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{4,}')) AS x FROM documents)")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of one label as a guess at the other."""
    df = _t(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("q"), (1 - F.col("toxic")).cast("string").alias("t"))
    figures = metrics.report(metrics.matrix(metrics.confusion(df, "q", "t"), ["0", "1"]), ["0", "1"])
    return spark.createDataFrame([(k, round(figures[k]["precision"], 6), round(figures[k]["recall"], 6), round(figures[k]["f1-score"], 6), figures[k]["support"]) for k in ("0", "1")], "label string, precision double, recall double, f1 double, support bigint")


_add("classification_report", _report, " UNION ALL ".join(f"SELECT '{k}' AS label, round(h / m, 6) AS precision, round(h / s, 6) AS recall, round(2 * h / (m + s), 6) AS f1, s AS support FROM (SELECT count(*) FILTER (quality = {k} AND 1 - toxic = {k}) AS h, count(*) FILTER (1 - toxic = {k}) AS m, count(*) FILTER (quality = {k}) AS s FROM labels)" for k in (0, 1)))
_add("column_name_labels", lambda spark, sf_dir: spark.createDataFrame([(c, label) for c, (label, _) in labeler.Labeler.from_library("column_name").predict(["email_address", "SSN", "c_name", "file_name", "ip-address", *_t(spark, sf_dir, "lineitem").columns]).items()], "column_name string, label string"), "SELECT unnest(['email_address', 'SSN', 'ip-address']) AS column_name, unnest(['EMAIL_ADDRESS', 'SSN', 'IPV4']) AS label")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["numeric_moments"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

