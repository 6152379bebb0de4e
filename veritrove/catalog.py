"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import association as A
from .operators import insights as I
from .operators import profile as P
from .operators import temporal as X
from .operators.base import Context, create
from .operators.stat_rules import ks_statistic
from .plans.planner import results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _rules(name: str, table: str, rules: list[tuple], sql: str | None, view: Callable[[DataFrame], DataFrame] = lambda d: d, refs: dict[str, Callable] | None = None) -> None:
    """rules: (label, kind, params[, condition])."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        get = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        tables = {k: f(get) for k, f in (refs or {}).items()}
        built = [create(r[1], r[2], condition=r[3] if len(r) > 3 else None) for r in rules]
        return results(view(get(table)), built, Context(spark, name=table, tables=tables, now=NOW), [r[0] for r in rules])

    _add(name, query, sql)


def _of(label: str, bad: str, table: str, total: str = "count(*)", where: str = "true") -> str:
    return f"SELECT '{label}' AS rule, {total} AS total_count, coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END),0)::BIGINT AS failed_count, coalesce(sum(CASE WHEN {bad} THEN 1 ELSE 0 END),0)=0 AS passed FROM {table} WHERE {where}"


def _row(name: str, table: str, kind: str, params: dict, bad: str, **kw) -> None:
    _rules(name, table, [(name, kind, params)], _of(name, bad, kw.pop("sql_table", table)), **kw)


def _frame(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _add(name, lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet")), sql)


# --- row rules -----------------------------------------------------------------------------------------------------------
_rules(
    "fused_lineitem",
    "lineitem",
    [
        ("range", "RangeCheck", {"field": "l_discount", "min_value": 0, "max_value": 0.05}),
        ("values", "ValidValuesCheck", {"field": "l_returnflag", "valid_values": ["A", "R"]}),
        ("regex", "RegexCheck", {"field": "l_returnflag", "pattern": "[AN]"}),
        ("mandatory", "MandatoryFieldCheck", {"fields": ["l_orderkey", "l_returnflag"]}),
        ("length", "StringLengthCheck", {"field": "l_linestatus", "max_length": 1}),
        ("completeness", "CompletenessCheck", {"field": "l_tax", "min_completeness": 0.99}),
    ],
    " UNION ALL ".join(
        [
            _of("range", "l_discount<0 OR l_discount>0.05", "lineitem"),
            _of("values", "l_returnflag NOT IN ('A','R')", "lineitem"),
            _of("regex", "NOT regexp_matches(l_returnflag,'^(?:[AN])')", "lineitem"),
            _of("mandatory", "l_orderkey IS NULL OR l_returnflag IS NULL OR trim(l_returnflag)=''", "lineitem", "2*count(*)"),
            _of("length", "length(l_linestatus)>1", "lineitem"),
            _of("completeness", "l_tax IS NULL", "lineitem"),
        ]
    ),
)
_null_status = lambda d: d.withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
_row("mandatory_null", "orders", "MandatoryFieldCheck", {"fields": ["o_orderstatus"]}, "nullif(o_orderstatus,'P') IS NULL", view=_null_status)
_row("regex_anchored", "customer", "RegexCheck", {"field": "c_name", "pattern": "Customer#0*[1-9]5"}, "NOT regexp_matches(c_name,'^(?:Customer#0*[1-9]5)')")
_row("regex_inverted", "customer", "RegexCheck", {"field": "c_name", "pattern": ".*7$", "invert": True}, "regexp_matches(c_name,'^(?:.*7$)')")
_row("inline_regex", "documents", "InlineRegexCheck", {"field": "text", "pattern": "@", "should_match": False}, "regexp_matches(text,'@')")
_row("format_check", "part", "FormatCheck", {"field": "p_brand", "pattern": "Brand#[1-3][1-5]"}, "NOT regexp_full_match(p_brand,'Brand#[1-3][1-5]')")
_row("valid_values", "orders", "ValidValuesCheck", {"field": "o_orderstatus", "valid_values": ["F", "O"]}, "o_orderstatus NOT IN ('F','O')")
_row("valid_values_nocase", "customer", "ValidValuesCheck", {"field": "c_mktsegment", "valid_values": ["building", "machinery"], "case_sensitive": False}, "lower(c_mktsegment) NOT IN ('building','machinery')")
_row("range_two_sided", "orders", "RangeCheck", {"field": "o_totalprice", "min_value": 1000, "max_value": 200000}, "o_totalprice<1000 OR o_totalprice>200000")
_rules("range_condition", "lineitem", [("range_condition", "RangeCheck", {"field": "l_tax", "max_value": 0.05}, "l_quantity > 25 and not l_returnflag == 'A'")], _of("range_condition", "l_tax>0.05", "lineitem", where="l_quantity>25 AND NOT l_returnflag='A'"))
_row("date_format", "orders", "DateFormatCheck", {"field": "o_orderdate", "format": "%Y-%m-%d %H:%M:%S"}, "try_strptime(strftime(o_orderdate,'%Y-%m-%d %H:%M:%S'),'%Y-%m-%d %H:%M:%S') IS NULL")
_row("date_format_wrong", "customer", "DateFormatCheck", {"field": "c_name", "format": "%Y-%m-%d"}, "try_strptime(c_name,'%Y-%m-%d') IS NULL")
_row("string_length", "part", "StringLengthCheck", {"field": "p_name", "min_length": 8, "max_length": 9}, "length(p_name)<8 OR length(p_name)>9")
_places = "length(rtrim(regexp_extract(CAST(l_extendedprice AS VARCHAR),'\\.(\\d+)',1),'0'))"
_row("precision_max", "lineitem", "NumericPrecisionCheck", {"field": "l_extendedprice", "max_decimal_places": 1}, f"{_places}>1")
_row("precision_exact", "lineitem", "NumericPrecisionCheck", {"field": "l_extendedprice", "exact_decimal_places": 2}, f"{_places}<>2")
_row("boolean_check", "labels", "BooleanCheck", {"field": "quality"}, "CAST(quality AS VARCHAR) NOT IN ('0','1')")
_row("business_day", "orders", "BusinessDayCheck", {"field": "o_orderdate"}, "isodow(o_orderdate)>=6")
_row("blank_record", "orders", "BlankRecordCheck", {"exclude_fields": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]}, "nullif(o_orderstatus,'P') IS NULL", view=_null_status)
for _op, _sql in (("==", "="), ("!=", "<>"), ("<", "<"), ("<=", "<="), (">", ">"), (">=", ">=")):
    _n = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}[_op]
    _row(f"cross_field_{_n}", "lineitem", "CrossFieldComparisonCheck", {"field_a": "l_discount", "operator": _op, "field_b": "l_tax"}, f"NOT (l_discount{_sql}l_tax)")
_row("business_rule", "lineitem", "InlineBusinessRuleCheck", {"rule": "l_quantity > 5 AND (l_discount < 0.08 OR NOT l_returnflag IN ('A', 'R'))"}, "NOT (l_quantity>5 AND (l_discount<0.08 OR l_returnflag NOT IN ('A','R')))")
_row("lookup_allow", "nation", "InlineLookupCheck", {"field": "n_regionkey", "reference_values": [0, 1, 2]}, "n_regionkey NOT IN (0,1,2)")
_row("lookup_deny", "nation", "InlineLookupCheck", {"field": "n_regionkey", "reference_values": [3], "check_type": "deny"}, "n_regionkey=3")
_rules("completeness_fail", "orders", [("completeness_fail", "CompletenessCheck", {"field": "o_orderstatus", "min_completeness": 99})], "SELECT 'completeness_fail' AS rule, count(*) AS total_count, (count(*)-count(nullif(o_orderstatus,'P')))::BIGINT AS failed_count, count(nullif(o_orderstatus,'P'))/count(*)>=0.99 AS passed FROM orders", view=_null_status)
_rules("row_count_range", "orders", [("row_count_range", "RowCountRangeCheck", {"min_rows": 10, "max_rows": 1000})], "SELECT 'row_count_range' AS rule, 1::BIGINT AS total_count, (CASE WHEN count(*) BETWEEN 10 AND 1000 THEN 0 ELSE 1 END)::BIGINT AS failed_count, count(*) BETWEEN 10 AND 1000 AS passed FROM orders")
_rules("recency", "events", [("recency", "RecencyCheck", {"field": "ts", "max_days_old": 1, "now": NOW})], f"SELECT 'recency' AS rule, 1::BIGINT AS total_count, (CASE WHEN date_diff('day',max(ts)::DATE,DATE '2024-02-01')<=1 THEN 0 ELSE 1 END)::BIGINT AS failed_count, date_diff('day',max(ts)::DATE,DATE '2024-02-01')<=1 AS passed FROM events")
_rules("freshness_data", "events", [("freshness_data", "FreshnessCheck", {"check_type": "data", "date_field": "ts", "max_age_hours": 30})], f"SELECT 'freshness_data' AS rule, 1::BIGINT AS total_count, (CASE WHEN epoch(TIMESTAMP '{NOW}')-epoch(max(ts))<=108000 THEN 0 ELSE 1 END)::BIGINT AS failed_count, epoch(TIMESTAMP '{NOW}')-epoch(max(ts))<=108000 AS passed FROM events")
_rules("conditional", "lineitem", [("conditional", "ConditionalValidation", {"then_validate": [{"type": "RangeCheck", "params": {"field": "l_tax", "max_value": 0.05}}], "else_validate": [{"type": "RangeCheck", "params": {"field": "l_discount", "max_value": 0.02}}]}, "l_quantity > 25")], "SELECT 'conditional' AS rule, count(*) AS total_count, sum(CASE WHEN l_quantity>25 THEN (l_tax>0.05)::INT ELSE (l_discount>0.02)::INT END)::BIGINT AS failed_count, sum(CASE WHEN l_quantity>25 THEN (l_tax>0.05)::INT ELSE (l_discount>0.02)::INT END)=0 AS passed FROM lineitem")

# --- schema rules --------------------------------------------------------------------------------------------------------
_rules("schema_match", "orders", [("schema_match", "SchemaMatchCheck", {"expected_schema": {"o_orderkey": "integer", "o_totalprice": "string", "o_gone": "any"}, "strict": True})], "SELECT 'schema_match' AS rule, 3::BIGINT AS total_count, 3::BIGINT AS failed_count, false AS passed")
_rules("column_presence", "orders", [("column_presence", "ColumnPresenceCheck", {"required_columns": ["O_ORDERKEY", "x"], "case_sensitive": False})], "SELECT 'column_presence' AS rule, 2::BIGINT AS total_count, 1::BIGINT AS failed_count, false AS passed")

# --- keys and joins ------------------------------------------------------------------------------------------------------
def _cross(name: str, table: str, kind: str, params: dict, total: str, failed: str, refs=None, passed: str | None = None) -> None:
    sql = f"SELECT '{name}' AS rule, ({total})::BIGINT AS total_count, ({failed})::BIGINT AS failed_count, {passed or f'({failed})=0'} AS passed"
    _rules(name, table, [(name, kind, params)], sql, refs=refs)


_some = {"ref": lambda get: get("customer").where("c_custkey % 10 <> 0")}
_cross("unique_key", "lineitem", "UniqueKeyCheck", {"fields": ["l_orderkey", "l_linenumber"]}, "SELECT count(*) FROM lineitem", "SELECT sum(n-1) FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey,l_linenumber)")
_cross("duplicate_row", "documents", "DuplicateRowCheck", {"key_fields": ["text"]}, "SELECT count(*) FROM documents", "SELECT sum(n-1) FROM (SELECT count(*) n FROM documents GROUP BY text)")
_cross("duplicate_all_fields", "labels", "DuplicateRowCheck", {"consider_all_fields": True}, "SELECT count(*) FROM labels", "SELECT count(*)-(SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) FROM labels")
_cross("referential", "orders", "ReferentialIntegrityCheck", {"foreign_key": "o_custkey", "reference_file": "ref", "reference_key": "c_custkey"}, "SELECT count(*) FROM orders", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%10<>0)", _some)
_cross("referential_clean", "orders", "ReferentialIntegrityCheck", {"foreign_key": "o_custkey", "reference_file": "c", "reference_key": "c_custkey", "allow_null": True}, "SELECT count(*) FROM orders", "SELECT 0", {"c": lambda get: get("customer")})
_cross("composite_key", "lineitem", "CrossFileKeyCheck", {"foreign_key": ["l_orderkey", "l_linenumber"], "reference_file": "l", "reference_key": ["l_orderkey", "l_linenumber"]}, "SELECT count(*) FROM lineitem", "SELECT count(*) FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity>25 AND a.l_orderkey=b.l_orderkey AND a.l_linenumber=b.l_linenumber)", {"l": lambda get: get("lineitem").where("l_quantity > 25")})
_cross("key_subset", "orders", "CrossFileKeyCheck", {"foreign_key": "o_custkey", "reference_file": "ref", "reference_key": "c_custkey", "check_mode": "subset"}, "SELECT count(*) FROM orders", "SELECT count(*) FROM orders WHERE o_custkey%10=0", _some)
_cross("key_overlap", "orders", "CrossFileKeyCheck", {"foreign_key": "o_custkey", "reference_file": "ref", "reference_key": "c_custkey", "check_mode": "overlap", "min_overlap_pct": 80}, "SELECT count(DISTINCT o_custkey) FROM orders", "SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey%10=0", _some, "true")
_cross("key_superset", "orders", "CrossFileKeyCheck", {"foreign_key": "o_custkey", "reference_file": "c", "reference_key": "c_custkey", "check_mode": "superset"}, "SELECT count(DISTINCT c_custkey) FROM customer", "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", {"c": lambda get: get("customer")})
_cross("cross_file_duplicate", "documents", "CrossFileDuplicateCheck", {"columns": ["doc_id"], "reference_files": ["labels"]}, "SELECT count(*) FROM documents", "SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", {"labels": lambda get: get("labels")})
for _how, _agg in (("count", "count(*)"), ("sum", "sum(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):
    _ok = f"(SELECT {_agg} FROM orders WHERE o_orderstatus='F') >= (SELECT {_agg} FROM orders WHERE o_orderstatus='O')-(SELECT abs({_agg})*0.5/100 FROM orders WHERE o_orderstatus='O')"
    _rules(f"comparison_{_how}", "orders", [(f"comparison_{_how}", "CrossFileComparisonCheck", {"aggregation": _how, "column": "o_totalprice", "comparison": ">=", "reference_file": "open", "tolerance_pct": 0.5}, "o_orderstatus == 'F'")], f"SELECT 'comparison_{_how}' AS rule, 1::BIGINT AS total_count, (CASE WHEN {_ok} THEN 0 ELSE 1 END)::BIGINT AS failed_count, {_ok} AS passed", refs={"open": lambda get: get("orders").where("o_orderstatus = 'O'")})
_cross("sql_custom", "orders", "SQLCustomCheck", {"sql_query": "SELECT o_orderkey FROM {data} WHERE o_totalprice > 300000"}, "SELECT count(*) FROM orders WHERE o_totalprice>300000", "SELECT count(*) FROM orders WHERE o_totalprice>300000")
_cross("db_constraint", "orders", "DatabaseConstraintCheck", {"table": "orders", "constraint_query": "SELECT c.c_custkey FROM {cust} c LEFT ANTI JOIN {data} o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal < 0"}, "SELECT count(*) FROM customer WHERE c_acctbal<0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT count(*) FROM customer WHERE c_acctbal<0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)", {"cust": lambda get: get("customer")})
_cross("db_referential", "orders", "DatabaseReferentialIntegrityCheck", {"foreign_key_table": "orders", "foreign_key_column": "o_custkey", "reference_table": "ref", "reference_key_column": "c_custkey"}, "SELECT count(*) FROM orders", "SELECT count(*) FROM orders WHERE o_custkey%10=0", {"orders": lambda get: get("orders"), **_some})

# --- statistics ----------------------------------------------------------------------------------------------------------
_z = "WITH s AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) d FROM customer)"
_rules("zscore", "customer", [("zscore", "StatisticalOutlierCheck", {"field": "c_acctbal", "method": "zscore", "threshold": 1.5})], f"{_z} SELECT 'zscore' AS rule, count(*) AS total_count, sum((abs(c_acctbal-m)>1.5*d)::INT)::BIGINT AS failed_count, sum((abs(c_acctbal-m)>1.5*d)::INT)=0 AS passed FROM customer, s")
_q = "WITH s AS (SELECT quantile_cont(l_extendedprice,0.25) q1, quantile_cont(l_extendedprice,0.75) q3 FROM lineitem)"
_out = "l_extendedprice<q1-0.5*(q3-q1) OR l_extendedprice>q3+0.5*(q3-q1)"
_rules("iqr", "lineitem", [("iqr", "StatisticalOutlierCheck", {"field": "l_extendedprice", "method": "iqr", "threshold": 0.5})], f"{_q} SELECT 'iqr' AS rule, count(*) AS total_count, sum(({_out})::INT)::BIGINT AS failed_count, sum(({_out})::INT)=0 AS passed FROM lineitem, s")
_m = "WITH a AS (SELECT median(value) m FROM events), b AS (SELECT median(abs(value-m)) d FROM events, a)"
_rules("modified_zscore", "events", [("modified_zscore", "AdvancedAnomalyDetectionCheck", {"column": "value", "method": "modified_zscore", "threshold": 3.5, "max_anomaly_pct": 2})], f"{_m} SELECT 'modified_zscore' AS rule, count(*) AS total_count, sum((abs(0.6745*(value-m)/d)>3.5)::INT)::BIGINT AS failed_count, 100.0*sum((abs(0.6745*(value-m)/d)>3.5)::INT)/count(*)<=2 AS passed FROM events,a,b")
_frame("spearman", "orders", lambda d: _spearman(d), "WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice)+(count(*) OVER (PARTITION BY o_totalprice)-1)/2.0 a, rank() OVER (ORDER BY o_custkey)+(count(*) OVER (PARTITION BY o_custkey)-1)/2.0 b FROM orders) SELECT round(corr(a,b),6) AS r FROM r")


def _spearman(d: DataFrame) -> DataFrame:
    from .operators.stat_rules import average_ranks

    p = d.select(F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return p.join(average_ranks(p, "a"), "a").join(average_ranks(p, "b"), "b").agg(F.round(F.corr("rank_a", "rank_b"), 6).alias("r"))


def _ks(kind: str) -> Callable[[DataFrame], DataFrame]:
    def f(d: DataFrame) -> DataFrame:
        stat, n = ks_statistic(d, "l_quantity", kind)
        return d.sparkSession.createDataFrame([(n, round(stat, 5))], "n long, d double")

    return f


_ecdf = "WITH c AS (SELECT l_quantity::DOUBLE x, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT x, n, sum(n) OVER (ORDER BY x)-n b, sum(n) OVER () t, min(x) OVER () lo, max(x) OVER () hi FROM c)"
_frame("ks_uniform", "lineitem", _ks("uniform"), f"{_ecdf} SELECT max(t)::BIGINT AS n, round(max(greatest((b+n)/t-(x-lo)/(hi-lo),(x-lo)/(hi-lo)-b/t)),5) AS d FROM r")
_frame("ks_exponential", "lineitem", _ks("exponential"), f"{_ecdf}, m AS (SELECT avg(l_quantity) a FROM lineitem) SELECT max(t)::BIGINT AS n, round(max(greatest((b+n)/t-(1-exp(-x/a)),(1-exp(-x/a))-b/t)),5) AS d FROM r, m")
_frame("ks_normal", "lineitem", _ks("normal"), None)
_base = {"base": lambda get: get("events").groupBy(F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))}
_b = "WITH d AS (SELECT ts::DATE dt, sum(value) v FROM events GROUP BY 1), m AS (SELECT avg(v) FILTER (WHERE date_diff('day',dt,DATE '2024-02-01') BETWEEN 0 AND 10) b FROM d), s AS (SELECT sum(value) c FROM events WHERE user_id<>0)"
_rules("baseline", "events", [("baseline", "BaselineComparisonCheck", {"metric": "sum", "column": "value", "baseline_file": "base", "lookback_days": 10, "tolerance_pct": 5}, "user_id != 0")], f"{_b} SELECT 'baseline' AS rule, 1::BIGINT AS total_count, (CASE WHEN 100*abs(c-b)/abs(b)<=5 THEN 0 ELSE 1 END)::BIGINT AS failed_count, 100*abs(c-b)/abs(b)<=5 AS passed FROM m,s", refs=_base)
_rules("trend_rule", "events", [("trend_rule", "TrendDetectionCheck", {"metric": "sum", "column": "value", "baseline_file": "base", "comparison_period": 5, "max_growth_pct": 50})], "WITH d AS (SELECT sum(value) v FROM events WHERE ts::DATE=DATE '2024-01-27'), s AS (SELECT sum(value) c FROM events) SELECT 'trend_rule' AS rule, 1::BIGINT AS total_count, (CASE WHEN 100*(c-v)/abs(v)<=50 THEN 0 ELSE 1 END)::BIGINT AS failed_count, 100*(c-v)/abs(v)<=50 AS passed FROM d,s", refs=_base)
_gap = "WITH t AS (SELECT DISTINCT ts FROM events), g AS (SELECT (epoch_us(ts)-epoch_us(lag(ts) OVER (ORDER BY ts)))/1e6 s FROM t), h AS (SELECT s FROM g WHERE s IS NOT NULL)"
_rules("temporal_gap", "events", [("temporal_gap", "TemporalGapCheck", {"field": "ts", "max_gap": 900})], f"{_gap} SELECT 'temporal_gap' AS rule, count(*) AS total_count, sum((s>900)::INT)::BIGINT AS failed_count, sum((s>900)::INT)=0 AS passed FROM h")
_rules("temporal_frequency", "events", [("temporal_frequency", "TemporalFrequencyCheck", {"field": "ts"})], f"{_gap}, m AS (SELECT median(s) b FROM h) SELECT 'temporal_frequency' AS rule, count(*) AS total_count, sum((abs(s-b)>0.2*b)::INT)::BIGINT AS failed_count, sum((abs(s-b)>0.2*b)::INT)=0 AS passed FROM h,m")

# --- profiles ------------------------------------------------------------------------------------------------------------
_NUM = ("l_quantity", "l_extendedprice", "l_discount")
_frame("numeric_profile", "lineitem", lambda d: P.numeric_profile(d, list(_NUM)), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS \"distinct\", round(min({c}),4) AS low, round(max({c}),4) AS high, round(avg({c}),4) AS mean, round(stddev_pop({c}),4) AS sd, " + ", ".join(f"round(quantile_cont({c},{q}),4) AS {k}" for k, q in (("p01", 0.01), ("p05", 0.05), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p95", 0.95), ("p99", 0.99))) + " FROM lineitem" for c in _NUM))
_frame("shape", "lineitem", lambda d: P.shape(d, list(_NUM)), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(skewness({c}),4) AS skewness, round(kurtosis({c}),4) AS kurtosis FROM lineitem" for c in _NUM))
_frame("null_kinds", "orders", lambda d: P.null_kinds(d.select(F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.when(F.col("o_orderstatus") == "F", " N/A ").when(F.col("o_orderstatus") == "O", "  ").otherwise("x").alias("b")), ["a", "b"]), "SELECT 'a' AS \"column\", count(*) AS total, sum((o_orderstatus='P')::INT)::BIGINT AS nulls, 0::BIGINT AS blanks, 0::BIGINT AS placeholders FROM orders UNION ALL SELECT 'b', count(*), 0, sum((o_orderstatus='O')::INT)::BIGINT, sum((o_orderstatus='F')::INT)::BIGINT FROM orders")
_frame("string_lengths", "part", lambda d: P.string_lengths(d, ["p_name", "p_type"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min(length({c}))::INT AS shortest, max(length({c}))::INT AS longest, round(avg(length({c})),4) AS mean FROM part" for c in ("p_name", "p_type")))
_frame("top_values", "lineitem", lambda d: P.top_values(d, ["l_returnflag", "l_linenumber"], 3), "WITH v AS (SELECT 'l_returnflag' c, l_returnflag v, count(*) n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) k FROM v) SELECT c AS \"column\", k::INT AS rank, v AS value, n FROM r WHERE k<=3")
_frame("char_patterns", "customer", lambda d: P.pattern_histogram(d, "c_name"), "SELECT regexp_replace(regexp_replace(left(c_name,50),'[0-9]','9','g'),'[A-Za-z]','A','g') AS pattern, count(*) AS n FROM customer GROUP BY 1")
_frame("compressed_patterns", "part", lambda d: P.pattern_histogram(d, "p_brand", P.compressed_pattern), "SELECT regexp_replace(regexp_replace(left(p_brand,50),'[A-Za-z]+','A+','g'),'[0-9]+','9+','g') AS pattern, count(*) AS n FROM part GROUP BY 1")
_frame("format_anomalies", "orders", lambda d: P.format_anomalies(d.withColumn("x", F.when(F.col("o_orderkey") % 50 == 0, "bad").otherwise(F.concat(F.lit("ok"), F.col("o_orderkey").cast("string")))), "x"), "SELECT 'A+' AS pattern, count(*) AS n FROM orders WHERE o_orderkey%50=0")
_frame("type_counts", "orders", lambda d: P.type_counts(d.select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("1.5").alias("b"), F.to_date("o_orderdate").alias("c"), F.col("o_orderpriority").alias("d")), ["a", "b", "c", "d"]), "SELECT 'a' AS \"column\", count(*) AS \"integer\", 0::BIGINT AS \"float\", 0::BIGINT AS \"boolean\", 0::BIGINT AS \"date\", 0::BIGINT AS \"string\", 0::BIGINT AS \"null\" FROM orders UNION ALL SELECT 'b',0,sum((o_orderkey%2<>0)::INT)::BIGINT,sum((o_orderkey%2=0)::INT)::BIGINT,0,0,0 FROM orders UNION ALL SELECT 'c',0,0,0,count(*),0,0 FROM orders UNION ALL SELECT 'd',0,0,0,0,count(*),0 FROM orders")
_frame("quality_score", "customer", lambda d: P.quality_score(d.select("c_name", "c_mktsegment"), ["c_name", "c_mktsegment"]), "SELECT c AS \"column\", 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS validity, 1.0::DOUBLE AS consistency, 100.0::DOUBLE AS score FROM (VALUES ('c_name'),('c_mktsegment')) t(c)")
_frame("histogram", "lineitem", lambda d: P.histogram(d, "l_extendedprice"), "WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) SELECT least(floor((l_extendedprice-lo)/((hi-lo)/20)),19)::INT AS bin, count(*) AS n FROM lineitem,s GROUP BY 1")
_frame("pattern_counts", "orders", lambda d: P.pattern_counts(d.select(F.to_date("o_orderdate").alias("a"), F.lpad(F.col("o_custkey").cast("string"), 5, "0").alias("b")), ["a", "b"]).select("column", "date_iso", "zip", "email"), "SELECT 'a' AS \"column\", count(*) AS date_iso, 0::BIGINT AS zip, 0::BIGINT AS email FROM orders UNION ALL SELECT 'b', 0, count(*), 0 FROM orders")
_frame("email_redaction", "documents", lambda d: d.where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9]")).select("doc_id", F.regexp_count(P.redact(F.col("text")), F.lit(r"\*\*\*@")).cast("long").alias("masked")), "SELECT doc_id, len(regexp_extract_all(text,'[A-Za-z0-9._%+-][A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})'))::BIGINT AS masked FROM documents WHERE regexp_matches(text,'[A-Za-z0-9]@[A-Za-z0-9]')")
_frame("luhn", "orders", lambda d: d.agg(F.count_if(P.luhn(F.col("o_orderkey").cast("string"))).alias("valid"), F.count(F.lit(1)).alias("n")), "WITH d AS (SELECT o_orderkey k, unnest(range(1,length(o_orderkey::VARCHAR)+1)) i, o_orderkey::VARCHAR s FROM orders), e AS (SELECT k, (length(s)-i)%2 odd, substr(s,i::INT,1)::INT v FROM d), f AS (SELECT k, sum(CASE WHEN odd=0 THEN v WHEN v>4 THEN 2*v-9 ELSE 2*v END) t FROM e GROUP BY k) SELECT (SELECT count(*) FROM orders o JOIN f ON o.o_orderkey=f.k WHERE t%10=0) AS valid, (SELECT count(*) FROM orders) AS n")

# --- associations and anomalies ------------------------------------------------------------------------------------------
_frame("pearson_matrix", "lineitem", lambda d: A.pearson(d, list(_NUM)), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),4) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
_frame("regression", "lineitem", lambda d: A.regression(d, "l_quantity", "l_extendedprice"), "SELECT round(regr_slope(l_extendedprice,l_quantity),4) AS slope, round(regr_intercept(l_extendedprice,l_quantity),2) AS intercept, round(regr_r2(l_extendedprice,l_quantity),4) AS r2, round(stddev_pop(l_extendedprice)*sqrt(1-regr_r2(l_extendedprice,l_quantity)),2) AS residual_sd FROM lineitem")
_tab = "WITH t AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE n FROM lineitem GROUP BY 1,2), r AS (SELECT a, sum(n) na FROM t GROUP BY 1), c AS (SELECT b, sum(n) nb FROM t GROUP BY 1)"
_frame("cramers_v", "lineitem", lambda d: A.cramers_v(d, "l_returnflag", "l_linestatus"), f"{_tab}, x AS (SELECT sum(n) t, sum(n*n/(na*nb)) s, count(DISTINCT a) ca, count(DISTINCT b) cb FROM t JOIN r USING(a) JOIN c USING(b)) SELECT round(t*(s-1),4) AS chi2, round(sqrt(greatest(0,t*(s-1))/(t*(least(ca,cb)-1))),6) AS v FROM x")
_frame("mutual_information", "lineitem", lambda d: A.mutual_information(d, "l_returnflag", "l_linestatus"), f"{_tab}, g AS (SELECT sum(n) t FROM t) SELECT round(sum(n/g.t*ln(n*g.t/(na*nb))),6) AS mi FROM t JOIN r USING(a) JOIN c USING(b), g")
_frame("correlation_ratio", "part", lambda d: A.correlation_ratio(d, "p_size", "p_retailprice"), "WITH g AS (SELECT p_size, count(*) n, avg(p_retailprice) m, var_pop(p_retailprice) v FROM part GROUP BY 1), t AS (SELECT sum(n*m)/sum(n) mu, sum(n*v) w, sum(n) n FROM g), b AS (SELECT sum(g.n*(m-mu)*(m-mu)) b FROM g,t) SELECT round(b/(b+w),6) AS eta2 FROM b,t")
_frame("class_statistics", "lineitem", lambda d: A.class_statistics(d, "l_returnflag", "l_quantity"), "SELECT l_returnflag AS category, count(*) AS n, round(avg(l_quantity),4) AS mean, round(stddev_pop(l_quantity),4) AS sd, round(quantile_cont(l_quantity,0.25),4) AS q1, round(quantile_cont(l_quantity,0.5),4) AS median, round(quantile_cont(l_quantity,0.75),4) AS q3 FROM lineitem GROUP BY 1")
_frame("cohens_d", "orders", lambda d: A.cohens_d(d, "o_orderstatus", "o_totalprice", "F", "O"), "WITH g AS (SELECT o_orderstatus s, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1) SELECT round((a.m-b.m)/sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2)),6) AS d FROM g a, g b WHERE a.s='F' AND b.s='O'")
_frame("point_biserial", "lineitem", lambda d: A.point_biserial(d, F.col("l_returnflag") == "R", "l_quantity"), "SELECT round(corr((l_returnflag='R')::INT::DOUBLE,l_quantity),6) AS r FROM lineitem")
_frame("functional_dependency", "lineitem", lambda d: A.functional_dependency(d, "l_partkey", "l_suppkey"), "WITH g AS (SELECT l_partkey, count(*) n, count(DISTINCT l_suppkey) k FROM lineitem GROUP BY 1 HAVING count(*)>=5) SELECT count(*) AS sources, coalesce(sum((k=1)::INT),0)::BIGINT AS determined FROM g")
_frame("co_missing", "orders", lambda d: A.co_missing(d.select(F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("b")), ["a", "b"]), "SELECT 'a' AS a, 'b' AS b, round(sum((o_orderstatus='P' AND NOT o_totalprice>100000)::INT)/sum((o_orderstatus='P' OR NOT o_totalprice>100000)::INT),6) AS jaccard FROM orders")
_frame("missing_by_class", "orders", lambda d: A.missing_by_class(d.withColumn("x", F.when(F.col("o_totalprice") > 100000, 1)), "x", "o_orderpriority"), "SELECT o_orderpriority AS target, count(*) AS n, round(avg((NOT o_totalprice>100000)::INT),6) AS missing_rate FROM orders GROUP BY 1")
_frame("near_duplicates", "customer", lambda d: A.near_duplicates(d.select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("s")), "s"), "SELECT lower(c_mktsegment) AS form, count(*) AS n, 2::BIGINT AS spellings FROM customer GROUP BY 1")
_frame("rare_categories", "events", lambda d: A.rare_categories(d, "event_type", 0.2), "WITH g AS (SELECT event_type v, count(*) n FROM events GROUP BY 1) SELECT v AS value, n FROM g WHERE n<0.2*(SELECT sum(n) FROM g)")
_frame("benford", "orders", lambda d: A.benford(d, "o_totalprice"), "WITH g AS (SELECT left(ltrim(replace((abs(o_totalprice))::VARCHAR,'.',''),'0'),1)::INT d, count(*) n FROM orders WHERE o_totalprice<>0 GROUP BY 1) SELECT d AS digit, n, round((SELECT sum(n) FROM g)*log10(1+1/d),4) AS expected FROM g")
_frame("ratio_outliers", "lineitem", lambda d: A.ratio_outliers(d, "l_extendedprice", "l_quantity"), "WITH r AS (SELECT l_extendedprice/l_quantity r FROM lineitem WHERE l_quantity<>0), q AS (SELECT quantile_cont(r,0.25) a, quantile_cont(r,0.75) b FROM r) SELECT count(*) AS n, sum((r>b+3*(b-a) OR r<greatest(a-3*(b-a),0.001))::INT)::BIGINT AS outliers FROM r,q")
_frame("correlation_breaks", "lineitem", lambda d: A.correlation_breaks(d, "l_quantity", "l_extendedprice"), "WITH m AS (SELECT regr_slope(l_extendedprice,l_quantity) s, regr_intercept(l_extendedprice,l_quantity) i FROM lineitem), r AS (SELECT abs(l_extendedprice-(s*l_quantity+i)) r FROM lineitem,m), e AS (SELECT quantile_cont(r,0.99) p FROM r) SELECT count(*) AS n, sum((r>p)::INT)::BIGINT AS breaks FROM r,e")
_frame("drift", "orders", lambda d: A.drift(d.where("o_orderkey % 2 = 0"), d.where("o_orderkey % 2 = 1 AND o_totalprice > 50000"), "o_totalprice"), "WITH a AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders WHERE o_orderkey%2=0), b AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders WHERE o_orderkey%2=1 AND o_totalprice>50000) SELECT round(abs(b.m-a.m)/a.s+abs(ln(b.s/a.s)),6) AS drift FROM a,b")

# --- time ----------------------------------------------------------------------------------------------------------------
_frame("calendar", "events", lambda d: X.calendar(d, "ts"), " UNION ALL ".join(f"SELECT '{u}' AS unit, {e}::INT AS slot, count(*) AS n FROM events GROUP BY 2" for u, e in (("hour", "hour(ts)"), ("weekday", "isodow(ts)-1"), ("month", "month(ts)"), ("quarter", "quarter(ts)"))))
_frame("temporal_red_flags", "events", lambda d: X.red_flags(d, "ts"), "SELECT round(avg((hour(ts)=0 AND minute(ts)=0 AND second(ts)=0)::INT),6) AS midnight, round(avg((isodow(ts)>=6)::INT),6) AS weekend, round(avg((hour(ts) BETWEEN 9 AND 16)::INT),6) AS business_hours FROM events")
_frame("gap_summary", "events", lambda d: X.gap_summary(d, "ts"), f"{_gap}, m AS (SELECT median(s) b FROM h) SELECT count(*) AS intervals, sum((s>2*b)::INT)::BIGINT AS gaps, round(max(s),3) AS longest FROM h,m")
_frame("daily_trend", "events", lambda d: X.trend(d, "ts", F.col("value")), "WITH d AS (SELECT ts::DATE d, avg(value) v FROM events GROUP BY 1) SELECT round(regr_slope(v,date_diff('day',DATE '1970-01-01',d)),6) AS slope, round(regr_r2(v,date_diff('day',DATE '1970-01-01',d)),6) AS r2 FROM d")
_frame("autocorrelation", "events", lambda d: X.autocorrelation(d, "ts"), "WITH d AS (SELECT ts::DATE d, count(*)::DOUBLE v FROM events GROUP BY 1), l AS (SELECT unnest(range(1,8)) k) SELECT k::INT AS lag, round(corr(a.v,b.v),6) AS r FROM d a, l, d b WHERE b.d=a.d+k::INT GROUP BY 1")


# --- findings ------------------------------------------------------------------------------------------------------------
_frame("outlier_methods", "orders", lambda d: I.outlier_methods(d, "o_totalprice"), "WITH m AS (SELECT avg(o_totalprice) a, stddev_samp(o_totalprice) s, quantile_cont(o_totalprice,0.25) q1, median(o_totalprice) q2, quantile_cont(o_totalprice,0.75) q3 FROM orders), k AS (SELECT median(abs(o_totalprice-q2)) mad FROM orders,m), r AS (SELECT abs(o_totalprice-a)>3*s z, (o_totalprice<q1-1.5*(q3-q1) OR o_totalprice>q3+1.5*(q3-q1)) i, abs(0.6745*(o_totalprice-q2)/mad)>3.5 o FROM orders,m,k) SELECT sum(z::INT)::BIGINT AS zscore, sum(i::INT)::BIGINT AS iqr, sum(o::INT)::BIGINT AS modified, sum((z OR i OR o)::INT)::BIGINT AS \"any\", sum((z AND i AND o)::INT)::BIGINT AS \"all\" FROM r")
_frame("length_anomalies", "documents", lambda d: I.length_anomalies(d, "text").groupBy("size").agg(F.count(F.lit(1)).alias("n")), "WITH m AS (SELECT avg(length(text)) a, stddev_pop(length(text)) s FROM documents) SELECT length(text)::INT AS size, count(DISTINCT text) AS n FROM documents,m WHERE abs(length(text)-a)>3*s GROUP BY 1")
_frame("proportion_gap", "orders", lambda d: I.proportion_gap(d, "o_orderpriority", "o_orderstatus", "F", "O"), "WITH g AS (SELECT o_orderpriority c, sum((o_orderstatus='F')::INT) a, sum((o_orderstatus='O')::INT) b FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1), t AS (SELECT sum(a) na, sum(b) nb FROM g) SELECT c AS category, round(a/na,6) AS first, round(b/nb,6) AS second, round(abs(a/na-b/nb),6) AS gap FROM g,t")
_frame("key_candidates", "orders", lambda d: I.key_candidates(d, ["o_orderkey", "o_custkey", "o_orderstatus"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS \"distinct\", (count(*)-count({c})) AS nulls, count(DISTINCT {c})=count(*) AS is_key FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
_frame("self_reference", "customer", lambda d: I.self_reference(d.withColumn("parent", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 2)), "parent", "c_custkey"), "SELECT count(*) AS rows, sum((c_custkey*2 NOT IN (SELECT c_custkey FROM customer))::INT)::BIGINT AS orphans, count(DISTINCT CASE WHEN c_custkey*2 NOT IN (SELECT c_custkey FROM customer) THEN c_custkey*2 END) AS distinct_orphans FROM customer WHERE c_custkey%3=0")
_frame("category_sample", "orders", lambda d: I.category_sample(d, "o_orderstatus", "o_orderkey", 25).select("o_orderstatus", "o_orderkey"), "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 25")
_frame("log_histogram", "orders", lambda d: P.histogram(d, "o_totalprice", 30, log=True), "WITH x AS (SELECT log10(o_totalprice) x FROM orders WHERE o_totalprice>0), m AS (SELECT min(x) a, max(x) b FROM x) SELECT least(floor((x-a)/((b-a)/30)),29)::INT AS bin, count(*) AS n FROM x,m GROUP BY 1")
_rules("pearson", "part", [("pearson", "CorrelationCheck", {"column1": "p_partkey", "column2": "p_retailprice", "min_correlation": 0.5})], "SELECT 'pearson' AS rule, count(*) AS total_count, (corr(p_partkey,p_retailprice)<0.5)::INT::BIGINT AS failed_count, corr(p_partkey,p_retailprice)>=0.5 AS passed FROM part")
_rules("kendall", "part", [("kendall", "CorrelationCheck", {"column1": "p_size", "column2": "p_retailprice", "correlation_type": "kendall", "min_correlation": 0.01})], "WITH p AS (SELECT sum(sign(a.p_size-b.p_size)*sign(a.p_retailprice-b.p_retailprice)) s, sqrt(sum((a.p_size<>b.p_size)::INT))*sqrt(sum((a.p_retailprice<>b.p_retailprice)::INT)) d FROM part a, part b) SELECT 'kendall' AS rule, (SELECT count(*) FROM part) AS total_count, (s/d<0.01)::INT::BIGINT AS failed_count, s/d>=0.01 AS passed FROM p")


# --- without an equivalent in SQL ---------------------------------------------------------------------------------------
def _forest(d: DataFrame) -> DataFrame:
    from .operators.forest import isolation_scores

    return isolation_scores(d.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")), ["o_totalprice", "o_custkey"]).select("o_orderkey", "score", "anomaly")


_frame("isolation_forest", "orders", _forest, None)
