"""A query for every operator of the dialect, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.types import DURATION, seconds

FLAGSHIP = """
select l_returnflag l_linestatus count(*) as n sum(l_quantity) as qty avg(l_extendedprice) as price
from lineitem where l_shipdate < '1998-09-02' group by l_returnflag l_linestatus order by l_returnflag asc
"""

#: name: (query, SQL). Float sums and means depend on the order of additions, so both sides round them in `ROUNDED`.
PAIRS: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "select l_returnflag, l_linestatus, count(*)::double as n, round(sum(l_quantity), 4) as qty, round(avg(l_extendedprice), 4) as price from lineitem where l_shipdate < '1998-09-02' group by all"),
    "scan_star_limit": ("select top 3 * from region order by r_regionkey", "select r_regionkey::bigint as r_regionkey, r_name from region order by r_regionkey desc limit 3"),
    "scan_empty_select": ("select from nation", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation"),
    "project_no_commas": ("select c_custkey c_name, c_acctbal from customer", "select c_custkey, c_name, c_acctbal from customer"),
    "project_alias": ("select l_orderkey l_linenumber rev = l_extendedprice*(1-l_discount) l_tax as tax from lineitem", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_extendedprice*(1-l_discount) as rev, l_tax as tax from lineitem"),
    "project_unnamed": ("select s_suppkey s_acctbal * 2 s_nationkey + 1 from supplier", "select s_suppkey, s_acctbal * 2 as col2, s_nationkey + 1 as col3 from supplier"),
    "project_ordinals": ("select c1 c3 C_NAME from customer where c3 < 5", "select c_custkey, c_nationkey::bigint as c_nationkey, c_name from customer where c_nationkey < 5"),
    "project_numbers": ("c select 1 3 '7' as seven from customer where 3 > '20'", "select c_custkey, c_nationkey::bigint as c_nationkey, 7::bigint as seven from customer where c_nationkey > 20"),
    "project_qualified": ("select n.n_name, n.n_regionkey as r from nation n where n.n_regionkey = 2", "select n_name, n_regionkey::bigint as r from nation where n_regionkey = 2"),
    "literal_barewords": ("select o_orderkey kind = fast five = 5 half = .5 day = '6/1/2017' from orders where o_orderstatus = F", "select o_orderkey, 'fast' as kind, 5::bigint as five, 0.5::double as half, timestamp '2017-06-01' as day from orders where o_orderstatus = 'F'"),
    "arith_right_assoc": ("select l_orderkey l_linenumber a = l_quantity - l_linenumber - 1 b = l_quantity / l_linenumber / 2 from lineitem", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity - (l_linenumber - 1) as a, l_quantity / (l_linenumber / 2.0) as b from lineitem"),
    "arith_power": ("select p_partkey a = p_size ^ 2 b = 2 * p_size ^ 2 d = -p_size ^ 2 e = 2 ^ 3 * 2 from part", "select p_partkey, (p_size * p_size)::bigint as a, (2 * p_size * p_size)::bigint as b, (p_size * p_size)::bigint as d, 64::bigint as e from part"),
    "int_div_mod": ("select p_partkey a = p_size / 3 b = p_size % 3 d = p_size / 0 e = p_size % 0 from part", "select p_partkey, (p_size // 3)::bigint as a, (p_size % 3)::bigint as b, null::bigint as d, null::bigint as e from part"),
    "arith_negation": ("select s_suppkey a = -s_acctbal b = 20-s_nationkey d = (-s_suppkey)+s_nationkey from supplier", "select s_suppkey, -s_acctbal as a, (20 - s_nationkey)::bigint as b, -s_suppkey + s_nationkey as d from supplier"),
    "string_concat_minus": ("select n_nationkey a = n_name + '-x' b = n_name - '-x' from nation", "select n_nationkey::bigint as n_nationkey, n_name || '-x' as a, n_name as b from nation"),
    "where_cmp": ("select o_orderkey from orders where o_totalprice >= 100000 and o_orderpriority <> '1-URGENT'", "select o_orderkey from orders where o_totalprice >= 100000 and o_orderpriority <> '1-URGENT'"),
    "where_chain": ("select o_orderkey from orders where o_orderstatus = F and o_totalprice > 200000 or o_orderpriority = '2-HIGH'", "select o_orderkey from orders where o_orderstatus = 'F' and (o_totalprice > 200000 or o_orderpriority = '2-HIGH')"),
    "where_parens": ("select o_orderkey from orders where (o_orderstatus = F and ((o_totalprice) > 200000)) or (o_orderpriority = '2-HIGH')", "select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 200000) or o_orderpriority = '2-HIGH'"),
    "not_chain": ("select o_orderkey from orders where not o_orderstatus = F and o_totalprice > 100000", "select o_orderkey from orders where not (o_orderstatus = 'F' and o_totalprice > 100000)"),
    "not_infix": ("select p_partkey from part where p_size !< 10 and p_name not like '%a%' and ! p_size = 20", "select p_partkey from part where not p_size < 10 and (not p_name ilike '%a%' and not p_size = 20)"),
    "xor": ("select o_orderkey from orders where o_orderstatus = F xor o_totalprice > 150000", "select o_orderkey from orders where (o_orderstatus = 'F') <> (o_totalprice > 150000)"),
    "between_half_open": ("select l_orderkey l_linenumber from lineitem where l_quantity between 10 and 20", "select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 20"),
    "between_reversed": ("select l_orderkey l_linenumber from lineitem where l_quantity not between 40 and 5", "select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem where not (l_quantity >= 5 and l_quantity < 40)"),
    "between_dates": ("select o_orderkey from orders where o_orderdate between '1/1/1995' and 'june 30 1996'", "select o_orderkey from orders where o_orderdate >= '1995-01-01' and o_orderdate < '1996-06-30'"),
    "like_ci": ("select p_partkey p_name from part where p_name like '%A_e%'", "select p_partkey, p_name from part where p_name ilike '%a_e%'"),
    "like_number": ("select p_partkey from part where p_size like '1_'", "select p_partkey from part where p_size::varchar like '1_'"),
    "in_list": ("select p_partkey from part where p_size in (1, 5 9) and p_brand not in ('Brand#11', 'Brand#12')", "select p_partkey from part where p_size in (1, 5, 9) and p_brand not in ('Brand#11', 'Brand#12')"),
    "in_expressions": ("select l_orderkey l_linenumber from lineitem where l_quantity in (l_linenumber, l_linenumber * 2)", "select l_orderkey, l_linenumber::bigint as l_linenumber from lineitem where l_quantity in (l_linenumber, l_linenumber * 2)"),
    "null_eq": ("select p_partkey from part where case when p_size > 25 then p_size end = null", "select p_partkey from part where case when p_size > 25 then p_size end is null"),
    "null_ne": ("select p_partkey from part where case when p_size > 25 then p_size end <> 30", "select p_partkey from part where case when p_size > 25 then p_size end is distinct from 30"),
    "null_lt_ge": ("select p_partkey from part where case when p_size > 25 then p_size end < 30 or case when p_size < 10 then p_size end >= null", "select p_partkey from part where (p_size > 25 and p_size < 30) or p_size <= 25 or p_size < 10"),
    "null_between": ("select p_partkey from part where case when p_size > 25 then p_size end not between 30 and 40", "select p_partkey from part where p_size > 25 and not (p_size >= 30 and p_size < 40)"),
    "case_searched": ("select p_partkey size = case when p_size < 10 then small when p_size < 30 then medium else large end from part", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size from part"),
    "case_simple": ("select o_orderkey s = case o_orderstatus when F then 1 when O then 2.5 end from orders", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2.5 end::double as s from orders"),
    "case_predicate": ("select o_orderkey from orders where case o_orderstatus when F then 1 when O then 2 else 3 end = case when o_totalprice > 100000 then 1 else 2 end", "select o_orderkey from orders where case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end = case when o_totalprice > 100000 then 1 else 2 end"),
    "coalesce": ("select p_partkey v = coalesce(case when p_size > 40 then p_size end case when p_size < 5 then 0 end, -1) from part", "select p_partkey, case when p_size > 40 then p_size when p_size < 5 then 0 else -1 end::bigint as v from part"),
    "group_sum_avg": ("select o_orderpriority total = sum(o_totalprice) mean = avg(o_totalprice) from orders group by o_orderpriority", "select o_orderpriority, round(sum(o_totalprice), 4) as total, round(avg(o_totalprice), 4) as mean from orders group by all"),
    "group_min_max": ("select p_brand lo = min(p_size) hi = max(p_retailprice) name = min(p_name) from part group by p_brand", "select p_brand, min(p_size)::bigint as lo, max(p_retailprice) as hi, min(p_name) as name from part group by all"),
    "group_count": ("select n_regionkey n = count(*) named = count(case when n_nationkey > 10 then n_name end) from nation group by n_regionkey", "select n_regionkey::bigint as n_regionkey, count(*)::double as n, count(case when n_nationkey > 10 then n_name end)::double as named from nation group by all"),
    "group_stdev": ("select l_returnflag s = stdev(l_quantity) p = stdevp(l_quantity) from lineitem group by l_returnflag", "select l_returnflag, round(stddev_samp(l_quantity), 4) as s, round(stddev_pop(l_quantity), 4) as p from lineitem group by all"),
    "group_int_sum": ("select l_returnflag total = sum(l_linenumber) mean = avg(l_linenumber) from lineitem group by l_returnflag", "select l_returnflag, sum(l_linenumber)::bigint as total, round(avg(l_linenumber), 4) as mean from lineitem group by all"),
    "group_two_keys": ("select l_returnflag l_linestatus n = count(*) from lineitem group by l_returnflag l_linestatus", "select l_returnflag, l_linestatus, count(*)::double as n from lineitem group by all"),
    "group_expression": ("select m = month(o_orderdate) n = count(*) from orders group by month(o_orderdate)", "select month(o_orderdate)::bigint as m, count(*)::double as n from orders group by all"),
    "group_no_aggregate": ("select c_mktsegment from customer group by c_mktsegment", "select distinct c_mktsegment from customer"),
    "group_null_key": ("select k = case when p_size > 40 then p_size end n = count(*) from part group by case when p_size > 40 then p_size end", "select case when p_size > 40 then p_size end::bigint as k, count(*)::double as n from part group by all"),
    "global_aggregate": ("select n = count(*) lo = min(c_acctbal) hi = max(c_name) from customer", "select count(*)::double as n, min(c_acctbal) as lo, max(c_name) as hi from customer"),
    "global_empty": ("select n = count(*) lo = min(c_acctbal) from customer where c_custkey < 0", "select count(*)::double as n, min(c_acctbal) as lo from customer where c_custkey < 0"),
    "group_having": ("select c_nationkey n = count(*) from customer group by c_nationkey having count(*) between 50 and 70 and max(c_acctbal) > 100", "select c_nationkey::bigint as c_nationkey, count(*)::double as n from customer group by all having count(*) >= 50 and count(*) < 70 and max(c_acctbal) > 100"),
    "group_expr_agg": ("select p_brand v = max(p_size) * 2 + min(p_size) from part group by p_brand", "select p_brand, (max(p_size) * 2 + min(p_size))::bigint as v from part group by all"),
    "group_order_top": ("select top 7 o_custkey total = sum(o_orderkey) from orders group by o_custkey order by sum(o_orderkey)", "select o_custkey, sum(o_orderkey)::bigint as total from orders group by all order by total desc limit 7"),
    "agg_distinct": ("select n = count(distinct c_mktsegment) s = sum(distinct c_nationkey) a = avg(distinct c_nationkey) from customer", "select count(distinct c_mktsegment)::double as n, sum(distinct c_nationkey)::bigint as s, round(avg(distinct c_nationkey), 4) as a from customer"),
    "agg_distinct_grouped": ("select p_brand n = count(distinct p_size) from part group by p_brand", "select p_brand, count(distinct p_size)::double as n from part group by all"),
    "last_value_group": ("select o_orderstatus n = count(*) o_orderkey o_totalprice from orders group by o_orderstatus", "select o_orderstatus, count(*)::double as n, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by all"),
    "distinct_on": ("select distinct o_orderpriority o_orderkey from orders", "select distinct on (o_orderpriority) o_orderpriority, o_orderkey from orders order by o_orderpriority, o_orderkey"),
    "distinct_hidden": ("select distinct hidden o_orderstatus o_orderkey from orders", "select o_orderkey from (select distinct on (o_orderstatus) o_orderstatus, o_orderkey from orders order by o_orderstatus, o_orderkey)"),
    "distinct_order": ("select distinct o_custkey o_orderkey from orders order by o_orderkey", "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_orderkey desc"),
    "distinct_aggregate": ("select distinct hidden o_custkey n = count(*) total = sum(o_orderkey) from orders", "select count(*)::double as n, sum(k)::bigint as total from (select min(o_orderkey) as k from orders group by o_custkey)"),
    "order_desc": ("select top 20 c_custkey c_acctbal from customer order by c_custkey", "select c_custkey, c_acctbal from customer order by c_custkey desc limit 20"),
    "order_asc_limit": ("select c_custkey from customer order by c_custkey asc limit 15", "select c_custkey from customer order by c_custkey limit 15"),
    "order_numbered": ("select v = case when p_size > 25 then p_size end n = inc() from part order by case when p_size > 25 then p_size end", "select case when p_size > 25 then p_size::bigint end as v, row_number() over (order by case when p_size > 25 then p_size end desc nulls last)::double as n from part"),
    "order_asc_numbered": ("select p_size n = inc() from part order by p_size asc", "select p_size::bigint as p_size, row_number() over (order by p_size)::double as n from part"),
    "where_or_pushed": ("select o_orderkey from orders where o_totalprice > 200000 or o_orderkey < 5", "select o_orderkey from orders where o_totalprice > 200000 or o_orderkey < 5"),
    "distinct_null": ("select distinct v = case when p_size > 25 then p_size end from part", "select distinct case when p_size > 25 then p_size::bigint end as v from part"),
    "order_nulls": ("select p_partkey v = case when p_size > 25 then p_partkey end from part order by case when p_size > 25 then p_partkey end * 1", "select p_partkey, case when p_size > 25 then p_partkey end as v from part"),
    "inner_join": ("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "left_join": ("select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey"),
    "outer_join": ("select c.c_custkey, o.o_orderkey from customer c left outer join orders o on o.o_custkey = c.c_custkey where o.o_orderkey = null", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where o_orderkey is null"),
    "multi_join": ("select c.c_name, n.n_name, r.r_name from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey", "select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "expr_key_join": ("select c.c_custkey, n.n_name from customer c join nation n on c.c_nationkey + 1 = n.n_nationkey * 2", "select c_custkey, n_name from customer join nation on c_nationkey + 1 = n_nationkey * 2"),
    "join_star": ("select * from nation n join region r on n.n_regionkey = r.r_regionkey", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, r_regionkey::bigint as r_regionkey, r_name from nation join region on n_regionkey = r_regionkey"),
    "small_join": ("select s.s_name, n.n_name from supplier s sjoin nation n on s.s_nationkey = n.n_nationkey", "select s_name, n_name from supplier join nation on s_nationkey = n_nationkey"),
    "big_join": ("select l.l_orderkey, l.l_linenumber, o.o_totalprice from lineitem l bjoin orders o on l.l_orderkey = o.o_orderkey where o.o_totalprice > 300000", "select l_orderkey, l_linenumber::bigint as l_linenumber, o_totalprice from lineitem join orders on l_orderkey = o_orderkey where o_totalprice > 300000"),
    "ordered_join_top": ("select top 12 o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey order by o.o_orderkey", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey order by o_orderkey desc limit 12"),
    "join_null_keys": ("select a.n_nationkey, b.r_name from nation a join region b on case when a.n_regionkey > 1 then a.n_regionkey end = b.r_regionkey", "select n_nationkey::bigint as n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where n_regionkey > 1"),
    "grouped_join": ("select c.c_mktsegment, n = count(*), keys = sum(o.o_orderkey) from orders o left join customer c on o.o_custkey = c.c_custkey group by c.c_mktsegment order by count(*)", "select c_mktsegment, count(*)::double as n, sum(o_orderkey)::bigint as keys from orders left join customer on o_custkey = c_custkey group by all"),
    "date_parts": ("select o_orderkey y = year(o_orderdate) m = month(o_orderdate) mn = monthname(o_orderdate) w = week(o_orderdate) d = day(o_orderdate) dw = dayofweek(o_orderdate) dn = dayname(o_orderdate) dy = dayofyear(o_orderdate) dm = dayofmonth(o_orderdate) h = hour(o_orderdate) from orders", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, strftime(o_orderdate, '%B') as mn, dayofyear(o_orderdate) // 7 as w, dayofweek(o_orderdate) as d, dayofweek(o_orderdate) as dw, strftime(o_orderdate, '%A') as dn, dayofyear(o_orderdate) as dy, day(o_orderdate) as dm, hour(o_orderdate) as h from orders"),
    "date_arith": ("select o_orderkey later = o_orderdate + '3 weeks' year = o_orderdate + '1 year' earlier = o_orderdate - '36 hours' from orders", "select o_orderkey, o_orderdate + interval 21 day as later, o_orderdate + interval 364 day as year, o_orderdate - interval 36 hour as earlier from orders"),
    "date_difference": ("select o_orderkey since = o_orderdate - '1/1/1992' twice = (o_orderdate - '1/1/1992') * 2 half = '3 days' / 2 from orders", "select o_orderkey, (epoch(o_orderdate) - epoch(timestamp '1992-01-01'))::double as since, 2 * (epoch(o_orderdate) - epoch(timestamp '1992-01-01'))::double as twice, 129600::double as half from orders"),
    "duration_aggregate": ("select o_orderstatus longest = max(o_orderdate - '1/1/1992') from orders where o_orderdate - '1/1/1992' > '2 years' group by o_orderstatus", "select o_orderstatus, (epoch(max(o_orderdate)) - epoch(timestamp '1992-01-01'))::double as longest from orders where o_orderdate > timestamp '1992-01-01' + interval 728 day group by all"),
    "where_function": ("select o_orderkey from orders where year(o_orderdate) = 1996 and monthname(o_orderdate) in (May, june)", "select o_orderkey from orders where year(o_orderdate) = 1996 and strftime(o_orderdate, '%B') in ('May', 'june')"),
    "abs": ("select s_suppkey a = abs(s_acctbal) b = abs(s_nationkey - 12) from supplier", "select s_suppkey, abs(s_acctbal) as a, abs(s_nationkey - 12)::bigint as b from supplier"),
    "format_identity": ("select n_name f = format(n_regionkey) from nation", "select n_name, n_regionkey::bigint as f from nation"),
    "inc": ("select o_orderkey n = inc() from orders order by o_orderkey asc", "select o_orderkey, row_number() over (order by o_orderkey)::double as n from orders"),
    "inc_scan": ("select o_orderkey n = inc(2) from orders where o_orderstatus = F", "select o_orderkey, (1 + 2 * (row_number() over (order by o_orderkey) - 1))::double as n from orders where o_orderstatus = 'F'"),
    "crypt_roundtrip": ("select c_custkey same = decrypt(encrypt(c_name, sesame), sesame) wrong = decrypt(encrypt(c_name, sesame), other) none = decrypt('', x) from customer", "select c_custkey, c_name as same, '' as wrong, null::varchar as none from customer"),
    "events_scan": ("select event_id user_id value from events where event_type like 'click%' and value > 1", "select event_id, user_id, value from events where event_type ilike 'click%' and value > 1"),
}

#: Columns that both sides round to 4 places.
ROUNDED = {"flagship": ("qty", "price"), "group_sum_avg": ("total", "mean"), "group_stdev": ("s", "p"), "group_int_sum": ("mean",), "agg_distinct": ("a",)}


def _runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = Engine(spark, sf_dir).query(PAIRS[name][0])
        df = result.df
        for c, kind in zip(result.names, result.types, strict=True):
            if kind == DURATION:  # as seconds, which both sides have
                df = df.withColumn(c, seconds(F.col(f"`{c}`")))
        for c in ROUNDED.get(name, ()):
            df = df.withColumn(c, F.round(c, 4))
        return df

    return run


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` written as CSV by the executors and queried from there, with inferred types."""
    path = f"{_folder(spark)}/customer.csv"
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.mode("overwrite").option("header", True).csv(path)
    return Engine(spark).sql(f"select c_custkey c_name c_nationkey c_acctbal c_mktsegment from '{path}'")


def _folder(spark: SparkSession) -> str:
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/tabq-csv-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="tabq-csv-")


def _viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorting, filtering and hiding on a result, as a viewer does."""
    from .operators.viewer import filter_rows, hide, sort_rows

    df = Engine(spark, sf_dir).sql("select n_nationkey n_name n_regionkey from nation")
    return hide(sort_rows(filter_rows(df, "n_regionkey", "1"), "n_name"), "n_regionkey")


def _viewer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.viewer import distinct_values

    return distinct_values(Engine(spark, sf_dir).sql("select * from customer"), "c_mktsegment")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries in one text; the second one's rows."""
    return Engine(spark, sf_dir).run("select 'a;b' as x from region; select n_name from nation where n_regionkey = 3")[1].df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _runner(name) for name in PAIRS} | {"csv_roundtrip": csv_roundtrip, "viewer": _viewer, "viewer_distinct": _viewer_distinct, "multi_query": _many}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items()} | {
    "csv_roundtrip": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer",
    "viewer": "select n_nationkey::bigint as n_nationkey, n_name from nation where n_regionkey = 1",
    "viewer_distinct": "select distinct c_mktsegment from customer",
    "multi_query": "select n_name from nation where n_regionkey = 3",
}
