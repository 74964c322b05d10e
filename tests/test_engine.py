import io
import itertools
import json
import operator

import duckdb
import pytest
from pyspark.sql import functions as F

from tabq import Engine, QueryError
from tabq.queries import ORACLES, QUERIES
from tabq.sources.sinks import as_json, save_csv, save_folder, save_path, write
from tabq.streaming import query_stream

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"create view {x} as select * from '{sf_dir}/{x}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == cols
    want = sorted(repr(tuple(r[order.index(c)] for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_order_nulls_orders_all_rows(spark, tmp_path):
    sizes = [(i, i % 50) for i in range(3000)]
    spark.createDataFrame(sizes, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in QUERIES["order_nulls"](spark, str(tmp_path)).collect()]
    assert sorted(r[0] for r in got) == [i for i, _ in sizes]
    some = sorted((i for i, n in sizes if n > 25), reverse=True)
    assert [r[1] for r in got] == some + [None] * (len(sizes) - len(some))


def rows(spark, text, **more):
    return [tuple(r) for r in Engine(spark, **more).sql(text).collect()]


OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def model(op, a, b):
    """Two-valued comparison in plain Python: null equals null and is less than all else; ``<=`` with null is false."""
    if op in ("=", "<>"):
        return OPS[op](a, b)
    if a is None or b is None:
        return {"<": a is None and b is not None, ">": b is None and a is not None, "<=": False, ">=": a is not None and b is None}[op]
    return OPS[op](a, b)


@pytest.mark.parametrize("form", ["{p}", "not ({p})", "{p} or 1 = 2", "not not {p}"])
def test_comparisons_with_null(spark, form):
    values = [None, 1, 2]
    data = [(i, a, b) for i, (a, b) in enumerate(itertools.product(values, values))]
    e = Engine(spark)
    e.register("v", spark.createDataFrame(data, "i long, a long, b long"))
    for op in OPS:
        for right, pick in (("b", lambda r: r[2]), ("1", lambda r: 1), ("null", lambda r: None)):
            got = {r[0] for r in e.sql(f"select i from v where {form.format(p=f'a {op} {right}')}").collect()}
            want = {r[0] for r in data if model(op, r[1], pick(r)) != (form == "not ({p})")}
            assert got == want, (op, right)


def test_worked_examples(spark):
    e = Engine(spark)
    e.register("one", spark.createDataFrame([(10, 3, 2, 7.0)], "a int, b int, c int, f double"))
    got = e.sql("select a-b-c, 100/a/c, c*b^c, c^b*c, -c^c, a/b, f/c, a/0, 5+'x' 'd'+'7' week('1/7/2024') day('6/2/2024') '1 year' from one").first()
    assert list(got[:8]) == [9, 20, 18, 64, 4, 3, 3.5, None]
    assert got[8:12] == ("5x", "d7", 1, 0)
    assert got[12].days == 364
    for test, want in (("a between 1 and 10", 0), ("a between 10 and 1", 0), ("b between 10 and 1", 1), ("'abc' like 'A_C'", 1), ("'a.c' like 'a.c'", 1), ("'abc' like 'a.c'", 1), ("a = 10 and b = 9 or c = 2", 1), ("not a = 10 or b = 3", 0)):
        assert len(rows_of(e, f"select a from one where {test}")) == want, test
    assert rows_of(sharing(e, between_inclusive=True), "select a from one where a between 1 and 10") == [(10,)]
    assert not rows_of(sharing(e, like_regex=False), "select a from one where 'abc' like 'a.c'")


def sharing(other, **switches):
    e = Engine(other.spark, **switches)
    e.catalog.registered.update(other.catalog.registered)
    return e


def rows_of(e, text):
    return [tuple(r) for r in e.sql(text).collect()]


def test_csv_types(spark, folder):
    r = Engine(spark).query(f"select * from '{folder}/types.csv'")
    assert r.types == [5, 1, 0, 4, 4, 3, 3, 2, 2]
    first, second = r.as_text().collect()
    assert list(first) == ["007", None, None, "1h30m0s", "504h0m0s", "2017-06-01 00:00:00", "1955-05-18 00:00:00", "1", "1.5"]
    assert list(second) == ["012", "5", None, "1m30s", "8736h0m0s", "2017-06-02 00:00:00", "2017-06-01 00:00:00", "2.5", "-2"]


def test_csv_nulls(spark, folder):
    t = f"'{folder}/nulls.csv'"
    assert rows(spark, f"select k from {t} where i = null") == [(2,), (3,)]
    assert rows(spark, f"select k from {t} where i < 7") == [(1,), (2,), (3,)]
    assert rows(spark, f"select k from {t} where s like ''") == [(2,)]
    assert rows(spark, f"select count(i) count(f) count(*) from {t}") == [(2.0, 2.0, 4.0)]
    assert sorted(rows(spark, f"select distinct i k from {t}"), key=repr) == [(1, 1), (7, 4), (None, 2)]


def test_csv_files(spark, folder):
    assert rows(spark, f"select * from '{folder}/quoted.csv'") == [("x, y", 'say "hi"'), ("two\nlines", "z")]
    assert rows(spark, f"select * from '{folder}/ragged.csv'") == [(1, 2), (3, None), (4, 5)]
    late = rows(spark, f"select sum(n) count(n) count(*) from '{folder}/late.csv'")
    assert late == [(sum(range(10_050)), 10_050.0, 10_051.0)]
    assert rows(spark, f"nh select top 1 col1 c2 from '{folder}/cities.csv'") == [("city0", 0)]
    assert rows(spark, f"select count(*) from '{folder}/cities.csv' noheader") == [(12.0,)]
    assert rows(spark, f"select a c1 c3 from '{folder}/dupnames.csv'") == [(1, 1, 3)]
    assert rows(spark, "select w from herbs where 1 = 2", base=folder) == []


def test_joins(spark, folder):
    on = f"from '{folder}/left.csv' l {{}} '{folder}/right.csv' r on l.k = r.k"
    inner = sorted(rows(spark, "select l.v r.w " + on.format("join")))
    assert inner == [("a", "p"), ("b", "q"), ("c", "q"), ("d", "r"), ("d", "s")]
    for kind in ("sjoin", "bjoin", "left inner join"):
        assert sorted(rows(spark, "select l.v r.w " + on.format(kind))) == inner
    assert sorted(rows(spark, "select l.v r.w " + on.format("left join")), key=repr) == sorted([*inner, ("e", None)], key=repr)
    empty = f"from '{folder}/left.csv' l left join '{folder}/hollow.csv' r on l.k = r.k"
    assert len(rows(spark, "select l.v r.w " + empty)) == 5
    r = Engine(spark).query("select w " + on.format("join"))
    assert r.notes and "literal" in r.notes[0]


def test_last_row_of_a_group_keeps_null(spark):
    e = Engine(spark)
    e.register("v", spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, s string").coalesce(1))
    assert sorted(rows_of(e, "select k s count(*) from v group by k")) == [(1, None, 2.0), (2, "b", 1.0)]


def test_inc_counts_across_partitions(spark):
    e = Engine(spark)
    e.register("v", spark.range(0, 100, 1, 7))
    got = dict(rows_of(e, "select id n = inc(3) from v where id % 2 = 0"))
    assert got == {2 * i: 1.0 + 3 * i for i in range(50)}


def test_filters_reach_the_scan(spark, sf_dir):
    e = Engine(spark, sf_dir)
    plan = lambda text: e.sql(text)._jdf.queryExecution().executedPlan().toString()
    got = plan("select l_orderkey from lineitem where l_quantity > 45 and l_shipdate < '1995-01-01'")
    assert "GreaterThan(l_quantity" in got and "LessThan(l_shipdate" in got
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in got
    assert "TakeOrderedAndProject" in plan("select top 5 o_orderkey from orders order by o_totalprice")
    assert "In(n_regionkey" in plan("select n_name from nation where n_regionkey in (1, 2)")


def test_wrong_password_and_errors_name_the_query(spark):
    e = Engine(spark, password="pw")
    e.register("v", spark.createDataFrame([("secret",), (None,)], "s string"))
    assert rows_of(e, "select decrypt(encrypt(s)) from v") == [("secret",), ("",)]
    assert rows_of(e, "select decrypt(encrypt(s), other) decrypt(s) from v")[0] == ("", None)
    with pytest.raises(QueryError, match="query 2"):
        e.run("select s from v; select s frm v")


def test_sinks(spark, folder, tmp_path):
    e = Engine(spark, folder)
    results = e.run("select city = c1 c2 from cities noheader limit 2; select k w from hollow")
    paths = save_csv(results, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out-1.csv", "out-2.csv"]
    assert open(paths[0]).read() == "city,col2\ncity0,0\ncity1,1\n"
    assert open(paths[1]).read() == "k,w\n"
    out = io.StringIO()
    assert write(results[0], out) == 2 and out.getvalue() == open(paths[0]).read()
    entry = json.loads(as_json(results))["Entries"][0]
    assert (entry["Numrows"], entry["Colnames"], entry["Types"], entry["Vals"][0]) == (2, ["city", "col2"], ["string", "integer"], ["city0", "0"])
    save_folder(results[0], str(tmp_path / "many"))
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 2
    with pytest.raises(QueryError):
        save_path(str(tmp_path / "no" / "x.csv"))
    assert results[0].display().count() == 2
    assert "cities.csv" in e.catalog.list(folder)[1]


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = query_stream(Engine(spark), "live", stream, "select event_type n = count(*) from live group by event_type")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = {r[0]: float(r[1]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*")).collect()}
    assert {r[0]: r[1] for r in spark.table("counts").collect()} == want


def test_entry_without_the_training_data_operators(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
