"""Each rule of the dialect by a query over a small garden, with the rows it must give, and each refusal."""

import pytest

from tabq import Engine, QueryError

ROWS = {
    # selections
    "select herb from herbs where bed = 3": [("dill",)],
    "select herb, bed jars from herbs where herb = mint": [("mint", 2, 7)],
    "select h = herb jars + 1 as more from herbs where bed = 1": [("basil", 13), ("sage", None)],
    "select from beds": [(1, "loam"), (2, "clay"), (4, "sand")],
    "c select 2 from beds": [("loam",), ("clay",), ("sand",)],
    "select c2 from beds where c1 > 1": [("clay",), ("sand",)],
    "select b.soil from beds b where b.bed = 4": [("sand",)],
    "select weed '3' soil from beds where bed = 2": [("weed", 3, "clay")],
    "select 'sown on' = year('sown on') herb from herbs where bed = 2": [(2020, "mint"), (2022, "thyme")],
    # arithmetic
    "select jars * 2 + 1 from herbs where herb = basil": [(25,)],
    "select 20 - jars - 3 from herbs where herb = dill": [(18,)],
    "select jars / 2 cm / 2 from herbs where herb = mint": [(3, 22.5)],
    "select jars % 5 from herbs where herb = basil": [(2,)],
    "select -jars bed ^ 3 from herbs where herb = thyme": [(-7, 8)],
    "select herb + s from herbs where bed = 3": [("dills",)],
    "select jars / 0 from herbs where herb = dill": [(None,)],
    "select year('sown on' + '5 weeks') month('sown on' - '1 day') from herbs where herb = thyme": [(2022, 12)],
    # predicates
    "select herb from herbs where jars = null": [("sage",)],
    "select herb from herbs where jars < 6": [("sage",), ("dill",)],
    "select herb from herbs where jars <= 5": [("dill",)],
    "select herb from herbs where not (bed = 1 or bed = 2)": [("dill",)],
    "select herb from herbs where bed = 1 xor jars = 12": [("sage",)],
    "select herb from herbs where cm between 20.5 and 45": [("basil",), ("thyme",)],
    "select herb from herbs where cm not between 45 and 20.5": [("mint",), ("sage",), ("dill",)],
    "select herb from herbs where herb like 'M%T'": [("mint",)],
    "select herb from herbs where herb not like '%i%'": [("sage",), ("thyme",)],
    "select herb from herbs where herb like '_I__'": [("mint",), ("dill",)],
    "select herb from herbs where place in (row, shade)": [("sage",), ("dill",)],
    "select herb from herbs where bed not in (1, 2)": [("dill",)],
    "select herb from herbs where 'sown on' >= '2021-03-20'": [("dill",), ("thyme",)],
    "select herb from herbs where bed = 3 or bed = 1 and jars > 10": [("basil",), ("dill",)],
    "select herb from herbs where case bed when 1 then low else high end = low": [("basil",), ("sage",)],
    # cases and functions
    "select case when cm > 60 then tall when cm > 40 then middling end from herbs": [(None,), (None,), ("middling",), ("tall",), ("tall",)],
    "select coalesce(place, none) from herbs where bed = 2": [("none",), ("pot",)],
    "select abs(5 - jars) from herbs where herb = mint": [(2,)],
    "select monthname('sown on') dayofmonth('sown on') from herbs where herb = sage": [("November", 30)],
    # groups
    "select bed n = count(*) from herbs group by bed": [(1, 2.0), (2, 2.0), (3, 1.0)],
    "select bed sum(jars) from herbs group by bed having count(jars) = 2": [(2, 14)],
    "select min(cm) max(jars) from herbs": [(20.5, 12)],
    "select count(distinct jars) count(jars) from herbs": [(3.0, 4.0)],
    "select avg(jars) from herbs where bed = 2": [(7.0,)],
    "select bed herb count(*) from herbs where bed = 2 group by bed": [(2, "thyme", 2.0)],
    "select max(cm) - min(cm) from herbs": [(60.0,)],
    "select count(*) from herbs where bed = 77": [(0.0,)],
    # distinct, order, limits
    "select distinct bed herb from herbs": [(1, "basil"), (2, "mint"), (3, "dill")],
    "select distinct hidden bed herb from herbs": [("basil",), ("mint",), ("dill",)],
    # joins
    "select h.herb b.soil from herbs h join beds b on h.bed = b.bed": [("basil", "loam"), ("mint", "clay"), ("sage", "loam"), ("thyme", "clay")],
    "select h.herb b.soil from herbs h left join beds b on h.bed = b.bed where h.jars < 7": [("sage", "loam"), ("dill", None)],
    "select h.herb from herbs h sjoin beds b on h.bed * 2 = b.bed": [("basil",), ("mint",), ("sage",), ("thyme",)],
    "select h.herb from herbs h bjoin beds b on h.bed + 1 = b.bed": [("basil",), ("sage",), ("dill",)],
}

IN_ORDER = {
    "select top 2 herb from herbs order by cm": [("dill",), ("sage",)],
    "select herb from herbs order by cm asc limit 2": [("thyme",), ("basil",)],
    "select herb n = inc() from herbs order by jars asc limit 3": [("sage", 1.0), ("dill", 2.0), ("mint", 3.0)],
    "select bed from herbs group by bed order by sum(cm)": [(1,), (3,), (2,)],
}

REFUSED = [
    "select herb", "select from", "select from weeds", "select herb from herbs where", "select herb from herbs where bed", "select herb from herbs where (bed = 1",
    "select herb from herbs where bed = 1 and", "select herb * 2 from herbs", "select 'sown on' * bed from herbs", "select 'sown on' + jars from herbs",
    "select cm % 2.5 from herbs", "select month(bed) from herbs", "select abs(herb) from herbs", "select max(min(cm)) from herbs", "select max(cm) + bed from herbs",
    "select herb from herbs where sum(jars) > 1", "select avg(herb) from herbs", "select herb from herbs having bed = 1", "select herb from herbs group bed",
    "select case bed else 1 end from herbs", "select herb as a + bed from herbs", "select top few herb from herbs", "select \"herb from herbs", "select c7 from herbs",
    "select from herbs h join beds b on h.bed = b.bed and h.jars = b.bed", "select from herbs h join beds b on h.bed = h.jars", "select from herbs join beds b on bed = b.bed",
    "select from herbs h join beds on h.bed = bed", "select inc(-2) from herbs", "select encrypt(herb) from herbs", "select inc() from herbs group by bed",
]


def got(spark, folder, query):
    return [tuple(r) for r in Engine(spark, folder).sql(query).collect()]


@pytest.mark.parametrize("query", ROWS)
def test_rows(spark, folder, query):
    assert sorted(got(spark, folder, query), key=repr) == sorted(ROWS[query], key=repr)


@pytest.mark.parametrize("query", IN_ORDER)
def test_rows_in_order(spark, folder, query):
    assert got(spark, folder, query) == IN_ORDER[query]


@pytest.mark.parametrize("query", REFUSED)
def test_is_refused(spark, folder, query):
    with pytest.raises(QueryError):
        Engine(spark, folder).sql(query)


def test_csv_files_are_split_unless_a_line_ends_in_quotes(spark, folder):
    e = Engine(spark, folder)
    assert e.catalog._broken_lines(f"{folder}/quoted.csv") and not e.catalog._broken_lines(f"{folder}/late.csv")
    plan = e.sql("select from late")._jdf.queryExecution().analyzed().toString()
    assert plan and len(e.sql("select n from late where n > 10047").collect()) == 2
    assert len(Engine(spark, folder, multiline=False).sql("select a from quoted").collect()) == 3


def test_either_side_of_an_or_reaches_the_scan(spark, sf_dir):
    plan = Engine(spark, sf_dir).sql("select o_orderkey from orders where o_totalprice > 200000 or o_orderkey < 5")._jdf.queryExecution().executedPlan().toString()
    assert "Or(GreaterThan(o_totalprice" in plan


def test_command_line(spark, folder, tmp_path, capsys):
    from tabq.__main__ import main

    assert main(["--base", folder, "-c", "select soil from beds where bed = 2"]) == 0
    assert capsys.readouterr().out == "soil\nclay\n"
    assert main(["--base", folder, "-c", "select soil from beds; select bed from beds", "--folder", str(tmp_path / "many")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "many-1")).count() == 3
    assert main(["--base", folder, "-c", "select soil frm beds"]) == 1
