import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabq import QueryError
from tabq.functions import types as t
from tabq.plans.ast import Binary, Call, Chain, Compare, Negate, Not, Word
from tabq.plans.lexer import END, KEYWORD, SYMBOL, WORD, split_queries, tokens
from tabq.plans.parser import parse


def expr(text, **more):
    return parse(f"select {text} from f", **more).selections[0].of


def test_tokens():
    got = [(x.kind, x.text) for x in tokens("SELECT c1<='a b' -2.5 \"from\"")]
    assert got == [(KEYWORD, "select"), (WORD, "c1"), (SYMBOL, "<="), (WORD, "a b"), (SYMBOL, "-"), (WORD, "2.5"), (WORD, "from"), (END, "end of query")]
    with pytest.raises(QueryError, match="line 2, column 3"):
        tokens("select\n  'open")


def test_split_queries_minds_quotes():
    assert split_queries("select ';' from a; select b from c;") == ["select ';' from a", "select b from c"]


def test_arithmetic_groups_to_the_right():
    a, b, c = Word("10"), Word("3"), Word("2")
    assert expr("10 - 3 - 2") == Binary("-", a, Binary("-", b, c))
    assert expr("10 - 3 - 2", left_assoc=True) == Binary("-", Binary("-", a, b), c)
    assert expr("-10 ^ 2") == Binary("^", Negate(a), c)


def test_optional_commas():
    q = parse("select c1 -5 c2, *, x = c3 * from f")
    assert [s.of for s in q.selections] == [Binary("-", Word("c1"), Word("5")), Word("c2"), None, Word("c3"), None]
    assert q.selections[3].alias == "x"


def test_logic_has_no_precedence():
    q = parse("select from f where not a = 1 and b = 2 or c = 3")
    a, b, c = (Compare("=", Word(x), Word(str(i + 1))) for i, x in enumerate("abc"))
    assert q.where == Not(Chain("and", a, Chain("or", b, c)))
    assert parse("select from f where not not (a = 1)").where == a


def test_functions_need_a_parenthesis():
    assert expr("count(*)") == Call("count", (), star=True)
    assert expr("year") == Word("year")
    assert expr("'year'") == Word("year", True)


def test_types_of_texts():
    want = {"": t.NULL, "null": t.NULL, "NA": t.NULL, "5": t.INT, "-5": t.INT, "007": t.STRING, "2.5": t.FLOAT, "1e3": t.FLOAT, "6/1/2017": t.DATE, "May 18 1955": t.DATE, "june 1 1017": t.DATE, "2017-06-01 10:11:12": t.DATE, "1h30m": t.DURATION, "3 weeks": t.DURATION, "2 d": t.DURATION, "dog": t.STRING}
    assert {x: t.infer(x) for x in want} == want


def test_durations():
    assert t.parse_duration("1 year").days == 364
    assert t.parse_duration("1.5 days").total_seconds() == 129600
    assert t.parse_duration("1h30m").total_seconds() == 5400
    assert t.parse_duration("1 month") is None


def test_the_chart():
    assert len(t.CHART) == 12 and all(len(r) == 12 for r in t.CHART)
    assert t.combined(t.INT, False, t.STRING, True) == t.INT
    assert t.combined(t.DATE, False, t.INT, True) == t.DATE
    assert t.combined(t.NULL, False, t.INT, False) == t.STRING


@given(st.text(alphabet="selct from'\"()*,=<>!1.a-+%^/ ", max_size=40))
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except QueryError:
        pass
