import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from seriesloom.lang.parser import ParseError, parse, tag_terms
from seriesloom.lang.times import align_start, at_time, interval


@pytest.mark.parametrize(
    "text, kind, args",
    [
        ("metric", "name", []),
        ("metric.foo.{a,b}*.c", "name", []),
        ("1min.load", "name", []),
        ("func(metric)", "call", ["metric"]),
        ("func(m1,m2, 3 , 'x')", "call", ["m1", "m2", "3", "'x'"]),
        ("f(g(a),-1.5)", "call", ["g(a)", "-1.5"]),
        ("a|f(1)|g('x')", "call", ["f(a,1)", "'x'"]),
        ("3", "number", []),
        ("1e3", "number", []),
        ("seriesByTag('a=b','c!=~d,e')", "name", []),
        ("Ünï.cödé", "name", []),
        ("a\\,b", "name", []),
    ],
)
def test_trees(text, kind, args):
    node = parse(text)
    assert (node.kind, [a.text for a in node.args]) == (kind, args)


def test_named_arguments():
    node = parse("f(a, b, key='v', n=3, flag=true, ref=x.y)")
    assert [a.text for a in node.args] == ["a", "b"]
    assert {k: v.value for k, v in node.named.items()} == {"key": "v", "n": 3.0, "flag": True, "ref": "x.y"}
    assert parse("f(metric=)").args[0].text == "metric="


@pytest.mark.parametrize("text", ["", "f(", "f(a", "f(a))", "a{b", "'x", "f(a,)", "f(k=1,a)", "f(a)b", "a|b", "a}b"])
def test_no_expressions(text):
    with pytest.raises(ParseError):
        parse(text)


def test_macros():
    assert parse("m(a.b,3)", {"m": "scale({0},{1})"}).text == "scale(a.b,3)"
    assert parse("m(x)", {"m": "n({args})", "n": "sum({0})"}).text == "sum(x)"
    assert parse("m(alias(a,\"it's\"))", {"m": "scale({0},2)"}).text == "scale(alias(a,\"it's\"),2)"
    with pytest.raises(ParseError):
        parse("m(x)", {"m": "m({0})"})
    with pytest.raises(ParseError):
        parse("m(x)", {"m": "f({3})"})


def test_tag_terms():
    assert tag_terms("seriesByTag('name=a.b','x=~1,2',\"y!=z\",'w!=~q')") == [("name", "=", "a.b"), ("x", "=~", "1,2"), ("y", "!=", "z"), ("w", "!=~", "q")]


@pytest.mark.parametrize("text, seconds", [("1s", 1), ("2min", 120), ("3m", 180), ("1h30min", 5400), ("-1d", -86400), ("+1w", 604800), ("1mon", 2592000), ("1Y", 31536000), ("5 ", None), ("", None), ("1x", None), ("100000y", None)])
def test_intervals(text, seconds):
    if seconds is None:
        with pytest.raises(ValueError):
            interval(text)
    else:
        assert interval(text) == seconds


NOW = 1700000000  # 2023-11-14 22:13:20


@pytest.mark.parametrize(
    "text, ts",
    [("now", NOW), ("-1h", NOW - 3600), ("now-1d", NOW - 86400), ("1500000000", 1500000000), ("midnight", 1699920000), ("noon+3h", 1699963200 + 10800), ("today", 1699920000), ("yesterday", 1699833600), ("tomorrow", 1700006400),
     ("today-2d", 1699747200), ("10:30_20240102", 1704191400), ("01/02/24", 1704153600), ("20240102", 1704153600), ("noon_yesterday", 1699876800), ("teatime", 1699977600)],
)
def test_at_times(text, ts):
    assert at_time(text, NOW) == ts


def test_bad_at_times():
    assert at_time("nonsense", NOW, 5) == 5
    with pytest.raises(ValueError):
        at_time("25:00", NOW)


def test_align_start():
    assert align_start(NOW, "months") == 1698796800
    assert align_start(NOW, "years") == 1672531200
    assert align_start(NOW, "2days") == 1699920000
    assert align_start(NOW, "weeks1") == 1699833600  # a Monday
    assert align_start(NOW, "weeks7") == align_start(NOW, "weeks0") == 1699747200
    with pytest.raises(ValueError):
        align_start(NOW, "weeks")


@settings(max_examples=1500, deadline=None)
@example("\"'\"")
@example("f(\"it's\",'a\"b')")
@given(st.text("abf(){},'\"|=1.*- \\", max_size=25))
def test_the_parser_ends_in_a_tree_or_an_error(text):
    try:
        node = parse(text)
    except ParseError:
        return
    assert parse(node.text).text == node.text
