import pytest

from siftline.functions.analysis import phrase
from siftline.plans.language import QuerySyntaxError, parse
from siftline.plans.tree import And, flat


def tree(query):
    return repr(parse(query, phrase))


@pytest.mark.parametrize("query", ["", "  ", '"a" "b"', 'foo "bar"', "foo (bar)", "a AND", "OR a", "()", "(a", '"a', '"a\\d"', "a)", "AND"])
def test_refused(query):
    with pytest.raises(QuerySyntaxError):
        parse(query, phrase)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("x AND y OR z", "And(Phrase(x), Or(Phrase(y), Phrase(z)))"),
        ("x OR y AND z", "And(Or(Phrase(x), Phrase(y)), Phrase(z))"),
        ("(x && y) || z", "Or(And(Phrase(x), Phrase(y)), Phrase(z))"),
        ("rock and roll", "And(Phrase(rock), Phrase(roll))"),
        ("ANDROID", "Phrase(android)"),
        ("a&&b", "Phrase(a b)"),
        ("And", "Phrase(and)"),
        ("foo  bar", "Phrase(foo bar)"),
        ('"a\\nb"', "Phrase(a nb)"),
        ('"and"', "Phrase(and)"),
        ('"!!!"', "Phrase()"),
    ],
)
def test_shapes(query, want):
    assert tree(query) == want


def test_flat():
    assert repr(flat(parse("x AND y AND z", phrase))) == "And(Phrase(x), Phrase(y), Phrase(z))"
    with pytest.raises(ValueError):
        And()
