from hypothesis import given
from hypothesis import strategies as st

from textloom.plans import parser

QUERY = st.lists(st.sampled_from(["wort", " AND ", " OR ", " BUT NOT ", "LINKTO ", "*", "'", '"', " ", "a", "(a+b)"]), max_size=12).map("".join)


@given(QUERY)
def test_any_query_parses(query):
    for strict in (False, True):
        tree = parser.parse(query, strict=strict)
        assert tree is not None
    assert not set(parser.plain(query)) & set("'\"*") and "LINKTO " not in parser.plain(query).replace("LINKTO LINKTO ", "")


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.lists(st.sampled_from([" AND ", " OR ", " BUT NOT "]), min_size=4, max_size=4))
def test_operators_fold_to_the_left(words, operators):
    query = words[0] + "".join(o + w for o, w in zip(operators, words[1:]))
    tree = parser.boolean(query)
    for o, w in reversed(list(zip(operators, words[1:]))):
        assert type(tree) is {" AND ": parser.And, " OR ": parser.Or, " BUT NOT ": parser.ButNot}[o] and tree.right == parser.Term(w)
        tree = tree.left
    assert tree == parser.Term(words[0])
