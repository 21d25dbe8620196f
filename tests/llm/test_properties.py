from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import leakage, markup, pieces

SNIPPETS = st.lists(
    st.sampled_from(["== a ==\n", "* b\n", "# c\n", "<pre>", "</pre>", "$x$", "$", "<!--", "-->", "```\n", "[[", "]]", "|", "{{", "}}", "\\item ", "\\begin{verbatim}", "\\end{verbatim}", "<li>", "'''", "&amp;", "\n", " ", "wort", "ä", "\x02", "\x03", "1\x03"]),
    max_size=40,
).map("".join)


@given(SNIPPETS)
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(text):
    clean, elements = markup.read(text)
    assert isinstance(clean, str)
    assert all(k in ("heading", "item", "code", "formula") and c == " ".join(c.split()) and c for _, k, c in elements)


@given(SNIPPETS)
@settings(max_examples=200, deadline=None)
def test_wholes_lie_in_order(text):
    at = 0
    for start, end, *_ in markup.wholes(text):
        assert at <= start < end <= len(text)
        at = end


@given(st.text(alphabet="ab. ,\n;äx", max_size=900), st.integers(30, 120), st.integers(0, 14))
@settings(max_examples=200, deadline=None)
def test_pieces_tile_any_text(text, limit, overlap):
    got = pieces.cut(text, limit, overlap, max(limit // 2, overlap + 1))
    assert "".join(text[new:end] for _, end, new in got) == text
    assert all(end - start <= limit and 0 <= new - start <= overlap for start, end, new in got)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_find_is_exact(docs, item, n):
    shard = [(i, " ".join(d)) for i, d in enumerate(docs) if d]
    if not shard:
        return
    n_item = min(n, len(item))
    runs = {tuple(item[k : k + n_item]) for k in range(len(item) - n_item + 1)}
    want = {i for i, t in shard if any(tuple(t.split()[k : k + n_item]) in runs for k in range(len(t.split()) - n_item + 1))}
    assert {r[1] for r in leakage.find(shard, leakage.phrases([(1, " ".join(item))], n))} == want
