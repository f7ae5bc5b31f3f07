import pytest

from lectern.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("a  b\n c", "a b c"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y</ul>", "- x\n- y"),
        ("<ol start=9><li>x<li>y</ol>z", "9. x\n10. y\n\nz"),
        ("<ul><li>a<ol><li>b</ol><li>c</ul>", "- a\n  1. b\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>Apple<td>10<tr><td>x<td></table>", "Name   N\nApple  10\nx"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("<table><tr><td>漢字<td>1<tr><td>abc<td>2</table>", "漢字  1\nabc   2"),
        ("<head><title>t</title></head><body>b", "b"),
        ("<script>if (a<b) '</p>'</script>x<style>y{}</style>", "x"),
        ("<p hidden>a</p><p style='DISPLAY : none'>b</p><p style=\"visibility:hidden\">c</p>d", "d"),
        ("<p style='color:red'>a</p>", "a"),
        ("<!-- x > y -->a<!-- open", "a"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("&lt;b&gt; &amp;amp; &eacute;&#65;", "<b> &amp; éA"),
        ("a</nosuch></p>b", "a\n\nb"),
        ("<blockquote>q</blockquote>", "> q"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<p>it's<a title=\"x>y\">l</a>", "it'sl"),
        ("a <b>c</b>d", "a cd"),
        ("<textarea>a<b></textarea>", "a<b>"),
        ("<img alt='pic'>", "pic"),
        ("x<a href=", "x"),
        ("1 < 2 > 1", "1 < 2 > 1"),
        ("<p style='backface-visibility:hidden'>a</p><p style='--display:none'>b</p>", "a\n\nb"),
        ("<p style='content: \"display:none\"; background:url(a;display:none)'>a</p>", "a"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<i style='visibility:inherit'>d</i></div>e", "b\ne"),
        ("<div style='display:none'>a<b style='visibility:visible;display:block'>b</b></div>c", "c"),
        ("<p hidden style='display:block'>a</p><p style='display:block;display:none'>b</p><p style='display:block!important;display:none'>c</p>", "a\n\nc"),
        ("<p style='display/**/:none'>a</p><p style='/* display:none */'>b</p>", "b"),
        ("<table><tr><td rowspan=2>k<td>1<tr><td>2</table>", "k  1\n   2"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td rowspan=0>k<td>1<tr><td>2<tr><td>3</table>", "k  1\n   2\n   3"),
        ("<table><tr><td>n<td><table><tr><td>a<td>b<tr><td>cc<td>d</table><tr><td>mm<td>z</table>", "n   a   b\n    cc  d\nmm  z"),
        ("<table><tr><td><p>one<p>two<td>x</table>", "one  x\ntwo"),
        ("<pre>a&nbsp;b  c\t<b>d  e</b></pre>", "a\xa0b  c\td  e"),
        ("<pre>\nfirst\r\n\r\nthird</pre>x", "first\n\nthird\n\nx"),
        ("<pre>a  b<div>c  d</div></pre>", "a  b\nc  d"),
    ],
)
def test_text(page, text):
    assert html_text.visible_text(page) == text


def test_deep_and_broken_pages_take_little_time():
    for page in ("<div>" * 50_000 + "x", "<p><b>" * 30_000, '<a "' * 20_000, "</" * 40_000, "<ul><li>" * 2000 + "z", "<table><tr><td>" * 2000 + "q", "<td>" * 3000, "<table>" + "<tr><td rowspan=65534>x" * 20_000, "<table>" + "<tr><td colspan=1000>x<td>y" * 20_000, "<table><tr>" + "<td colspan=1000>x" * 20_000, "<p style='" + "a:b;" * 50_000 + "'>", "<p style='" + "(\"" * 50_000 + "'>"):
        html_text.visible_text(page)


def test_query(spark):
    pages = spark.createDataFrame([(1, None, "u"), (None, "<p>a<p>b", "u"), (1, "<p>a<p>b", "u")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_lines) for r in html_text.extract(pages).collect()) == [("1", "", 0), ("1", "a\n\nb", 3), ("None", "a\n\nb", 3)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_formulas_labels_and_fallbacks_are_shown():
    assert html_text.visible_text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>.</p>") == "so x=1."
    assert html_text.visible_text("<svg><title>T</title><desc>D</desc><defs><text>no</text></defs><metadata>M</metadata><text>one</text><text>two</text></svg>after") == "one two after"
    assert html_text.visible_text("<svg><defs/><text>seen</text></svg>") == "seen" and html_text.visible_text("<desc>seen</desc>") == "seen"
    assert html_text.visible_text('<object data="a.swf"><param name="a"><p>fallback</p></object>') == "fallback"


def test_inline_content_ends_an_open_head():
    for body in ("text", "<span>text</span>", "<a href=x>text</a>", "<b>text</b>", '<img alt="text">'):
        assert html_text.visible_text(f"<html><head><meta charset=utf-8> <title>T</title>\n<style>s</style>{body}") == "text"
    assert html_text.visible_text("<head><noscript><img alt=no><div>no</div></noscript><template>no</template></head><body>yes") == "yes"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<details><summary>S</summary><p>secret</details>after", "S\nafter"),
        ("<details open><summary>S</summary><p>shown</details>", "S\n\nshown"),
        ("<details>only<b>text</b></details>x", "x"),
        ("<dialog>closed</dialog><dialog open>open</dialog><dialog style='display:block'>set</dialog>", "open\nset"),
        ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
        ("<ol><li value=5>a<li>b<li value=x>c</ol>", "5. a\n6. b\n7. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
        ("He said <q>yes</q>.", "He said “yes”."),
    ],
)
def test_more_forms(page, text):
    assert html_text.visible_text(page) == text


def grid_text(cells):
    """The text of a table by definition: column c begins two blanks behind the widest cell of the one before."""
    widths = [max(len(r[c][0]) for r in cells if c < len(r)) for c in range(max(map(len, cells)))]
    starts = [sum(widths[:c]) + 2 * c for c in range(len(widths))]
    out = []
    for r in cells:
        line = ""
        for c, (x,) in enumerate(r):
            line = line.ljust(starts[c]) + x if x else line
        out.append(line.rstrip())
    return "\n".join(out)


@pytest.mark.parametrize(("seed", "columns", "rows", "longest"), [(1, 3, 4, 9), (2, 15, 3, 100), (3, 40, 6, 300), (4, 300, 2, 3), (5, 1, 50, 500)])
def test_cells_are_aligned_at_any_width(seed, columns, rows, longest):
    import random

    rnd = random.Random(seed)
    cells = [[("x" * rnd.randint(1, longest),) for _ in range(columns)] for _ in range(rows)]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for (x,) in r) for r in cells) + "</table>"
    assert html_text.visible_text(page) == grid_text(cells)


def test_many_cells_reach_into_the_next_row():
    page = "<table><tr>" + "<td rowspan=2>aa" * 300 + "<td>b<tr><td>c</table>"
    first, second = html_text.visible_text(page).split("\n")
    assert len(second) - 1 == first.index("b") == 1200 and second.strip() == "c"


def test_alignment_of_huge_tables_is_bounded_unless_asked_for():
    page = "<table>" + f"<tr><td>{'w' * 20_000}<td>x" + "<tr><td>a<td>b" * 3000 + "</table>"
    near, exact = html_text.visible_text(page), html_text.visible_text(page, None)
    assert len(near) < 3e5 and len(exact) > 5e7
    assert "".join(near.split()) == "".join(exact.split()) and all(x.index("b") == 20_002 for x in exact.split("\n")[1:])
