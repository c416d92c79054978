from faultlens.llm import html_text as h


def text(source):
    return h.render(h.parse(source))


def test_implied_tags_and_spacing():
    assert text("<p>one<p>two <b>bold</b>\n  text<div>three</div>four") == "one\n\ntwo bold text\n\nthree\nfour"
    assert text("a<br>b<hr>c") == "a\nb\n\nc"
    assert text("x &amp; y &lt;z&gt; &#233;") == "x & y <z> é"


def test_lists():
    assert text("<ul><li>a<li><p>b</p><ol start=3><li>c<li>d</ol><li></ul>e") == "- a\n- b\n\n  3. c\n  4. d\n\ne"


def test_tables_are_aligned():
    source = "<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all of it</table>"
    assert text(source) == "Cap\nName       Qty\napple pie  3\nall of it"
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert text("<table><td>x</td><td>y</table>") == "x  y"
    assert text("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>") == "in  ner  out"
    grid = "<table><tr><td>long one<td>a<tr><td>b<td>c</table>"
    assert text("<table><tr><td>" * 400 + grid) == "long one  a\nb         c"
    assert text("<table>stray<tr><td>cell</table>") == "stray\n\ncell"


def test_visibility():
    hidden = "<script>x<p></script><style>y</style><!-- z --><div style='color:red; display: none'>n</div><i hidden>n</i>"
    assert text(f"<head><title>t</title></head>{hidden}<span aria-hidden=true>n</span><template>n</template>seen") == "seen"
    assert h.title(h.parse("<title> A &amp;\n B</title>")) == "A & B"


def test_formulas():
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then") == "if x=1 then"
    formula = "<semantics><mfrac><mi>a</mi><mn>2</mn></mfrac><annotation encoding=tex>\\frac</annotation></semantics>"
    assert text(f"<p>is <math>{formula}</math>.") == "is a 2."
    assert text("<math><mtable><mtr><mtd>1<mtd>2</mtable></math>") == "1 2"
    assert text("<math><mspace/><mi>y</mi></math><p>after") == "y\n\nafter"


def test_labels_of_drawings():
    unseen = "<title>t</title><desc>d</desc><defs><text>n</text></defs><style>s</style><script>j</script><clipPath/>"
    drawing = f"<svg viewBox='0 0 1 1'>{unseen}<path d='M0'/><text>In</text><g><text>Out <tspan x=1>two</tspan><tspan x=1>lines</tspan></text></g></svg>"
    assert text(f"<p>see {drawing} here") == "see In Out two lines here"
    assert text("<svg><desc/><text>a</text><foreignObject><div>b</div></foreignObject></svg>c") == "a\nb\nc"
    assert text("<svg><text><![CDATA[a > b]]></text></svg>") == "a > b"
    assert text("<svg aria-hidden=true><text>n</text></svg><svg/><desc>seen</desc>") == "seen"


def test_choices():
    source = "Size <select><option>S<option selected>M<optgroup label=Big><option>L<option label=XL></optgroup></select> please"
    assert text(source) == "Size S M Big L XL please"
    assert text("<datalist><option>n</datalist><select hidden><option>n</select>x") == "x"


def test_text_areas():
    assert text("Note<textarea rows=2>\nfirst &amp; <b>second</textarea>end") == "Note first & <b>second end"


def test_preformatted_text_keeps_spaces():
    assert text("<pre>\n  a\n    b  c\n</pre>after") == "  a\n    b  c\n\nafter"


def test_malformed_deep_and_empty_pages():
    assert text("") == "" and text("< 3 and <> & &bogus;") == "< 3 and <> & &bogus;"
    assert text("<div>" * 20_000 + "deep") == "deep"
    assert text("<table><tr><td>" * 5_000 + "deep") == "deep"
    assert text("<table><tr><td>x<td>" * 300 + "deep") == "x  " * 300 + "deep"
    assert text("<ul><li>" * 300 + "deep").endswith("- deep")
    assert text("</p></b>x</table>") == "x"
    assert text('<a href="never closed>b') == '<a href="never closed>b'


def test_every_page_has_a_row(spark):
    rows = [(1, "u", "<p>a<p>b", 9), (1, "u", "<p>a<p>b", 9), (None, None, None, 9), (2, "v", "", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars, r.n_lines) for r in h.extract_text(pages).collect()))
    assert got == [(0, "", 0, 0), (1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (2, "", 0, 0)]
    assert h.extract_text(pages.limit(0)).collect() == []


def test_all_words_of_given_pages_survive(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in h.extract_text(pages).collect()}
    for row in pages.collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", row.html)
        assert got[row.page_id].replace("- ", " ").split() == html.unescape(re.sub(r"<[^>]*>", " ", body)).replace("- ", " ").split()
