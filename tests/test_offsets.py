"""Maps from rendered text back to its source."""

import random

from pyspark.sql import functions as F

from proselake.sources import offsets
from proselake.sources.html import html_text

SF = "/root/testdata/sf0.001"


def signs(text, pieces):
    """(start, end) of every sign, laid out one by one."""
    out = []
    for n, (at, a, z, run) in enumerate(pieces):
        size = (pieces[n + 1][0] if n + 1 < len(pieces) else len(text)) - at
        out += [(a + k, a + k + 1) for k in range(size)] if run else [(a, z)] * size
    return out


def page(rng):
    parts = ["<p>", "</p>", "<br/>", "<b>", "</b>", "&amp;", "&#8220;", "&bad;", "&", "<script>x<y</script>", "<!-- a -->", "text ", "a", "\n", " ", "<i title='a>b'>", "<pre>no</pre>", "<div", ">"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_pieces_cover_the_text_and_show_its_source():
    rng = random.Random(5)
    for _ in range(400):
        html = page(rng)
        text, pieces = offsets.render(html)
        at = signs(text, pieces)
        assert len(at) == len(text)
        for sign, (a, z) in zip(text, at, strict=True):
            assert html[a:z] == sign or (html[a:z].startswith("&") and offsets.entity(html[a:z]) == sign) or (a == z and sign in " \n")
        for _ in range(5):
            a, z = sorted((rng.randint(0, len(text) + 2), rng.randint(0, len(text) + 2)))
            first = min(a, len(text) - 1)
            want = (at[first][0], at[max(first, min(max(a, z - 1), len(text) - 1))][1]) if text else (0, 0)
            assert offsets.source_range(pieces, len(text), a, z) == want
    assert offsets.render("a<!-- open")[0] == "a" and offsets.render("<b")[0] == ""


def test_maps_compose():
    rng = random.Random(6)
    for _ in range(300):
        source = page(rng)
        middle, inner = offsets.render(source)
        text, outer = offsets.render(middle)
        whole = offsets.composed(outer, len(text), inner)
        first, last = signs(text, outer), signs(text, whole)
        by = signs(middle, inner)
        for (a, z), got in zip(first, last, strict=True):
            if z > a:
                assert got == (by[a][0], by[z - 1][1])
    parts = [offsets.render("<p>one &amp; two</p>"), offsets.render("  "), offsets.render("<b>three</b>")]
    text, pieces = offsets.combined(parts)
    assert text == "one & two\n\n\n\nthree " and len(signs(text, pieces)) == len(text)
    assert offsets.source_range(pieces, len(text), 4, 5) == (7, 12)


def test_rendered_pages_equal_the_expression(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html").union(spark.createDataFrame([("A &amp; <b>b</b><br>c<!-- no --><p>d",), (None,)], "html string"))
    rows = pages.select(html_text(F.col("html")).alias("a"), offsets.rendered(F.col("html"))["text"].alias("b")).collect()
    assert rows and all(r.a.split() == r.b.split() for r in rows)


def test_findings_cut_their_own_match_out_of_the_page(spark):
    from proselake.plans.extracts import page_findings

    rows = page_findings(spark, SF).collect()
    assert {"emoji", "apology-reflex", "absolute-claim", "performed-candor"} & {r.rule for r in rows} and len(rows) > 100
    for r in rows:
        if r.rule != "semantic-redundancy":
            assert offsets.render(r.source)[0].strip() == r.match.strip(), r
    assert any("<b>" in r.source and r.match == "the fast est" for r in rows) or any(r.source == "Sorr&#121;" for r in rows)
