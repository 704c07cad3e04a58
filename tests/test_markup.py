from litscreen.sources import articles, journals, lookups, markup

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><script>var p = "</p><p>no</p>";</script></head><body>
<nav><p>menu</p></nav><p class="lead">Before &amp;lt; any<br>heading<!-- <p>hidden</p> -->
<h1>First <b>title</b></h1><div>loose text</div><p>One <i>two</i>&nbsp;three<p>unclosed
<h2>Second</h2><ul><li>item</li></ul><P>LAST</P><p> </p><pre>x</pre></body></html>"""


def cut(spark, text, **tags):
    df = spark.createDataFrame([(1, text)], "page_id long, html string")
    return [(s["title"], s["text"]) for s in markup.sections_from_markup(df, **tags).first()["sections"]]


def test_web_page(spark):
    assert cut(spark, PAGE) == [
        ("", "Before &lt; any heading"), ("First title", "One two three"), ("First title", "unclosed"), ("Second", "LAST")
    ]


def test_journal_and_converter_tags(spark):
    xml = "<article><body><sec><title>Aim</title><p>a</p><p>b</p></sec><sec><title>End</title><p>c</p></sec></body></article>"
    assert cut(spark, xml, heading_tags=("title",), dropped_tags=()) == [("Aim", "a"), ("Aim", "b"), ("End", "c")]
    tei = "<text><body><div><head>Aim</head><p>a <ref>[1]</ref></p></div></body></text>"
    assert cut(spark, tei, heading_tags=("head",), dropped_tags=()) == [("Aim", "a [1]")]
    assert cut(spark, tei, heading_tags=("head",)) == [("Aim", "a [1]")]  # a heading is not dropped


def test_character_references(spark):
    text = "<p>&#945;-toxin &alpha; &#x1F600; &amp;lt; &unknown; a & b &copy;&nbsp;x &#0; &#1114112;</p>"
    assert cut(spark, text) == [("", "\u03b1-toxin \u03b1 \U0001f600 &lt; &unknown; a & b \xa9 x &#0; &#1114112;")]


def test_no_paragraph(spark):
    assert cut(spark, "<h1>only</h1>") == []
    df = spark.createDataFrame([(1, "<h1>only</h1>")], "page_id long, html string")
    assert articles.drop_empty_articles(markup.articles_from_markup(df)).count() == 0


def test_locations(spark):
    text = """{"best_oa_location": {"url_for_pdf": "b"}, "oa_locations": [{"url_for_pdf": "no"}], "x_oa_location": null,
        "first_oa_location": {"url_for_pdf": "f"}, "y_oa_location": {"url_for_pdf": null}, "doi": "d"}"""
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, None), (4, "broken")], "id long, record string")
    rows = lookups.explode_locations(df, "record").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "b"), (1, 1, "f")]


def test_first_candidate_must_be_larger_than_the_minimum(spark):
    df = spark.createDataFrame(
        [(1, 2, 10_001), (1, 0, 10_000), (1, 1, 20_000), (2, 0, 3)], "article_id long, pos int, size int"
    )
    assert [tuple(r) for r in lookups.first_valid_candidate(df).collect()] == [(1, 1, 20_000)]


JOURNAL = """<?xml version="1.0"?><!DOCTYPE article><article xmlns:xlink="x"><front><journal-meta><title>No</title></journal-meta><article-meta>
<article-id pub-id-type="pmid">7</article-id><article-id pub-id-type="doi"> 10.1/a&amp;b </article-id>
<abstract><sec><title>Aim</title><p>First <italic>one</italic> &lt; two</p></sec><sec><title>End</title><p>Second &amp;lt; x</p></sec></abstract>
</article-meta></front><body><p>Loose</p><sec id="s1"><title>Intro <bold>b</bold></title><p>p1 <xref ref-type="bibr">[1]</xref> tail</p>
<fig><caption><p>not</p></caption></fig><sec><title>Sub</title><p>p2</p><sec><p>p3<list><list-item><p>li</p></list-item></list>after</p></sec></sec>
</sec><sec sec-type="x"><title>Last</title><p/><p>&#945; &alpha;</p></sec></body><sub-article><body><sec><p>reply</p></sec></body></sub-article></article>"""


def journal_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "article_id long, xml string").selectExpr("*", "'old' AS doi", "'old' AS sections", "1 AS x")
    return journals.articles_from_journals(df)


def test_journal(spark):
    row = journal_rows(spark, [JOURNAL]).first()
    assert (row["doi"], row["abstract"], row["n_sec"]) == ("10.1/a&b", ["First one < two", "Second &lt; x"], 4)
    assert [tuple(s) for s in row["sections"]] == [
        ("", "Loose"), ("Intro b", "p1 [1] tail"), ("Sub", "p2"), ("", "p3"), ("", "li after"), ("Last", "\u03b1 \u03b1")
    ]


def test_journals_that_are_no_journals(spark):
    texts = [None, "", "plain", "<article><body><sec><p>a<</sec>", "<article><body></body><abstract></abstract></article>", "<body><p>a\x00\x01b \ue000 &</p></body>"]
    got = [(r["doi"], r["abstract"], [tuple(s) for s in r["sections"]], r["n_sec"]) for r in journal_rows(spark, texts).orderBy("article_id").collect()]
    assert got[:5] == [(None, [], [], 0)] * 5 and got[5] == (None, [], [("", "a b &")], 0)
    assert journal_rows(spark, ["x"]).limit(0).count() == 0


def test_sections_nested_to_any_depth(spark):
    deep = "".join(f"<sec><title>t{i}</title><p>{'w ' * 2000}{i}</p>" for i in range(40)) + "</sec>" * 40
    row = journal_rows(spark, [f"<article><body>{deep}</body></article>"]).first()
    assert row["n_sec"] == 40 and [s["title"] for s in row["sections"]] == [f"t{i}" for i in range(40)]
    assert all(s["text"] == "w " * 2000 + str(i) for i, s in enumerate(row["sections"]))


def test_gate_counts_sections_of_journals(spark):
    one = "<article><abstract><p>x</p></abstract><body><sec><p>a</p><p>b</p><p>c</p></sec></body></article>"
    two = one.replace("<p>b</p>", "<sec><p>b</p></sec>")
    assert [r["article_id"] for r in articles.full_text_gate(journal_rows(spark, [one, two])).collect()] == [1]
    plan = journal_rows(spark, [one])._jdf.queryExecution().toString()
    assert "from_xml" in plan and "Python" not in plan


def test_each_step_over_a_journal_text_is_done_once(spark):
    """A column that is used twice would be worked out twice, with all steps before it."""
    texts = spark.range(3).selectExpr("id AS article_id", "repeat('<p>', id) AS xml")
    plan = journals.articles_from_journals(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CDATA") == 1  # of all steps over the whole text
    assert plan.count("(<(?:/p|/title|sec)>)") == 2  # abstract and body


def test_unwanted_characters_of_a_journal_text(spark):
    bad = "".join(map(chr, [*range(9), 11, 12, *range(14, 32), 0xE000, 0xFFFE, 0xFFFF]))
    xml = "<article><front><abstract><p>a" + "b".join(bad) + "\t\n\r\u20ac\ue001c</p></abstract></front></article>"
    row = journals.articles_from_journals(spark.createDataFrame([(1, xml)], "article_id long, xml string")).first()
    assert row["abstract"] == ["a" + " " + " ".join("b" * (len(bad) - 1)) + " \u20ac\ue001c"]
