from quarry.llm import language


def test_language_declared_after_a_long_prolog(spark):
    docs = spark.createDataFrame([(i, ("the and of that " if i % 2 else "der und die das ") * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    tag, end = '<html class="x" lang="de-AT">', "<p>xq</p></html>"
    rows = [
        (1, "http://a.x/", "<!-- " + "note " * 2000 + "-->" + tag + end),
        (2, "http://b.x/", " \n" * 5000 + tag + end),
        (3, "http://c.x/", '<!-- <html lang="fr"> -->' + tag + end),
        (4, "http://d.x/", "<html>" + "<p>xq</p>" * 1000 + "<script>s = '<html lang=\"fr\">';</script></html>"),
    ]
    got = {g.page_id: g.declared for g in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got == {1: "de", 2: "de", 3: "de", 4: ""}
