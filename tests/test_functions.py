import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.functions import python_functions as py
from searchloom.functions import text, vectors
from searchloom.operators import frontier


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_article_titles(spark):
    cases = {
        "https://es.wikipedia.org/wiki/Grupo_sangu%C3%ADneo#:~:text=..": "Grupo sanguíneo",
        "https://es.wikipedia.org/wiki/VIH/sida": "VIH/sida",
        "https://es.wikipedia.org/wiki/Portal:OTAN/Estados_miembros": "Portal: OTAN",
        "https://es.wikipedia.org/wiki/Anexo:Lista_1": "Anexo: Lista 1",
        "https://es.wikipedia.org/wiki/C%2B%2B_+x": "C++ +x",
        "https://es.wikipedia.org/wiki/100%_malo": "100% malo",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, title string")
    for row in rows.select("title", text.article_title(F.col("url")).alias("got")).collect():
        assert row["got"] == row["title"]


def test_questions_are_unwanted(spark):
    bad = ["que es x en wikipedia", "el clima wikipedia", "www x y", "hola em casa", "força de hoy", "como es a.com", "vida mía letra"]
    good = ["el barça de hoy", "que es una letra capital", "wikipedia que es eso", "uno dos tres cuatro wikipedia"]
    rows = spark.createDataFrame([(q, True) for q in bad] + [(q, False) for q in good], "q string, bad boolean")
    for row in rows.select("q", "bad", text.is_unwanted(F.lower("q")).alias("got")).collect():
        assert row["got"] == row["bad"], row["q"]


def test_search_url(spark):
    url = one(spark, text.search_url(F.col("q"), F.col("c")), q="qué es", c="mx")
    assert url == "http://www.google.com.mx/search?q=qu%C3%A9+es+wikipedia&gl=mx&hl=es"
    assert "wikipedia+wikipedia" not in one(spark, text.search_url(F.col("q"), F.col("c")), q="sol wikipedia", c="es")


def test_small_text_functions(spark):
    assert one(spark, text.clean_passage(F.lit("#REDIRECCIÓN  a\t b "))) == "a b"
    assert one(spark, text.first_words(F.lit("a b c d"), 2)) == "a b"
    assert one(spark, text.shortened(F.lit("a b c"), 2)) == "a b [...]"
    assert one(spark, text.latex_safe(F.lit("a_b&c%"))) == "a\\_b\\&c\\%"
    assert one(spark, text.after_delimiter(F.lit("a to b"), " to ")) == "b"
    assert one(spark, text.after_delimiter(F.lit("a to "), " to ")) is None
    assert one(spark, text.unaccent(F.lit("Ñandú"), keep_enie=True)) == "Ñandu"
    assert one(spark, text.topic_label(F.lit("3_sol_luna"), F.lit(1234), F.lit(5.61))) == "sol, luna n=1,234 (5.6%)"
    assert one(spark, text.modular_slice(F.array(*map(F.lit, "abc")), F.lit(2), 2)) == ["c", "a"]
    assert one(spark, text.chunks(F.array(*map(F.lit, "abcde")), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert one(spark, text.joined_fields(F.lit(""), F.lit("t"))) == ". t"


def test_python_functions():
    assert py.cleaned("Año  1\nÉl!") == "ano 1el"
    assert py.unquoted('"""What ""stirrup""?"""') == 'What "stirrup"?' or py.unquoted('"a"') == "a"
    assert py.common_substring("xabcy", "zabcd") == 3
    assert py.common_substring("", "abc") == 0


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_substring_is_brute_force(a, b):
    want = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    assert py.common_substring(a, b) == want


def test_udfs_over_nulls(spark):
    rows = spark.createDataFrame([("&amp;Á", "Á"), (None, None)], "a string, b string")
    got = rows.select(py.clean_string("b").alias("c"), py.html_unescape("a").alias("h"), py.longest_common_substring("a", "b").alias("l")).collect()
    assert [tuple(r) for r in got] == [("a", "&Á", 1), (None, None, None)]


def test_unaccent_agrees_with_decomposition(spark):
    marked = text.MARKED + "ñÑ"
    want = "".join(c for c in unicodedata.normalize("NFKD", marked) if not unicodedata.combining(c))
    assert one(spark, text.unaccent(F.lit(marked))) == want


def test_vectors(spark):
    v, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(v)) == 5.0
    assert one(spark, vectors.dot(v, v)) == 25.0
    assert [round(x, 6) for x in one(spark, vectors.l2_normalised(v))] == [0.6, 0.8]
    assert one(spark, vectors.l2_normalised(zero)) == [0.0, 0.0]


def test_accented_patterns(spark):
    got = {r["pattern"] for r in frontier.accented(spark.createDataFrame([("que",), ("por cuanto",)], "pattern string")).collect()}
    assert got == {"que", "qué", "por cuanto", "por cuánto"}


def test_searches_and_local_suggestions(spark):
    got = {r["search"] for r in frontier.searches(spark.createDataFrame([("que ",)], "prefix string")).collect()}
    assert len(got) == 28 and "que" in got and "que ñ" in got
    rows = [("p", "us", "a long suggestion"), ("p", "mx", "a long suggestion"), ("q", "us", "another long one"), ("q", "mx", "a third, quite long"), ("q", "mx", "short")]
    found = frontier.local_suggestions(spark.createDataFrame(rows, "prefix string, country string, suggestion string"), "us")
    assert [(r["prefix"], r["country"]) for r in found.collect()] == [("q", "mx")]


def test_crawl_follows_new_prefixes(spark):
    table = [("que", "que es el sol"), ("que es", "que es la luna"), ("que es l", "que es la luz")]
    rows = spark.createDataFrame(table, "prefix string, suggestion string")
    start = spark.createDataFrame([("que ",)], "prefix string")
    found = frontier.crawl(start, rows, frontier.seeds(spark, ["que"]), [1])
    assert {r["result"] for r in found.collect()} == {"que es el sol", "que es la luna", "que es la luz"}
