import pytest
from pyspark.sql import functions as F

from peerlens.functions import company, text


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_name(spark):
    cases = {
        "Crème Brûlée, Inc.": "crème brûlée", "東京 Labs": "東京 labs", "Acme Pte. Ltd.": "acme pte", "Acme Pte Ltd": "acme pte", "Foo Co., Ltd.": "foo co",
        "INC": "inc", "x SAS": "x", "Foo_Bar!": "foo_bar", "ﬁ Nº½ co": "ﬁ nº½", None: "", "nan": "", " NaN ": "", "": "", "A-B  C LLC.": "a b c", "A\tLLC": "a llc",
    }
    assert values(spark, text.normalize_name, cases) == list(cases.values())


def test_extract_domain(spark):
    cases = {
        "https://www.Acme.com/x": "acme.com", "HTTP://acme.com?x=1": "acme.com", "acme.com/path": "acme.com/path", "www.wiz.io/": "wiz.io", "https://www./": "www.",
        "ftp x": None, "https://u:p@h.com:80/x": "u:p@h.com:80", "see https://a.b/c": "a.b", "nan": None, "  ": None, None: None, "localhost": None,
    }
    assert values(spark, text.extract_domain, cases) == list(cases.values())


def test_other_domains(spark):
    assert values(spark, text.strict_domain, ["https://a.b?q/x", "HTTP://a.b", "a.b", None]) == ["a.b?q", None, None, None]
    assert values(spark, text.enrichment_domain, ["www.Wiz.io/", "wiz.io", None]) == ["wiz.io", "wiz.io", None]


def test_tier(spark):
    cases = {"Tier_1": "tier_1", "2": "tier_2", "tier3": "tier_3", "strong": "tier_4", "tier_12": "tier_1", "": "tier_4", None: "tier_4"}
    assert values(spark, text.tier, cases) == list(cases.values())


def test_team_size_bucket(spark):
    assert values(spark, company.team_size_bucket, [9, 10, 50, 51, 1000, 10000, 10001, None], "int") == [0, 1, 1, 2, 5, 7, 8, None]


def test_headcount_prefers_the_enum_even_if_unknown(spark):
    df = spark.createDataFrame([("c_00011_00050", 7), ("other", 7), (None, 7), ("", None)], "e string, n int")
    assert [r[0] for r in df.select(company.headcount_bucket(F.col("e"), F.col("n"))).collect()] == [1, None, 0, None]


def test_parse_funding(spark):
    assert values(spark, company.parse_funding, ["$1,200,000", "$1.5M", "1-2", "-", "", None]) == [1200000.0, 1.5, None, None, None, None]


def test_parse_founded(spark):
    got = values(spark, lambda c: company.parse_founded(c)[1], ["2012-05-01", "2012", "2012-05", "05/01/2012", "soon", "nan", None])
    assert got == [2012, 2012, 2012, 2012, None, None, None]


def test_epoch_year(spark):
    assert values(spark, lambda c: company.founded_from_epoch(c)[1], [1577836800.0, 0.0, -5.0, 1e20, None], "double") == [2020, None, None, None, None]


def test_countries(spark):
    assert values(spark, company.registry_country, [["a", "b", "c", "d"], ["a", "b"], [], None], "array<string>") == ["c", "b", None, None]
    assert values(spark, lambda c: company.directory_country(c, F.array(F.lit("Europe"))), ["SF, CA, USA", " , ", None]) == ["USA", "Europe", "Europe"]


def test_lists_and_slugs(spark):
    assert values(spark, text.split_list, [" a, ,b\t,", "", None]) == [["a", "b"], [], []]
    assert values(spark, text.slugify, ["Hugging Face!", "--", None]) == ["hugging_face", "seed", "seed"]
    assert values(spark, text.clean, [" x ", "NaN", "", "\t", None]) == ["x", None, None, None, None]


def test_descriptions(spark):
    df = spark.createDataFrame([("long", "one", "N", ["a"]), ("", None, "N", ["a", "b", "c", "d", "e"]), (None, "", "N", [])], "l string, o string, n string, i array<string>")
    cols = [F.col(c) for c in ("l", "o", "n", "i")]
    assert [r[0] for r in df.select(text.embedding_text(*cols)).collect()] == ["long\none", "N — a, b, c, d", "N"]
    assert values(spark, lambda c: text.combined_description(c, F.lit("b"), F.lit("a")), ["a", None]) == ["a\nb", "b\na"]


def test_truthy(spark):
    assert values(spark, text.truthy, ["true", "false", "False ", "", None, "yes"]) == [True, False, False, False, False, True]


def test_display(spark):
    assert values(spark, company.display_number, [12, 1234, 2_500_000], "long") == ["12", "1.2K", "2.5M"]
    # ties of the binary value go up: 1.15 lies below its tie, 1.25 on it
    shown = values(spark, company.display_number, [None, 1000, 1150, 1250, 9_999, 12_500, 999_999, 1_250_000, 3_000_000, 1_234_500_000], "long")
    assert shown == ["—", "1K", "1.1K", "1.3K", "10K", "13K", "1000K", "1.3M", "3M", "1234.5M"]
    assert values(spark, company.display_cosine, [None, 0.0625, -0.0625, 0.9, 1.0], "double") == ["—", "0.063", "-0.063", "0.900", "1.000"]
    assert values(spark, company.site_url, ["a.com", "http://b.org/x", "", None]) == ["https://a.com", "https://b.org/x", None, None]
    assert values(spark, company.criterion_class, [1, 7, 8], "long") == ["c1", "c7", "c1"]
    assert values(spark, company.initials, ["big old co", "x", "", None]) == ["BO", "X", "?", "?"]
    assert values(spark, text.escape_html, ["<a href='x'>&\""]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "a", 0.0), ("a", "a", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(spark, a, b, want):
    from peerlens.operators.features import jaro_winkler

    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)
