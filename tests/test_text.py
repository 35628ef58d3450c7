import pytest
from pyspark.sql import functions as F

from laborlens.functions import text as X
from laborlens.functions.embed import DIMENSIONS, embed, fnv1a



def col():
    return F.col("x")



@pytest.mark.parametrize(
    "make, value, want",
    [
        (X.normalize_title, "Sr. Data Engineer (m/v/x) – 32-40 uur!", "senior data engineer"),
        (X.normalize_title, "Vacature: Verpleegkundige", "verpleegkundige"),
        (X.normalize_company, "Canal Analytics B.V.", "canal analytics"),
        (X.normalize_plain, "Café  ﬁne—ok", "cafe fine ok"),
        (X.normalize_label, "C++ / Node.js_x", "c++ node.js x"),
        (X.url_domain, "https://www.CanalAnalytics.example/careers", "canalanalytics.example"),
        (X.url_domain, "jobs.canalanalytics.example", "canalanalytics.example"),
        (X.url_domain, None, None),
        (X.url_canonical, "https://WWW.Example.com/jobs/123/?utm_source=x&b=2&a=1#apply", "https://example.com/jobs/123?a=1&b=2"),
        (X.url_canonical, "not a url", None),
        (X.url_mask, "https://a.b/?app_key=s3&x=1", "https://a.b/?app_key=***&x=1"),
        (X.html_to_text, "<p>a&amp;lt;b &#233;&#x41;</p><ul><li>one<li>two</ul><script>x</script>", "a&lt;b éA\n\n• one\n• two"),
        (X.html_to_text, "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "Hi & bye"),
        (X.remote_class, "Hybrid or remote", "hybrid"),
        (X.short_label, "Python (computer programming)", "Python"),
        (X.month_to_date, "2019-3", "2019-03-01"),
        (X.month_to_date, "2019", "2019-01-01"),
        (X.parse_date, "soon", None),
    ],
)
def test_text_columns(one, make, value, want):
    assert one(make(col()), "x string", value) == want


def test_employment_types(one):
    assert one(X.employment_types(col()), "x string", "Full-time contract, zzp") == ["full_time", "freelance"]
    assert one(X.employment_types(col()), "x string", "contract") == ["contract"]


def test_dedup_key_is_stable(one):
    k = X.dedup_key(F.col("a"), F.col("b"), F.col("c"))
    ddl = "a string, b string, c string"
    assert one(k, ddl, "Senior Data Engineer (m/v/x)", "Canal Analytics B.V.", "Amsterdam") == one(
        k, ddl, "Sr Data Engineer", "Canal Analytics", "amsterdam"
    )


CV = """Jan van Dijk
Date of birth: 1 January 1990
jan@example.com | +31 6 1234 5678 | linkedin.com/in/jan
Kerkstraat 12, 1017 GA Amsterdam
Contract id 123456789
Worked with Piet Jansen in Paris"""


def test_redaction(spark):
    df = spark.createDataFrame([(CV, ["Piet Jansen"])], "text string, names array<string>")
    r = X.redact_steps(df, "text", "names").first()
    out = r["redacted"]
    for secret in ("Jan van Dijk", "1990", "jan@", "1234", "linkedin", "Kerkstraat", "1017", "123456789", "Piet", "Jansen"):
        assert secret not in out, secret
    assert "in Paris" in out and out.startswith("[NAME]")
    assert {k: r[f"n_{k}"] for k in ("email", "phone", "url", "address", "personal_line", "id_number")} == {
        "email": 1, "phone": 1, "url": 1, "address": 1, "personal_line": 1, "id_number": 1,
    }


def test_redaction_keeps_plain_text(spark):
    df = spark.createDataFrame([("experience\nbuilt a road in 2010 for 12 people",)], "text string")
    assert X.redact_text(df, "text").first()["text"] == "experience\nbuilt a road in 2010 for 12 people"


def slow_fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_embedding_matches_brute_force(spark):
    grams = ["data", "engineer", "data_engineer", "é", "x" * 40]
    assert list(fnv1a(grams)) == [slow_fnv(g) for g in grams]
    v = spark.createDataFrame([("Data engineer, at a data firm",)], "x string").select(embed(col()).alias("v")).first()["v"]
    words = ["data", "engineer", "data", "firm"]
    bow = [0.0] * DIMENSIONS
    for g in words + [f"{a}_{b}" for a, b in zip(words, words[1:])]:
        h = slow_fnv(g)
        bow[h % (DIMENSIONS - 1) + 1] += 1 if h & 1 else -1
    norm = sum(b * b for b in bow) ** 0.5
    want = [b / norm * 0.3**0.5 for b in bow]
    want[0] = 0.7**0.5
    assert max(abs(a - b) for a, b in zip(v, want)) < 1e-6
