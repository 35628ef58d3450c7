import json

from pyspark.sql import functions as F

from laborlens.operators import classify as C, taxonomy as T
from laborlens.sources import feeds as S, mapping as P, taxonomy_files as TX
from laborlens.streaming import jobs as J


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_adzuna_file(spark, tmp_path):
    doc = {"count": 1, "results": [{"id": "7", "title": "Dev <b>x</b>", "description": "d", "created": "2026-08-01T10:00:00Z", "redirect_url": "u",
                                    "company": {"display_name": "Acme"}, "location": {"display_name": "Delft, ZH", "area": ["NL", "ZH", "Delft"]},
                                    "salary_min": 50000, "salary_is_predicted": "1", "contract_time": "full_time"}]}
    r = S.map_adzuna(S.read_adzuna(spark, write(tmp_path / "a.json", json.dumps(doc)))).first()
    assert (r["external_id"], r["title"], r["city"], r["region"], r["employment_types"]) == ("7", "Dev x", "Delft", "ZH", ["full_time"])
    assert r["salary"]["min"] == 50000 and r["salary"]["is_estimate"] and r["salary"]["unit"] == "year"
    assert str(r["date_posted"]) == "2026-08-01"


def test_personio_file(spark, tmp_path):
    xml = ("<workzag-jobs><position><id>12</id><office>Breda</office><name>Tester</name><jobDescriptions><jobDescription><name>You</name>"
           "<value><![CDATA[<p>test</p>]]></value></jobDescription><jobDescription><name>We</name><value>pay</value></jobDescription></jobDescriptions>"
           "<employmentType>intern</employmentType><schedule>full-time</schedule><createdAt>2026-07-02T00:00:00+00:00</createdAt></position></workzag-jobs>")
    r = S.map_personio(S.read_personio(spark, write(tmp_path / "p.xml", xml)), "acme").first()
    assert r["description"] == "You\ntest\n\nWe\npay" and r["employment_types"] == ["full_time", "internship"]
    assert (r["external_id"], r["company_name"], str(r["date_posted"])) == ("12", "acme", "2026-07-02")


def test_generic_xml_mapping(spark, tmp_path):
    xml = "<feed><job ref='a1'><functie>Kok</functie><tekst>&lt;p&gt;Soep&lt;/p&gt;</tekst><salaris>€ 2.500 per maand</salaris></job><job><functie>Chef</functie></job></feed>"
    items = S.read_feed_items(spark, write(tmp_path / "f.xml", xml), "xml", "job", "attr_ref string, functie string, tekst string, salaris string")
    rows = items.select(F.try_parse_json(F.to_json(F.struct("*"))).alias("item"))
    fields = {"externalId": {"path": "attr_ref"}, "title": {"path": "functie"}, "description": {"path": "tekst"}, "salaryText": {"path": "salaris"}}
    mapped = P.map_items(rows, "item", fields)
    good = P.accepted(mapped).collect()
    assert [(r["external_id"], r["title"], r["description"], r["salary"]["min"], r["salary"]["unit"]) for r in good] == [("a1", "Kok", "Soep", 2500.0, "month")]
    assert P.rejected(mapped).first()["errors"] == ["externalId: required field is empty", "description: required field is empty"]


def test_number_transform(one):
    assert one(P.number_of(F.col("x")), "x string", "32,5 uur") == 32.5
    assert one(P.number_of(F.col("x")), "x string", "none") == 0.0
    assert one(P.number_of(F.col("x")), "x string", "3.500,00") is None


def test_taxonomy_csv(spark, tmp_path):
    write(tmp_path / "skills_en.csv", 'conceptUri,preferredLabel,altLabels,skillType\nu1,"say ""hi""","one\ntwo|three",knowledge\nu2,plain,,skill\n')
    write(tmp_path / "skills_nl.csv", "conceptUri,preferredLabel\nu1,hoi\n")
    write(tmp_path / "broaderRelationsSkillPillar.csv", "conceptUri,broaderUri\nu1,u2\n")
    write(tmp_path / "occupations_en.csv", "conceptUri,preferredLabel,altLabels,iscoGroup,code\no1,cook,,5120,1\no2,x,,51,2\n")
    write(tmp_path / "occupations_nl.csv", "conceptUri,preferredLabel\n")
    skills, jobs = TX.read_taxonomy_csv(spark, str(tmp_path))
    rows = {r["uri"]: r for r in skills.collect()}
    assert rows["u1"]["label_en"] == 'say "hi"' and rows["u1"]["alt_labels"] == ["one", "two", "three"]
    assert rows["u1"]["broader_uris"] == ["u2"] and rows["u2"]["alt_labels"] == [] and rows["u2"]["label_nl"] is None
    assert [r["uri"] for r in jobs.collect()] == ["o1"]


CONCEPTS = [
    ("py", "Python (computer programming)", None, ["Python"]), ("af", "Airflow", None, ["Apache Airflow"]), ("pg", "PostgreSQL", None, ["Postgres"]),
    ("dk", "Docker", None, []), ("r", "R", None, []), ("pm", "project management", None, []), ("cs", "C#", None, []),
]


def found(spark, text):
    concepts = spark.createDataFrame(CONCEPTS, "uri string, label_en string, label_nl string, alt_labels array<string>")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hits = T.find_concepts(docs, T.label_entries(concepts), "doc_id", "text").collect()
    return [h["uri"] for h in sorted(hits, key=lambda h: (h["index"], -len(h["label"])))]


def test_dictionary(spark):
    assert found(spark, "Built pipelines in Python and Airflow on Postgres, deployed with Docker.") == ["py", "af", "pg", "dk"]
    assert found(spark, "We use R daily; no Rust, no docker-like. Project  Management!") == ["r", "dk", "pm"]
    assert found(spark, "r and c# and C# code") == ["cs"]
    assert found(spark, "dockers python3 airflow+") == []


def test_languages(spark):
    docs = spark.createDataFrame([(1, "Fluent English. Dutch is a plus; German B1")], "doc_id long, text string")
    got = {(r["language"], r["level"], r["required"]) for r in C.mentioned_languages(docs, "doc_id", "text", "B2", True).collect()}
    assert got == {("en", "C1", True), ("nl", "B2", False), ("de", "B1", False)}


def test_ingest_stream_runs_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    dirs = [str(tmp_path / n) for n in ("archive", "canon", "ckpt")]

    def run(n, rows):
        write(land / f"{n}.json", "\n".join(json.dumps(dict(zip(("source_id", "external_id", "payload"), r))) for r in rows))
        J.stream_ingest(spark, str(land), *dirs, lambda d: d.select("external_id", "payload_hash")).awaitTermination()
        return J.archive_table(spark, dirs[0]).read().count(), spark.read.parquet(dirs[1]).count()

    assert run(1, [("s", "1", "a"), ("s", "1", "a"), ("s", "2", "b")]) == (2, 2)
    assert run(2, [("s", "1", "a"), ("s", "1", "c")]) == (3, 3)
