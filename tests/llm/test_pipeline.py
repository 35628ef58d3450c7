"""The stages against brute force, each on its own input, and the whole run on a small folder."""

import re

import pytest
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_near_duplicates import plain as plain_groups
from test_search_tiling_toxicity import plain_tiles, split, toxic_rows

import corpus_pipeline
from laborlens.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEMS = [(0, " ".join(f"bench{i}" for i in range(24))), (1, " ".join(f"item{i}" for i in range(30)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic texts, repeated lines, near copies and benchmark passages."""
    rows, labels = toxic_rows(9, 700)
    extra = []
    for i, (_, text) in enumerate(rows[:60]):
        words = text.split(" ")
        words[len(words) // 2] = f"edit{i}"
        extra.append((1000 + i, " ".join(words)))  # near copies
    moved = ITEMS[0][1].split()
    extra += [(2000, "intro words here " + " ".join(moved[12:] + ["gap"] + moved[:12])), (2001, "some " + " ".join(ITEMS[1][1].split()[:9]) + " end")]
    extra += [(3000 + i, f"the very same closing line stands here again today\nown line of {i} " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(20)]
    extra += [(4000, None), (4001, "")]
    root = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in rows + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict(labels)


def test_every_stage_on_its_own_input(spark, folder):
    root, labels = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, root)
        path = f"{root}/{k}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name != "mixing":
            assert docs.columns == COLUMNS
        kept[name] = (before, after)

    before, after = kept["toxicity"]
    wrong = sum((i in after) == bool(t) for i, t in labels.items())
    assert wrong <= 0.02 * len(labels) and {4000, 4001, 3000} <= set(after)
    assert all(after[i] == before[i] for i in after)

    before, after = kept["line_dedup"]
    gone = plain_lines([(i, r["text"]) for i, r in before.items()])
    assert set(after) == set(before)
    for i, r in after.items():
        lines = None if before[i]["text"] is None else before[i]["text"].split("\n")
        want = None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))
    assert any(gone.values())

    before, after = kept["near_duplicates"]
    groups = plain_groups(sorted((i, r["text"]) for i, r in before.items()))
    assert set(after) == set(groups.values())

    before, after = kept["decontamination"]
    for i, r in before.items():
        shares = [plain_tiles(split(t), split(r["text"]), 5) if "bench" in (r["text"] or "") or "item" in (r["text"] or "") else 0.0 for _, t in ITEMS]
        assert (i in after) == (max(shares) < 0.5)
    assert 2000 not in after

    before, after = kept["mixing"]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in before.items()}
    assert set(after) <= set(before) and all(r["taken"] == r["copies"] * size[i] and r["copies"] in (1, 2) for i, r in after.items())
    total = {}
    for i, r in after.items():
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
    for r in after.values():
        assert abs(total[r["source"]] - r["target"]) <= max(size.values())


def test_run_gives_the_last_stage(spark, folder):
    root, _ = folder
    rows = corpus_pipeline.run(spark, root)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken", "copies"] and rows.count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).lexicon == {}


CLASHES = ("score", "held_out", "removed", "_id", "contaminated", "items", "id", "others_", "predicted", "line", "coverage", "n_lines")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Names that stages use inside, no ``n_chars``, repeated ids, nulls and empty texts."""
    rows = [(1, "a b c\nd e f"), (1, "quite another text of its own here"), (2, "a b c\nx y z"), (None, "a b c"), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("kept"))
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such passage in any text")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert all(r["removed"] == "kept" and r["items"] == "kept" and r["_id"] == "kept" for r in out.collect())
    texts = [r["text"] for r in corpus_pipeline.one_of_each_group(spark, docs, folder).filter("doc_id = 1").collect()]
    assert len(texts) == 2  # different texts under one id both stay
