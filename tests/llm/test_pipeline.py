"""The pipeline's stages: what goes, what stays, and the columns between them."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from snaptrail.llm import contamination


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_stages(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rng = np.random.default_rng(6)
    docs = {i: " ".join(rng.choice(words, 40)) for i in range(200)}
    for i in range(0, 60, 2):  # toxic
        w = docs[i].split()
        w[3], w[20], w[31] = "zorqul", "zorqam", "zorqik"
        docs[i] = " ".join(w)
    for i in range(61, 85):  # a line on many sites
        docs[i] = docs[i] + "\nBoiler plate of all sites"
    docs[150] = docs[101]
    docs[151] = docs[101] + " one more"
    item = "this benchmark item has exactly nine words here today"
    docs[160] = docs[160] + " " + item + " " + docs[10][:30]
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in docs.items()] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    table(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, tmp_path, "labels", [(i, 1, int(i < 60 and i % 2 == 0)) for i in range(140)], "doc_id long, quality int, toxic int")
    table(spark, tmp_path, "benchmark", [(1, item), (2, None)], "item_id long, text string")
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert left.columns == corpus_pipeline.COLUMNS
        out = str(tmp_path / f"out{k}")
        left.write.parquet(out)
        left = spark.read.parquet(out)
        ids[name] = {r["doc_id"] for r in left.select("doc_id").distinct().collect()}
        if name == "line dedup":
            assert left.filter(F.contains("text", F.lit("Boiler"))).count() == 0 and left.filter("n_chars <> length(text)").count() == 0
    toxic = set(range(0, 60, 2))
    everyone = set(docs) | {900, 901}
    assert len(toxic - ids["toxicity"]) >= 27 and len((everyone - toxic) - ids["toxicity"]) <= 3
    assert ids["line dedup"] == ids["toxicity"]
    # the null and the empty text are one class
    assert ids["line dedup"] - ids["near dedup"] == {150, 151, 901} & ids["line dedup"]
    assert ids["near dedup"] - ids["decontamination"] == {160}
    assert ids["packing"] == ids["decontamination"]


def test_an_empty_corpus_passes(spark, tmp_path):
    table(spark, tmp_path, "documents", [], "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    table(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_tells_rows_apart_by_id_and_text(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(rng.choice(words, 60)) for _ in range(5))
    near = b + " more"
    rows = [(None, a), (None, c), (None, c), (7, d), (7, near), (7, d), (3, b), (None, b), (9, e), (9, e)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for parts in (1, 3):
        docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], schema).repartition(parts)
        left = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
        assert left.columns == corpus_pipeline.COLUMNS
        assert {(r["doc_id"], r["text"], r["source"]) for r in left.collect()} == {(None, a, "s0"), (None, c, "s1"), (7, d, "s3"), (3, b, "s6"), (9, e, "s8")}
        assert left.count() == 5


def test_decontamination_tells_rows_apart_by_id_and_text(spark, tmp_path):
    item, other = "this benchmark item has exactly nine words here today", "a wholly different second text under the same item id"
    table(spark, tmp_path, "benchmark", [(1, item), (1, other + " " + " ".join(f"x{i}" for i in range(60))), (None, other)], "item_id long, text string")
    rows = [(None, f"before {item} after"), (None, "clean text without any id at all"), (5, f"five holds {item}"), (5, "five has a clean text as well"), (6, f"six {other}"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == corpus_pipeline.COLUMNS
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(None, rows[1][1]), (5, rows[3][1]), (7, None)}
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    found = contamination.contained(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"], r["containment"]) for r in found} == {(None, 1, 5, 5, 1.0), (5, 1, 5, 5, 1.0)}
