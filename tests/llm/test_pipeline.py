from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenvec.llm.decontaminate import find_leaks
from lumenvec.llm.near_dup import near_duplicates
from lumenvec.llm.packing import TOKENIZER, Encoder
from lumenvec.llm.toxic import score_toxicity, train

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, part int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, toxic ones, near copies and leaks; labels; items."""
    r = np.random.default_rng(20)
    words = ["w%d" % i for i in range(800)]
    text = lambda n: " ".join(r.choice(words, n))
    base, item = text(150), text(60)
    rows = [(i, (text(80) + (" idiot scum" if i % 6 == 0 else "") + "\n\n" + text(20)), ["en", None, "de"][i % 3], ["a", "b", None][i % 3], 1, 0) for i in range(240)]
    rows += [(300 + i, base + f" tail{i}", "en", "a", None, None) for i in range(5)] + [(None, base, None, None, None, None)] * 3
    rows += [(400, text(30) + " " + item + " " + text(30), "en", "b", 1, 1), (None, item, None, "b", 1, 1), (401, item[: len(item) // 4], "en", "b", 1, 1)]
    rows += [(500, None, "en", "a", 0, 0), (501, "", None, None, 0, 0), (502, " \n ", "en", "b", 0, 0), (503, text(20_000), "en", "a", 0, 0), (1, "one two", "en", "a", 0, 0), (1, "one two", "en", "a", 0, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)] + [(7, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_one_by_one(spark, folder):
    """Each stage's rows against the operator that decides them and against what was planted; columns stay those of documents."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))

    mild = stages["toxicity"](spark, docs, folder)
    scored = score_toxicity(docs, train(docs, labels))
    assert mild.columns == docs.columns and mild.count() == scored.where("not toxic").count()
    texts = [r.text or "" for r in mild.collect()]
    assert sum("idiot" in t for t in texts) <= 4 and sum("idiot" not in t for t in texts) >= docs.where("text is null or text not like '%idiot%'").count() - 4

    once = stages["near_duplicates"](spark, docs, folder)
    kept = bag(once)
    assert once.columns == docs.columns and not kept - bag(docs)
    groups = near_duplicates(docs.where("doc_id >= 300 and doc_id < 400"), 80).toPandas()
    assert groups.component_id.nunique() == 1
    assert sum(n for x, n in kept.items() if x[1] and "tail" in x[1] or x[0] is None and x[4] is None) == 1
    assert sum(n for x, n in kept.items() if x[1] == "one two") == 1 and sum(n for x, n in kept.items() if not (x[1] or "").strip()) == 3
    assert sum(kept.values()) == docs.count() - 7 - 1

    clean = stages["decontamination"](spark, docs, folder)
    leaks = {r.doc_id for r in find_leaks(docs, benchmark).collect()}
    assert leaks == {400, None} and clean.columns == docs.columns and clean.count() == docs.count() - 2 and not clean.where("doc_id = 400").count()

    mix = stages["mixing"](spark, clean, folder)
    size = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert mix.columns == docs.columns and abs(size(mix) / size(clean) - 1.5) < 0.1 and mix.where("text is null").count() == 0
    whole = {r.text for r in clean.collect()}
    assert sum(r.text in whole for r in mix.collect()) > 0.8 * mix.count()

    packed = stages["packing"](spark, mix, folder).collect()
    encoder = Encoder(open(TOKENIZER, "rb").read())
    assert sum(r.n_tokens for r in packed) == sum(len(encoder.encoding.encode_ordinary(r.text)) for r in mix.collect())


def test_run_is_the_stages_in_order(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(len(r.input_ids) == 4096 and r.cu_seqlens[-1] == r.n_tokens for r in rows)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_columns_of_odd_names(spark, folder):
    """Names with spaces, dots and colons, and those that the stages use themselves, come through every stage but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("a b", "a.b", "x:y", "__row", "__all", "row", "score", "place", "__component"):
        docs = docs.withColumn(name, F.lit(f"kept {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
        assert [tuple(r) for r in out.select(*[f"`{c}`" for c in docs.columns[-9:]]).distinct().collect()] == [tuple(f"kept {c}" for c in docs.columns[-9:])]
    assert corpus_pipeline.packing(spark, docs, folder).count() > 0
