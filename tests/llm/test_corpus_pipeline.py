"""The corpus pipeline, stage by stage, on a small table whose right result is known."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brooklet.llm import op10_jaccard
from brooklet.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    random.seed(11)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.lang: [x.text for x in source.where(f"lang = '{r.lang}'").orderBy("doc_id").limit(12).collect()] for r in source.select("lang").distinct().collect()}
    plain = [(t, lang) for lang, ts in texts.items() for t in ts]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(plain)]
    n = len(rows)
    fresh = " ".join(f"the and of word{random.randrange(9999)}" for _ in range(60))
    rows += [(n, "123 456", "en", "s", 7), (n + 1, None, "en", "s", None), (n + 2, f"{fresh} alpha", "en", "s", 1), (n + 3, f"{fresh} alpha", "en", "s", 1), (n + 4, f"{fresh[:200]} {item} {fresh[200:400]}", "en", "s", 1)]
    rows += [(n + 5, fresh[::-1] + " password=0123456789abcdef end", "en", "s", 1), (n + 2, f"{fresh} alpha", "en", "s", 1)]
    docs = spark.createDataFrame(rows, source.schema)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == source.columns, name
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert not {n, n + 1} & set(kept[0])
    assert kept[1].count(n + 2) == 1 and n + 3 not in kept[1]
    assert n + 4 in kept[1] and n + 4 not in kept[2]
    assert sorted(kept[3]) == sorted(kept[2])
    assert "password" not in docs.where(f"doc_id = {n + 5}").first().text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept[3])


def test_ids_that_say_little(spark):
    """Rows are told apart by id and text: an id that two texts share, null ids, repeated rows, further columns."""
    random.seed(13)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    make = lambda: " ".join(f"w{random.randrange(9999)}" for _ in range(80))
    one, two, three, four = make(), make(), make(), make()
    leak = f"{two} {item} {two[::-1]}"
    rows = [(5, one), (7, one + " more"), (7, two), (None, one + " again"), (None, three), (None, three + " tail"), (9, four), (9, four), (10, None), (11, ""), (None, None), (8, leak), (8, three[::-1]), (None, leak[:-40])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int, `group` string")
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()), key=str)
    null_texts = [t for i, t in got if i == 0 and t]
    assert [t for i, t in got if i in (5, 7, 9)] == [one, two, four]
    assert len([t for t in null_texts if t.startswith(three)]) == 1 and not any(t.startswith(one) for t in null_texts)
    assert {10, 11} <= {i for i, _ in got}
    clean = corpus_pipeline.decontaminated(spark, docs, SF)
    assert clean.columns == docs.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert (8, leak) not in left and (8, three[::-1]) in left and (None, leak[:-40]) not in left and (None, None) in left and len(left) == len(rows) - 2
    secret = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(" password=abcdef0123"))).otherwise(F.col("text")))
    out = corpus_pipeline.without_secrets(spark, secret, SF)
    assert out.columns == docs.columns and out.count() == len(rows) and out.where("text like '%password%'").count() == 0
    assert corpus_pipeline.packed(spark, docs, SF).where("start = 0").count() == len(rows)


def test_run(spark, tmp_path):
    """run() on a folder of its own: what is packed is what the stages keep, and no table of an earlier stage is left."""
    from pathlib import Path

    from brooklet.llm.common import shared_dir

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    docs = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test")
    middle = set(folder.iterdir())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert len(set(folder.iterdir()) - middle) <= 3 and len(middle - before) > 3


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty(spark, stage):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, empty, SF).count() == 0


def test_near_copies_of_one_text(spark, monkeypatch):
    """Of many near copies of one text each group keeps its least id, and their pairs are compared in few regions."""
    rng, compared, written = random.Random(15), [], op10_jaccard.stored
    words = [f"w{i}" for i in range(3000)]
    base, rows, sets, group = rng.choices(words, k=200), [], [], []
    for i in range(150):
        t = list(base)
        for k in rng.sample(range(200), rng.randint(1, 12)):
            t[k] = rng.choice(words)
        rows.append((i, " ".join(t)))
        s = set(zip(*(t[k:] for k in range(5)), strict=False))
        near = [j for j in range(i) if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])]
        sets.append(s)
        joined = {group[j] for j in near} | {i}
        group = [min(joined) if g in joined else g for g in [*group, i]]

    def seen(df, tag):
        out = written(df, tag)
        if tag == "windows":
            compared.append(out.count())
        return out

    monkeypatch.setattr(op10_jaccard, "stored", seen)
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert sum(compared) <= 2 * len(rows)
