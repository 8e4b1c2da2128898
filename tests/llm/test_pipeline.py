"""The corpus pipeline against a brute-force version, with nulls, repeated rows, empty tables and clashing columns."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import contaminated_by_definition, linked_by_definition
from tidemark.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, salt string, component_id int"


def tables(spark, folder, docs, benchmark=(), labels=()):
    rows = [(i, t, lang, "s", len(t or ""), 1, "x", 2) for i, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def by_brute_force(docs, benchmark):
    """Without labels every document with words is good; the other stages by their definitions."""
    kept = {i: t for i, t, _ in docs if (t or "").split()}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    kept = {i: kept[i] for i in last.values()}
    component = linked_by_definition(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    bad = {d for d, _ in contaminated_by_definition(list(kept.items()), benchmark)}
    data, pattern = bpe.vocabulary()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    return {i: coder.encode_ordinary(t) for i, t in kept.items() if i not in bad}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, item = text(60), text(25)
    docs = [(i, text(rng.randint(1, 80)), rng.choice(["en", None, "zz"])) for i in range(60)]
    docs += [(100 + i, base.replace(base.split()[7 * i], "other"), "en") for i in range(8)] + [(120 + i, base, "en") for i in range(5)]
    docs += [(200, f"{text(20)} {item} {text(20)}", "en"), (201, item, None), (202, None, "en"), (203, "", None), (204, " \n\t", "en"), (205, "x" * 50_000, "en"), (206, "one", "en")]
    docs += [(207, "Twice the same row", "en"), (207, "Twice the same row", "en")]
    folder = tables(spark, tmp_path, docs, [(1, item), (2, None), (3, "")])
    got = {r.doc_id: list(memoryview(bytes(r.ids)).cast("I")) if r.ids else [] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == by_brute_force(docs, [(1, item), (2, None), (3, "")])


def test_pipeline_of_empty_tables_and_null_ids(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [])).count() == 0
    folder = tables(spark, tmp_path / "b", [(None, "a row without an id", "en"), (1, None, None)], [(5, "other")], [(None, None, None), (1, 1, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
    assert [r.text for r in docs.collect()] == ["a row without an id"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES) - 1))
def test_each_stage_keeps_clean_documents(spark, stage):
    """On the supplied documents a stage only drops, and every stage drops something it was made for."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    assert kept.columns == docs.columns and kept.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
    n = kept.count()
    assert 0.6 * docs.count() <= n < docs.count()
    assert n == kept.select(F.count_distinct("doc_id")).first()[0]
