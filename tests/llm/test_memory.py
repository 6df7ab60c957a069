"""What near duplicates hold and move: one Python worker a task, texts where they lie, freed memory handed back."""

import os

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import common, kernel, ngram_jaccard
from hearthline.llm.common import Scratch

D = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    if not os.path.isdir(D):
        pytest.skip("no test data")
    return spark.read.parquet(f"{D}/documents.parquet")


def test_no_written_table_runs_two_python_functions(docs, monkeypatch):
    plans = []
    plain = Scratch.table

    def table(self, df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    assert ngram_jaccard.near_duplicates(docs).count() == docs.count()
    assert "open" in dict(plans) and not [n for n, p in plans if p.count("InArrow") > 1]


def test_dropping_near_duplicates_does_not_shuffle_texts(docs):
    left = ngram_jaccard.drop_near_duplicates(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    found = ngram_jaccard.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == sorted({r["component_id"] for r in found})


def test_a_tidy_function_hands_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def body(batches):
        held = [np.ones(2000) for _ in range(10_000)]  # small arrays, which malloc keeps
        pins = [np.ones(2000) for _ in range(1)]
        del held
        yield from batches
        sizes.append(resident())
        pinned.extend(pins)

    sizes, pinned = [], []
    assert list(kernel.tidy(body)(iter([1, 2]))) == [1, 2]
    assert resident() <= sizes[0] - 50_000_000


def test_written_tables_hand_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(common.BATCH)
    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    with common.Scratch(spark, "batches") as scratch:
        found = [r["n"] for r in scratch.table(rows, "sizes").collect()]
    assert sum(found) == 5000 and max(found) <= 1000
    assert spark.conf.get(common.BATCH) == before


def test_prefix_tokens_that_one_document_has_make_no_entries(spark, monkeypatch):
    """Pairs share 60 of 204 shingles, which leave the prefixes; most of those that take their place are in one document each."""
    made = {}
    plain = Scratch.table

    def table(self, df, name):
        out = plain(self, df, name)
        if name == "entries":
            made[name] = out.groupBy("token").count().where("count = 1").count()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    words = lambda name, n: " ".join(f"{name}x{j}" for j in range(n))
    rows = [(k, f"{words(f'pair{k // 2}', 64)} {words(f'own{k}', 140)}") for k in range(60)]
    got = dict(ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "component_id").collect())
    assert got == {k: k for k in range(60)}
    assert made["entries"] < 10
