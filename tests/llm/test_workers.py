"""What operators leave in Spark's Python workers, which other stages use again."""

from __future__ import annotations

import os

import pyarrow as pa

from rulewright.llm import hmm, jaccard_join, packing
from rulewright.llm.common import stored
from rulewright.llm.queries import tokenizer_path


def _wordbooks(spark):
    """How many workers of four tasks, started one after another or not, still hold ids of words."""

    def look(batches):
        import gc

        for batch in batches:
            found = [x for x in gc.get_objects() if isinstance(x, packing.WordIds)]
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(found)])], ["pid", "n"])

    return {r.pid: r.n for r in spark.range(0, 4, 1, 4).mapInArrow(look, "pid long, n long").collect()}


def _texts(spark, n=2000):
    return spark.range(0, n, 1, 4).selectExpr("id AS doc_id", "concat('word', id, ' another', id * 7, '\n', repeat(concat('some line ', id % 9), 5)) AS text")


def test_another_operator_ends_what_packing_remembers(spark):
    docs = _texts(spark)
    assert packing.pack(docs, tokenizer_path()).count() >= 2000
    assert sum(_wordbooks(spark).values()) >= 1
    for _ in range(3):  # four tasks at once, so that all workers get one
        jaccard_join.describe(docs).count()
    assert sum(_wordbooks(spark).values()) == 0


def test_scoring_ends_what_packing_remembers(spark):
    docs = _texts(spark)
    assert packing.pack(docs, tokenizer_path()).count() >= 2000
    assert sum(_wordbooks(spark).values()) >= 1
    for _ in range(3):  # four tasks at once, so that all workers get one
        hmm.blocks(docs, 4).count()
    assert sum(_wordbooks(spark).values()) == 0


def test_expected_counts_hold_one_lot(monkeypatch):
    """Neither a lot's probabilities add up with the next one's, nor its weights with its emissions."""
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(5)
    model = hmm.Model.first(rnd.random(hmm.CLASSES))
    kinds, sizes = rnd.integers(0, hmm.CLASSES, 2000 * 150), np.full(2000, 150)
    monkeypatch.setattr(hmm, "LOT", 1 << 16)
    tracemalloc.start()
    hmm.expected(model, kinds, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * hmm.LOT * hmm.STATES * 8


def test_scores_shuffle_no_words(spark):
    """What meets the corpus counts in the end is a block without its words and their own counts."""
    plan = hmm.score(_texts(spark, 50), rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert "places" in plan and "words" not in plan


def test_tasks_of_packing_share_what_they_remember(spark):
    """One book of words in a worker, however many tasks it ran."""
    docs = stored(_texts(spark), "texts")
    for _ in range(3):
        packing.pack(docs.repartition(8), tokenizer_path()).count()
    assert set(_wordbooks(spark).values()) <= {0, 1}


def test_describing_texts_takes_little_memory(spark):
    """Neither the shingles of a slice nor the tokens that wait to be counted add up with the texts."""
    import random
    import tracemalloc

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, shape):
            return run

    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(20_000)]
    texts = [" ".join(words[k : k + 1000]) for k in (rnd.randrange(19_000) for _ in range(4500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(len(b.column("n_shingles").drop_null()) for b in jaccard_join.describe(Docs())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 100e6
