"""Memory of packing: a task holds lists of runs and places of ids of a small slice of texts only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from barlake.llm import packing


def test_packing_asks_for_small_slices(spark, monkeypatch):
    seen = []

    class Cache:
        def many(self, texts):
            seen.append(sum(len(x) for x in texts.to_pylist()))
            assert seen[-1] <= 1 << 20, seen
            return [np.zeros(1, np.uint16)] * len(texts)

    monkeypatch.setattr(packing, "shared", lambda *x: Cache())
    made = []

    class Docs:
        """Gives the function of the tasks a batch of four texts of half a MB."""

        sparkSession, schema = spark, spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["a " * (1 << 18)] * 4)], ["key", "text"])
            made.extend(run(iter([batch])))

    packing.token_pieces(Docs())
    assert sum(x.num_rows for x in made) == 4 and len(seen) >= 2
