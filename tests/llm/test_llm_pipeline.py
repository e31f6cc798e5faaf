"""The pipeline stage by stage, each against the operator's brute-force meaning on its own input."""

from __future__ import annotations

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_llm_operators import LOWER, brute_components, brute_ratios, check_packing

from barlake.llm import decontamination, line_dedup, toxicity


def brute_toxic(rows, labels, slope, intercept):
    """Ids of the rows that the two models, counted and compared in plain Python, call toxic."""

    def words(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode())

    def grams(word):
        return [(b"\1" + word + b"\2")[max(0, j - 5) : j + 2] for j in range(len(word) + 1)]

    counts = collections.defaultdict(lambda: [0, 0])
    for i, text in rows:
        if i in labels and zlib.crc32(str(i).encode()) % 5:
            for word in words(text):
                for g in grams(word):
                    counts[g][labels[i]] += 1
    ratio = brute_ratios(counts)
    out = set()
    for i, text in rows:
        own = [np.log(1 + toxicity.TOXIC_WORDS * (np.exp(sum(ratio.get(g, 0) for g in grams(w))) - 1)) for w in words(text)]
        if slope * sum(own) / max(1, len(own)) + intercept >= 0:
            out.add(i)
    return out


def brute_lines(rows):
    """Texts without the lines of the host that are boilerplate; rows: id, host, text."""
    pages, holds = collections.Counter(h for _, h, _ in rows), collections.Counter()
    for _, h, text in rows:
        holds.update((h, x) for x in {x.strip(" ") for x in (text or "").split("\n")} if x)
    bad = {k for k, n in holds.items() if n >= line_dedup.LEAST_PAGES and n >= pages[k[0]] * line_dedup.RATIO}
    return {i: "\n".join(x for x in text.split("\n") if (h, x.strip(" ")) not in bad) for i, h, text in rows}


def brute_leaks(rows, items):
    """Ids of the texts that an item aligns with, by alignment of every pair that has enough words in common."""

    def code(text):
        return np.array([zlib.crc32(x) for x in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode())], np.int64)

    tests, out = [code(x) for x in items], set()
    for i, text in rows:
        own = code(text)
        if any(np.isin(t, own).sum() >= decontamination.SCORE * len(t) and decontamination.align(t, own)[0] >= decontamination.SCORE for t in tests if len(t)):
            out.add(i)
    return out


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = docs.count()
        rows = [(r.doc_id, r.source, r.text) for r in before.collect()]
        texts = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else {}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            slope, intercept = toxicity.fit(before, labels)[1:]
            toxic = brute_toxic([(i, t) for i, _, t in rows], {r.doc_id: r.toxic for r in labels.collect()}, slope, intercept)
            assert toxic and set(texts) == {i for i, _, _ in rows} - toxic
        if name == "line_dedup":
            assert texts == brute_lines(rows)
        if name == "decontamination":
            leaks = brute_leaks([(i, t) for i, _, t in rows], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
            assert leaks and set(texts) == {i for i, _, _ in rows} - leaks
        if name == "near_dedup":
            want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, c in want.items() if i == c}
        if name == "packing":
            rows = docs.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
            check_packing(rows, sum(r.length for r in rows) / 4096)
    assert kept["toxicity"] >= 150 and kept["decontamination"] < kept["near_dedup"] < kept["line_dedup"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_with_odd_rows(spark):
    """Nulls in any column, repeated rows, an extra column, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rank", F.lit("x"))
    null = docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    odd = docs.limit(20).union(docs.limit(2)).union(null).union(null)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert name == "packing" or got.columns == odd.columns
        assert got.where("doc_id is null").count() == 2
        assert stage(spark, odd.limit(0), SF).count() == 0
