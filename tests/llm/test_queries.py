"""The registered training-data queries against DuckDB, the pipeline against plain Python, and the entry without the subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barlattice.llm import pii_fpe, quality_fm, tokens
from barlattice.llm.queries import ORACLES, PII_KEY, QUERIES, fit_quality, tokenizer
from tests.llm.test_operators import contaminated, jaccard_components
from tools.verify import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    _, status, _, detail = compare(name, spark, sf, duck(sf), QUERIES, ORACLES)
    assert status == "OK", detail


def test_tokens_of_the_table(spark, sf):
    """op4 and op10 against one library call per text."""
    e = tokens.Encoder.of(tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    ids = {r["doc_id"]: e._library([r["text"] or ""])[0] + bytes(4) for r in docs}
    want, start = [], 0
    for d in sorted(ids):
        want.append((d, start, len(ids[d]) // 4, zlib.crc32(ids[d])))
        start += len(ids[d]) // 4
    got = QUERIES["op4_bit_packed_tokens"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want
    pieces = QUERIES["op10_cost_packing"](spark, sf).collect()
    for r in pieces:
        assert zlib.crc32(ids[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"] and r["doc_tokens"] * 4 == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == start


def test_pipeline(spark, sf, tmp_path):
    """Each stage on what its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = {r["doc_id"]: r for r in docs.collect()}

    def after(name, frame):
        stages[name](spark, frame, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, {r["doc_id"]: r for r in out.collect()} if "text" in out.columns else out.collect()

    model = fit_quality(spark, sf)
    good = {d for d, r in held.items() if quality_fm.predict(pa.array([r["text"] or ""], pa.large_string()), pa.array([r["n_chars"]], pa.float64()).to_numpy(zero_copy_only=False), model)[0] >= 0.7}
    docs, kept = after("quality_classifier", docs)
    assert docs.columns == corpus_pipeline.COLUMNS and set(kept) == good and len(good) < len(held)
    firsts = {d for d, _, c in jaccard_components([(d, r["text"]) for d, r in kept.items()], 5, 80, 100) if d == c}
    docs, kept = after("near_duplicates", docs)
    assert docs.columns == corpus_pipeline.COLUMNS and set(kept) == firsts and len(firsts) < len(good)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, r in kept.items() if not contaminated(r["text"], items)[4]}
    docs, kept = after("benchmark_decontamination", docs)
    assert docs.columns == corpus_pipeline.COLUMNS and set(kept) == clean and len(clean) < len(firsts)
    names = pii_fpe.Pseudonyms(PII_KEY)
    want = {d: pii_fpe.replace(r["text"], names)[0] for d, r in kept.items()}
    changed = sum(want[d] != r["text"] for d, r in kept.items())
    docs, kept = after("pii_pseudonyms", docs)
    assert docs.columns == corpus_pipeline.COLUMNS and {d: r["text"] for d, r in kept.items()} == want and changed
    e = tokens.Encoder.of(tokenizer())
    _, pieces = after("sequence_packing", docs)
    assert sum(r["length"] for r in pieces) == sum(len(e._library([t])[0]) // 4 + 1 for t in want.values())


def test_pipeline_takes_odd_tables(spark, sf):
    """No documents, and documents that are null, empty, without id, repeated or of equal id."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, None), (3, "w " * 5000, "en", "s", 1), (3, "other text of equal id", "en", "s", 2), (3, "w " * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS and stage(spark, docs.limit(0), sf).count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    assert stages["near_duplicates"](spark, docs, sf).count() == 5
    assert stages["benchmark_decontamination"](spark, docs, sf).count() == 6 and stages["pii_pseudonyms"](spark, docs, sf).count() == 6
    assert stages["sequence_packing"](spark, docs, sf).agg(F.count_distinct("doc_id")).first()[0] == 3


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sma' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=env, timeout=120)
