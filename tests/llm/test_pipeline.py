import importlib.util
import os
import sys

import pytest
from pyspark.sql import functions as F

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def load():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(root, "corpus_pipeline.py"))
    m = importlib.util.module_from_spec(spec)
    sys.modules["corpus_pipeline"] = m
    spec.loader.exec_module(m)
    return m


def test_stages_against_plain_versions(spark):
    from test_filters import brute as overlaps
    from test_minhash import brute as classes
    from test_packing import check_rows

    from docloom.llm.common import materialise, table

    p = load()
    docs = table(spark, DATA, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, DATA, "labels").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    kept = {}
    for name, stage in p.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = materialise(stage(spark, docs, DATA))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        ids = {r["doc_id"] for r in before}
        if name == "language":
            assert kept[name] == ids
        elif name == "toxicity":
            assert all(labels.get(k) == 1 for k in ids - kept[name] if k in labels)
        elif name == "near_duplicates":
            assert kept[name] == {c for _, c in classes([(r["doc_id"], r["text"]) for r in before])}
        elif name == "decontamination":
            bad = {k for k, _, n_hit, *_ in overlaps([(r["doc_id"], r["text"]) for r in before], items) if n_hit}
            assert {str(k) for k in ids - kept[name]} == bad
        else:
            check_rows(docs.collect(), [(r["doc_id"], r["text"]) for r in before])
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(kept["packing"]) < 200


def test_run_and_odd_rows(spark, odd, none, tmp_path):
    p = load()
    base = spark.read.parquet(f"{DATA}/labels.parquet").limit(0), spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0)
    for name, df in (("odd", odd), ("none", none)):
        d = tmp_path / name
        df.write.parquet(str(d / "documents.parquet"))
        base[0].write.parquet(str(d / "labels.parquet"))
        base[1].write.parquet(str(d / "benchmark.parquet"))
        out = p.run(spark, str(d))
        assert out.where(F.col("length") < 1).count() == 0
        assert (out.count() > 10) == (name == "odd")
