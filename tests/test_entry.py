"""Driver contract: entry() runs on sf0.001, every oracle has a job, names are unique."""

from __future__ import annotations

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"dataset", "sample_count", "diversity_score", "passed"} <= set(df.columns)


def test_oracles_have_jobs_and_job_names_are_clean():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_config_hashes_match_python(spark):
    import hashlib
    import json

    import pyarrow.parquet as pq

    from .conftest import SF001

    rows = {r["config_id"]: r for r in E.queries()["config_hashes"](spark, SF001).collect()}
    t = pq.read_table(f"{SF001}/part.parquet").to_pylist()
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()
    for p in t[:50]:
        model = {
            "model": {"name": p["p_name"]}, "training": {"type": p["p_type"]}, "datasets": {"default": {"price": p["p_retailprice"]}},
        }
        training = {**model, "provider_name": p["p_brand"], "provider": {"size": p["p_size"]}}
        got = rows[p["p_partkey"]]
        assert got["model_dataset_hash"] == digest(model)
        assert got["training_critical_hash"] == digest(training)
        assert got["late_stage_hash"] == digest({"inference": {"type": p["p_type"]}, "evaluation": {"size": p["p_size"]}})


def test_jobs_are_listed_without_a_session():
    import subprocess
    import sys

    from .conftest import ROOT

    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
