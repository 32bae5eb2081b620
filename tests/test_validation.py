"""Dataset checks: boundary values from the reference's unit tests and
brute-force Python equality on driver data."""

from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from finelens.functions.text import py_split, py_strip, py_strip_length
from finelens.operators import checks as C

from .conftest import SF001


def _text_df(spark, texts, dataset="d"):
    rows = [(dataset, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, row_idx bigint, text string")


def test_python_whitespace_semantics(spark):
    samples = ["a\x1cb c", " 　lead\xa0trail  ", "\t\n", "x\x0by\x85z", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(py_split("s").alias("t"), py_strip("s").alias("p"), py_strip_length("s").alias("n")).collect()
    for s, r in zip(samples, got):
        assert r["t"] == s.split()
        assert r["p"] == s.strip()
        assert r["n"] == len(s.strip())


def test_duplicates_seven_equal_rows(spark):
    texts = ["same text"] * 7 + ["a", "b", "c"]
    r = C.dedup_stats(_text_df(spark, texts), ["dataset"]).collect()[0]
    assert r["duplicate_count"] == 6
    assert r["duplicate_ratio"] == pytest.approx(0.6)
    assert r["passed"] is False
    pairs = C.duplicate_pairs(_text_df(spark, texts), ["dataset"]).collect()
    assert sorted((p["dup_idx"], p["first_idx"]) for p in pairs) == [(i, 0) for i in range(1, 7)]


def test_duplicates_exactly_at_threshold_pass(spark):
    texts = ["dup"] * 2 + [f"t{i}" for i in range(8)]
    r = C.dedup_stats(_text_df(spark, texts), ["dataset"]).collect()[0]
    assert r["duplicate_ratio"] == pytest.approx(0.1)
    assert r["passed"] is True


def test_dedup_is_case_and_whitespace_sensitive(spark):
    r = C.dedup_stats(_text_df(spark, ["Hello", "hello", "hello ", "hello"]), ["dataset"]).collect()[0]
    assert r["duplicate_count"] == 1


def test_empty_ratio_and_avg_length(spark):
    texts = ["", "   ", "short", "this text is long enough"] + ["x" * 60] * 6
    prof = C.text_profile(_text_df(spark, texts), ["dataset"])
    r = C.default_check_columns(prof, C.TextThresholds(min_samples=10)).collect()[0]
    assert r["empty_count"] == 3
    assert r["empty_ratio"] == pytest.approx(0.3)
    assert r["avg_length"] == pytest.approx(sum(len(t) for t in texts) / 10)
    assert r["min_samples_passed"] is True


def test_profile_of_empty_group_and_zero_tokens(spark):
    prof = C.text_profile(_text_df(spark, ["", "  "]), ["dataset"]).collect()[0]
    assert prof["sample_count"] == 2
    assert prof["total_tokens"] == 0 and prof["unique_tokens"] == 0
    r = C.default_check_columns(C.text_profile(_text_df(spark, ["", "  "]), ["dataset"])).collect()[0]
    assert r["diversity_score"] == 0.0


def test_profile_matches_python_on_driver_documents(spark):
    t = pq.read_table(f"{SF001}/documents.parquet").to_pydict()
    exp: dict[str, dict] = {}
    for src, text in zip(t["source"], t["text"]):
        s = "None" if text is None else text
        e = exp.setdefault(src, {"n": 0, "len": 0, "short": 0, "tok": 0, "set": set(), "md5": set()})
        e["n"] += 1
        e["len"] += len(s)
        e["short"] += len(s.strip()) < 10
        toks = s.lower().split()
        e["tok"] += len(toks)
        e["set"].update(toks)
        e["md5"].add(hashlib.md5(s.encode()).hexdigest())
    from finelens.sources.tables import Tables

    tb = Tables(spark, SF001)
    prof = {r["dataset"]: r for r in C.text_profile(tb.text_samples, ["dataset"]).collect()}
    dd = {r["dataset"]: r for r in C.dedup_stats(tb.text_samples, ["dataset"]).collect()}
    assert set(prof) == set(exp)
    for k, e in exp.items():
        p = prof[k]
        assert (p["sample_count"], p["total_length"], p["empty_count"]) == (e["n"], e["len"], e["short"])
        assert (p["total_tokens"], p["unique_tokens"]) == (e["tok"], len(e["set"]))
        assert dd[k]["unique_count"] == len(e["md5"])


def test_diversity_score_formula(spark):
    # 3 distinct of 4 tokens -> min(10 * 0.75, 1) = 1.0 ; 1 of 40 -> 0.25
    r = C.default_check_columns(C.text_profile(_text_df(spark, ["a b c a"]), ["dataset"])).collect()[0]
    assert r["diversity_score"] == 1.0
    r = C.default_check_columns(C.text_profile(_text_df(spark, ["w " * 40]), ["dataset"])).collect()[0]
    assert r["diversity_score"] == pytest.approx(0.25)


def test_preference_rules(spark):
    rows = [("d", 0, "a", "b"), ("d", 1, "Same ", " same"), ("d", 2, None, "x"), ("d", 3, "y", None), ("d", 4, None, None)]
    pairs = spark.createDataFrame(rows, "dataset string, row_idx bigint, chosen string, rejected string")
    ip = C.identical_pairs_stats(pairs, ["dataset"]).collect()[0]
    # rows 1 and 4 ('none' == 'none') are identical; denominator is all rows
    assert ip["identical_count"] == 2 and ip["identical_ratio"] == pytest.approx(0.4)
    pf = C.preference_format_stats(pairs, ["dataset"]).collect()[0]
    assert pf["valid_count"] == 2 and pf["invalid_count"] == 3
    issues = {r["row_idx"]: r["error_type"] for r in C.preference_issues(pairs, ["dataset"]).collect()}
    assert issues == {2: "invalid_type.chosen", 3: "invalid_type.rejected", 4: "invalid_type.chosen"}
    missing = pairs.drop("rejected")
    assert {r["error_type"] for r in C.preference_issues(missing, ["dataset"]).collect()} == {"missing_field.rejected"}


def test_error_groups_bounds(spark):
    issues = spark.createDataFrame(
        [("d", i, "short_text") for i in (9, 3, 5, 1, 7)] + [("d", 2, "dup")],
        "dataset string, row_idx bigint, error_type string",
    )
    g = {r["error_type"]: r for r in C.error_groups(issues, ["dataset"], max_examples=3).collect()}
    assert g["short_text"]["sample_indices"] == [1, 3, 5] and g["short_text"]["total_count"] == 5
    g0 = C.error_groups(issues, ["dataset"], max_examples=0).collect()
    assert all(r["sample_indices"] == [] for r in g0)


def test_error_group_limit_is_partial_before_shuffle(spark):
    issues = spark.range(1000).select(
        (F.col("id") % 2).cast("string").alias("dataset"),
        F.col("id").alias("row_idx"),
        (F.col("id") % 3).cast("string").alias("error_type"),
    )
    plan = C.error_groups(issues, ["dataset"], max_examples=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_default_check_result_rows(spark):
    prof = C.text_profile(_text_df(spark, ["tiny"] * 3), ["dataset"])
    rows = {r["check"]: r for r in C.default_check_results(prof, ["dataset"]).collect()}
    assert rows["min_samples"]["errors"] == ["Not enough examples: 3 < 100"]
    assert rows["avg_length"]["passed"] is False
    assert rows["empty_ratio"]["metrics"]["empty_count"] == 3.0
