"""Metrics and evaluation: brute-force Python equality for the jobs that have
no SQL twin, plus boundary values (p95 of 1..100 is 96, nearest-point ties)."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from finelens.operators import evaluate as EVAL
from finelens.operators import metrics as M

from .conftest import SF001


def _pct(vals, p):
    s = sorted(vals)
    return s[min(int(len(s) * p), len(s) - 1)]


def test_index_rule_p95_of_1_to_100(spark):
    df = spark.createDataFrame([("r", "k", float(v)) for v in range(1, 101)], "run_id string, key string, value double")
    r = M.index_percentiles(df, ["run_id", "key"]).collect()[0]
    assert r["p95"] == 96.0 and r["p99"] == 100.0 and r["data_points"] == 100


def test_index_percentiles_match_python_with_ties_and_sizes(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(30):
        n = rnd.choice([1, 2, 3, 19, 20, 21, 100, 1000, 5000])
        for _ in range(n):
            rows.append((f"g{g}", float(rnd.choice([rnd.randint(0, 5), rnd.random() * 100]))))
    df = spark.createDataFrame(rows, "g string, value double")
    # small accuracy forces the banded path on the large groups
    got = {r["g"]: r for r in M.index_percentiles(df, ["g"], accuracy=50).collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    for g, vals in by.items():
        assert got[g]["p95"] == _pct(vals, 0.95), g
        assert got[g]["p99"] == _pct(vals, 0.99), g
        assert got[g]["min_val"] == min(vals) and got[g]["max_val"] == max(vals)


def test_trend_direction_band_and_zero_first(spark):
    rows = [("a", 1, 100.0), ("a", 2, 104.0), ("b", 1, 0.0), ("b", 2, 5.0), ("c", 2, 1.0), ("c", 1, 2.0)]
    df = spark.createDataFrame(rows, "key string, seq long, value double")
    t = {r["key"]: r for r in M.trend(df, ["key"]).collect()}
    assert t["a"]["direction"] == "stable" and t["a"]["change_pct"] == pytest.approx(4.0)
    assert t["b"]["change_pct"] == 0.0
    assert t["c"]["first"] == 2.0 and t["c"]["direction"] == "decreased"


def test_loss_volatility_not_flagged_when_peak_at_start(spark):
    rows = [("train_loss", 1, 10.0), ("train_loss", 2, 0.5), ("train_loss", 3, 0.1)]
    df = spark.createDataFrame(rows, "key string, seq long, value double")
    v = M.metric_verdicts(M.trend(df, ["key"])).collect()[0]
    assert v["status"] == "GOOD" and v["verdict"].startswith("Improved by 99.0%")
    rows = [("eval_loss", 1, 1.0), ("eval_loss", 2, 20.0), ("eval_loss", 3, 0.5)]
    v = M.metric_verdicts(M.trend(spark.createDataFrame(rows, "key string, seq long, value double"), ["key"])).collect()[0]
    assert v["status"] == "WARNING" and v["verdict"].endswith("(high volatility)")


def _brute_nearest(points, phases, cap=30_000):
    out = {}
    for run, idx, start, end in phases:
        keys = {k for r, k, *_ in points if r == run}
        for key in keys:
            series = sorted([p for p in points if p[0] == run and p[1] == key], key=lambda p: p[4])
            if any(start <= p[2] <= end for p in series):
                continue
            centre = (start + end) / 2
            best = min(series, key=lambda p: (abs(p[2] - centre), p[4]))
            if abs(best[2] - centre) < cap:
                out[(run, idx, key)] = best[4]
    return out


def test_slice_nearest_matches_brute_force(spark):
    rnd = random.Random(3)
    points, phases = [], []
    seq = 0
    for run in range(4):
        for key in ("gpu", "mem"):
            t = 0
            for _ in range(60):
                t += rnd.choice([5_000, 10_000, 20_000, 45_000])
                seq += 1
                points.append((run, key, t, float(rnd.random()), seq))
        for i in range(15):
            s = rnd.randint(0, 1_500_000)
            phases.append((run, i, s, s + rnd.choice([0, 0, 1000, 200_000])))
    # an exact tie: two points equally far from a phase centre, earliest seq wins
    points += [(9, "gpu", 1000, 1.0, 10_001), (9, "gpu", 3000, 2.0, 10_000)]
    phases.append((9, 0, 2000, 2000))
    pdf = spark.createDataFrame(points, "run_id long, key string, ts_ms long, value double, seq long").withColumn("step", F.col("seq"))
    hdf = spark.createDataFrame(phases, "run_id long, phase_idx long, start_ms long, end_ms long")
    got = {(r["run_id"], r["phase_idx"], r["key"]): r["seq"] for r in M.slice_nearest(pdf, hdf).collect()}
    assert got == _brute_nearest(points, phases)
    assert got[(9, 0, "gpu")] == 10_000
    inside = M.slice_by_phase(pdf, hdf).count()
    assert inside == sum(1 for run, i, s, e in phases for p in points if p[0] == run and s <= p[2] <= e)


# ---- semantic match: independent Python version of the rules ----------------
_TOK = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _norm(t):
    t = (t or "").strip()
    return "\n".join(" ".join(ln.strip().split()) for ln in t.splitlines() if ln.strip())


def test_semantic_match_against_python(spark):
    from finelens.plans.evaluation import eval_items
    from finelens.sources.tables import Tables

    items = eval_items(Tables(spark, SF001))
    got = {r["sample_idx"]: r for r in EVAL.semantic_match(items).collect()}
    for r in items.collect():
        c, e = _norm(r["model_answer"]), _norm(r["expected_answer"])
        g = got[r["sample_idx"]]
        if not c or not e:
            assert g["score"] == 0.0 and g["hard_eval_errors"] == ["empty_candidate_or_expected"]
            continue
        seq = difflib.SequenceMatcher(a=c.lower(), b=e.lower()).ratio()
        ta, tb = set(_TOK.findall(c.lower())), set(_TOK.findall(e.lower()))
        jac = len(ta & tb) / len(ta | tb) if ta | tb else 0.0
        assert g["sequence_ratio"] == pytest.approx(seq, abs=1e-12)
        assert g["token_jaccard"] == pytest.approx(jac, abs=1e-12)
        n_err = len(g["hard_eval_errors"])
        base = 0.55 * seq + 0.25 * jac + (0.2 if c == e else 0.0)
        score = 1.0 if c == e else max(0.0, min(1.0, base - min(0.45, 0.15 * n_err)))
        assert g["score"] == pytest.approx(score, abs=1e-12)
        assert g["exact_match"] == (c == e)


def test_hard_eval_rules_cases(spark):
    from finelens.functions.query_text import hard_eval_errors

    cases = [
        ("", "QUERY f(v: [F64]) =>\n  r <- SearchV<X>(Embed(v), 3)\nRETURN r", ["embed_vector_misuse"]),
        ("", "QUERY f(v: [F64], v: String) =>\n  r <- SearchV<X>(Embed(v), 3)\nRETURN r", []),
        ("", "QUERY f() =>\n r <- X::RerankRRF(k: 60)\nRETURN r", []),
        ("", "QUERY f() =>\n r <- X::RerankRRF(k: 60, w: 1)\nRETURN r", ["rerank_rrf_invalid_args"]),
        ("Please exclude `a` and `b`", "QUERY f() =>\n r <- X::!{a}\nRETURN r", ["missing_required_exclusions"]),
        ("Please exclude `a`", "QUERY f() =>\n r <- X::!{a, c}\nRETURN r", []),
        ("", "x := 1", ["not_starting_with_query", "contains_colon_equals", "missing_query_keyword"]),
    ]
    df = spark.createDataFrame(cases, "u string, q string, exp array<string>")
    for r in df.select("exp", hard_eval_errors(F.col("u"), F.col("q")).alias("got")).collect():
        assert r["got"] == r["exp"]


def test_judge_parse_paths(spark):
    raws = ['{"score": 4, "reasoning": "x"}', '```json\n{"score": 9}\n```', 'see "score": 3 {bad', "nothing",
            '{"score": "4"}', '{"score": 2.9}', '{"score": 0}']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [r[0] for r in df.select(EVAL.judge_score(F.col("raw"))).collect()]
    assert got == [4, 5, 3, None, None, 2, 1]


def test_aggregate_scores_interpolated_median(spark):
    df = spark.createDataFrame([(1, s, EVAL.SCORE_MIN) for s in (0.0, 0.25, 0.5, 1.0)], "g int, score double, raw_score int")
    r = EVAL.aggregate_scores(df, ["g"]).collect()[0]
    assert r["p50_score"] == pytest.approx(0.375) and r["mean_score"] == pytest.approx(0.4375) and r["passed"] is False


def test_percentiles_with_one_value_on_a_third_of_the_rows(spark):
    import random

    from finelens.operators import metrics as M

    r = random.Random(2)
    rows = [(g, 7.0 if r.random() < 0.34 else float(r.randrange(5) if g else r.random() * 100)) for g in (0, 1) for _ in range(3000)]
    rows += [(2, 1.0)] * 999 + [(2, 2.0)]
    got = M.index_percentiles(spark.createDataFrame(rows, "g long, value double"), ["g"], ps=(0.34, 0.5, 0.95, 0.999), accuracy=50)
    for row in got.collect():
        v = sorted(x for g, x in rows if g == row["g"])
        want = [v[min(int(len(v) * p), len(v) - 1)] for p in (0.34, 0.5, 0.95, 0.999)]
        assert [row["p34"], row["p50"], row["p95"], row["p100"]] == want


def test_fixed_digits_as_python_has_them(spark):
    import random

    from pyspark.sql import functions as F

    from finelens.functions.text import fixed

    r = random.Random(6)
    values = [43.55, 50.65, 39.05, 22.25, 0.15, 2.5, 3.5, 0.5, -1.5, -0.25, 0.0, 1e12 + 0.05, 12345678.125] + [r.randrange(100000) / 100 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", *[fixed(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 4)]).collect():
        assert [row[f"d{d}"].replace("-0", "0", 1) if float(row[f"d{d}"]) == 0 else row[f"d{d}"] for d in (0, 1, 2, 4)] == [
            f"{row['v']:.{d}f}".replace("-0", "0", 1) if float(f"{row['v']:.{d}f}") == 0 else f"{row['v']:.{d}f}" for d in (0, 1, 2, 4)
        ], row["v"]
