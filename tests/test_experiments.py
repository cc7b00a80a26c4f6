"""Experiment text log in the reference layout (FIXTURES §4 experiments_text):
two entries with the 70-'=' rules, two models each, parsed back per model."""

import os
import tempfile

from clickforge.sources import experiments as EXP

RULE = "=" * 70


def entry(num, ts, run_model, models, exec_time):
    lines = ["\n" + RULE, f"[{ts}] Experiment #{num}", RULE, "", f"Model: {run_model}", "Notes: Mode: Full", "",
             "--- Key Parameters ---", "  max_depth: 6", "  eta: 0.05", "", "--- Results ---", ""]
    for name, auc, ap in models:
        lines += [f"  [{name}]", f"    AUC: {auc:.4f}", f"    AP: {ap:.4f}", "    Actual CTR: 0.019100",
                  "    Predicted CTR: 0.020100", "    CTR Bias: 0.001000", ""]
    lines += ["  [Prediction Stats]", "    Mean: 0.241058", "    Std: 0.074164", "    Min: 0.162903",
              "    Max: 0.905850", "", f"  Execution Time: {exec_time:.1f}s", "  Successful Models: 2", "",
              RULE, ""]
    return "\n".join(lines)


def test_parse_reference_layout(spark):
    text = (entry(1, "2024-01-01 10:00:00", "xgboost", [("logistic", 0.5358, 0.0217), ("xgboost", 0.7393, 0.0787)], 331.5)
            + entry(2, "2024-01-02 11:30:00", "lightgbm", [("lightgbm", 0.7512, 0.0801), ("logistic", 0.5401, 0.0220)], 120.0))
    d = tempfile.mkdtemp(prefix="exp-text-", dir="/tmp")
    with open(os.path.join(d, "experiments.log"), "w") as f:
        f.write(text)
    entries = EXP.read_text_log(spark, d)
    assert EXP.experiment_count(entries).first()["n_experiments"] == 2
    parsed = EXP.parse_entries(entries)
    rows = sorted((r["experiment_num"], r["model"], r["auc"], r["ap"], r["ts"], r["execution_time"])
                  for r in parsed.collect())
    assert rows == [
        (1, "logistic", 0.5358, 0.0217, "2024-01-01 10:00:00", 331.5),
        (1, "xgboost", 0.7393, 0.0787, "2024-01-01 10:00:00", 331.5),
        (2, "lightgbm", 0.7512, 0.0801, "2024-01-02 11:30:00", 120.0),
        (2, "logistic", 0.5401, 0.0220, "2024-01-02 11:30:00", 120.0),
    ]
    best = EXP.best_experiment(parsed).first()
    # L3 ranks by the first AUC of each entry: 0.5358 (entry 1) vs 0.7512 (entry 2)
    assert best["best_experiment"] == 2 and best["best_auc"] == 0.7512
    assert [r["experiment_num"] for r in EXP.recent_experiments(parsed, 1).collect()] == [2]
