"""Whole runs: the reproducible baseline and the staged run with a report."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tabwright.operators.infer import choose_target, fallback_target, validate_target
from tabwright.operators.models import Trained, train
from tabwright.operators.profile import class_gate, numeric_gate, quality_snapshot
from tabwright.operators.report import best_summary
from tabwright.operators.scale import local_frame
from tabwright.operators.schema import bad_target_examples
from tabwright.operators.select import rank_features
from tabwright.plans.prepare import prepare
from tabwright.sources.tables import require_shape, stable_sample, write_report


def resolve_target(df: DataFrame, target: str | None, task: str | None, statement: str | None) -> dict[str, str]:
    """Given target and task, else those the statement leads to, else the last column."""
    if target and task:
        return validate_target(df, {"target": target, "task": task})
    if not statement:
        raise ValueError("give a target and a task, or a problem statement")
    try:
        return choose_target(df, statement)
    except ValueError:
        return fallback_target(df)


def check_target(df: DataFrame, target: str, task: str) -> None:
    """Stop early on a target that cannot be learned."""
    if task == "classification":
        gate = class_gate(df, target).first()
        if not gate["ok"]:
            raise ValueError(f"{target}: {gate['classes']} classes, smallest {gate['smallest']} rows; two of each are needed")
    elif task == "regression":
        gate = numeric_gate(df, target).first()
        if not gate["ok"]:
            examples = [r["value"] for r in bad_target_examples(df, target).collect()]
            raise ValueError(f"{target}: only {gate['valid_ratio']:.2f} of the values are numbers, not {examples}")
    else:
        raise ValueError(f"unsupported task: {task}")


def ranked_drop(df: DataFrame, target: str, task: str) -> list[str]:
    """Features the ranking rules reject, from the rows given; the target is never among them."""
    return [r["feature"] for r in rank_features(df, target, task).where("NOT selected").collect()]


def run_baseline(
    df: DataFrame, target: str | None = None, task: str | None = None, statement: str | None = None, skip_heavy: bool = True,
    cv: int = 2, max_rows: int = 0, key: Sequence[str] | None = None, path: str | None = None, **training: Any,
) -> tuple[DataFrame, DataFrame, Trained]:
    """Report row, quality snapshot and trained run. Target and quality come from all rows.

    ``max_rows`` bounds the labelled rows that models are fitted on (a stable sample; 0: all rows).
    """
    require_shape(df)
    choice = resolve_target(df, target, task, statement)
    quality = quality_snapshot(df, choice["target"])
    rows = stable_sample(df, key or df.columns, max_rows) if max_rows else df
    trained = train(rows, choice["target"], choice["task"], cv=max(2, cv), skip_heavy=skip_heavy, **training)
    metric = "Accuracy" if choice["task"] == "classification" else "R2_Score"
    top = trained.leaderboard.orderBy("rank").first()
    report = local_frame(
        df.sparkSession, [(statement, choice["task"], choice["target"], metric, top["Model"], float(top[metric]), top["Best_Params"])],
        "statement string, task string, target string, metric string, best_model string, best_score double, best_params string",
    )
    if path is not None:
        write_report(report, f"{path}/report")
        write_report(trained.leaderboard, f"{path}/leaderboard")
        write_report(quality, f"{path}/quality")
        write_report(trained.failure_table(), f"{path}/failures")
    return report, quality, trained


def run_stages(
    df: DataFrame, statement: str, target: str | None = None, task: str | None = None, prepared: bool = False, select: bool = False, **training: Any
) -> tuple[DataFrame, Trained | None]:
    """Prepare, choose a target, check it, train and summarise; a failing stage ends the run with its reason.

    The report is (stage, status, detail), one row per stage reached, and a row ``train``, ``failed`` per model or setting left out.
    """
    state: dict[str, Any] = {"df": df}
    steps: list[tuple[str, Callable[[], str]]] = [
        ("load", lambda: _loaded(state, prepared)),
        ("target", lambda: _target(state, statement, target, task)),
        ("check", lambda: check_target(state["df"], state["target"], state["task"]) or "ok"),
        ("train", lambda: _trained(state, select, training)),
        ("report", lambda: best_summary(state["trained"].leaderboard, state["task"]).first()["reason"]),
    ]
    rows: list[tuple[str, str, str]] = []
    for name, step in steps:
        try:
            rows.append((name, "ok", step()))
        except Exception as error:  # the report carries the reason
            rows.append((name, "error", str(error).split("\n")[0]))
            break
    if "trained" in state:
        rows += [("train", "failed", f"{name}{' ' + params if params else ''}: {reason}") for name, params, reason in state["trained"].failures]
    report = local_frame(df.sparkSession, rows, "stage string, status string, detail string")
    return report, state.get("trained")


def _loaded(state, prepared):
    state["df"] = require_shape(state["df"]) if prepared else prepare(state["df"])
    return f"{len(state['df'].columns)} columns"


def _target(state, statement, target, task):
    state.update(resolve_target(state["df"], target, task, statement))
    return json.dumps({"target": state["target"], "task": state["task"]})


def _trained(state, select, training):
    training.setdefault("skip_heavy", True)
    state["trained"] = train(state["df"], state["target"], state["task"], select=ranked_drop if select else None, **training)
    return ", ".join(r["Model"] for r in state["trained"].leaderboard.orderBy("rank").collect())
