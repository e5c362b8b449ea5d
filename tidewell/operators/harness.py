"""Trials with a model in the loop: re-ranking of candidates, and the agents' tasks, tools and checks. The model is any callable."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import COARSE_COLUMNS, SLICE_COLUMNS, Windows
from . import profile, tools
from .agents import BUDGETS, Chat, Outcome, rerank, run
from .localise import COARSE_BAR, merged_pool, rank_bursts, rank_within_slices, top_k

MODES = ("coarse_only", "hybrid", "expanded")


def candidates(panel: DataFrame, w: Windows, mode: str = "expanded", k: int = 5, burst_column: str = "item_id") -> list[dict]:
    """The pool of a trial, best first (at most 3 k rows): coarse slices, with items and bursts beside them if the mode, or a weak coarse best, asks for them."""
    coarse = top_k(rank_within_slices(panel, "sales", w, COARSE_COLUMNS), k)
    if mode == "hybrid":
        best = coarse.agg(F.max("score")).first()[0]
        mode = "coarse_only" if best is not None and best >= COARSE_BAR else "expanded"
    if mode == "coarse_only":
        return [r.asDict() for r in coarse.orderBy("rank").select("slice_col", "slice_val", "score", "coverage").collect()]
    items = top_k(rank_within_slices(panel, "sales", w, (burst_column,)), k)
    bursts = top_k(rank_bursts(panel, w, burst_column), k)
    return [r.asDict() for r in merged_pool(coarse, items, bursts).orderBy("pool_rank").drop("pool_rank").collect()]


def rerank_trials(trials: Sequence[tuple[str, DataFrame, Windows, tuple[str, str]]], chat: Chat, mode: str = "expanded", repeats: int = 1, abort_after: int = 3, done: frozenset[str] = frozenset()) -> list[dict]:
    """A row a trial: the deterministic first place and the model's, whether each is the true slice, and why the model's order was not used if it was not.

    trials: (id, panel, windows, true slice); those in `done` are skipped. After abort_after fallbacks in a row the model is not asked any more.
    """
    out, failed = [], 0
    for name, panel, w, truth in trials:
        if name in done:
            continue
        pool = candidates(panel, w, mode)
        order, reason = (pool, "no candidates") if not pool else (pool, "aborted") if failed >= abort_after else rerank(pool, chat, repeats)
        failed = 0 if reason == "ok" else failed + 1
        first = lambda p: (p[0]["slice_col"], p[0]["slice_val"]) if p else None
        out.append({"trial_id": name, "n_candidates": len(pool), "base": "=".join(first(pool) or ("", "")), "model": "=".join(first(order) or ("", "")), "base_hit": first(pool) == truth, "model_hit": first(order) == truth, "used": reason == "ok", "reason": reason})
    return out


def _rows(df: DataFrame, n: int = 8) -> list[dict]:
    return [r.asDict() for r in df.limit(n).collect()]


def investigate(panel: DataFrame, w: Windows, chat: Chat, budget: int = BUDGETS["investigator"]) -> Outcome:
    """The investigator: histories, comparisons and spikes by tool call; answers a known column and value."""

    def tool(f: Callable[[str], DataFrame], score: str) -> Callable[..., object]:
        def call(col: str, val: str | None = None) -> object:
            wrong = tools.validate(panel, col, val)
            if wrong:
                return {"error": wrong}
            df = f(col)
            return _rows(df.where(F.col("slice_val") == val) if val is not None else tools.screen(df, score))

        return call

    named = {
        "get_slice_history": tool(lambda c: tools.history(panel, c, w), "change_vs_own_p90"),
        "compare_windows": tool(lambda c: tools.compare_windows(panel, c, w), "js"),
        "check_spikes": tool(lambda c: rank_bursts(panel, w, c), "score"),
    }
    check = lambda a: tools.validate(panel, a.get("col", ""), a.get("val")) or (None if a.get("val") is not None else "no val")
    return run(chat, named, json.dumps({"find": "the slice that drifted", "columns": SLICE_COLUMNS, "answer": {"col": "...", "val": "..."}}), budget, check)


def inspect_faults(panel: DataFrame, w: Windows, chat: Chat, budget: int = BUDGETS["faults"]) -> Outcome:
    """The fault agent: duplicates, constant runs, label consistency and mean changes by tool call."""
    kinds = ("stale_feed", "zero_fill", "duplicated_rows", "unit_change", "mislabelled_category", "none")
    named = {
        "duplicate_check": lambda by="store_id": _rows(tools.duplicate_check(panel, ["id", "date"], by).orderBy(F.desc("n_duplicated")), 15),
        "constant_run_check": lambda min_run=3: _rows(tools.trailing_runs(panel, w).where(F.col("trail_run") >= min_run).orderBy(F.desc("trail_run"), "id"), 15),
        "label_consistency": lambda a="item_id", b="dept_id": _rows(tools.label_consistency(panel, a, b), 15),
        "compare_windows": lambda col="cat_id": _rows(tools.compare_means(panel, col, w), 12),
    }
    return run(chat, named, json.dumps({"find": "a data fault", "kinds": kinds}), budget, lambda a: None if a.get("fault") in kinds else f"fault must be one of {kinds}")


def onboard(tables: dict[str, DataFrame], chat: Chat, budget: int = BUDGETS["onboarding"]) -> Outcome:
    """The onboarding agent: profiles by tool call; answers a configuration whose columns exist."""
    named = {
        "list_files": lambda: sorted(tables),
        "list_columns": lambda file: tables[file].columns if file in tables else {"error": "no such file"},
        "profile": lambda file: _rows(profile.columns_profile(tables[file]), 60) if file in tables else {"error": "no such file"},
        "dependency": lambda file, a, b: _rows(profile.dependencies(tables[file], [(a, b)])),
    }

    def check(a: dict) -> str | None:
        if a.get("fact") not in tables:
            return "fact must be a file"
        missing = [k for k in ("item", "store", "date", "target") if a.get(k) not in tables[a["fact"]].columns]
        return f"not columns of the fact: {missing}" if missing else None

    return run(chat, named, json.dumps({"find": "roles of the columns", "answer": ["fact", "item", "store", "date", "target"]}), budget, check)


def decide(payload: dict, chat: Chat) -> Outcome:
    """The decision agent: one answer, retrain or ignore, with a confidence."""
    ok = lambda a: None if a.get("decision") in ("retrain", "ignore") and isinstance(a.get("confidence"), (int, float)) and 0 <= a["confidence"] <= 1 else "decision must be retrain or ignore, confidence 0 to 1"
    return run(chat, {}, json.dumps(payload), 0, ok)


