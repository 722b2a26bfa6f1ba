"""Pipelines: stages named in JSON, run in dependency order over lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

STAGES: dict[str, Callable[..., DataFrame]] = {}
FORBIDDEN = frozenset(("code", "script", "eval", "exec", "lambda", "function"))


def stage_named(name: str):
    """Register a stage: a function of (inputs by node id, node) that gives a DataFrame."""

    def keep(fn):
        STAGES[name] = fn
        return fn

    return keep


def ordered(nodes: list[dict]) -> list[dict]:
    """Nodes behind what they depend on, otherwise in the given order; cycles and unknown names are errors."""
    by_id = {n["id"]: n for n in nodes}
    if len(by_id) != len(nodes):
        raise ValueError("node ids must be unique")
    for n in nodes:
        if n.get("stage") not in STAGES:
            raise ValueError(f"unknown stage {n.get('stage')!r}")
        if bad := FORBIDDEN & set(n):
            raise ValueError(f"fields that carry code are not allowed: {sorted(bad)}")
        if missing := [d for d in n.get("depends_on", ()) if d not in by_id]:
            raise ValueError(f"{n['id']} depends on unknown nodes {missing}")
    done: set[str] = set()
    out: list[dict] = []
    while len(out) < len(nodes):
        ready = next((n for n in nodes if n["id"] not in done and all(d in done for d in n.get("depends_on", ()))), None)
        if ready is None:
            raise ValueError("the pipeline has a cycle")
        done.add(ready["id"])
        out.append(ready)
    return out


def run(pipeline: dict, sources: dict[str, DataFrame]) -> list[dict]:
    """Records {id, ok, result or error} in order; nodes behind a failed one are skipped."""
    if pipeline.get("version") != 1:
        raise ValueError("pipeline version must be 1")
    made = dict(sources)
    records, failed = [], set()
    for n in ordered(pipeline["nodes"]):
        if bad := [d for d in n.get("depends_on", ()) if d in failed]:
            failed.add(n["id"])
            records.append({"id": n["id"], "ok": False, "error": f"skipped: {bad[0]} failed"})
            continue
        try:
            made[n["id"]] = STAGES[n["stage"]](made, n)
            records.append({"id": n["id"], "ok": True, "result": made[n["id"]]})
        except Exception as e:
            failed.add(n["id"])
            records.append({"id": n["id"], "ok": False, "error": f"{type(e).__name__}: {e}"[:500]})
    return records


@stage_named("filter")
def _filter(made: dict[str, DataFrame], node: dict) -> DataFrame:
    return made[node["input"]].filter(node["where"])


@stage_named("select")
def _select(made: dict[str, DataFrame], node: dict) -> DataFrame:
    return made[node["input"]].select(*node["columns"])


@stage_named("join")
def _join(made: dict[str, DataFrame], node: dict) -> DataFrame:
    return made[node["input"]].join(made[node["with"]], node["on"], node.get("how", "inner"))


@stage_named("search_select")
def _search_select(made: dict[str, DataFrame], node: dict) -> DataFrame:
    """Results by tier, source type and domain, in their order, at most ``max`` of each query."""
    from weft.functions import urls as U

    df = made[node["input"]]
    if node.get("tiers"):
        df = df.filter(df["tier"].isin(*node["tiers"]))
    if node.get("source_types"):
        df = df.filter(df["source_type"].isin(*node["source_types"]))
    if node.get("domains"):
        df = df.filter(U.domain_filter("url", node["domains"]))
    return df.filter(df["rank"] <= int(node.get("max", 10)))
