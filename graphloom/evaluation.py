"""Questions with assertions over the results of the tools.

A result is what a tool returned: None, a dict, or a list of dicts (a dict with ``nodes`` counts as its list).  An error
inside an assertion counts as failed; assertions on all rows need at least one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


def nested(value: Any, path: str) -> Any:
    """Value at a dotted path of keys and list positions; None where it leads nowhere."""
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def rows(result: Any) -> list[dict]:
    return result.get("nodes", []) if isinstance(result, dict) else list(result or [])


def some(items: list, test: Callable[[Any], bool]) -> bool:
    return bool(items) and all(test(x) for x in items)


ASSERTIONS: dict[str, Callable[[Any, dict], bool]] = {
    "not_null": lambda r, a: r is not None,
    "is_null": lambda r, a: r is None,
    "min_results": lambda r, a: len(rows(r)) >= a["value"],
    "field_equals": lambda r, a: nested(r, a["field"]) == a["value"],
    "field_present": lambda r, a: nested(r, a["field"]) is not None,
    "all_have_field": lambda r, a: some(rows(r), lambda x: nested(x, a["field"]) is not None),
    "all_match_layer": lambda r, a: some(rows(r), lambda x: x.get("layer") == a["layer"]),
    "contains_name": lambda r, a: any(a["name"].lower() in (x.get("name") or "").lower() for x in rows(r)),
    "min_neighbors": lambda r, a: len(r["neighbors"]) >= a["value"],
    "min_upstream": lambda r, a: len(r["upstream"]) >= a["value"],
    "upstream_contains_layer": lambda r, a: any(x.get("layer") == a["layer"] for x in r["upstream"]),
    "chain_length": lambda r, a: len(r["chain"]) == a["value"],
    "chain_contains_name": lambda r, a: any(a["name"] == x.get("name") for x in r["chain"]),
    "results_have_scores": lambda r, a: some(rows(r), lambda x: x.get("score") is not None),
    "all_type_equals": lambda r, a: some(rows(r), lambda x: x.get("type") == a["value"]),
    "contains_layer_name": lambda r, a: any(x.get("name") == a["name"] for x in rows(r)),
    "all_neighbors_have_edge_type": lambda r, a: some(r["neighbors"], lambda x: x.get("edge_type") == a["value"]),
}


def holds(result: Any, assertion: dict) -> bool:
    try:
        return bool(ASSERTIONS[assertion["type"]](result, assertion))
    except Exception:  # whatever an assertion stumbles on is a failure of it
        return False


def run(questions: list[dict], tools: Any) -> dict:
    """Ask every question (id, tool, input, assertions) and count what holds."""
    found = []
    for q in questions:
        began = time.time()
        try:
            result, error = getattr(tools, q["tool"])(**q["input"]), None
        except Exception as e:  # a tool that fails is a failed question
            result, error = None, str(e)
        passed = error is None and all(holds(result, a) for a in q["assertions"])
        found.append({"id": q["id"], "passed": passed, "error": error, "ms": (time.time() - began) * 1000})
    good = sum(x["passed"] for x in found)
    return {"questions": found, "total": len(found), "passed": good, "pass_rate": good / max(1, len(found)), "mean_ms": sum(x["ms"] for x in found) / max(1, len(found))}


def report(result: dict) -> str:
    """The run as a Markdown table."""
    lines = ["| question | passed | ms |", "|---|---|---|", *(f"| {x['id']} | {'yes' if x['passed'] else 'no'} | {x['ms']:.0f} |" for x in result["questions"])]
    return "\n".join([*lines, "", f"{result['passed']} of {result['total']} passed, {result['mean_ms']:.0f} ms on average."])
