"""Index lifecycle: a pure step over a catalog's state at a given time, and background tasks over Spark job groups."""

from __future__ import annotations

import re
import threading
import time
import uuid

_UNITS = {"d": 86_400.0, "h": 3_600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6, "ns": 1e-9}
PHASES = ("hot", "warm", "cold", "frozen", "delete")


def seconds(text: str | int | float | None) -> float:
    """Seconds of a duration such as 30d, 1h30m or 500ms; 0 for none."""
    if not text:
        return 0.0
    if isinstance(text, (int, float)):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|[dhms])", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"bad duration {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def next_phase(phases: dict, current: str, age: float) -> str:
    """The last phase, in order, at or after the current one whose min_age has passed."""
    at = PHASES.index(current)
    due = [p for p in PHASES[at:] if p in phases and age >= seconds(phases[p].get("min_age"))]
    return due[-1] if due else current


def wants_rollover(action: dict, age: float, docs: int, size: int = 0) -> bool:
    """Any of max_age, max_docs and max_size reached, and min_docs, if given, too."""
    if docs < int(action.get("min_docs") or 0):
        return False
    most = action.get("max_size")
    return bool(action.get("max_age") and age >= seconds(action["max_age"]) or action.get("max_docs") and docs >= int(action["max_docs"]) or most and size >= _bytes(most))


def _bytes(text) -> float:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)b?", str(text).lower())
    if not m:
        raise ValueError(f"bad size {text!r}")
    return float(m[1]) * 1024 ** " kmgt".index(m[2] or " ")


def rollover_name(index: str, count: int) -> str:
    return f"{re.sub(r'-[0-9]+$', '', index)}-{count + 1}"


def tick(catalog, now: float) -> list[tuple[str, str]]:
    """One pass over the indices whose setting index.lifecycle.name names a policy; (index, what was done) of each action."""
    done = []
    for name in sorted(catalog.indices):
        meta = catalog.indices[name]
        policy = catalog.policies.get(meta.settings.get("index.lifecycle.name"))
        if policy is None:
            continue
        phases = policy.get("policy", policy).get("phases", {})
        state = meta.lifecycle or {"phase": "hot", "since": meta.created_at, "rollovers": 0, "rolled": False, "ran": []}
        age = now - meta.created_at
        to = next_phase(phases, state["phase"], age)
        if to != state["phase"]:
            state |= {"phase": to, "since": now, "ran": []}
            done.append((name, f"phase:{to}"))
        meta.lifecycle = state
        actions = (phases.get(to) or {}).get("actions", {})
        if "rollover" in actions and not state["rolled"]:
            action = actions["rollover"]
            docs = catalog.count(name) if action.get("max_docs") or action.get("min_docs") else 0
            if wants_rollover(action, age, docs, catalog.store_bytes(name) if action.get("max_size") else 0):
                new = rollover_name(name, state["rollovers"])
                catalog.create(new, {"mappings": meta.mapping.to_json(), "settings": dict(meta.settings)}, now=now)
                catalog.indices[new].lifecycle = {"phase": "hot", "since": now, "rollovers": state["rollovers"] + 1, "rolled": False, "ran": []}
                catalog.move_aliases(name, new)
                state["rolled"] = True
                done.append((name, f"rollover:{new}"))
        if "forcemerge" in actions and "forcemerge" not in state["ran"]:
            catalog.compact(name, int(actions["forcemerge"].get("max_num_segments") or 1))
            state["ran"].append("forcemerge")
            done.append((name, "forcemerge"))
        if "set_priority" in actions and "set_priority" not in state["ran"]:
            meta.settings["index.priority"] = actions["set_priority"].get("priority")
            state["ran"].append("set_priority")
            done.append((name, "set_priority"))
        if to == "delete":
            catalog.drop(name)
            done.append((name, "delete"))
    return done


class Tasks:
    """Work in the background, each task in a Spark job group of its own that cancel() stops."""

    def __init__(self, spark):
        self.spark, self.tasks = spark, {}

    def submit(self, action: str, work) -> str:
        """work() returns the numbers of its progress."""
        from pyspark import inheritable_thread_target

        key = uuid.uuid4().hex
        t = {"id": key, "action": action, "status": "running", "started": time.time(), "progress": {}, "error": None}
        self.tasks[key] = t

        def run():
            self.spark.sparkContext.setJobGroup(key, action, interruptOnCancel=True)
            try:
                t["progress"] = work() or {}
                t["status"] = "completed" if t["status"] == "running" else t["status"]
            except Exception as e:
                t["error"] = str(e)[:500]
                t["status"] = "failed" if t["status"] == "running" else t["status"]

        t["thread"] = threading.Thread(target=inheritable_thread_target(self.spark)(run), daemon=True)
        t["thread"].start()
        return key

    def get(self, key: str) -> dict | None:
        t = self.tasks.get(key)
        return None if t is None else {k: v for k, v in t.items() if k != "thread"}

    def list(self, action: str | None = None) -> list[dict]:
        return [self.get(k) for k, t in self.tasks.items() if action in (None, t["action"])]

    def wait(self, key: str, timeout: float | None = None) -> dict:
        self.tasks[key]["thread"].join(timeout)
        return self.get(key)

    def cancel(self, key: str) -> bool:
        t = self.tasks.get(key)
        if t is None or t["status"] != "running":
            return False
        t["status"] = "cancelled"
        self.spark.sparkContext.cancelJobGroup(key)
        return True
