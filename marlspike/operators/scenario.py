"""Generated scenarios: seeded tasks, their gold and raw renderings, shape variants, and bundles with lineage."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ("ready", "in_progress", "done")
NAMES = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon")
ASSIGNEES = ("alice", "bob", "carol")
TAGS = ("backend", "frontend", "ops", "qa")
ALIASES = {"entity_id": "task_id", "name": "task_name", "status": "status_text", "duration_days": "duration_days", "assignee": "assignee", "tags": "tags"}
MOST_TASKS = 10


@dataclass(frozen=True)
class Task:
    entity_id: str
    name: str
    status: str
    duration_days: int
    assignee: str | None = None
    tags: tuple[str, ...] = ()


def sample_scenario(seed: int, tasks: int = 2, optional: bool = True) -> list[Task]:
    """Tasks from a seed, the same each time."""
    if not 1 <= tasks <= MOST_TASKS:
        raise ValueError(f"a scenario has 1 to {MOST_TASKS} tasks")
    r = random.Random(seed)
    out = []
    for i in range(tasks):
        name, status, days = r.choice(NAMES), r.choice(STATUSES), r.randint(1, 10)
        assignee = r.choice((None, *ASSIGNEES)) if optional else None
        tags = tuple(sorted(r.sample(TAGS, r.randint(0, 2)))) if optional else ()
        out.append(Task(f"task-{i + 1:03d}", f"{name} {i + 1}", status, days, assignee, tags))
    return out


def bulk_tasks(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n tasks generated on the executors by hashes of seed and id; another sequence than sample_scenario()'s."""
    h = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    pick = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h(k), F.lit(len(values))) + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("task-%09d", "id").alias("entity_id"),
        pick("name", NAMES).alias("name"),
        pick("status", STATUSES).alias("status"),
        (F.pmod(h("days"), F.lit(10)) + 1).cast("int").alias("duration_days"),
        F.when(F.pmod(h("who?"), F.lit(2)) == 0, pick("who", ASSIGNEES)).alias("assignee"),
        F.filter(F.array(*[F.when(F.pmod(h(t), F.lit(3)) == 0, F.lit(t)) for t in TAGS]), lambda x: x.isNotNull()).alias("tags"),
    )


def render_gold(tasks: list[Task]) -> dict:
    return {"tasks": [{"id": t.entity_id, "name": t.name, "status": t.status, "duration_days": t.duration_days, "assignee": t.assignee, "tags": list(t.tags)} for t in tasks]}


def variant_of(policy: dict | None, index: int, record: dict) -> dict:
    """The shape variant of a record: in turn, or weighted by the digest of its canonical JSON."""
    variants = (policy or {}).get("variants") or [{}]
    if policy and policy.get("mode") == "weighted":
        wide = [v for v in variants for _ in range(v.get("weight", 1))]
        digest = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        return wide[int(digest[:8], 16) % len(wide)]
    return variants[index % len(variants)]


def variant_index(text: Column, total: int) -> Column:
    """variant_of()'s weighted choice for a column of canonical JSON."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % total).cast("int")


def render_raw(tasks: list[Task], template: dict | None = None) -> Any:
    """The tasks under a template's names, wrappers, envelope and extras; null and empty fields are left out."""
    template = template or {}
    out = []
    for i, t in enumerate(tasks):
        data = asdict(t)
        v = variant_of(template.get("shape_variants"), i, data)
        names = {**ALIASES, **template.get("aliases", {}), **v.get("aliases", {})}
        hidden = set(template.get("hidden_fields", ())) | set(v.get("hidden_fields", ()))
        record = {names[k]: list(x) if isinstance(x, tuple) else x for k, x in data.items() if x not in (None, (), []) and k not in hidden}
        record |= {**template.get("extra_fields", {}), **v.get("extra_fields", {})}
        if v.get("wrap_task_object", template.get("wrap_task_object")):
            record = {v.get("task_object_key", template.get("task_object_key", "task")): record}
        out.append(record)
    return out if template.get("root_mode") == "list" else {template.get("records_key", "records"): out}


def _digest(data: Any) -> str:
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def build_bundle(seed: int, tasks: int = 2, template: dict | None = None) -> dict:
    """Scenario, template, raw and gold renderings of one seed, with an id that their content gives."""
    scenario = sample_scenario(seed, tasks)
    raw, gold = render_raw(scenario, template), render_gold(scenario)
    return {"bundle_id": f"bundle-{_digest([raw, gold])[:12]}", "bundle_kind": "base", "seed": seed, "scenario": [asdict(t) for t in scenario], "template": template or {}, "l0": raw, "l1": gold}


def drift_bundle(parent: dict, raw: Any, manifest: dict) -> dict:
    """A bundle whose raw rendering drifted, with its lineage."""
    lineage = {"parent_bundle_id": parent["bundle_id"], **{k: manifest[k] for k in ("drift_id", "drift_type", "severity", "compatibility_class", "operator_sequence")}}
    return {**parent, "bundle_id": f"bundle-{_digest([raw, manifest])[:12]}", "bundle_kind": "drift", "l0": raw, "drift_manifest": manifest, "lineage": lineage}


_PARTS = ("scenario", "template", "l0", "l1")
_EXTRA = ("drift_manifest", "lineage")


def save_bundle(bundle: dict, folder: str) -> list[str]:
    """One JSON file for each part."""
    out = Path(folder, bundle["bundle_id"])
    out.mkdir(parents=True, exist_ok=True)
    head = {k: bundle[k] for k in ("bundle_id", "bundle_kind", "seed")}
    files = {"metadata": head, "manifest": {"parts": [p for p in (*_PARTS, *_EXTRA) if p in bundle]}, **{p: bundle[p] for p in (*_PARTS, *_EXTRA) if p in bundle}}
    for name, data in files.items():
        (out / f"{name}.json").write_text(json.dumps(data, sort_keys=True, indent=2) + "\n")
    return sorted(f"{n}.json" for n in files)


def load_bundle(folder: str) -> dict:
    read = lambda n: json.loads(Path(folder, f"{n}.json").read_text())
    return {**read("metadata"), **{p: read(p) for p in _PARTS}, **{p: read(p) for p in _EXTRA if Path(folder, f"{p}.json").exists()}}
