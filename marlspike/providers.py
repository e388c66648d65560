"""The boundary to language models, which only propose schemas, programs and templates, offline: an adapter protocol, a
queue of prepared replies, call budgets, prompts, and a cache of accepted templates. Nothing here uses a network."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from string import Template
from typing import Any, Protocol

from marlspike.operators.evaluate import Ranked, rank_candidates
from marlspike.operators.scenario import ALIASES, render_raw, sample_scenario
from marlspike.operators.schema import SourceSchema
from marlspike.plans.ir import Program, ProgramError

STAGES = ("schema", "mapping", "repair")
#: Of a task's fields those that each rendering must have. Fixed values.
REQUIRED = ("entity_id", "name", "status", "duration_days")


@dataclass(frozen=True)
class Prompt:
    system: str
    user: str
    family: str = ""
    version: str = "v1"
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Reply:
    ok: bool
    payload: Any = None
    text: str = ""
    error: str | None = None
    usage: dict = field(default_factory=dict)


class Adapter(Protocol):
    def complete(self, prompt: Prompt, schema_name: str | None = None) -> Reply: ...


class PreparedAdapter:
    """Replies in the order in which they were queued; keeps the calls. An empty queue is an error reply."""

    def __init__(self, replies: list[Reply | dict | str] = ()):
        self.queue, self.calls = deque(replies), []

    def complete(self, prompt: Prompt, schema_name: str | None = None) -> Reply:
        self.calls.append((prompt, schema_name))
        if not self.queue:
            return Reply(False, error="no reply left")
        r = self.queue.popleft()
        return r if isinstance(r, Reply) else Reply(True, r if isinstance(r, dict) else None, r if isinstance(r, str) else json.dumps(r))


class BudgetExceeded(RuntimeError):
    pass


class BudgetLedger:
    """An adapter that refuses a call beyond its stage's or the total budget before it is made, and records the others."""

    def __init__(self, adapter: Adapter, budgets: dict[str, int], total: int | None = None):
        self.adapter, self.budgets, self.total, self.records = adapter, budgets, total, []

    def used(self, stage: str | None = None) -> int:
        return sum(stage in (None, r["stage"]) for r in self.records)

    def complete(self, prompt: Prompt, schema_name: str | None = None, stage: str = "mapping") -> Reply:
        if self.used(stage) >= self.budgets.get(stage, 0) or (self.total is not None and self.used() >= self.total):
            raise BudgetExceeded(f"no calls left for {stage}")
        reply = self.adapter.complete(prompt, schema_name)
        self.records.append({"index": len(self.records), "stage": stage, "family": prompt.family, "version": prompt.version, "schema_name": schema_name, "usage": reply.usage, "ok": reply.ok})
        return reply

    def snapshot(self) -> dict:
        return {s: {"used": self.used(s), "budget": self.budgets.get(s, 0)} for s in STAGES}


#: Prompt texts by family. A folder of <family>/<version>-{system,user}.txt takes their place where it is given.
PROMPTS = {
    "source_schema": ("Describe the fields of a data source as JSON.", "Evidence:\n$evidence\nRequired meanings:\n$semantics"),
    "mapping": ("Write a mapping program as JSON.", "Source schema:\n$schema\nTarget:\n$target\nOperations: copy, rename, cast, map_enum, unit_convert, split, merge, nest, unnest, derive, default, drop, validate"),
    "repair": ("Repair a mapping program.", "Program:\n$program\nFailures:\n$failures"),
    "template": ("Propose a template as JSON.", "Fields:\n$fields\nRules:\n$rules"),
}


def render_prompt(family: str, version: str = "v1", folder: str | None = None, **values: Any) -> Prompt:
    if folder:
        system, user = (Path(folder, family, f"{version}-{p}.txt").read_text() for p in ("system", "user"))
    else:
        system, user = PROMPTS[family]
    texts = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True, indent=2, default=list) for k, v in values.items()}
    return Prompt(Template(system).safe_substitute(texts), Template(user).safe_substitute(texts), family, version, {"values": sorted(values)})


def synthesise(adapter: Adapter, schema: SourceSchema, wanted: list[str], candidates: int = 2, **options: Any) -> list[Ranked]:
    """`candidates` proposals for a mapping, checked and ranked; replies that aren't programs are left out."""
    out = []
    prompt = render_prompt("mapping", schema=[f.__dict__ for f in schema.fields], target=wanted, **options)
    for _ in range(candidates):
        reply = adapter.complete(prompt, "program")
        if reply.ok and isinstance(reply.payload, dict):
            try:
                out.append(Program.read(reply.payload))
            except (ProgramError, KeyError, TypeError):
                continue
    return rank_candidates(out, [f.path for f in schema.fields], wanted)


class TemplateCache:
    """Accepted templates by a digest of model, prompt and request."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    @staticmethod
    def key(**parts: Any) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def load(self, key: str) -> dict | None:
        path = self.folder / f"{key}.json"
        return json.loads(path.read_text()) if path.exists() else None

    def write(self, key: str, entry: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{key}.json").write_text(json.dumps(entry, sort_keys=True, indent=2) + "\n")


def template_issues(template: dict) -> list[str]:
    """What the renderers don't allow: blank keys and names, and required names that are blank or twice."""
    issues = []
    blank = lambda v: v is not None and not str(v).strip()
    surfaces = [("", template), *((f"shape_variants.variants[{i}].", v) for i, v in enumerate((template.get("shape_variants") or {}).get("variants") or []))]
    for at, t in surfaces:
        if not at and t.get("root_mode", "object") == "object" and blank(t.get("records_key")):
            issues.append("records_key is blank")
        if t.get("wrap_task_object") and blank(t.get("task_object_key")):
            issues.append(f"{at}task_object_key is blank")
        names = {**ALIASES, **(template.get("aliases") or {}), **(t.get("aliases") or {})}
        seen: dict[str, str] = {}
        for k in REQUIRED:
            if blank(names[k]):
                issues.append(f"{at}aliases.{k} is blank")
            elif names[k] in seen:
                issues.append(f"{at}aliases.{k} is that of {seen[names[k]]}")
            seen[names[k]] = k
    return issues


def _tasks_of(raw: Any, template: dict) -> list[dict]:
    return raw if template.get("root_mode") == "list" else raw[template.get("records_key", "records")]


def check_template(reply: Reply, accepted: set[str], seed: int = 0, tasks: int = 3) -> tuple[dict | None, list[dict]]:
    """(template, gates) of a proposal: parse, policy, dry_run, serialization and diversity, up to the first that it doesn't pass.

    dry_run renders a sampled scenario and looks for each task's required values under the names that the template gives them;
    diversity compares the digest of the template with those accepted before. Without a template a gate has failed."""
    gates: list[dict] = []

    def gate(name: str, wrong: list[str]) -> bool:
        gates.append({"gate": name, "passed": not wrong, "issues": wrong})
        return not wrong

    template = reply.payload
    if not gate("parse", [] if reply.ok and isinstance(template, dict) else [reply.error or "not an object"]):
        return None, gates
    if not gate("policy", template_issues(template)):
        return None, gates
    try:
        scenario = sample_scenario(seed, tasks)
        raw = render_raw(scenario, template)
        texts = [json.dumps(r, default=str) for r in _tasks_of(raw, template)]
        wrong = [f"task {i}: {k} is not rendered" for i, (t, text) in enumerate(zip(scenario, texts, strict=True)) for k in REQUIRED if json.dumps(getattr(t, k)) not in text]
    except (KeyError, TypeError, ValueError, AttributeError) as err:
        raw, wrong = None, [f"{type(err).__name__}: {err}"]
    if not gate("dry_run", wrong):
        return None, gates
    try:
        again = json.loads(json.dumps(raw, sort_keys=True)) == raw and raw == render_raw(scenario, json.loads(json.dumps(template)))
        wrong = [] if again else ["another rendering after a round trip through JSON"]
    except (TypeError, ValueError) as err:
        wrong = [str(err)]
    if not gate("serialization", wrong):
        return None, gates
    if not gate("diversity", ["as one accepted before"] if TemplateCache.key(template=template) in accepted else []):
        return None, gates
    return template, gates


def generate_template(adapter: Adapter, cache: TemplateCache, request: dict, gates: list[Callable[[dict], str | None]] = (), attempts: int = 2, model: str = "", accepted: set[str] = frozenset()) -> dict | None:
    """A template from the cache, or the first of `attempts` proposals that passes every gate, check_template()'s and the caller's; it is cached by model, prompt and request."""
    prompt = render_prompt("template", fields=request, rules="")
    key = TemplateCache.key(model=model, system=prompt.system, user=prompt.user, version=prompt.version, request=request)
    if (hit := cache.load(key)) is not None:
        return hit
    for _ in range(attempts):
        reply = adapter.complete(prompt, "template")
        template, _ = check_template(reply, accepted)
        if template is not None and not any(g(template) for g in gates):
            cache.write(key, template)
            return template
    return None
