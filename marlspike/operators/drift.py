"""Schema drift: two profiles compared by path, renamed fields matched, and every change classified.

The comparison is a full outer join of two tables with a row for each path. Names are compared on the driver, where
schemas are; nothing here grows with the number of records."""

from __future__ import annotations

from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classifications by severity. Fixed values.
SEVERITY = ("no_change", "additive_compatible", "rename_compatible", "semantic_change", "breaking_change")
COMPATIBLE = ("no_change", "additive_compatible", "rename_compatible")
NEAR_REQUIRED = 0.95
ENUM_OVERLAP = 0.25
RENAME_SCORE = 0.72
_SIGNATURE = ("dominant_type", "present_ratio", "null_ratio", "cardinality", "enum_values", "unit")


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Signatures side by side, b_* and c_*, with kind shared, added or removed. Both need path and the signature's columns; unit may lack."""
    sides = []
    for df, p in ((baseline, "b"), (candidate, "c")):
        df = df if "unit" in df.columns else df.withColumn("unit", F.lit(None).cast("string"))
        sides.append(df.select("path", F.lit(True).alias(f"{p}_there"), *[F.col(c).alias(f"{p}_{c}") for c in _SIGNATURE]))
    both = sides[0].join(sides[1], "path", "full")
    return both.withColumn("kind", F.when(F.col("b_there").isNull(), "added").when(F.col("c_there").isNull(), "removed").otherwise("shared"))


def enum_jaccard() -> Column:
    """Overlap of a shared path's enum values, null where either side has none."""
    b, c = (F.filter(F.col(f"{p}_enum_values"), lambda v: v != "") for p in "bc")
    return F.when((F.size(b) > 0) & (F.size(c) > 0), F.size(F.array_intersect(b, c)) / F.size(F.array_union(b, c)))


def classified(both: DataFrame) -> DataFrame:
    """compared() with reasons and classification, renames aside."""
    numeric = F.col("b_dominant_type").isin("int", "float") & F.col("c_dominant_type").isin("int", "float")
    retyped = ~F.col("b_dominant_type").eqNullSafe(F.col("c_dominant_type"))
    enums = (F.col("b_dominant_type") == "str") & (F.col("c_dominant_type") == "str") & (enum_jaccard() < ENUM_OVERLAP)
    rules = [
        (F.col("b_cardinality") != F.col("c_cardinality"), "cardinality", "breaking_change"),
        (retyped & ~F.coalesce(numeric, F.lit(False)), "type", "breaking_change"),
        (retyped & F.coalesce(numeric, F.lit(False)), "numeric_type", "semantic_change"),
        ((F.col("b_present_ratio") >= NEAR_REQUIRED) & (F.col("c_present_ratio") < NEAR_REQUIRED), "partially_missing", "breaking_change"),
        (F.col("b_unit") != F.col("c_unit"), "unit", "semantic_change"),
        (enums, "enum_values", "semantic_change"),
    ]
    shared = F.col("kind") == "shared"
    reasons = F.filter(F.array(*[F.when(shared & F.coalesce(c, F.lit(False)), name) for c, name, _ in rules]), lambda r: r.isNotNull())
    worst = F.greatest(*[F.when(F.coalesce(c, F.lit(False)), SEVERITY.index(s)).otherwise(0) for c, _, s in rules])
    names = F.array(*[F.lit(s) for s in SEVERITY])
    removed = F.when(F.col("b_present_ratio") >= NEAR_REQUIRED, "breaking_change").otherwise("semantic_change")
    label = F.when(shared, F.element_at(names, worst + 1)).when(F.col("kind") == "added", "additive_compatible").otherwise(removed)
    return both.withColumns({"reasons": reasons, "classification": label})


@dataclass(frozen=True)
class FieldDrift:
    kind: str
    baseline_path: str | None
    candidate_path: str | None
    classification: str
    reasons: tuple[str, ...] = ()
    score: float | None = None
    signature: dict = field(default_factory=dict, compare=False)

    @property
    def compatible(self) -> bool:
        return self.classification in COMPATIBLE


@dataclass(frozen=True)
class DriftReport:
    drifts: tuple[FieldDrift, ...]
    classification: str

    @property
    def compatible(self) -> bool:
        return self.classification in COMPATIBLE


def _plain(path: str) -> str:
    leaf = path.replace("[]", "").split(".")[-1]
    return "".join(c for c in leaf.lower() if c.isalnum())


def rename_score(b: dict, c: dict) -> float:
    """How likely an added path is a removed one's new name."""
    names = SequenceMatcher(a=_plain(b["path"]), b=_plain(c["path"])).ratio()
    return 0.7 * names + 0.2 * (1 - abs(b["present_ratio"] - c["present_ratio"])) + 0.1 * (1 - abs(b["null_ratio"] - c["null_ratio"]))


def rename_pairs(removed: list[dict], added: list[dict], threshold: float = RENAME_SCORE) -> list[tuple[float, str, str]]:
    """Best pairs first, each path once; only of one type and cardinality."""
    scored = sorted(
        ((rename_score(b, c), b["path"], c["path"]) for b in removed for c in added if b["dominant_type"] == c["dominant_type"] and b["cardinality"] == c["cardinality"]),
        key=lambda x: (-x[0], x[1], x[2]),
    )
    used: set[str] = set()
    out = []
    for score, b, c in scored:
        if score >= threshold and f"b{b}" not in used and f"c{c}" not in used:
            used |= {f"b{b}", f"c{c}"}
            out.append((score, b, c))
    return out


def classify_drift(baseline: DataFrame, candidate: DataFrame) -> DriftReport:
    """The drift between two profiles' signatures."""
    rows = [r.asDict(recursive=True) for r in classified(compared(baseline, candidate)).collect()]  # a row for each path
    side = lambda r, p: {"path": r["path"], **{c: r[f"{p}_{c}"] for c in _SIGNATURE}}
    removed = {r["path"]: side(r, "b") for r in rows if r["kind"] == "removed"}
    added = {r["path"]: side(r, "c") for r in rows if r["kind"] == "added"}
    pairs = rename_pairs(list(removed.values()), list(added.values()))
    renamed = {b for _, b, _ in pairs} | {c for _, _, c in pairs}
    out = [FieldDrift("renamed", b, c, "rename_compatible", ("renamed",), round(s, 6), added[c]) for s, b, c in pairs]
    for r in rows:
        if r["kind"] == "shared" and r["classification"] != "no_change":
            out.append(FieldDrift("changed", r["path"], r["path"], r["classification"], tuple(r["reasons"]), None, side(r, "c")))
        elif r["kind"] == "removed" and r["path"] not in renamed:
            out.append(FieldDrift("removed", r["path"], None, r["classification"], ("removed",), None, removed[r["path"]]))
        elif r["kind"] == "added" and r["path"] not in renamed:
            out.append(FieldDrift("added", None, r["path"], r["classification"], ("added",), None, added[r["path"]]))
    out.sort(key=lambda d: (d.baseline_path or d.candidate_path or "", d.kind))
    worst = max((SEVERITY.index(d.classification) for d in out), default=0)
    return DriftReport(tuple(out), SEVERITY[worst])
