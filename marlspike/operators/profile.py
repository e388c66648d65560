"""Profiles: statistics for each path of a dataset, from one pass over its flattened observations.

A record becomes one array of observations, which is inlined; no record id and no distinct count is needed, because a path's
presence in a record is marked: on its one observation, or for paths in lists by a mark beside them. One aggregate by (path, type, text) is shared by all statistics; what is
per path is aggregated from it, and top values go through buckets, so that a path with as many values as records is never
sorted in one task."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions.values import is_float, is_int, is_number, py_str

OBSERVATION = "struct<path:string,type:string,text:string,num:double,len:int,missing:boolean,first:boolean>"
TOP = 5
BUCKETS = 64
#: A path present everywhere with at least this share of distinct values may be a key.
KEY_RATIO = 0.95


def type_label(t: T.DataType) -> str:
    """null, bool, int, float, list, object or str."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if is_int(t):
        return "int"
    if is_float(t):
        return "float"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.StructType | T.MapType):
        return "object"
    return "str"


def _one(path: str, c: Column, t: T.DataType, first: bool) -> Column:
    label = type_label(t)
    num = c.cast("double") if is_number(t) else F.lit(None).cast("double")
    size = F.length(c) if label == "str" and isinstance(t, T.StringType) else F.size(c) if label == "list" else F.lit(None).cast("int")
    text = F.coalesce(py_str(c, t), F.lit("None"))
    return F.struct(F.lit(path).alias("path"), F.when(c.isNull(), "null").otherwise(label).alias("type"), text.alias("text"), num.alias("num"), F.when(c.isNotNull(), size).alias("len"), c.isNull().alias("missing"), F.lit(first).alias("first")).cast(OBSERVATION)


def _observations(path: str, c: Column, t: T.DataType, first: bool = True) -> Column:
    """Array of the observations at and below a path; those in lists are not marked."""
    none = F.array().cast(f"array<{OBSERVATION}>")
    if isinstance(t, T.StructType):
        parts = [_observations(f"{path}.{f.name}" if path else f.name, c.getField(f.name), f.dataType, first) for f in t.fields]
        return F.when(c.isNull(), none).otherwise(F.concat(*parts)) if parts else none
    if isinstance(t, T.ArrayType):
        inner = f"{path}[]"
        items = F.flatten(F.transform(c, lambda x: _observations(inner, x, t.elementType, False)))
        empty = F.array(F.struct(F.lit(inner).alias("path"), F.lit("list").alias("type"), F.lit("[]").alias("text"), F.lit(None).cast("double").alias("num"), F.lit(0).alias("len"), F.lit(False).alias("missing"), F.lit(False).alias("first")).cast(OBSERVATION))
        below = F.when(c.isNull(), none).when(F.size(c) == 0, empty).otherwise(items)
        return F.concat(F.array(_one(path, c, t, first)), below)
    return F.array(_one(path, c, t, first))


def _has_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) or isinstance(t, T.StructType) and any(_has_list(f.dataType) for f in t.fields)


def record_observations(fields: list[T.StructField]) -> Column:
    """Array of a record's observations, and of one mark without type and text for each of its paths in lists."""
    every = []
    for f in fields:
        found = _observations(f.name, F.col(f"`{f.name}`"), f.dataType)
        if _has_list(f.dataType):
            inside = F.array_distinct(F.transform(F.filter(found, lambda o: ~o["first"]), lambda o: o["path"]))
            none = [F.lit(None).alias(n) for n in ("type", "text", "num", "len")]
            marks = F.transform(inside, lambda p: F.struct(p.alias("path"), *none, F.lit(True).alias("missing"), F.lit(True).alias("first")).cast(OBSERVATION))
            found = F.concat(found, marks)
        every.append(found)
    return F.concat(*every)


def flatten_records(df: DataFrame) -> DataFrame:
    """All observations and marks of the records: path, type, text, num, len, missing, first."""
    return df.select(F.explode(record_observations(df.schema.fields)).alias("o")).select("o.*")


def flatten_variant(df: DataFrame, record: str = "record", rid: str = "rid", depth: int = 8) -> DataFrame:
    """(rid, path, type, text) of records as VARIANT: a missing key gives no row, a null one does.

    `depth` levels are planned unseen; a look at the data for each level from there on tells whether to go deeper."""
    level = df.select(F.col(rid).alias("rid"), F.lit("").alias("path"), F.col(record).alias("v"))
    out = None
    for d in count():
        if d >= depth and level.where("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'").isEmpty():
            return out
        level.createOrReplaceTempView(name := f"_variant_level_{d}_{id(level)}")
        deeper = df.sparkSession.sql(f"SELECT rid, path || CASE WHEN e.key IS NULL THEN '[]' WHEN path = '' THEN e.key ELSE '.' || e.key END AS path, e.value AS v FROM {name}, LATERAL variant_explode(v) AS e")
        shape = F.schema_of_variant("v")
        kind = F.when(F.is_variant_null("v"), "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape == "BOOLEAN", "bool").when(shape == "BIGINT", "int").when(shape.isin("DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "float").otherwise("str")
        rows = deeper.withColumn("type", kind).where("type <> 'object'").select("rid", "path", "type", F.coalesce(F.variant_get("v", "$", "string"), F.lit("None")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
        level = deeper


def value_counts(observations: DataFrame) -> DataFrame:
    """The shared aggregate: one row for each path, type and text; the marks of paths in lists have no type, no text and n = 0."""
    return observations.groupBy("path", "type", "text").agg(
        F.count("type").alias("n"),
        F.sum(F.col("first").cast("long")).alias("records"),
        F.max("missing").alias("missing"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        F.min("len").alias("short"),
        F.max("len").alias("long"),
    )


def type_counts(counts: DataFrame) -> DataFrame:
    return counts.where("type IS NOT NULL").groupBy("path", "type").agg(F.sum("n").alias("n"))


def field_stats(counts: DataFrame, n_records: int) -> DataFrame:
    """One row for each path: present_ratio, null_ratio, unique_ratio, numeric and length ranges, max_array_length, candidate_id.

    Several nulls in one record's list can't take null_ratio above 1."""
    good = ~F.col("missing")
    texts = counts.groupBy("path", "text").agg(F.max(good).alias("good"), F.sum("n").alias("n"), F.sum("records").alias("records"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("values"), F.sum(F.when(~good, F.col("n")).otherwise(0)).alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short"), F.max("long").alias("long"), F.max(F.col("type").isin("str", "int")).alias("keyed"), F.max(F.when(F.col("type") == "list", F.col("long"))).alias("items"))
    by_path = texts.groupBy("path").agg(
        F.sum("records").alias("records"),
        F.sum("values").alias("values"),
        F.sum("nulls").alias("nulls"),
        F.count_if("good").alias("distinct"),
        F.min("low").alias("numeric_min"),
        F.max("high").alias("numeric_max"),
        F.min("short").alias("length_min"),
        F.max("long").alias("length_max"),
        F.max("keyed").alias("keyed"),
        F.max("items").alias("items"),
    )
    lists = by_path.select(F.concat("path", F.lit("[]")).alias("path"), F.col("items").alias("max_array_length")).where("max_array_length IS NOT NULL")
    by_path = by_path.join(lists, "path", "left")
    unique = F.when(F.col("values") > 0, F.col("distinct") / F.col("values")).otherwise(0.0)
    present = F.col("records") / max(1, n_records)
    return by_path.select(
        "path",
        present.alias("present_ratio"),
        F.least(F.lit(1.0), F.when(F.col("records") > 0, F.col("nulls") / F.col("records")).otherwise(0.0)).alias("null_ratio"),
        unique.alias("unique_ratio"),
        "numeric_min",
        "numeric_max",
        "length_min",
        "length_max",
        "max_array_length",
        ((F.col("records") == n_records) & (F.col("values") > 0) & (unique >= KEY_RATIO) & F.col("keyed")).alias("candidate_id"),
    )


def _first_in_buckets(texts: DataFrame, order: list[Column], limit: int) -> DataFrame:
    bucketed = texts.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)))
    some = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("path", "bucket").orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("rank") <= limit).drop("bucket")


def top_values(counts: DataFrame, limit: int = TOP) -> DataFrame:
    """(path, rank, text, n): each path's most frequent scalar values, ties in text order."""
    texts = counts.where("NOT missing AND type NOT IN ('list', 'object')").groupBy("path", "text").agg(F.sum("n").alias("n"))
    return _first_in_buckets(texts, [F.col("n").desc(), F.col("text")], limit)


def sample_values(counts: DataFrame, limit: int = TOP) -> DataFrame:
    """(path, rank, text): each path's first distinct texts in text order; null counts as None."""
    return _first_in_buckets(counts.where("type IS NOT NULL").select("path", "text").distinct(), [F.col("text")], limit)


@dataclass
class Profile:
    """A profile: its header, and its fields as a DataFrame with a row for each path."""

    n_records: int
    fields: DataFrame
    fingerprint: str
    format: str = "rows"
    root: str = "rows"

    def signatures(self) -> DataFrame:
        return self.fields.select("path", "dominant_type", "present_ratio", "null_ratio", "cardinality", "enum_values")


def profile(df: DataFrame, format: str = "rows", root: str = "rows") -> Profile:
    """The profile of a DataFrame; what comes to the driver is a row for each path."""
    n = df.count()
    counts = value_counts(flatten_records(df)).persist()  # every statistic reads it
    types = type_counts(counts)
    observed = types.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("observed_types"), F.max_by("type", F.struct(F.col("n"), F.expr("-ascii(type)"), F.length("type"))).alias("dominant_type"))
    tops = top_values(counts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("value"), "n"))).alias("top_values"))
    samples = sample_values(counts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s")).select("path", F.transform("s", lambda x: x["text"]).alias("sample_values"))
    fields = field_stats(counts, n).join(observed, "path").join(tops, "path", "left").join(samples, "path", "left")
    fields = fields.withColumn("cardinality", F.when(F.col("path").contains("[]") | F.exists("observed_types", lambda x: x["type"] == "list"), "many").otherwise("one"))
    fields = fields.withColumn("enum_values", F.coalesce(F.transform("top_values", lambda x: x["value"]), F.array().cast("array<string>")))
    rows = fields.collect()  # a row for each path
    counts.unpersist()
    return Profile(n, df.sparkSession.createDataFrame(rows, fields.schema), _digest_of(rows), format, root)


def fingerprint(fields: DataFrame) -> str:
    """SHA-256 of paths, types, optional and nullable: the same for any order, repetition or number of records."""
    return _digest_of(fields.select("path", "observed_types", "present_ratio", "null_ratio").collect())


def _digest_of(rows: list[Row]) -> str:
    schema = sorted(({"path": r.path, "types": sorted(t.type for t in r.observed_types), "optional": r.present_ratio < 1, "nullable": r.null_ratio > 0} for r in rows), key=lambda x: x["path"])
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def representative_samples(df: DataFrame, rid: str, limit: int = 3, texts: Column | None = None) -> list[dict]:
    """Greedy picks of records that cover new paths, are complete and rare; ties go to the smaller canonical JSON.

    limit rounds of one aggregate and a top-1 each; only the winners come to the driver. A limit of 0 counts as 3."""
    limit = limit or 3
    body = [c for c in df.columns if c != rid]
    obs = df.select(F.col(rid).alias("rid"), F.explode(record_observations([f for f in df.schema.fields if f.name != rid])).alias("o")).select("rid", "o.*")
    paths = obs.where("first").groupBy("path").agg(F.count("*").alias("path_n"))
    typed = obs.where("type IS NOT NULL").groupBy("path", "type").agg(F.count("*").alias("typed_n"))
    weighed = obs.join(typed, ["path", "type"], "left").join(paths, "path")
    scored = weighed.groupBy("rid").agg(
        F.sum((~F.col("missing")).cast("int")).alias("values"),
        F.sum(F.coalesce(1.0 / F.col("typed_n"), F.lit(0.0)) + F.when(F.col("first"), 1.0 / F.col("path_n")).otherwise(0.0)).alias("rarity"),
        F.collect_set("path").alias("paths"),
    )
    canonical = texts if texts is not None else F.to_json(F.struct(*body))
    records = scored.join(df.select(F.col(rid).alias("rid"), canonical.alias("text"), F.to_json(F.struct(*body)).alias("record")), "rid")
    complete = records.withColumn("completeness", F.col("values") / F.greatest(F.lit(1), F.size("paths"))).persist()  # each pick reads it
    try:
        picks = _greedy(complete, limit, ["text", "rid"])
    finally:
        complete.unpersist()
    return [{"rid": p.rid, "score": p.score, "covered_paths": sorted(p.paths), "record": json.loads(p.record)} for p, _ in picks]


def _greedy(records: DataFrame, limit: int, ties: list[str]) -> list[tuple[Row, list[str]]]:
    """(row, paths that it adds) of up to `limit` rows (rid, paths, completeness, rarity ...), each with the most new paths, completeness and rarity in sum."""
    covered: list[str] = []
    chosen: list[tuple[Row, list[str]]] = []
    for _ in range(limit):
        new = F.size(F.array_except("paths", F.array(*[F.lit(p) for p in covered]).cast("array<string>")))
        left = records.where(~F.col("rid").isin([c.rid for c, _ in chosen])) if chosen else records
        best = left.withColumn("score", F.round(new + F.col("completeness") + F.col("rarity"), 9)).orderBy(F.col("score").desc(), *ties).limit(1).collect()
        if not best:
            break
        added = sorted(set(best[0].paths) - set(covered))
        chosen.append((best[0], added))
        covered += added
    return chosen


def select_candidates(candidates: DataFrame, limit: int) -> list[dict]:
    """Greedy picks of rows (record_id, paths, completeness, rarity), with the paths that each adds; ties go to the smaller record_id."""
    rows = candidates.select(F.col("record_id").alias("rid"), F.array_distinct("paths").alias("paths"), "completeness", "rarity")
    return [{"record_id": p.rid, "score": p.score, "covered_paths": added} for p, added in _greedy(rows, max(0, limit), ["rid"])]


class EvidenceBudgetExceeded(ValueError):
    pass


#: Fields and samples that a mode packs at most. Fixed values.
MODES = {"compact": (5, 2), "balanced": (8, 3), "full": (12, 5)}


def field_score() -> Column:
    """How much a field is worth in packed evidence."""
    p = F.col("path")
    score = F.col("present_ratio") + F.col("unique_ratio")
    for condition, bonus in (
        (F.col("candidate_id"), 1.0),
        (p.contains("."), 0.3),
        (p.contains("[]"), 0.45),
        (p.endswith(".id"), 0.75),
        ((F.col("present_ratio") > 0) & (F.col("present_ratio") < 0.5), 0.25),
        (F.coalesce(F.col("max_array_length"), F.lit(0)) > 0, 0.2),
    ):
        score = score + F.when(condition, bonus).otherwise(0.0)
    return score + F.least(F.size("observed_types"), F.lit(3)) * 0.05


def pack_evidence(found: Profile, samples: list[dict], budget: int = 1800, mode: str = "balanced") -> dict:
    """The best fields and samples whose JSON fits the budget; at least one sample, for which fields give way."""
    most_fields, most_samples = MODES[mode]
    rows = found.fields.withColumn("score", F.round(field_score(), 9)).orderBy(F.col("score").desc(), "path").collect()
    out = {"mode": mode, "budget": budget, "estimated_size": 0, "truncated": False, "summary": {"source_format": found.format, "root_type": found.root, "record_count": found.n_records, "field_count": len(rows), "schema_fingerprint": found.fingerprint}, "fields": [], "samples": []}
    size = lambda b: len(json.dumps(b, sort_keys=True))
    if size(out) > budget:
        raise EvidenceBudgetExceeded(f"{mode}: {size(out)} characters are needed at least, the budget is {budget}")
    packed = [{"path": r.path, "observed_types": [t.type for t in r.observed_types], "present_ratio": r.present_ratio, "null_ratio": r.null_ratio, "unique_ratio": r.unique_ratio, "candidate_id": r.candidate_id, "examples": list(r.sample_values or [])[:3], "max_array_length": r.max_array_length} for r in rows]
    for name, items, most in (("fields", packed, most_fields), ("samples", samples, most_samples)):
        for item in items:
            if len(out[name]) >= most:
                out["truncated"] = True
                break
            trial = {**out, name: [*out[name], item]}
            if size(trial) > budget:
                out["truncated"] = True
            else:
                out = trial
    if samples and not out["samples"]:
        for s in samples:
            trial = {**out, "samples": [s]}
            while size(trial) > budget and trial["fields"]:
                trial = {**trial, "fields": trial["fields"][:-1]}
            if size(trial) <= budget:
                out = trial
                break
    out["estimated_size"] = size(out)
    return out
