"""Registry of the engine's queries over the provided tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.functions import paths
from marlspike.operators import drift, evaluate, patch, profile, scenario, schema, synthetic, validation
from marlspike.plans import repair
from marlspike.plans.compile import ERROR, CompiledProgram, compile_program
from marlspike.plans.ir import Program
from marlspike.sources import readers, shared, writers
from marlspike.streaming.mapping import map_stream, write_all

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def program(refs: dict[str, str], steps: dict[str, dict], targets: dict[str, str], **conditions: list[dict]) -> Program:
    """A program from source ids and paths, step ids and operations, target paths and step ids."""
    return Program.read({
        "source_refs": [{"id": i, "path": p, "dtype": "str"} for i, p in refs.items()],
        "steps": [{"id": i, "operation": op} for i, op in steps.items()],
        "assignments": [{"step_id": s, "target_path": p} for p, s in targets.items()],
        **conditions,
    })


def mapped(df: DataFrame, p: Program, *columns: str) -> DataFrame:
    """Columns, as SQL over target and _error, of the mapped records."""
    return compile_program(p, df.schema).transform(df).selectExpr(*columns)


def derived(df: DataFrame, refs: list[str], **expressions: str) -> DataFrame:
    """refs and one derived column for each expression over them; records with an error are left out."""
    steps = {r: {"kind": "copy", "source_ref": r} for r in refs} | {n: {"kind": "derive", "source_refs": refs, "expression": e} for n, e in expressions.items()}
    p = program({r: r for r in refs}, steps, {n: n for n in steps})
    good, _ = compile_program(p, df.schema).split(df)
    return good.select("target.*")


# The flagship: orders to a nested target


def order_program() -> Program:
    return program(
        {"key": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority"},
        {
            "id": {"kind": "cast", "source_ref": "key", "to_type": "str"},
            "state": {"kind": "map_enum", "source_ref": "status", "mapping": {"F": "filled", "O": "open", "P": "partial"}},
            "cents": {"kind": "unit_convert", "source_ref": "price", "from_unit": "unit", "to_unit": "cent", "factor": 100},
            "rank": {"kind": "split", "source_ref": "priority", "delimiter": "-"},
            "label": {"kind": "merge", "source_refs": ["status", "priority"], "delimiter": "/"},
            "sane": {"kind": "validate", "source_ref": "price", "predicate": "value >= 0", "message": "negative price"},
        },
        {"order.id": "id", "order.status": "state", "order.cents": "cents", "order.rank": "rank", "order.label": "label"},
        preconditions=[{"kind": "non_null", "ref": "key"}],
    )


def compiled_orders(df: DataFrame) -> CompiledProgram:
    return compile_program(order_program(), df.schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    good, _ = compiled_orders(orders).split(orders)
    return good.groupBy(F.col("target.order.status").alias("status")).agg(F.count("*").alias("n_orders"), F.round(F.sum("target.order.cents"), 0).alias("sum_cents"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE o_orderstatus END AS status, count(*) AS n_orders, round(sum(o_totalprice * 100), 0) AS sum_cents FROM orders GROUP BY 1")
def map_orders_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# Mapping operators


@query("SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders")
def map_copy_rename(spark, sf_dir):
    p = program({"k": "o_orderkey", "s": "o_orderstatus"}, {"a": {"kind": "copy", "source_ref": "k"}, "b": {"kind": "rename", "source_ref": "s"}}, {"order.id": "a", "order.status": "b"})
    return mapped(table(spark, sf_dir, "orders"), p, "target.order.id AS order_id", "target.order.status AS status")


@query("SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(trunc(-o_totalprice) AS BIGINT) AS negative FROM orders")
def map_cast_int_trunc(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("minus", -F.col("o_totalprice"))
    p = program({"k": "o_orderkey", "p": "o_totalprice", "m": "minus"}, {"k": {"kind": "copy", "source_ref": "k"}, "a": {"kind": "cast", "source_ref": "p", "to_type": "int"}, "b": {"kind": "cast", "source_ref": "m", "to_type": "int"}}, {"k": "k", "whole": "a", "negative": "b"})
    return mapped(df, p, "target.*")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN NULL ELSE false END AS flag, quality = 0 AND toxic = 1 AS failed FROM labels")
def map_cast_bool_tokens(spark, sf_dir):
    df = table(spark, sf_dir, "labels").withColumn("word", F.when(F.col("quality") == 1, " Yes").when(F.col("toxic") == 1, "maybe").otherwise("no"))
    p = program({"k": "doc_id", "w": "word"}, {"k": {"kind": "copy", "source_ref": "k"}, "b": {"kind": "cast", "source_ref": "w", "to_type": "bool"}}, {"doc_id": "k", "flag": "b"})
    return mapped(df, p, "target.doc_id", "target.flag", "_error IS NOT NULL AS failed")


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(trunc(x * 100) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def map_cast_list(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("scaled", F.transform("embedding", lambda x: x * F.lit(100).cast("float")))
    p = program({"k": "vec_id", "e": "scaled"}, {"k": {"kind": "copy", "source_ref": "k"}, "i": {"kind": "cast", "source_ref": "e", "to_type": "int"}}, {"vec_id": "k", "items": "i"})
    return mapped(df, p, "target.vec_id", "aggregate(target.items, 0L, (a, x) -> a + x) AS total")


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def map_enum_passthrough(spark, sf_dir):
    p = program({"k": "o_orderkey", "s": "o_orderstatus"}, {"k": {"kind": "copy", "source_ref": "k"}, "m": {"kind": "map_enum", "source_ref": "s", "mapping": {"F": "filled", "O": "open"}}}, {"k": "k", "status": "m"})
    return mapped(table(spark, sf_dir, "orders"), p, "target.*")


@query("SELECT l_orderkey AS k, l_quantity * 0.5 AS half, CAST(l_linenumber * 60 AS BIGINT) AS minutes FROM lineitem")
def map_unit_convert_scalar(spark, sf_dir):
    unit = {"kind": "unit_convert", "from_unit": "a", "to_unit": "b"}
    p = program({"k": "l_orderkey", "q": "l_quantity", "n": "l_linenumber"}, {"k": {"kind": "copy", "source_ref": "k"}, "h": {**unit, "source_ref": "q", "factor": 0.5}, "m": {**unit, "source_ref": "n", "factor": 60}}, {"k": "k", "half": "h", "minutes": "m"})
    return mapped(table(spark, sf_dir, "lineitem"), p, "target.*")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10)), 4) AS total FROM embeddings")
def map_unit_convert_array(spark, sf_dir):
    p = program({"k": "vec_id", "e": "embedding"}, {"k": {"kind": "copy", "source_ref": "k"}, "u": {"kind": "unit_convert", "source_ref": "e", "from_unit": "a", "to_unit": "b", "factor": 10}}, {"vec_id": "k", "items": "u"})
    return mapped(table(spark, sf_dir, "embeddings"), p, "target.vec_id", "round(aggregate(target.items, 0D, (a, x) -> a + x), 4) AS total")


@query("SELECT o_orderkey AS k, array_to_string(list_filter(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), lambda x: x <> ''), '|') AS pieces FROM orders")
def map_split_trim(spark, sf_dir):
    p = program({"k": "o_orderkey", "s": "o_orderpriority"}, {"k": {"kind": "copy", "source_ref": "k"}, "x": {"kind": "split", "source_ref": "s", "delimiter": "-"}}, {"k": "k", "pieces": "x"})
    return mapped(table(spark, sf_dir, "orders"), p, "target.k", "array_join(target.pieces, '|') AS pieces")


@query("SELECT p_partkey AS k, concat_ws('/', p_name, p_type, CAST(p_size AS VARCHAR)) AS label FROM part")
def map_merge_concat(spark, sf_dir):
    p = program({"k": "p_partkey", "n": "p_name", "t": "p_type", "s": "p_size"}, {"k": {"kind": "copy", "source_ref": "k"}, "m": {"kind": "merge", "source_refs": ["n", "t", "s"], "delimiter": "/"}}, {"k": "k", "label": "m"})
    return mapped(table(spark, sf_dir, "part"), p, "target.*")


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer")
def map_nest_unnest(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("profile", F.struct("c_mktsegment"))
    p = program(
        {"k": "c_custkey", "n": "c_name", "p": "profile"},
        {"k": {"kind": "copy", "source_ref": "k"}, "n": {"kind": "copy", "source_ref": "n"}, "u": {"kind": "unnest", "source_ref": "p", "child_path": "c_mktsegment"}, "o": {"kind": "nest", "step_refs": ["n", "u"], "child_keys": {"n": "name", "u": "segment"}}},
        {"k": "k", "profile": "o"},
    )
    return mapped(df, p, "target.k", "target.profile.name AS name", "target.profile.segment AS segment")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def map_unnest_json(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    p = program({"e": "event_id", "p": "p"}, {"e": {"kind": "copy", "source_ref": "e"}, "k": {"kind": "unnest", "source_ref": "p", "child_path": "k"}}, {"event_id": "e", "k": "k"})
    return mapped(df, p, "target.*")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def map_default_empty(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("long")), "doc_id", "left")
    p = program({"d": "doc_id", "q": "quality"}, {"d": {"kind": "copy", "source_ref": "d"}, "v": {"kind": "default", "source_ref": "q", "value": -1}}, {"doc_id": "d", "quality": "v"})
    return mapped(df, p, "target.*")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier")
def map_drop_field(spark, sf_dir):
    p = program({"k": "s_suppkey", "n": "s_name", "b": "s_acctbal"}, {"k": {"kind": "copy", "source_ref": "k"}, "n": {"kind": "copy", "source_ref": "n"}, "x": {"kind": "drop", "source_ref": "b"}}, {"k": "k", "name": "n", "balance": "x"})
    return mapped(table(spark, sf_dir, "supplier"), p, "target.*")


@query("SELECT CASE WHEN l_returnflag <> 'N' THEN 'condition equals on ''f'' isn''t met' WHEN NOT (l_discount >= 0.05 AND l_quantity < 40) THEN 'v: too much' END AS error, count(*) AS n FROM lineitem GROUP BY 1")
def map_validate_quarantine(spark, sf_dir):
    p = program(
        {"d": "l_discount", "q": "l_quantity", "f": "l_returnflag"},
        {"v": {"kind": "validate", "source_ref": "d", "source_refs": ["q"], "predicate": "value >= 0.05 and q < 40", "message": "too much"}},
        {"discount": "v"},
        preconditions=[{"kind": "equals", "ref": "f", "value": "N"}],
    )
    return mapped(table(spark, sf_dir, "lineitem"), p, "_error AS error").groupBy("error").agg(F.count("*").alias("n"))


# Paths


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def path_wildcard_nested(spark, sf_dir):
    p = program({"c": "conv_id", "r": "turns[].role"}, {"c": {"kind": "copy", "source_ref": "c"}, "m": {"kind": "merge", "source_refs": ["r"], "delimiter": ","}}, {"conv_id": "c", "roles": "m"})
    return mapped(_turns(spark, sf_dir), p, "target.*")


@query("SELECT conv_id, list_sort(list({'turn': turn, 'role': role, 'text': text}))[2].role AS second FROM conversations GROUP BY conv_id")
def path_index(spark, sf_dir):
    p = program({"c": "conv_id", "r": "turns.1.role"}, {"c": {"kind": "copy", "source_ref": "c"}, "m": {"kind": "copy", "source_ref": "r"}}, {"conv_id": "c", "second": "m"})
    return mapped(_turns(spark, sf_dir), p, "target.*")


@query("SELECT DISTINCT conv_id, 'none' AS gone, 0 AS n FROM conversations")
def path_missing(spark, sf_dir):
    p = program(
        {"c": "conv_id", "x": "meta.source", "y": "gone[].id"},
        {"c": {"kind": "copy", "source_ref": "c"}, "d": {"kind": "default", "source_ref": "x", "value": "none"}, "n": {"kind": "derive", "source_refs": ["y"], "expression": "len(y)"}},
        {"conv_id": "c", "gone": "d", "n": "n"},
    )
    return mapped(_turns(spark, sf_dir), p, "target.conv_id", "target.gone", "int(target.n) AS n")


@query("SELECT o_orderkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS numbers, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def path_nested_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    df = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    p = program({"k": "o_orderkey", "n": "items[].l_linenumber"}, {"k": {"kind": "copy", "source_ref": "k"}, "s": {"kind": "derive", "source_refs": ["n"], "expression": "sum(n)"}, "c": {"kind": "derive", "source_refs": ["n"], "expression": "len(n)"}}, {"k": "k", "numbers": "s", "n": "c"})
    return mapped(df, p, "target.*")


# Expressions


@query("SELECT l_orderkey, l_partkey, CAST(floor(-l_partkey / 7.0) AS BIGINT) AS fd, CAST(-l_partkey - 7 * floor(-l_partkey / 7.0) AS BIGINT) AS md, l_partkey / 4.0::DOUBLE AS q, l_partkey + 2 * l_orderkey AS s FROM lineitem")
def expr_arith_floor_mod(spark, sf_dir):
    return derived(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], fd="-l_partkey // 7", md="-l_partkey % 7", q="l_partkey / 4", s="l_partkey + 2 * l_orderkey")


@query("SELECT l_orderkey, l_quantity, l_returnflag, 5 < l_quantity AND l_quantity <= 25 AND l_returnflag <> 'R' AS a, NOT (l_quantity > 10 OR l_returnflag = 'A') AS b FROM lineitem")
def expr_bool_chain(spark, sf_dir):
    return derived(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"], a="5 < l_quantity <= 25 and l_returnflag != 'R'", b="not (l_quantity > 10 or l_returnflag == 'A')")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def expr_ternary(spark, sf_dir):
    return derived(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], band="'high' if o_totalprice > 200000 else 'mid' if o_totalprice > 50000 else 'low'")


@query("SELECT p_partkey, p_type, p_name, p_type IN (SELECT min(p_type) FROM part) OR p_type = 'STEEL' AS a, contains(p_name, 'a') AS b, p_size NOT IN (1, 2, 3) AS c, p_size FROM part")
def expr_in(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    low = df.agg(F.min("p_type")).first()[0]
    return derived(df, ["p_partkey", "p_type", "p_name", "p_size"], a=f"p_type in [{low!r}, 'STEEL']", b="'a' in p_name", c="p_size not in (1, 2, 3)")


@query("SELECT l_orderkey, l_quantity, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS r, CAST(trunc(l_quantity / 4) AS BIGINT) AS i FROM lineitem")
def expr_round_even(spark, sf_dir):
    return derived(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"], r="round(l_quantity / 2)", i="int(l_quantity / 4)")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, nullif(source, ''), 'none') AS pick FROM documents LEFT JOIN labels USING (doc_id)")
def expr_first_non_null(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("q", F.when(F.col("quality") == 1, "good"))
    return derived(df, ["doc_id", "q", "source"], pick="first_non_null(q, source, 'none')").select("doc_id", "pick")


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 5) AS high, round(list_min(embedding)::DOUBLE, 5) AS low, len(embedding) AS n, round(list_sort(embedding)[1]::DOUBLE, 5) AS first FROM embeddings")
def expr_list_fn(spark, sf_dir):
    out = derived(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"], high="max(embedding)", low="min(embedding)", n="len(embedding)", first="sorted(embedding)[0]")
    return out.selectExpr("vec_id", "round(double(high), 5) AS high", "round(double(low), 5) AS low", "n", "round(double(first), 5) AS first")


@query("SELECT p_partkey, p_name, substr(p_name, 1, 3) AS a, substr(p_name, length(p_name) - 1, 2) AS b, reverse(p_name) AS c, substr(p_name, length(p_name), 1) AS d FROM part")
def expr_slice(spark, sf_dir):
    return derived(table(spark, sf_dir, "part"), ["p_partkey", "p_name"], a="p_name[:3]", b="p_name[-2:]", c="p_name[::-1]", d="p_name[-1]")


@query("SELECT p_partkey, p_name || ':' || CAST(p_size AS VARCHAR) || repeat('-', 3) AS label, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS big FROM part")
def expr_str(spark, sf_dir):
    return derived(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_size"], label="p_name + ':' + str(p_size) + '-' * 3", big="str(p_size > 25)").select("p_partkey", "label", "big")


@query("SELECT count(*) AS failed FROM lineitem WHERE l_linenumber = 1")
def expr_errors(spark, sf_dir):
    p = program({"n": "l_linenumber"}, {"x": {"kind": "derive", "source_refs": ["n"], "expression": "10 // (n - 1)"}}, {"x": "x"})
    return mapped(table(spark, sf_dir, "lineitem"), p, "_error").agg(F.count(ERROR).alias("failed"))


# Profiles


def _counts(df: DataFrame) -> DataFrame:
    return profile.value_counts(profile.flatten_records(df))


_FLAT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_UNIONED = " UNION ALL ".join(f"SELECT '{c}' AS path, CAST({c} AS VARCHAR) AS v, {'CAST(' + c + ' AS DOUBLE)' if c.endswith('key') else 'CAST(NULL AS DOUBLE)'} AS num, {'CAST(NULL AS INT)' if c.endswith('key') else f'length({c})'} AS len FROM orders" for c in _FLAT)


@query(f"SELECT path, 1.0::DOUBLE AS present_ratio, 0.0::DOUBLE AS null_ratio, round(count(DISTINCT v) / count(v), 6) AS unique_ratio, min(num) AS numeric_min, max(num) AS numeric_max, min(len) AS length_min, max(len) AS length_max, count(DISTINCT v) / count(v) >= 0.95 AS candidate_id FROM ({_UNIONED}) GROUP BY path")
def profile_field_stats(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(*_FLAT)
    out = profile.field_stats(_counts(df), df.count())
    return out.select("path", "present_ratio", "null_ratio", F.round("unique_ratio", 6).alias("unique_ratio"), "numeric_min", "numeric_max", "length_min", "length_max", "candidate_id")


@query("SELECT 'quality' AS path, CASE WHEN quality IS NULL THEN 'null' ELSE 'int' END AS type, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL UNION ALL SELECT 'lang', 'str', count(*) FROM documents")
def profile_types(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").drop("doc_id")
    return profile.type_counts(_counts(df)).select("path", "type", F.col("n").cast("long").alias("n"))


@query(f"SELECT path, CAST(rank AS INT) AS rank, v AS text, n FROM (SELECT path, v, count(*) AS n, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, v) AS rank FROM ({_UNIONED}) GROUP BY path, v) WHERE rank <= 5")
def profile_top_values(spark, sf_dir):
    return profile.top_values(_counts(table(spark, sf_dir, "orders").select(*_FLAT))).select("path", "rank", "text", F.col("n").cast("long").alias("n"))


@query(f"SELECT path, CAST(rank AS INT) AS rank, v AS text FROM (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY v) AS rank FROM (SELECT DISTINCT path, v FROM ({_UNIONED}))) WHERE rank <= 5")
def profile_samples(spark, sf_dir):
    return profile.sample_values(_counts(table(spark, sf_dir, "orders").select(*_FLAT)))


@query("""SELECT 'items[].flags[]' AS path, count(*) FILTER (WHERE even) / count(*) AS present_ratio, CAST(sum(n) AS BIGINT) AS n FROM
  (SELECT l_orderkey, bool_or(l_linenumber % 2 = 0) AS even, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS n FROM lineitem GROUP BY l_orderkey)""")
def profile_nested_presence(spark, sf_dir):
    flags = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_returnflag"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", flags.alias("flags"))).alias("items"))
    df = items.select("l_orderkey", F.array_sort("items").alias("items"))
    counts = _counts(df)
    stats = profile.field_stats(counts, df.count()).where("path = 'items[].flags[]'").select("path", "present_ratio")
    return stats.join(profile.type_counts(counts).groupBy("path").agg(F.sum("n").cast("long").alias("n")), "path")


@query("SELECT 'turns[]' AS path, CAST(max(n) AS INT) AS max_array_length FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def profile_array_len(spark, sf_dir):
    df = _turns(spark, sf_dir).select(F.transform("turns", lambda t: t["role"]).alias("turns"))
    return profile.field_stats(_counts(df), df.count()).where("max_array_length IS NOT NULL").select("path", "max_array_length")


def _shape(path: str, label: str) -> str:
    return f"""'{{"nullable":' || CASE WHEN count({path}) < count(*) THEN 'true' ELSE 'false' END || ',"optional":false,"path":"{path}","types":[' || CASE WHEN count({path}) < count(*) AND count({path}) > 0 THEN '"{min(label, 'null')}","{max(label, 'null')}"' WHEN count({path}) = 0 THEN '"null"' ELSE '"{label}"' END || ']}}'"""


_SHAPES = [_shape("c_acctbal", "float"), _shape("c_custkey", "int"), _shape("c_mktsegment", "str"), _shape("c_name", "str"), _shape("c_nationkey", "int")]


@query(f"SELECT sha256('[' || {' || \',\' || '.join(_SHAPES)} || ']') AS fingerprint FROM customer")
def profile_fingerprint(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return spark.createDataFrame([(profile.profile(df).fingerprint,)], "fingerprint string")


@query("SELECT 'k' AS path, 'int' AS type, count(*) AS n FROM events UNION ALL SELECT 'tags', 'list', count(*) FROM events UNION ALL SELECT 'tags[]', 'str', 2 * count(*) FROM events")
def profile_variant(spark, sf_dir):
    text = F.concat(F.substring("props", 1, 1), F.lit('"tags": ["a", "b"], '), F.expr("substring(props, 2)"))
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.parse_json(text).alias("record"))
    return profile.flatten_variant(df, depth=3).groupBy("path", "type").agg(F.count("*").alias("n"))


@query()
def sample_greedy(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    picks = profile.representative_samples(df, "event_id", 3)
    return spark.createDataFrame([(i, p["rid"], p["score"]) for i, p in enumerate(picks)], "pick int, event_id long, score double")


# Validation


_CONTRACT = T.StructType([
    T.StructField("order", T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("status", T.StringType(), False, {"required": True, "enum": ["filled", "open"]}),
        T.StructField("cents", T.DoubleType(), True, {"ge": 0, "le": 20_000_000}),
        T.StructField("note", T.StringType(), True),
    ]), False),
])


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    checks = [
        validation.Assertion("same key", "predicate", "order.id", expression="actual == str(source['o_orderkey'])"),
        validation.Assertion("enum", "enum_mapping", "order.status", "o_orderstatus", mapping={"F": "filled", "O": "open"}),
        validation.Assertion("cents", "unit_conversion", "order.cents", "o_totalprice", factor=100),
        validation.Assertion("label", "equals", "order.label", "o_orderpriority"),
    ]
    return validation.acceptance_cases(orders, compiled_orders(orders), _CONTRACT, checks[:3])


@query("SELECT code, path, count(*) AS n FROM (SELECT 'literal_error' AS code, 'order.status' AS path FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'less_than_equal', 'order.cents' FROM orders WHERE o_totalprice * 100 > 20000000) GROUP BY ALL")
def contract_issues(spark, sf_dir):
    return _accepted(spark, sf_dir).select(F.inline("structural_issues")).groupBy("code", "path").agg(F.count("*").alias("n"))


@query("SELECT 'semantic_enum_mapping_mismatch' AS code, 'order.status' AS target_path, count(*) AS n FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
def semantic_issues(spark, sf_dir):
    return _accepted(spark, sf_dir).select(F.inline("semantic_issues")).groupBy("code", "target_path").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority <> o_orderstatus || '/' || o_orderpriority")
def semantic_equals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cases = validation.acceptance_cases(orders, compiled_orders(orders), _CONTRACT, [validation.Assertion("label", "equals", "order.label", "o_orderpriority")])
    return cases.agg(F.count_if(F.size("semantic_issues") > 0).alias("n"))


@query("SELECT count(*) AS case_count, true AS execution_success, false AS structural_validity, false AS semantic_validity, round(avg(CASE WHEN o_orderstatus <> 'P' AND o_totalprice * 100 <= 20000000 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM orders")
def acceptance_summary(spark, sf_dir):
    return validation.acceptance_report(_accepted(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


# Drift and patches


def _drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = base.select("o_orderkey", F.col("o_orderstatus").alias("o_order_status"), F.concat(F.lit("p"), "o_orderpriority").alias("o_orderpriority"), F.col("o_totalprice").cast("long").alias("o_totalprice"), F.lit(1).alias("o_new"))
    return base, new


def _top(expression: str) -> str:
    """SQL for a field's enum values: the list of its five most frequent texts."""
    return f"(SELECT list(v) FROM (SELECT CAST({expression} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"


def _overlap(b: str, c: str) -> str:
    return f"len(list_intersect({_top(b)}, {_top(c)})) / len(list_distinct(list_concat({_top(b)}, {_top(c)})))"


_SAME_PRIORITY = _overlap("o_orderpriority", "'p' || o_orderpriority")
#: Statistics of the two versions of orders, and the rules that fit their types.
_CHANGES = f"""SELECT 'o_orderkey' AS path, 'shared' AS kind, 'no_change' AS classification FROM orders HAVING count(o_orderkey) = count(*)
UNION ALL SELECT 'o_orderpriority', 'shared', CASE WHEN {_SAME_PRIORITY} < 0.25 THEN 'semantic_change' ELSE 'no_change' END
UNION ALL SELECT 'o_totalprice', 'shared', CASE WHEN typeof(any_value(o_totalprice)) = 'DOUBLE' THEN 'semantic_change' ELSE 'no_change' END FROM orders
UNION ALL SELECT 'o_orderstatus', 'removed', CASE WHEN count(o_orderstatus) >= 0.95 * count(*) THEN 'breaking_change' ELSE 'semantic_change' END FROM orders
UNION ALL SELECT 'o_order_status', 'added', 'additive_compatible' UNION ALL SELECT 'o_new', 'added', 'additive_compatible'"""


@query(_CHANGES)
def drift_diff_full_outer(spark, sf_dir):
    base, new = _drifted(spark, sf_dir)
    return drift.classified(drift.compared(profile.profile(base).signatures(), profile.profile(new).signatures())).select("path", "kind", "classification")


_RENAME = """0.7 * CAST(replace('o_orderstatus', '_', '') = replace('o_order_status', '_', '') AS INT)
  + 0.2 * (1 - abs(count(*) / count(*) - count(*) / count(*))) + 0.1 * (1 - abs(count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*) - count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*)))"""


@query(f"""WITH c AS ({_CHANGES}), r AS (SELECT {_RENAME} AS score FROM orders)
SELECT 'changed' AS kind, path AS baseline_path, path AS candidate_path, classification FROM c WHERE kind = 'shared' AND classification <> 'no_change'
UNION ALL SELECT 'renamed', 'o_orderstatus', 'o_order_status', 'rename_compatible' FROM r WHERE score >= 0.72
UNION ALL SELECT kind, CASE kind WHEN 'removed' THEN path END, CASE kind WHEN 'added' THEN path END, classification FROM c, r
  WHERE kind <> 'shared' AND NOT (score >= 0.72 AND path IN ('o_orderstatus', 'o_order_status'))""")
def drift_classify(spark, sf_dir):
    base, new = _drifted(spark, sf_dir)
    report = drift.classify_drift(profile.profile(base).signatures(), profile.profile(new).signatures())
    return spark.createDataFrame([(d.kind, d.baseline_path, d.candidate_path, d.classification) for d in report.drifts], "kind string, baseline_path string, candidate_path string, classification string")


@query(f"SELECT 'o_orderpriority' AS path, {_SAME_PRIORITY} AS overlap UNION ALL SELECT 'o_orderkey', {_overlap('o_orderkey', 'o_orderkey')}")
def drift_enum_jaccard(spark, sf_dir):
    base, new = _drifted(spark, sf_dir)
    both = drift.compared(profile.profile(base).signatures(), profile.profile(new).signatures())
    return both.where("kind = 'shared' AND path <> 'o_totalprice'").select("path", drift.enum_jaccard().alias("overlap"))


@query(f"SELECT 'o_orderstatus' AS removed, 'o_order_status' AS added, round(CAST({_RENAME} AS DOUBLE), 6) AS score FROM orders")
def drift_rename_pairs(spark, sf_dir):
    base, new = _drifted(spark, sf_dir)
    both = drift.compared(profile.profile(base).signatures(), profile.profile(new).signatures()).collect()
    side = lambda r, p: {"path": r.path, "dominant_type": r[f"{p}_dominant_type"], "cardinality": r[f"{p}_cardinality"], "present_ratio": r[f"{p}_present_ratio"], "null_ratio": r[f"{p}_null_ratio"]}
    pairs = drift.rename_pairs([side(r, "b") for r in both if r.kind == "removed"], [side(r, "c") for r in both if r.kind == "added"])
    return spark.createDataFrame([(b, c, round(s, 6)) for s, b, c in pairs], "removed string, added string, score double")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE o_orderstatus END AS status FROM orders")
def patch_retarget_roundtrip(spark, sf_dir):
    base = table(spark, sf_dir, "orders").drop("o_orderdate")
    new = base.withColumnRenamed("o_orderstatus", "o_order_status")
    source = schema.SourceSchema("orders", tuple(schema.SourceField(c, dtype="str") for c in base.columns)).normalised()
    by_path = Program.read({**order_program().as_dict(), "source_refs": [{"id": r.id, "path": r.path, "dtype": r.dtype} for r in order_program().source_refs]})
    report = drift.classify_drift(profile.profile(base).signatures(), profile.profile(new).signatures())
    keyed = patch.Patch(program=tuple(("retarget", r.id, d.candidate_path) for d in report.drifts if d.kind == "renamed" for r in by_path.source_refs if r.path == d.baseline_path))
    assert patch.apply_to_schema(source, patch.propose_patch(report, source, by_path).patch).by_path().get("o_order_status")
    return mapped(new, patch.apply_to_program(by_path, keyed), "target.order.id AS id", "target.order.status AS status")


# Synthetic drift


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("info"), F.col("o_custkey").alias("days"))


def _synth(spark: SparkSession, sf_dir: str, op: dict, *columns: str) -> DataFrame:
    return synthetic.apply_operator(_records(spark, sf_dir), op, "o_orderkey").selectExpr("o_orderkey", *columns)


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3) THEN 'high' END AS urgency FROM orders")
def synth_add(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "add_field", "path": "extra.urgency", "value": "high", "record_indexes": [1, 2, 3]}, "extra.urgency")


@query("SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (1, 2) THEN o_orderpriority END AS priority FROM orders")
def synth_drop(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "drop_optional_field", "path": "info.priority", "record_indexes": [1, 2]}, "info.priority")


@query("SELECT o_orderkey, o_orderstatus AS state FROM orders")
def synth_rename(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "rename_field", "path": "info.status", "new_path": "info.state"}, "info.state")


@query("SELECT o_orderkey, o_custkey AS days FROM orders")
def synth_nest(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "nest_field", "path": "days", "new_path": "plan.length.days"}, "plan.length.days")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def synth_flatten(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "flatten_field", "path": "info.status", "new_path": "status"}, "status")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) ELSE '' END AS b FROM orders")
def synth_split(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "split_field", "path": "info.priority", "new_paths": ["a", "b"], "separator": "-"}, "a", "b")


@query("SELECT o_orderkey, o_orderstatus || '+' || o_orderpriority AS both FROM orders")
def synth_merge(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "merge_fields", "paths": ["info.status", "info.priority"], "new_path": "both", "separator": "+"}, "both")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey = 1 THEN ' day' ELSE ' days' END AS days FROM orders")
def synth_format(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "change_value_format", "path": "days", "format_style": "duration_text"}, "days")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' ELSE o_orderstatus END AS status FROM orders")
def synth_enum(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "change_enum_surface", "path": "info.status", "mapping": {"F": "Fulfilled"}}, "info.status")


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey NOT IN (1, 3) THEN o_custkey END AS days FROM orders")
def synth_sparse(spark, sf_dir):
    return _synth(spark, sf_dir, {"kind": "inject_sparse_objects", "keep_paths": ["info.status"], "record_indexes": [1, 3]}, "info.status", "days")


# Evaluation


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and actual of each order; the actual priority of every tenth is wrong."""
    orders = table(spark, sf_dir, "orders")
    wrong = F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderpriority"))
    df = orders.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority", F.struct("o_custkey").alias("by")).alias("expected"), F.struct("o_orderstatus", wrong.alias("o_orderpriority"), F.struct("o_custkey").alias("by"), F.lit(1).alias("more")).alias("actual"))
    return evaluate.case_accuracy(df, "expected", "actual", ["o_orderpriority"])


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 3 END AS BIGINT) AS matched, CAST(3 AS BIGINT) AS total, round(CASE WHEN o_orderkey % 10 = 0 THEN 2 / 3.0 ELSE 1.0 END, 6)::DOUBLE AS ratio, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS required_ratio FROM orders")
def eval_case_accuracy(spark, sf_dir):
    return _cases(spark, sf_dir).select("o_orderkey", "accuracy.matched", "accuracy.total", F.round("accuracy.ratio", 6).alias("ratio"), "accuracy.required_ratio")


@query("SELECT o_orderstatus AS status, count(*) AS case_count, round(avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END), 6) AS required_accuracy, round(avg(CASE WHEN o_orderkey % 10 = 0 THEN 2 / 3.0 ELSE 1.0 END), 6) AS macro_accuracy, round(sum(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 3 END) / sum(3), 6) AS micro_accuracy, CASE WHEN bool_and(o_orderkey % 10 <> 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_at_1, round(avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM orders GROUP BY 1")
def eval_macro_micro(spark, sf_dir):
    cases = _cases(spark, sf_dir).withColumns({"status": F.col("expected.o_orderstatus"), "execution_success": F.lit(True), "structural_validity": F.lit(None).cast("boolean"), "semantic_validity": F.lit(None).cast("boolean")})
    out = evaluate.run_metrics(cases, ["status"])
    return out.select("status", "case_count", *[F.round(c, 6).alias(c) for c in ("required_accuracy", "macro_accuracy", "micro_accuracy", "pass_at_1", "coverage")])


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    tags = F.array(F.concat(F.lit("bundle_kind:"), F.when(F.col("l_linestatus") == "O", "drift").otherwise("base")), F.concat(F.lit("severity:"), "l_returnflag"), F.concat(F.lit("drift_type:"), "l_linestatus"))
    wide = items.select(F.concat(F.lit("run-"), "l_linenumber").alias("run_id"), F.col("l_returnflag").alias("scenario_name"), F.col("l_linestatus").alias("subject_name"), tags.alias("tags"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return evaluate.metric_rows(evaluate.tag_dimensions(wide), ["quantity", "discount"])


@query("SELECT l_returnflag AS scenario_name, metric_name, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT l_returnflag, 'quantity' AS metric_name, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem) GROUP BY ALL")
def eval_unpivot(spark, sf_dir):
    return _metric_rows(spark, sf_dir).groupBy("scenario_name", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'drift' ELSE 'base' END AS bundle_kind, l_returnflag AS severity, '' AS dataset, 2 * count(*) AS n FROM lineitem GROUP BY ALL")
def eval_tags_dims(spark, sf_dir):
    return _metric_rows(spark, sf_dir).groupBy("bundle_kind", "severity", F.coalesce("dataset_id", F.lit("")).alias("dataset")).agg(F.count("*").alias("n"))


_ROWS = "SELECT 'run-' || l_linenumber AS run_id, l_returnflag AS f, l_linestatus AS s, metric_name, value FROM (SELECT *, 'quantity' AS metric_name, l_quantity AS value FROM lineitem UNION ALL SELECT *, 'discount', l_discount FROM lineitem)"
_ROLL = "SELECT '{0}' AS group_type, {1} || ' / ' || s AS group_label, metric_name, count(DISTINCT run_id) AS run_count, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(stddev_pop(value), 5) AS stdev, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr FROM (" + _ROWS + ") {2} GROUP BY ALL"


@query(" UNION ALL ".join([_ROLL.format("scenario", "f", ""), _ROLL.format("bundle_kind", "CASE WHEN s = 'O' THEN 'drift' ELSE 'base' END", ""), _ROLL.format("drift_type", "s", "WHERE s = 'O'"), _ROLL.format("severity", "f", "WHERE s = 'O'")]))
def eval_rollup_summary(spark, sf_dir):
    out = evaluate.summarise(_metric_rows(spark, sf_dir))
    return out.select("group_type", "group_label", "metric_name", "run_count", *[F.round(c, 5).alias(c) for c in ("mean", "median", "stdev")], "min", "max", F.round("iqr", 5).alias("iqr"))


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1")
def eval_quartiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("run_id"), F.col("l_extendedprice").alias("value"))
    return evaluate.summary_stats(rows, ["flag"]).select("flag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query("SELECT 'program' AS subject_kind, 'run-001' AS run_id, count(*) AS cases, count(*) AS exact FROM nation")
def eval_run_benchmark(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    df = nation.select(F.col("n_nationkey").cast("string").alias("name"), "n_name", F.struct(F.col("n_name").alias("title")).alias("expected"))
    p = program({"n": "n_name"}, {"t": {"kind": "copy", "source_ref": "n"}}, {"title": "t"})
    cases, _ = evaluate.run_benchmark([evaluate.Subject.from_program("mapping", lambda kind: compile_program(p, kind))], [evaluate.Scenario("nations", df)])
    return cases.groupBy("subject_kind", "run_id").agg(F.count("*").alias("cases"), F.count_if(F.col("accuracy.matched") == F.col("accuracy.total")).alias("exact"))


@query("SELECT * FROM (VALUES (0, true, 1102.0), (1, false, 26.0)) t(rank, valid, score)")
def rank_candidates(spark, sf_dir):
    good = program({"k": "o_orderkey", "s": "o_orderstatus"}, {"a": {"kind": "copy", "source_ref": "k"}, "b": {"kind": "copy", "source_ref": "s"}}, {"id": "a", "status": "b"})
    bad = program({"k": "nowhere"}, {"a": {"kind": "copy", "source_ref": "k"}}, {"id": "a"})
    ranked = evaluate.rank_candidates([bad, good], table(spark, sf_dir, "orders").columns, ["id", "status"])
    return spark.createDataFrame([(i, r.valid, r.score) for i, r in enumerate(ranked)], "rank int, valid boolean, score double")


@query("SELECT * FROM (VALUES ('task_name', 'str', 'longer text', true, 0.85)) t(semantic_name, dtype, description, nullable, confidence)")
def dedupe_merge_votes(spark, sf_dir):
    a = schema.SourceSchema("a", (schema.SourceField("taskName", "task name", "text", "str", aliases=("title",), confidence=0.9),))
    b = schema.SourceSchema("b", (schema.SourceField("task_name", "task name", "longer text", "str", nullable=True, aliases=("title",), confidence=0.8),))
    merged = schema.merge_candidates([a, b])
    return spark.createDataFrame([(f.semantic_name, f.dtype, f.description, f.nullable, f.confidence) for f in merged.fields], "semantic_name string, dtype string, description string, nullable boolean, confidence double")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = F.col("o_orderstatus") != "P"
    return _cases(spark, sf_dir).withColumns({"status": F.col("expected.o_orderstatus"), "o_orderstatus": F.col("expected.o_orderstatus")}).withColumns({"execution_success": k % 7 != 0, "structural_validity": F.when(asked, k % 5 != 0), "semantic_validity": F.when(asked, k % 3 != 0)})


_FLAGS = "SELECT o_orderstatus AS status, o_orderkey % 7 <> 0 AS e, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 <> 0 END AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 3 <> 0 END AS m FROM orders"


@query(f"""SELECT status, 1.0::DOUBLE AS build_success, round(avg(e::INT), 6) AS execution_success_rate, round(avg((e AND coalesce(s AND m, s IS NULL OR m IS NULL))::INT), 6) AS runtime_validity_rate,
  round(avg(s::INT), 6) AS structural_validity_rate, round(avg(m::INT), 6) AS semantic_validity_rate, 0.5::DOUBLE AS mapping_quality FROM ({_FLAGS}) GROUP BY status""")
def eval_stage_metrics(spark, sf_dir):
    out = evaluate.stage_metrics(_flagged(spark, sf_dir), ["status"], overrides={"mapping_quality": 0.5})
    return out.select("status", "build_success", *[F.round(c, 6).alias(c) for c in ("execution_success_rate", "runtime_validity_rate", "structural_validity_rate", "semantic_validity_rate")], "mapping_quality")


@query(f"""SELECT status, 'stage' AS metric_group, 'stage.' || n AS metric_name, round(v, 6) AS value FROM (SELECT status, unnest(['build_success', 'execution_success_rate', 'runtime_validity_rate', 'structural_validity_rate', 'semantic_validity_rate']) AS n,
  unnest([1.0, avg(e::INT), avg((e AND coalesce(s AND m, s IS NULL OR m IS NULL))::INT), avg(s::INT), avg(m::INT)]) AS v FROM ({_FLAGS}) GROUP BY status) WHERE v IS NOT NULL""")
def eval_observation_metrics(spark, sf_dir):
    out = evaluate.observation_metrics(_flagged(spark, sf_dir), ["status"]).where("metric_group = 'stage'")
    return out.select("status", "metric_group", "metric_name", F.round("value", 6).alias("value"))


@query(f"SELECT 'lines' AS experiment_name, f AS scenario_name, CASE WHEN s = 'O' THEN 'drift' ELSE 'base' END AS bundle_kind, metric_name, count(*) AS n, round(sum(value), 4) AS total FROM ({_ROWS}) GROUP BY ALL")
def sink_boxplot_rows(spark, sf_dir):
    rows = writers.in_columns(_metric_rows(spark, sf_dir), writers.BOXPLOT_COLUMNS, experiment_name="lines")
    return rows.groupBy("experiment_name", "scenario_name", "bundle_kind", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INT) AS position, l_linenumber AS line, l_linenumber * 10 AS gold FROM lineitem""")
def eval_zip_gold(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("raw"))
    pairs = evaluate.zip_with_gold(lists.withColumn("gold", F.transform("raw", lambda x: x * 10)), "raw", "gold", ["l_orderkey"])
    return pairs.select("l_orderkey", "position", F.col("raw").alias("line"), "gold")


@query("SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"who\":{\"status\":\"' || o_orderstatus || '\"}}' AS record FROM orders")
def path_remove(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("who")).alias("r"))
    left = paths.remove_path(F.col("r"), orders.schema["r"].dataType, "who[].key")
    return orders.select("o_orderkey", F.to_json(left.col).alias("record"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS label FROM orders")
def repair_then_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    proposal = {
        "source_refs": [{"id": "key", "path": "o_orderkey", "dtype": "int"}, {"id": "priority", "path": "o_orderpriority", "dtype": "str"}],
        "steps": [{"id": "id", "operation": {"kind": "cast", "source_ref": "o_orderkey", "to_type": "str"}}, {"id": "label", "operation": {"kind": "derive", "source_refs": ["priority", "o_orderstatus"], "expression": "coalesce(priority, o_orderstatus)"}}],
        "assignments": [{"step_id": "id", "target_path": "id"}, {"step_id": "o_orderstatus", "target_path": "status"}, {"step_id": "label", "target_path": "label"}],
        "preconditions": [{"ref": "priority", "kind": "non_null"}],
    }
    want = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("label", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))])
    fixed, _ = repair.repair(proposal, orders.columns, want)
    return mapped(orders, fixed, "target.id", "target.status", "target.label")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS p, c_nationkey % 4 AS completeness, c_custkey % 3 AS rarity FROM customer),
a AS (SELECT * FROM c ORDER BY 2 + completeness + rarity DESC, c_custkey LIMIT 1),
b AS (SELECT * FROM c WHERE c_custkey <> (SELECT c_custkey FROM a) ORDER BY CAST(p <> (SELECT p FROM a) AS INT) + completeness + rarity DESC, c_custkey LIMIT 1)
SELECT 0 AS pick, c_custkey AS record_id, (2 + completeness + rarity)::DOUBLE AS score, 2 AS added FROM a
UNION ALL SELECT 1, c_custkey, (CAST(p <> (SELECT p FROM a) AS INT) + completeness + rarity)::DOUBLE, CAST(p <> (SELECT p FROM a) AS INT) FROM b""")
def sample_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.array(F.lit("id"), "c_mktsegment").alias("paths"), (F.col("c_nationkey") % 4).alias("completeness"), (F.col("c_custkey") % 3).alias("rarity"))
    picks = profile.select_candidates(rows, 2)
    return spark.createDataFrame([(i, p["record_id"], float(p["score"]), len(p["covered_paths"])) for i, p in enumerate(picks)], "pick int, record_id long, score double, added int")


# Sources, generation, streams


@query("SELECT p_partkey, lower(regexp_replace(trim('  ' || p_name || ' '), '\\s+', '_', 'g')) AS name FROM part")
def header_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", readers.normalised(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"))


@query("SELECT o_orderkey, CAST(CAST('0x' || substr(sha256('{\"o_orderkey\":' || o_orderkey || '}'), 1, 8) AS BIGINT) % 3 AS INT) AS variant FROM orders")
def shape_variant_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scenario.variant_index(F.to_json(F.struct("o_orderkey")), 3).alias("variant"))


@query("SELECT event_id, event_type AS kind, value * 2 AS twice FROM events")
def stream_map_equiv(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    unit = {"kind": "unit_convert", "source_ref": "v", "from_unit": "a", "to_unit": "b", "factor": 2.0}
    p = compile_program(program({"e": "event_id", "t": "event_type", "v": "value"}, {"e": {"kind": "copy", "source_ref": "e"}, "t": {"kind": "copy", "source_ref": "t"}, "d": unit}, {"event_id": "e", "kind": "t", "twice": "d"}), batch.schema)
    # a stream reads folders: of a table that is one file, its folder's file of that name
    folder, only = (path, "*") if readers.is_folder(spark, path) else (sf_dir, "events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", only).parquet(folder)
    mapped, out, log = map_stream(stream, p), shared.new_path(spark, "stream-map"), shared.new_path(spark, "stream-log")
    write_all(mapped, out, log).awaitTermination()
    shared.remove(spark, log)
    return spark.read.schema(mapped.schema).parquet(out).select("target.*")
