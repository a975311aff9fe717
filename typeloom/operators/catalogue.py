"""The queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.functions import formats, naming
from typeloom.functions.formats import FORMATS, PATTERNS
from typeloom.operators import engine, facts
from typeloom.operators.check import Checked, check_lines, patch_files
from typeloom.operators.infer import infer_frame, infer_lines, parsed, simplify_text
from typeloom.plans.declarations import read, root_of
from typeloom.plans.nodes import Scalar, encode
from typeloom.plans.settings import Options
from typeloom.sources.jsonl import lines_of_frame, with_validity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- formats in SQL


def _re2(pattern: str) -> str:
    import re

    return re.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", lambda m: f"\\x{{{m[1] or m[2]}}}", pattern)


def _sql_test(name: str, c: str) -> str:
    if name == "Path":
        return f"(contains({c}, '/') OR contains({c}, chr(92)))"
    if name == "Base64":
        return f"(length({c}) >= 24 AND length({c}) % 4 = 0 AND regexp_full_match({c}, '[A-Za-z0-9+/]+=*'))"
    return f"regexp_matches({c}, '(?s)\\A(?:{_re2(PATTERNS[name])})\\z')"


def _sql_first(c: str) -> str:
    """CASE of one value's first format."""
    arms = " ".join(f"WHEN {_sql_test(f.name, c)}{' AND ends_with(' + c + ', chr(61))' if f.name == 'Base64' else ''} THEN '{f.name}'" for f in FORMATS)
    return f"CASE {arms} ELSE 'string' END"


def _sql_common(c: str) -> str:
    """CASE of all values' common format."""
    arms = " ".join(f"WHEN bool_and({_sql_test(f.name, c)}){' AND bool_or(ends_with(' + c + ', chr(61)))' if f.name == 'Base64' else ''} THEN '{f.name}'" for f in FORMATS)
    return f"CASE {arms} WHEN min(length({c})) > {formats.BLOB_OVER} THEN 'Blob' ELSE 'string' END"


#: (label, table, Spark expression, DuckDB expression) of text columns.
TEXTS = [
    ("pages.url", "pages", "url", "url"),
    ("customer.c_name", "customer", "c_name", "c_name"),
    ("documents.text", "documents", "text", "text"),
    ("documents.lang", "documents", "lang", "lang"),
    ("orders.date", "orders", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("events.props", "events", "props", "props"),
    ("events.id64", "events", "base64(cast(concat('event-number-', event_id) as binary))", "to_base64(encode('event-number-' || event_id))"),
    ("nation.hex", "nation", "lower(substr(sha2(n_name, 256), 1, 40))", "substr(sha256(n_name), 1, 40)"),
    ("part.version", "part", "concat(p_size, '.', p_partkey, '.0')", "p_size || '.' || p_partkey || '.0'"),
    ("supplier.mail", "supplier", "concat('s', s_suppkey, '@example.org')", "'s' || s_suppkey || '@example.org'"),
]


def _texts(spark, sf):
    return [(label, table(spark, sf, t).select(F.expr(e).alias("c"))) for label, t, e, _ in TEXTS]


# ---------------------------------------------------------------- scan, parse, profile


def _k_of(batches):
    import pyarrow as pa

    for b in batches:
        ks = [r.get("k") if ok and isinstance(r, dict) else None for ok, r in map(parsed, b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ks, pa.int64())], ["event_id", "k"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_parse(spark, sf):
    return table(spark, sf, "events").select("event_id", "props").mapInArrow(_k_of, "event_id long, k long")


@query("SELECT 'documents' AS src, json_valid(text) AS valid, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'events', json_valid(props), count(*) FROM events GROUP BY 2")
def parse_reject(spark, sf):
    out = []
    for src, column in (("documents", "text"), ("events", "props")):
        lines = table(spark, sf, src).select(F.lit(0).alias("file_ord"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("id"), F.col(column).alias("line"))
        out.append(with_validity(lines).groupBy("valid").agg(F.count("*").alias("n")).select(F.lit(src).alias("src"), "valid", "n"))
    return union(*out)


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def key_histogram(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


PROFILED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic", "pages": "page_id url html"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS src, '{c}' AS path, count({c}) AS present, count(*) AS total FROM {t}" for t, cs in PROFILED.items() for c in cs.split()))
def field_presence(spark, sf):
    return union(*(facts.presence(lines_of_frame(table(spark, sf, t))).select(F.lit(t).alias("src"), "path", "present", "total") for t in PROFILED))


_KINDS = [("doc_id", "number"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "number")]


@query("SELECT '' AS path, 'object' AS kind, count(*) AS n FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', '{k}', count({c}) FROM documents HAVING count({c}) > 0" for c, k in _KINDS))
def field_kinds(spark, sf):
    return facts.profile(lines_of_frame(table(spark, sf, "documents")))


@query("SELECT vec_id, len(embedding) AS items, CAST(count(DISTINCT 1) AS BIGINT) AS kinds FROM embeddings GROUP BY ALL")
def array_items(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("j"))
    facts.register(spark)
    rows.createOrReplaceTempView("_typeloom_arrays")
    return spark.sql("SELECT vec_id, count(*) AS items, count(DISTINCT kind) AS kinds FROM _typeloom_arrays, LATERAL json_paths(j) p WHERE p.path = '[]' GROUP BY vec_id")


# ---------------------------------------------------------------- formats


@query(" UNION ALL ".join(f"SELECT '{label}' AS col, {_sql_common('c')} AS fmt FROM (SELECT {e} AS c FROM {t})" for label, t, _, e in TEXTS))
def alias_column(spark, sf):
    return union(*(df.agg(formats.common_format_agg(F.col("c")).alias("fmt")).select(F.lit(label).alias("col"), "fmt") for label, df in _texts(spark, sf)))


@query(" UNION ALL ".join(f"SELECT '{label}' AS col, {_sql_first('c')} AS fmt, count(*) AS n FROM (SELECT {e} AS c FROM {t}) WHERE c IS NOT NULL GROUP BY 2" for label, t, _, e in TEXTS))
def alias_histogram(spark, sf):
    return union(*(df.where("c IS NOT NULL").groupBy(formats.format_of(F.col("c")).alias("fmt")).agg(F.count("*").alias("n")).select(F.lit(label).alias("col"), "fmt", "n") for label, df in _texts(spark, sf)))


_ID64 = "to_base64(encode(event_type || '/number/' || event_id))"


@query(f"SELECT event_type, bool_and({_sql_test('Base64', 'c')}) AS fits, bool_or(ends_with(c, chr(61))) AS evidence FROM (SELECT event_type, {_ID64} AS c FROM events) GROUP BY event_type")
def alias_evidence(spark, sf):
    base64 = FORMATS[-1]
    rows = table(spark, sf, "events").select("event_type", F.base64(F.concat("event_type", F.lit("/number/"), F.col("event_id").cast("string")).cast("binary")).alias("c"))
    return rows.groupBy("event_type").agg(F.bool_and(base64.column(F.col("c"))).alias("fits"), F.bool_or(base64.evidence_column(F.col("c"))).alias("evidence"))


@query(" UNION ALL ".join(f"SELECT '{label}' AS col, CAST(min(length(c)) AS BIGINT) AS shortest, min(length(c)) > 50 AS blob FROM (SELECT {e} AS c FROM {t})" for label, t, _, e in TEXTS))
def blob_minlen(spark, sf):
    shortest = F.min(F.length("c"))
    return union(*(df.agg(shortest.cast("long").alias("shortest"), (shortest > formats.BLOB_OVER).alias("blob")).select(F.lit(label).alias("col"), "shortest", "blob") for label, df in _texts(spark, sf)))


@query("SELECT src, contains(c, '/') OR contains(c, chr(92)) OR starts_with(c, '~') AS path_like, count(*) AS n FROM (SELECT 'url' AS src, url AS c FROM pages UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'type', p_type FROM part) GROUP BY 1, 2")
def path_keys(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(src).alias("src"), F.col(c).alias("c")) for src, t, c in (("url", "pages", "url"), ("name", "customer", "c_name"), ("type", "part", "p_type"))]
    return union(*parts).groupBy("src", formats.path_key_column(F.col("c")).alias("path_like")).agg(F.count("*").alias("n"))


MODELS = ["gpt-4.1", "GPT-4o", "glm-4.7", "o3", "o-3", "claude", "claude-3.5-sonnet", "llama.2", "gemini-pro", "mistral-7b", "x/gpt-4", "qwen-2", "grok-", "kimi.k2", "deepseek-v3:latest"]
_FAMILY = "|".join(formats.MODEL_FAMILIES)


@query(f"SELECT s, regexp_full_match(s, '[A-Za-z0-9][A-Za-z0-9._:-]*') AND regexp_matches(s, '(?i)^({_FAMILY})($|[-.])') AND regexp_matches(s, '[0-9]') AS model_id FROM (VALUES {', '.join(f"('{m}')" for m in MODELS)}) t(s)")
def model_alias(spark, sf):
    return spark.createDataFrame([(m,) for m in MODELS], "s string").select("s", formats.model_id_column(F.col("s")).alias("model_id"))


# ---------------------------------------------------------------- tags and literals


@query("SELECT string_agg(DISTINCT role, ',' ORDER BY role) AS literals, count(DISTINCT role) AS n FROM conversations")
def tag_literals(spark, sf):
    return table(spark, sf, "conversations").agg(facts.literal_set(F.col("role")).alias("literals"), F.count_distinct("role").alias("n"))


_CAPPED = [("part", "p_type"), ("part", "p_brand"), ("part", "p_name"), ("customer", "c_name"), ("orders", "o_orderpriority")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n, CASE WHEN count(DISTINCT {c}) <= 64 THEN string_agg(DISTINCT {c}, ',' ORDER BY {c}) END AS literals FROM {t}" for t, c in _CAPPED))
def tag_literal_cap(spark, sf):
    return union(*(table(spark, sf, t).agg(F.count_distinct(c).alias("n"), facts.literal_set(F.col(c)).alias("literals")).select(F.lit(c).alias("col"), "n", "literals") for t, c in _CAPPED))


@query("WITH s AS (SELECT turn, list(DISTINCT role) AS roles FROM conversations GROUP BY turn) SELECT a.turn AS a, b.turn AS b, list_has_any(a.roles, b.roles) AS compatible FROM s a JOIN s b ON a.turn < b.turn")
def tag_overlap(spark, sf):
    s = table(spark, sf, "conversations").groupBy("turn").agg(F.collect_set("role").alias("roles"))
    a, b = s.select(F.col("turn").alias("a"), F.col("roles").alias("ra")), s.select(F.col("turn").alias("b"), F.col("roles").alias("rb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.arrays_overlap("ra", "rb").alias("compatible"))


# ---------------------------------------------------------------- key sets

#: Keys of the tables' rows without their prefixes: a small fixed list.
KEY_SETS = {
    "region": ["name", "regionkey"], "nation": ["name", "nationkey", "regionkey"], "customer": ["acctbal", "custkey", "mktsegment", "name", "nationkey"],
    "supplier": ["acctbal", "name", "nationkey", "suppkey"], "part": ["brand", "name", "partkey", "retailprice", "size", "type"],
    "orders": ["custkey", "orderdate", "orderkey", "orderpriority", "orderstatus", "totalprice"], "documents": ["doc_id", "lang", "n_chars", "source", "text"],
    "labels": ["doc_id", "quality", "toxic"], "twins": ["doc_id", "quality", "toxic"], "pages": ["html", "page_id", "url"], "benchmark": ["item_id", "text"],
}
_SETS = "(VALUES " + ", ".join(f"('{t}', {ks!r})" for t, ks in KEY_SETS.items()) + ") s(t, ks)"
_PAIRS = f"s AS (SELECT * FROM {_SETS}), p AS (SELECT a.t AS a, b.t AS b, a.ks AS ka, b.ks AS kb FROM s a JOIN s b ON a.t < b.t)"


def _pairs(spark, **conditions: str) -> DataFrame:
    """For each pair of tables whether their rows, as objects, meet each condition."""
    from typeloom.plans.fold import Folder
    from typeloom.plans.policy import Conditions

    folder = Folder()
    tests = [Conditions(folder.context).test(words) for words in conditions.values()]
    shapes = {t: folder.of(dict.fromkeys(ks, 1)) for t, ks in KEY_SETS.items()}
    found = [(a, b, *(bool(test(shapes[a], shapes[b])) for test in tests)) for a in shapes for b in shapes if a < b]
    return spark.createDataFrame(found, "a string, b string, " + ", ".join(f"{c} boolean" for c in conditions))


@query(f"WITH {_PAIRS} SELECT a, b, CASE WHEN len(ka) <= len(kb) THEN list_has_all(kb, ka) ELSE list_has_all(ka, kb) END AS subset FROM p")
def subset_keys(spark, sf):
    return _pairs(spark, subset="subset-keys")


@query(f"WITH {_PAIRS} SELECT a, b, len(ka) = len(kb) AND list_has_all(kb, ka) AS same FROM p")
def same_keys(spark, sf):
    return _pairs(spark, same="same-keys")


@query(f"WITH {_PAIRS} SELECT a, b, len(list_intersect(ka, kb)) >= 1 AS min1, len(list_intersect(ka, kb)) >= 2 AS min2, len(list_intersect(ka, kb)) >= 3 AS min3 FROM p")
def overlap_min(spark, sf):
    return _pairs(spark, min1="overlap-min 1", min2="overlap-min 2", min3="overlap-min 3")


@query(f"WITH {_PAIRS} SELECT a, b, len(ka) < 5 AND len(kb) < 5 AS both_under_5, len(ka) > 3 AND len(kb) > 3 AS both_over_3, NOT list_contains(ka, 'type') AND NOT list_contains(kb, 'type') AS untagged FROM p")
def key_size_gates(spark, sf):
    return _pairs(spark, both_under_5="keys-lt 5", both_over_3="keys-gt 3", untagged="no-tag")


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p WHERE list_has_any(ka, kb) UNION SELECT b, a FROM p WHERE list_has_any(ka, kb) UNION SELECT t, t FROM s), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS t, min(b) AS component FROM r GROUP BY a")
def shared_key_components(spark, sf):
    from typeloom.plans.unite import linked_groups

    names = list(KEY_SETS)
    groups = linked_groups(len(names), lambda i, j: bool(set(KEY_SETS[names[i]]) & set(KEY_SETS[names[j]])))
    return spark.createDataFrame([(names[i], min(names[j] for j in g)) for g in groups for i in g], "t string, component string")




# ---------------------------------------------------------------- rewrites, as relations


@query("WITH m AS (SELECT o_orderstatus AS s, min(o_orderkey) AS canon FROM orders GROUP BY 1) SELECT o.o_orderstatus AS s, coalesce(m.canon, o.o_orderkey) AS canon, count(*) AS n FROM orders o LEFT JOIN m ON o.o_orderstatus = m.s AND m.s <> 'F' GROUP BY 1, 2")
def canonical_rewrite(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    canon = orders.groupBy("s").agg(F.min("o_orderkey").alias("c")).where("s != 'F'")
    return orders.join(canon, "s", "left").groupBy("s", F.coalesce("c", "o_orderkey").alias("canon")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS most, arg_min(p_partkey, (length(p_name), p_name, p_partkey)) AS shortest FROM part GROUP BY p_brand")
def canon_pick(spark, sf):
    most = F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey")))
    return table(spark, sf, "part").groupBy("p_brand").agg(most.alias("most"), F.min_by("p_partkey", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("shortest"))




# ---------------------------------------------------------------- patch logs


def _patches(spark, sf):
    """Conversations as patch logs: turn 0 sets the state, later turns append to its messages."""
    c = table(spark, sf, "conversations")
    message = F.struct("role", "text")
    first = F.to_json(F.struct(F.lit(0).alias("kind"), F.struct(F.array(message).alias("messages")).alias("v")))
    later = F.to_json(F.struct(F.lit(2).alias("kind"), F.array(F.lit("messages")).alias("k"), message.alias("v")))
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.when(F.col("turn") == 0, first).otherwise(later).alias("line"))


@query("SELECT conv_id AS file_ord FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 20 GROUP BY conv_id HAVING count(*) >= 2 AND bool_or(turn = 0)")
def patch_detect(spark, sf):
    lines = _patches(spark, sf).select(F.col("file").cast("int").alias("file_ord"), F.lit(0).cast("long").alias("block"), F.col("ord").alias("id"), "line")
    return patch_files(lines).select(F.col("file_ord").cast("long").alias("file_ord"))


@query("SELECT conv_id AS file, count(*) AS messages, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1")
def patch_replay_append(spark, sf):
    states = facts.replay(_patches(spark, sf))
    m = F.from_json("state", "messages array<struct<role string, text string>>")["messages"]
    return states.select("file", F.size(m).cast("long").alias("messages"), F.element_at(m, -1)["text"].alias("last_text"))


@query("SELECT user_id AS file, event_type, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1, 2")
def patch_replay_set(spark, sf):
    e = table(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    put = F.to_json(F.struct(F.lit(1).alias("kind"), F.array("event_type").alias("k"), F.col("event_id").alias("v")))
    lines = e.select(F.col("user_id").alias("file"), F.col("r").alias("ord"), put.alias("line"))
    states = facts.replay(lines)
    return states.select("file", F.explode(F.from_json("state", "map<string, bigint>")).alias("event_type", "last"))


@query("SELECT path, kind, n FROM (SELECT 'messages[].role' AS path, 'string' AS kind, count(*) AS n FROM conversations UNION ALL SELECT 'messages[].text', 'string', count(*) FROM conversations)")
def patch_observed(spark, sf):
    states = facts.replay(_patches(spark, sf)).select(F.col("state").alias("line"))
    return facts.profile(states).where("path LIKE 'messages[].%'")


# ---------------------------------------------------------------- checks

_TURN = "export type Turn = {\n  conv_id: number;\n  role: \"assistant\" | \"user\";\n  text: string;\n  turn: number;\n};\n"
_UNION = "export type A = { role: \"assistant\"; text: string };\nexport type U = { role: \"user\"; text: string; turn: number };\nexport type S = { role: \"system\"; nothing: string };\nexport type Turn = A | U | S;\n"


def _check(spark, sf, name: str, schema: str, columns: list[str] | None = None) -> Checked:
    df = table(spark, sf, name)
    return check_lines(lines_of_frame(df.select(*columns) if columns else df), root_of(schema)[1], adapters=())


@query("SELECT count(*) AS total, count(*) FILTER (WHERE role NOT IN ('assistant', 'user')) AS failed FROM conversations")
def check_totals(spark, sf):
    return _check(spark, sf, "conversations", _TURN).totals().select("total", "failed")


@query("SELECT 'object' AS label, count(*) AS n FROM conversations UNION ALL SELECT 'number', count(*) + count(*) FILTER (WHERE role IN ('assistant', 'user')) FROM conversations UNION ALL SELECT '\"' || role || '\"', count(*) FROM conversations WHERE role IN ('assistant', 'user') GROUP BY 1 UNION ALL SELECT 'string', count(*) FROM conversations WHERE role IN ('assistant', 'user')")
def check_type_stats(spark, sf):
    return _check(spark, sf, "conversations", _TURN).types()


@query("WITH ok AS (SELECT role IN ('assistant', 'user') AS good FROM conversations) SELECT 'conv_id' AS path, count(*) AS n, 'number' AS types FROM ok UNION ALL SELECT 'role', count(*), 'string' FROM ok UNION ALL SELECT 'text', count(*), 'string' FROM ok WHERE good UNION ALL SELECT 'turn', count(*), 'number' FROM ok WHERE good")
def check_field_stats(spark, sf):
    return _check(spark, sf, "conversations", _TURN).fields().select("path", "n", F.array_join("types", ",").alias("types"))


@query("SELECT 'missing required field \"title\"' AS reason, count(*) AS n FROM documents HAVING count(*) > 0")
def check_missing(spark, sf):
    found = _check(spark, sf, "documents", "export type D = { title: string; doc_id: number };", ["doc_id", "lang"])
    return found.totals().agg(F.sum("failed").alias("n")).where("n > 0").select(F.lit('missing required field "title"').alias("reason"), "n")


@query("SELECT path, n FROM (SELECT 'lang (extra)' AS path, count(lang) AS n FROM documents UNION ALL SELECT 'source (extra)', count(source) FROM documents) WHERE n > 0")
def check_extra(spark, sf):
    found = _check(spark, sf, "documents", "export type D = { doc_id: number };", ["doc_id", "lang", "source"])
    return found.fields().where("path LIKE '% (extra)'").select("path", "n")


@query("SELECT role, count(*) AS n, count(*) FILTER (WHERE role = 'system') AS failed FROM conversations GROUP BY role")
def check_union_dispatch(spark, sf):
    lines = lines_of_frame(table(spark, sf, "conversations"))
    role = F.get_json_object("line", "$.role")
    roles = lines.select(role.alias("role"), "id", "block", "line")
    numbered = roles.select(F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2).alias("file_ord"), "block", "id", "line")
    totals = check_lines(numbered, root_of(_UNION)[1], adapters=()).totals()
    name = F.element_at(F.array(F.lit("assistant"), F.lit("system"), F.lit("user")), F.col("file_ord") + 1)
    return totals.select(name.alias("role"), F.col("total").alias("n"), "failed")


_BEST = "export type X = { doc_id: number; page: string };\nexport type Y = { doc_id: number; lang: number; source: string };\nexport type R = X | Y;\n"


@query("SELECT 'no union variant matched (2 tries): lang: expected number, got string' AS reason, count(*) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 20)")
def check_best_variant(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return check_lines(lines_of_frame(df), root_of(_BEST)[1], adapters=()).failures().groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT r - 1 AS place, turn FROM (SELECT turn, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'system') WHERE r <= 20")
def check_failures_topk(spark, sf):
    c = table(spark, sf, "conversations")
    lines = c.select(F.lit(0).alias("file_ord"), F.col("conv_id").alias("block"), F.col("turn").alias("id"), F.to_json(F.struct("*")).alias("line"))
    found = check_lines(lines, root_of(_TURN)[1], adapters=()).failures()
    return found.select((F.row_number().over(Window.orderBy("block", "id")) - 1).cast("long").alias("place"), F.col("id").alias("turn"))


@query("SELECT coalesce(source, 'all') AS source, count(*) AS total, count(*) FILTER (WHERE lang <> 'en') AS failed FROM documents GROUP BY GROUPING SETS ((source), ())")
def check_report_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    names = d.select("source").distinct().withColumn("file_ord", F.dense_rank().over(Window.orderBy("source")).cast("int"))
    lines = d.join(F.broadcast(names), "source").select("file_ord", F.lit(0).cast("long").alias("block"), F.col("doc_id").alias("id"), F.to_json(F.struct("doc_id", "lang")).alias("line"))
    totals = check_lines(lines, root_of('export type D = { doc_id: number; lang: "en" };')[1], adapters=()).totals().join(F.broadcast(names), "file_ord")
    per = totals.select("source", "total", "failed")
    return per.unionByName(per.agg(F.sum("total").alias("total"), F.sum("failed").alias("failed")).withColumn("source", F.lit("all")))


# ---------------------------------------------------------------- names

_SQL_PASCAL = "CASE WHEN len([x FOR x IN string_split_regex(c, '[^A-Za-z0-9]+') IF x <> '']) = 0 THEN 'Variant' ELSE array_to_string([upper(x[1]) || x[2:] FOR x IN string_split_regex(c, '[^A-Za-z0-9]+') IF x <> ''], '') END"


@query(f"SELECT c, {_SQL_PASCAL} AS name FROM (SELECT DISTINCT p_type AS c FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT '--')")
def pascal_names(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_type").alias("c")).union(table(spark, sf, "orders").select("o_orderpriority")).union(spark.sql("SELECT '--'")).distinct()
    return c.select("c", naming.pascal_column(F.col("c")).alias("name"))


@query("SELECT c, regexp_full_match(c, '[A-Za-z_$][A-Za-z0-9_$]*') AS safe FROM (SELECT DISTINCT p_type AS c FROM part UNION SELECT p_brand FROM part UNION SELECT event_type FROM events)")
def safe_ident(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_type").alias("c")).union(table(spark, sf, "part").select("p_brand")).union(table(spark, sf, "events").select("event_type")).distinct()
    return c.select("c", naming.identifier_column(F.col("c")).alias("safe"))


@query(f"SELECT c AS tag, {_SQL_PASCAL} || '_' || substr(sha256('Events_' || c), 1, 8) AS name FROM (SELECT DISTINCT event_type AS c FROM events)")
def variant_names(spark, sf):
    place = naming.Place("Events")
    c = table(spark, sf, "events").select(F.col("event_type").alias("c")).distinct()
    mark = naming.short_hash_column(F.concat(F.lit(place.chain + "_"), F.col("c")))
    return c.select(F.col("c").alias("tag"), F.concat(naming.pascal_column(F.col("c")), F.lit("_"), mark).alias("name"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations")
def ordinal_order(spark, sf):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", r.alias("ordinal"))


# ---------------------------------------------------------------- documents


@query("SELECT * FROM (VALUES (0, 'A', 'Shape'), (1, 'U', 'Shape'), (2, 'S', 'Shape'), (3, 'Turn', 'Choice')) t(ord, name, kind)")
def parse_dts_decls(spark, sf):
    return spark.createDataFrame([(i, n, type(node).__name__) for i, (n, node) in enumerate(read(_UNION).items())], "ord int, name string, kind string")


# ---------------------------------------------------------------- the engine on records made of the tables

#: Queries that have their operator's name, and the case of engine.CASES that each runs.
_OF_CASE = {
    "tagged_union": "fold_tagged",
    "field_tag_bucket": "field_tag",
    "tag_hint_names": "tag_hints",
    "key_alias_record": "recordify_urls",
    "inline_hoist_lookup": "inline_unify",
    "structural_dedupe": "structural",
    "inline_equivalent": "inline_equal",
    "inline_samekeys": "inline_same_keys",
    "hoist_shared": "hoist_parameters",
    "plugin_names": "plugin_mids",
    "unique_names": "untagged_variants",
    "decl_dedupe": "names_twice",
    "reachability": "auto_recursive",
}
_COMPUTED = {
    "fold_optional": engine.plain_sql("Order", "orders", [("customer", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END", "number"), ("id", "o_orderkey", "number"), ("price", "o_totalprice", "number")], _sql_common),
    "fold_tagged": engine.tagged_sql("Event", "(SELECT event_type AS type, event_id, CASE WHEN event_type = 'click' THEN value END AS value FROM events)", "type", [("id", "event_id", "number"), ("value", "value", "number")], _sql_common, "type"),
    "user_tag": engine.tagged_sql("Told", "(SELECT event_type AS kind, event_id FROM events)", "kind", [("id", "event_id", "number")], _sql_common, "kind"),
}


def _add_case(name: str, case: str) -> None:
    QUERIES[name] = lambda spark, sf: engine.declared(spark, sf, case)
    SQL[name] = _COMPUTED.get(case) or engine.expected_sql(case)


for _name, _case in _OF_CASE.items():
    _add_case(_name, _case)
for _case in engine.CASES:
    if _case not in _OF_CASE.values():
        _add_case(_case, _case)

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"
_INNER = "{' || chr(10) || '    k: number;' || chr(10) || '  }"


@query(engine.tagged_sql("Event", f"(SELECT *, event_type AS event, {_ISO.format('ts')} AS shown FROM events)", "event", [("event_id", "event_id", "number"), ("user_id", "user_id", "number"), ("value", "value", "number"), ("ts", "shown", "text"), ("props", "props", _INNER)], _sql_common, "event_id"))
def infer_dts(spark, sf):
    """Declarations of the events, re-keyed so that their type is a tag."""
    e = table(spark, sf, "events").orderBy("event_id").select(F.col("event_type").alias("event"), "event_id", "user_id", "value", "ts", F.from_json("props", "k bigint").alias("props"))
    return engine.rows(spark, infer_frame(e, Options(root_name="Event")))


@query(engine.tagged_sql("Turn", "conversations", "role", [("conv_id", "conv_id", "number"), ("text", "text", "text"), ("turn", "turn", "number")], _sql_common, "conv_id * 1000000 + turn"))
def infer_conversations(spark, sf):
    return engine.rows(spark, infer_frame(table(spark, sf, "conversations").orderBy("conv_id", "turn"), Options(root_name="Turn")))


_LINE_ITEM = [(c, c, "number") for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()]
_LINE_ITEM += [("l_returnflag", "l_returnflag", "text"), ("l_linestatus", "l_linestatus", "text"), ("l_shipdate", _ISO.format("l_shipdate"), "text")]


@query(engine.plain_sql("LineItem", "lineitem", _LINE_ITEM, _sql_common))
def infer_lineitem(spark, sf):
    return engine.rows(spark, infer_frame(table(spark, sf, "lineitem"), Options(root_name="LineItem")))


@query(engine.plain_sql("Document", "documents", [("doc_id", "doc_id", "number"), ("n_chars", "n_chars", "number"), ("text", "text", "text"), ("lang", "lang", "text"), ("source", "source", "text")], _sql_common))
def infer_documents(spark, sf):
    return engine.rows(spark, infer_frame(table(spark, sf, "documents"), Options(root_name="Document")))


@query("SELECT * FROM (VALUES (0, 'Both', '{' || chr(10) || '  k: number;' || chr(10) || '  name: string;' || chr(10) || '  zone?: number;' || chr(10) || '}', '')) t(ord, name, body, docs)")
def file_union(spark, sf):
    """Files of regions, nations and regions again, folded one by one and joined."""

    def side(i: int, t: str, p: str, *more) -> DataFrame:
        line = F.to_json(F.struct(F.col(f"{p}_{t}key").alias("k"), F.col(f"{p}_name").alias("name"), *more)).alias("line")
        return table(spark, sf, t).select(F.lit(i).alias("file_ord"), F.lit(0).cast("long").alias("block"), F.col(f"{p}_{t}key").cast("long").alias("id"), line)

    lines = union(side(0, "region", "r"), side(1, "nation", "n", F.col("n_regionkey").alias("zone")), side(2, "region", "r"))
    return engine.rows(spark, infer_lines(lines, Options(root_name="Both"))[0])


@query("SELECT * FROM (VALUES (0, 'State', '{' || chr(10) || '  count: number;' || chr(10) || '  rows: number[];' || chr(10) || '  title: string;' || chr(10) || '}', '')) t(ord, name, body, docs)")
def patch_types(spark, sf):
    """Logs of one state for each customer: set, appended to, and set below; their types by path."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("file_ord"), F.lit(0).cast("long").alias("block"), "c_name", "c_nationkey")
    steps = [
        F.struct(F.lit(0).alias("kind"), F.struct(F.lit(0).alias("count"), F.array().cast("array<int>").alias("rows")).alias("v")),
        F.struct(F.lit(1).alias("kind"), F.array(F.lit("title")).alias("k"), F.col("c_name").alias("v")),
        F.struct(F.lit(2).alias("kind"), F.array(F.lit("rows")).alias("k"), F.col("c_nationkey").alias("v")),
        F.struct(F.lit(1).alias("kind"), F.array(F.lit("count")).alias("k"), F.lit(1).alias("v")),
    ]
    lines = c.select("file_ord", "block", F.posexplode(F.array(*map(F.to_json, steps))).alias("id", "line")).withColumn("id", F.col("id").cast("long"))
    return engine.rows(spark, infer_lines(lines, Options(root_name="State"))[0])


_SIMPLIFIED = [
    ("Assistant", '{\n  role: "assistant";\n  text: string;\n}', "assistant"),
    ("User", '{\n  role: "user";\n  text: string;\n  turn: number;\n}', "user"),
    ("System", '{\n  nothing: string;\n  role: "system";\n}', "system"),
]


def _simplified_sql() -> str:
    mark = lambda name: f"'{name}_' || substr(sha256('Turn_{name.lower()}'), 1, 8)"
    lines = []
    for name, body, doc in _SIMPLIFIED:
        lines += [f"'/** {doc} */'", f"'export type ' || {mark(name)} || ' = {{'", *(f"'{x}'" for x in body.split("\n")[1:-1]), "'};'", "''"]
    lines.append("'export type Turn = ' || " + " || ' | ' || ".join(mark(n) for n, _, _ in _SIMPLIFIED) + " || ';'")
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(lines)) + ") t(ord, line)"


@query(_simplified_sql())
def simplify_dts(spark, sf):
    text = simplify_text(_UNION, Options(header=""))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "ord int, line string")


#: Phases of the first round and of those that follow until nothing changes.
_FIRST = "recordify hint-dedup auto-recursive field-tag tag-hints inline-unify inline-samekeys inline-equivalent structural-dedupe hoist-shared apply-plugins".split()
_AGAIN = "inline-unify inline-samekeys inline-equivalent structural-dedupe".split()


@query("SELECT * FROM (VALUES " + ", ".join(f"({r}, '{x}', 0, 0, false)" for r, phases in enumerate((_FIRST, _AGAIN)) for x in phases) + ") t(round, phase, rewrites, declared, new_root)")
def pipeline_trace(spark, sf):
    from typeloom.api import finish
    from typeloom.operators.infer import fold_stream
    from typeloom.plans.settings import settle

    settings = settle(Options(root_name="Turn"))
    done = finish(fold_stream(lines_of_frame(table(spark, sf, "conversations")), settings.context), settings)[1]
    return spark.createDataFrame([(t.round, t.phase, t.rewrites, t.declared, t.new_root) for t in done.trace], "round int, phase string, rewrites int, declared int, new_root boolean")


@query("SELECT kind, '[\"s\", [\"' || kind || '\"], null, null, null]' AS node FROM (VALUES ('string'), ('number'), ('boolean'), ('null')) t(kind)")
def shape_codec(spark, sf):
    """Types of scalars as they travel between tasks and driver."""
    return spark.createDataFrame([(k, encode(Scalar({k: None}))) for k in ("string", "number", "boolean", "null")], "kind string, node string")
