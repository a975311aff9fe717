"""Queries that run inference, the passes and printing on records made of the driver's tables.

Each case is a frame of records, options, and the declarations that the rules give, written
as SQL; parts that follow from the data (literals, formats, optional marks, hashes) are
computed there. Declarations are rows of ord, name, body, docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators.infer import DECLARATIONS, infer_frame, infer_lines
from typeloom.plans.emit import Document
from typeloom.plans.settings import Options

#: name: (tables, SQL of the records in their order, options).
CASES: dict[str, tuple[str, str, dict]] = {
    "fold_optional": ("orders", "SELECT if(o_orderstatus = 'F', o_custkey, null) AS customer, o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderkey", {"root_name": "Order"}),
    "fold_tagged": ("events", "SELECT event_type AS type, event_id AS id, if(event_type = 'click', value, null) AS value FROM events ORDER BY event_type, event_id", {"root_name": "Event"}),
    "fold_list": ("orders", "SELECT o_orderkey AS id, array(named_struct('type', 'half', 'low', cast(null as bigint), 'at', o_totalprice), named_struct('type', 'whole', 'low', o_custkey, 'at', cast(null as double))) AS parts FROM orders ORDER BY o_orderkey", {"root_name": "Cart"}),
    "fold_scalars": ("nation", "SELECT n_nationkey % 2 = 0 AS even, array(n_nationkey, null) AS keys, array() AS none, n_name AS name FROM nation ORDER BY n_nationkey", {"root_name": "Nation"}),
    "recordify_urls": ("nation", "SELECT map(concat('https://example.org/', n_name), named_struct('page', n_nationkey)) AS by_url FROM nation ORDER BY n_nationkey", {"root_name": "Site"}),
    "recordify_hint": ("part", "SELECT map(replace(p_brand, '#', ''), p_size) AS stock, p_partkey AS id FROM part ORDER BY p_partkey", {"root_name": "Part", "record_hints": ("stock",)}),
    "hint_dedup": ("supplier", "SELECT named_struct('items', array(named_struct('type', 'x', 'a', s_suppkey, 'b', s_name), named_struct('type', 'y', 'a', s_suppkey, 'b', cast(null as string)))) AS left, named_struct('items', array(named_struct('type', 'x', 'a', s_suppkey, 'c', s_acctbal), named_struct('type', 'y', 'a', s_suppkey, 'c', cast(null as double)))) AS right FROM supplier ORDER BY s_suppkey", {"root_name": "Pair", "dedup_hints": (("", "Items_X"),)}),
    "auto_recursive": ("region nation", "SELECT named_struct('type', 'place', 'name', r_name, 'inside', collect_list(named_struct('type', 'place', 'name', n_name, 'inside', array(named_struct('type', 'end', 'key', n_nationkey))))) AS top FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name ORDER BY r_regionkey", {"root_name": "World"}),
    "field_tag": ("customer", "SELECT named_struct('item', named_struct('kind', 'person', 'name', c_name, 'key', c_custkey, 'nation', c_nationkey)) AS left, named_struct('item', named_struct('kind', 'person', 'name', c_name, 'key', c_custkey, 'balance', c_acctbal)) AS right FROM customer ORDER BY c_custkey", {"root_name": "Both"}),
    "tag_hints": ("events", "SELECT named_struct('event', 'seen', 'id', event_id) AS a, named_struct('event', 'seen', 'user', user_id) AS b FROM events ORDER BY event_id", {"root_name": "Hinted", "tag_hints": ("event",)}),
    "inline_unify": ("customer", "SELECT named_struct('list', array(named_struct('kind', 'x', 'a', c_custkey, 'b', c_name, 'c', 1), named_struct('kind', 'y', 'a', c_custkey, 'b', cast(null as string), 'c', cast(null as int)))) AS many, named_struct('kind', 'x', 'a', c_custkey, 'b', c_name, 'c', 2) AS one FROM customer ORDER BY c_custkey", {"root_name": "Uses"}),
    "inline_same_keys": ("part", "SELECT named_struct('brand', p_brand, 'key', p_partkey, 'price', p_retailprice, 'size', p_size) AS new, named_struct('brand', p_brand, 'key', p_partkey, 'price', p_retailprice, 'size', p_size) AS old FROM part ORDER BY p_partkey", {"root_name": "Change"}),
    "inline_equal": ("nation", "SELECT named_struct('at', named_struct('key', n_nationkey, 'name', n_name)) AS a, named_struct('at', named_struct('key', n_regionkey, 'name', n_name)) AS b FROM nation ORDER BY n_nationkey", {"root_name": "Twice"}),
    "hoist_parameters": ("nation", "SELECT named_struct('key', n_nationkey, 'name', n_name) AS a, named_struct('key', n_regionkey, 'name', n_name) AS b FROM nation ORDER BY n_nationkey", {"root_name": "Plain", "parameters": {"hoist-shared.min-keys": 3}}),
    "structural": ("supplier", "SELECT array(named_struct('type', 'dot', 'at', s_suppkey)) AS a, array(named_struct('type', 'dot', 'at', s_name)) AS b FROM supplier ORDER BY s_suppkey", {"root_name": "Dots"}),
    "plugin_mids": ("nation", "SELECT named_struct('$mid', 1, 'path', concat('/', n_name)) AS v FROM nation ORDER BY n_nationkey", {"root_name": "Mids"}),
    "untagged_variants": ("orders", "SELECT if(o_orderkey % 2 = 0, o_totalprice, null) AS price, if(o_orderkey % 2 = 1, o_orderstatus, null) AS status FROM orders ORDER BY o_orderkey", {"root_name": "Split"}),
    "user_tag": ("events", "SELECT event_type AS kind, event_id AS id FROM events ORDER BY event_type, event_id", {"root_name": "Told", "user_tag": "kind"}),
    "names_twice": ("nation", "SELECT array(named_struct('type', 'a-b', 'x', n_nationkey), named_struct('type', 'a b', 'x', n_regionkey)) AS v FROM nation ORDER BY n_nationkey", {"root_name": "Clash"}),
    "quoted_names": ("region", "SELECT r_name AS `a-b`, r_regionkey AS `1st`, map('x y', r_regionkey) AS ok FROM region ORDER BY r_regionkey", {"root_name": "Odd"}),
}


def records(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables, sql, _ = CASES[name]
    for t in tables.split():
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(f"typeloom_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM typeloom_{t}").replace(f"JOIN {t}", f"JOIN typeloom_{t}")
    return spark.sql(sql)


def rows(spark: SparkSession, doc: Document) -> DataFrame:
    return spark.createDataFrame(doc.rows(), DECLARATIONS).select("ord", "name", "body", F.array_join("docs", "; ").alias("docs"))


def declared(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return rows(spark, infer_frame(records(spark, sf, name), Options(**CASES[name][2])))


#: The declarations that the rules give for each case: (name, body, docs), in their order.
EXPECTED: dict[str, list[tuple[str, str, str]]] = {
    "fold_list": [
        ("Parts_Half_b470677d", '{\n  at: number;\n  type: "half";\n}', "parts[] -> half"),
        ("Parts_Whole_79ba0719", '{\n  low: number;\n  type: "whole";\n}', "parts[] -> whole"),
        ("Cart", "{\n  id: number;\n  parts: Array<Parts_Half_b470677d | Parts_Whole_79ba0719>;\n}", ""),
    ],
    "fold_scalars": [
        ("Nation", "{\n  even: boolean;\n  keys: Array<number | null>;\n  name: string;\n  none: never[];\n}", ""),
    ],
    "recordify_urls": [
        ("Url", "string", ""),
        ("Site", "{\n  by_url: Record<Url, {\n    page: number;\n  }>;\n}", ""),
    ],
    "recordify_hint": [
        ("Part", "{\n  id: number;\n  stock: Record<string, number>;\n}", ""),
    ],
    "hint_dedup": [
        ("Items_X_9708a11e", '{\n  a: number;\n  b?: string;\n  c?: number;\n  type: "x";\n}', "left.items[] -> x"),
        ("Items_Y_2187cfca", '{\n  a: number;\n  type: "y";\n}', "left.items[] -> y"),
        ("Pair", "{\n  left: {\n    items: Array<Items_X_9708a11e | Items_Y_2187cfca>;\n  };\n  right: {\n    items: Array<Items_X_9708a11e | Items_Y_2187cfca>;\n  };\n}", ""),
    ],
    "auto_recursive": [
        ("Top_Place_fe4da650", '{\n  inside: Top_Place_fe4da650[];\n  name: string;\n  type: "place";\n}', "top -> place"),
        ("World", "{\n  top: Top_Place_fe4da650;\n}", ""),
    ],
    "field_tag": [
        ("Both", '{\n  left: {\n    item: {\n      balance?: number;\n      key: number;\n      kind: "person";\n      name: string;\n      nation?: number;\n    };\n  };\n  right: {\n    item: {\n      balance?: number;\n      key: number;\n      kind: "person";\n      name: string;\n      nation?: number;\n    };\n  };\n}', ""),
    ],
    "tag_hints": [
        ("event_seen_8d907646", '{\n  event: "seen";\n  id?: number;\n  user?: number;\n}', "a -> Variant"),
        ("Hinted", "{\n  a: event_seen_8d907646;\n  b: event_seen_8d907646;\n}", ""),
    ],
    "inline_unify": [
        ("List_X_e68c286e", '{\n  a: number;\n  b: string;\n  c: number;\n  kind: "x";\n}', "many.list[] -> x"),
        ("List_Y_cbfc9d3b", '{\n  a: number;\n  kind: "y";\n}', "many.list[] -> y"),
        ("Uses", '{\n  many: {\n    list: Array<List_X_e68c286e | List_Y_cbfc9d3b>;\n  };\n  one: {\n    a: number;\n    b: string;\n    c: number;\n    kind: "x";\n  };\n}', ""),
    ],
    "inline_same_keys": [
        ("New_Type_60f57975", "{\n  brand: string;\n  key: number;\n  price: number;\n  size: number;\n}", "new -> Variant"),
        ("Change", "{\n  new: New_Type_60f57975;\n  old: New_Type_60f57975;\n}", ""),
    ],
    "inline_equal": [
        ("At_Type_26029c24", "{\n  key: number;\n  name: string;\n}", "a.at -> Variant"),
        ("Twice", "{\n  a: {\n    at: At_Type_26029c24;\n  };\n  b: {\n    at: At_Type_26029c24;\n  };\n}", ""),
    ],
    "hoist_parameters": [
        ("A_Type_26029c24", "{\n  key: number;\n  name: string;\n}", "a -> Variant"),
        ("Plain", "{\n  a: A_Type_26029c24;\n  b: A_Type_26029c24;\n}", ""),
    ],
    "structural": [
        ("A_Dot_22bcaa59", '{\n  at: string | number;\n  type: "dot";\n}', "a[] -> dot"),
        ("Dots", "{\n  a: A_Dot_22bcaa59[];\n  b: A_Dot_22bcaa59[];\n}", ""),
    ],
    "plugin_mids": [
        ("Path", "string", ""),
        ("VscodeUri", "{\n  $mid: 1;\n  path: Path;\n}", "v -> Variant"),
        ("Mids", "{\n  v: VscodeUri;\n}", ""),
    ],
    "untagged_variants": [
        ("Variant_83ece227", "{\n  price: number;\n}", "Variant"),
        ("Variant_83ece227_2", "{\n  status: string;\n}", "Variant"),
        ("Split", "Variant_83ece227 | Variant_83ece227_2", ""),
    ],
    "names_twice": [
        ("V_AB_8d68cf5c", '{\n  type: "a-b";\n  x: number;\n}', "v[] -> a-b"),
        ("V_AB_1e5aaf24", '{\n  type: "a b";\n  x: number;\n}', "v[] -> a b"),
        ("Clash", "{\n  v: Array<V_AB_8d68cf5c | V_AB_1e5aaf24>;\n}", ""),
    ],
    "quoted_names": [
        ("Odd", '{\n  "1st": number;\n  "a-b": string;\n  ok: {\n    "x y": number;\n  };\n}', ""),
    ],
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def expected_sql(name: str) -> str:
    """The expected rows of a case as VALUES."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, row))})" for i, row in enumerate(EXPECTED[name])) + ") t(ord, name, body, docs)"


# ---------------------------------------------------------------- SQL of declarations that follow from the data


def _field(name: str, kind: str, optional: str = "") -> str:
    """SQL of one property's line."""
    mark = f"CASE WHEN {optional} THEN '?' ELSE '' END" if optional else "''"
    return f"'  {name}' || {mark} || ': ' || {kind} || ';' || chr(10)"


def plain_sql(root: str, table: str, fields: list[tuple[str, str, str]], common) -> str:
    """One object type: fields are (name, column, kind), strings get their values' common format."""
    texts = [c for _, c, kind in fields if kind == "text"]
    kinds = ", ".join(f"{common(c)} AS k{i}" for i, c in enumerate(texts))
    lines = " || ".join(_field(n, f"k{texts.index(c)}" if kind == "text" else f"'{kind}'", f"opt_{i}") for i, (n, c, kind) in enumerate(sorted(fields)))
    flags = ", ".join(f"count({c}) < count(*) AS opt_{i}" for i, (_, c, _) in enumerate(sorted(fields)))
    formats = " UNION ".join(f"SELECT DISTINCT k{i} AS name FROM s WHERE k{i} <> 'string'" for i in range(len(texts)))
    return (
        f"WITH s AS (SELECT {flags}{', ' + kinds if kinds else ''} FROM {table}), f AS ({formats or 'SELECT NULL AS name WHERE false'}) "
        "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ord, name, 'string' AS body, '' AS docs FROM f "
        f"UNION ALL SELECT CAST((SELECT count(*) FROM f) AS INTEGER), '{root}', '{{' || chr(10) || {lines} || '}}', '' FROM s"
    )


def tagged_sql(root: str, source: str, tag: str, fields: list[tuple[str, str, str]], common, order: str) -> str:
    """One object type for each literal of the tag, in the order of first appearance, and their choice. A field without values is absent."""
    texts = [c for _, c, kind in fields if kind == "text"]
    pieces = []
    for n, c, kind in sorted([*fields, (tag, tag, "tag")]):
        told = f"'\"' || {tag} || '\"'" if kind == "tag" else f"k{texts.index(c)}" if kind == "text" else f"'{kind}'"
        pieces.append(f"CASE WHEN n_{n} = 0 THEN '' ELSE {_field(n, told, f'n_{n} < n')} END")
    counts = ", ".join(f"count({c}) AS n_{n}" for n, c, _ in [*fields, (tag, tag, "")])
    kinds = "".join(f", {common(c)} AS k{i}" for i, c in enumerate(texts))
    formats = " UNION ".join(f"SELECT DISTINCT k{i} AS name FROM s WHERE k{i} <> 'string'" for i in range(len(texts)))
    name = f"upper({tag}[1]) || {tag}[2:] || '_' || substr(sha256('{root}_' || {tag}), 1, 8)"
    return (
        f"WITH s AS (SELECT {tag}, count(*) AS n, min({order}) AS low, {counts}{kinds} FROM {source} GROUP BY {tag}), f AS ({formats or 'SELECT NULL AS name WHERE false'}), "
        f"d AS (SELECT row_number() OVER (ORDER BY low) AS r, {name} AS name, '{{' || chr(10) || {' || '.join(pieces)} || '}}' AS body, {tag} AS docs FROM s) "
        "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS ord, name, 'string' AS body, '' AS docs FROM f "
        "UNION ALL SELECT CAST((SELECT count(*) FROM f) + r - 1 AS INTEGER), name, body, docs FROM d "
        f"UNION ALL SELECT CAST((SELECT count(*) FROM f) + (SELECT count(*) FROM d) AS INTEGER), '{root}', string_agg(name, ' | ' ORDER BY r), '' FROM d"
    )
