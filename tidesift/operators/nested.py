"""Nested workflow bodies as flat tables of nodes and values with parent and child links.

A body is walked level by level inside one row: a fold over its levels whose nested transforms attach to each child the
pointer of its node and of the node around that, flatten joins the children of a level, and one inline per target table
emits the rows. Nothing is shuffled, and each body takes as many levels as it is deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import spread

_ITEM = "struct<v:variant,m:map<string,variant>,a:array<variant>,k:string,own:boolean,node:string,parent:string,ptr:string>"
#: The tables' rows; what is read from a variant is left to the table that is taken, as most uses don't want it.
_VALUE = "struct<parent_ptr:string,node_ptr:string,value_ptr:string,v:variant>"
_NODE = "struct<parent_ptr:string,node_ptr:string,id:variant,type:variant>"

#: A variant with its fields if it is an object, and its elements if an array.
_OPEN = "{v} v, try_variant_get({v}, '$', 'map<string,variant>') m, try_variant_get({v}, '$', 'array<variant>') a"

#: The children of one item x, opened.
_CHILDREN = f"""
transform(
  if(x.m is not null,
     transform(map_entries(x.m), e -> named_struct('k', e.key, 'step', replace(replace(e.key, '~', '~0'), '/', '~1'),
                                                   'v', e.value)),
     transform(x.a, (v, i) -> named_struct('k', cast(null as string), 'step', cast(i as string), 'v', v))),
  c -> named_struct('k', c.k, 'step', c.step, 'o', struct({_OPEN.format(v="c.v")})))
"""

#: Whether a child is a node of its own.
_OWN = "c.o.m is not null and (x.a is not null and x.k <=> 'nodes' or _form = 'prompt' and x.node is null and x.ptr = '')"

_STEP = f"""
flatten(transform(filter(s.level, i -> i.m is not null or i.a is not null), x -> transform({_CHILDREN}, c ->
  if({_OWN},
     named_struct('v', c.o.v, 'm', c.o.m, 'a', c.o.a, 'k', c.k, 'own', true,
                  'node', concat(coalesce(x.node, ''), x.ptr, '/', c.step), 'parent', coalesce(x.node, ''), 'ptr', ''),
     named_struct('v', c.o.v, 'm', c.o.m, 'a', c.o.a, 'k', c.k, 'own', false, 'node', x.node, 'parent', x.parent,
                  'ptr', concat(x.ptr, '/', c.step))))))
"""


#: By table, the rows that a level adds to it
_ROWS = {
    "vals": (
        _VALUE,
        "transform(filter(s.level, i -> i.m is null and i.a is null and i.node is not null and not is_variant_null(i.v)), "
        "i -> named_struct('parent_ptr', i.parent, 'node_ptr', i.node, 'value_ptr', i.ptr, 'v', i.v))",
    ),
    "nodes": (
        _NODE,
        "transform(filter(s.level, i -> i.own), i -> named_struct('parent_ptr', i.parent, 'node_ptr', i.node, "
        "'id', i.m['id'], 'type', coalesce(i.m['class_type'], i.m['type'])))",
    ),
}


def _walk(tables: tuple[str, ...]) -> str:
    first = f"""cast(array(named_struct('v', cast(null as variant), 'm', _map, 'a', cast(null as array<variant>),
                 'k', cast(null as string), 'own', false, 'node', cast(null as string), 'parent', cast(null as string),
                 'ptr', '')) as array<{_ITEM}>)"""
    start = ", ".join([f"'level', {first}", *(f"'{t}', cast(array() as array<{_ROWS[t][0]}>)" for t in tables)])
    state = f"struct<{','.join([f'level:array<{_ITEM}>', *(f'{t}:array<{_ROWS[t][0]}>' for t in tables)])}>"
    step = ", ".join([f"'level', {_STEP}", *(f"'{t}', concat(s.{t}, {_ROWS[t][1]})" for t in tables)])
    # a step takes the rows of the level before it, so the last one only does that. Only the start is cast, and nothing is
    # bound to a name by a transform, as either would copy all rows once a level.
    return f"aggregate(sequence(0, _depth), cast(named_struct({start}) as {state}), (s, n) -> named_struct({step}))"


def parse_workflows(df: DataFrame, key: str = "workflow_id", body: str = "body") -> DataFrame:
    """key, the body as a map of variants and its form (`ui`, `prompt`), for each body that as a whole is valid JSON and
    a workflow: a root array `nodes`, or a non-empty map of objects that each have class_type. Others give no row.

    A repeated key inside an object counts with its last value. Objects nested over 1000 levels aren't parsed. Sets
    spark.sql.variant.allowDuplicateKeys in the session, without which such bodies would be no JSON.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # the parser ignores what follows the first value, so the body is followed by a mark which it must still reach
    mark = F.md5(F.col("_body"))
    held = F.try_parse_json(F.concat(F.lit("["), F.col("_body"), F.lit(',"'), mark, F.lit('"]')))
    bodies = spread(df.select(F.col(key).alias("_id"), F.col(body).alias("_body")).where(F.col(body).isNotNull()))
    parsed = _once(bodies.withColumn("_doc", held), "try_variant_get(_doc, '$', 'array<variant>') _both", "_id", "_body")
    whole = parsed.where((F.size("_both") == 2) & F.expr("try_variant_get(_both[1], '$', 'string') = md5(_body)"))
    mapped = _once(whole, "try_variant_get(_both[0], '$', 'map<string,variant>') _map", "_id", "_body").where("_map is not null")
    form = (
        "case when try_variant_get(_map['nodes'], '$', 'array<variant>') is not null then 'ui' "
        "when size(_map) > 0 and forall(map_values(_map), "
        "v -> coalesce(map_contains_key(try_variant_get(v, '$', 'map<string,variant>'), 'class_type'), false)) "
        "then 'prompt' end _form"
    )
    # strings and all but brackets are taken out, and the brackets counted
    depth = r"""aggregate(split(regexp_replace(_body, '(?s)"(?:[^"\\\\]|\\\\.)*+"|[^"\\[\\]{}]++', ''), ''),
        struct(0 d, 1 m), (s, c) -> struct(if(c in ('[', '{'), s.d + 1, s.d - 1) d,
        greatest(s.m, if(c in ('[', '{'), s.d + 1, s.d - 1)) m), s -> s.m) _depth"""
    return _once(mapped, form, "_id", "_map", "_body").where("_form is not null").select("_id", "_map", "_form", F.expr(depth))


def _once(df: DataFrame, expression: str, *keep: str) -> DataFrame:
    """Columns and an expression that is evaluated once a row, however often later steps use it: the result of a
    generator isn't written into the expressions after it."""
    return df.select(*keep, F.inline(F.expr(f"array(struct({expression}))")))


def flatten_workflows(
    df: DataFrame, key: str = "workflow_id", body: str = "body", tables: tuple[str, ...] = ("vals", "nodes")
) -> DataFrame:
    """key, form, vals and nodes: the result tables of each body as arrays. Take one with node_table or value_table; tables
    says which are wanted."""
    walked = _once(parse_workflows(df, key, body), f"{_walk(tables)} _flat", "_id", "_form")
    return walked.select(F.col("_id").alias(key), F.col("_form").alias("form"), *[f"_flat.{t}" for t in tables])


def value_table(flat: DataFrame, key: str = "workflow_id") -> DataFrame:
    """One row per non-null scalar inside a node: key, parent_ptr, node_ptr, value_ptr, value_type, value.

    Pointers are JSON Pointers; parent_ptr is '' for a node that no other encloses. Null and unparsable bodies give no
    row; bodies delivered twice give their rows under each key; columns of the input other than key don't appear.
    """
    rows = flat.select(key, F.inline("vals"))
    return rows.select(
        key, "parent_ptr", "node_ptr", "value_ptr", F.expr("schema_of_variant(v)").alias("value_type"),
        F.expr("try_variant_get(v, '$', 'string')").alias("value"),
    )


def node_table(flat: DataFrame, key: str = "workflow_id") -> DataFrame:
    """One row per node, also where it holds no scalar: key, parent_ptr, node_ptr, node_id, node_type."""
    rows = flat.select(key, F.inline("nodes"))
    text = "try_variant_get({}, '$', 'string')".format
    return rows.select(key, "parent_ptr", "node_ptr", F.expr(text("id")).alias("node_id"), F.expr(text("type")).alias("node_type"))
