import json

from tidesift.operators.nested import flatten_workflows, node_table, value_table

UI = {"nodes": [{"id": 1, "type": "A", "w": [1, None, {"nodes": [{"id": "x", "v": True}, 7]}], "a/b~c": "s"}, "loose"], "version": 0.4}
PROMPT = {"1": {"class_type": "K", "inputs": {"seed": 3, "deep": [[{"nodes": [{"q": []}, {"q": [{"r": "t"}]}]}]]}}}


def _values(o, ptr="", node=None, parent=None, key=None, prompt=False, root=False):
    """The rules, recursively."""
    steps = o.items() if isinstance(o, dict) else enumerate(o) if isinstance(o, list) else None
    if steps is None:
        if o is not None and node is not None:
            yield parent, node, ptr
        return
    for k, v in steps:
        at = f"{ptr}/{str(k).replace('~', '~0').replace('/', '~1')}"
        own = isinstance(v, dict) and (isinstance(o, list) and key == "nodes" or prompt and root)
        name = k if isinstance(o, dict) else None
        if own:
            yield from _values(v, "", (node or "") + at, node or "", name)
        else:
            yield from _values(v, at, node, parent, name, prompt)


def _run(spark, bodies):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(bodies)], "workflow_id bigint, body string, vals string, node_ptr string")
    flat = flatten_workflows(df)
    return (
        {(r.workflow_id, r.parent_ptr, r.node_ptr, r.value_ptr): r.value for r in value_table(flat).collect()},
        {(r.workflow_id, r.parent_ptr, r.node_ptr): (r.node_id, r.node_type) for r in node_table(flat).collect()},
    )


def test_both_forms_against_recursion(spark):
    values, nodes = _run(spark, [json.dumps(UI), json.dumps(PROMPT, indent=1)])
    expected = {(0, *v) for v in _values(UI)} | {(1, *v) for v in _values(PROMPT, prompt=True, root=True)}
    assert set(values) == expected
    assert values[0, "", "/nodes/0", "/a~1b~0c"] == "s"
    assert values[0, "/nodes/0", "/nodes/0/w/2/nodes/0", "/v"] == "true"
    assert nodes[0, "", "/nodes/0"] == ("1", "A")
    assert (1, "/1", "/1/inputs/deep/0/0/nodes/0") in nodes  # a node without any scalar


def test_what_is_no_workflow(spark):
    bodies = [None, "", "{", '{"nodes": []} x', '{"nodes": []}]', "[1]", '{"a": {"b": 1}}', "{}", '{"nodes": [{"a": NaN}]}', '{"nodes": [{"a": 1},]}']
    assert _run(spark, bodies) == ({}, {})


def test_repeated_keys_deep_and_long_bodies(spark):
    deep = "[" * 300 + "1" + "]" * 300
    bodies = ['{"nodes": [{"a": 1, "a": 2}]}', f'{{"nodes": [{{"a": {deep}, "b": "{"y" * 200_000}"}}]}}']
    values, _ = _run(spark, bodies)
    assert values[0, "", "/nodes/0", "/a"] == "2"
    assert values[1, "", "/nodes/0", "/a" + "/0" * 300] == "1"
    assert len(values[1, "", "/nodes/0", "/b"]) == 200_000


def test_empty_table(spark):
    flat = flatten_workflows(spark.createDataFrame([], "workflow_id bigint, body string"))
    assert value_table(flat).count() == node_table(flat).count() == 0
