from tidesift.operators.verdict import cascade, exit_code, layers_run, selected_layers, verdicts, worst_label


def _found(spark, rows):
    return spark.createDataFrame(rows, "target string, layer string, severity string")


def test_truth_table(spark):
    rows = [("c", "L0", "CRITICAL"), ("c", "L1", "info"), ("h", "L2", "high"), ("m", "L3", "medium"), ("l", "L4", "low"), ("i", "L5", "info"), ("o", "L5", "odd"), (None, "L5", "high")]
    targets = spark.createDataFrame([(x,) for x in "chmlioz"], "target string")
    got = {r.target: (r.label, r.score, r.confidence, r.recommendation, r.findings_count) for r in verdicts(_found(spark, rows), targets).collect()}
    assert got == {
        "c": ("malicious", 0.98, "high", "do_not_install", 2),
        "h": ("malicious", 0.85, "high", "do_not_install", 1),
        "m": ("suspicious", 0.55, "medium", "review", 1),
        "l": ("suspicious", 0.25, "low", "review", 1),
        "i": ("suspicious", 0.25, "low", "review", 1),
        "o": ("suspicious", 0.25, "low", "review", 1),
        "z": ("clean", 0.0, "high", "install", 0),
    }


def test_cascade_stops_after_a_critical_layer(spark):
    rows = [("a", "L1", "high"), ("a", "L2", "critical"), ("a", "L2", "low"), ("a", "L3", "high"), ("b", "L5", "low"), (None, "L0", "critical"), (None, "L1", "low")]
    found = _found(spark, rows)
    got = sorted((r.target or "", r.layer, r.severity) for r in cascade(found).collect())
    assert got == [("", "L0", "critical"), ("a", "L1", "high"), ("a", "L2", "critical"), ("a", "L2", "low"), ("b", "L5", "low")]
    other = sorted((r.target or "", r.layer) for r in cascade(found, layers=("L3", "L2")).collect())
    assert other == [("a", "L2"), ("a", "L2"), ("a", "L3")]
    targets = spark.createDataFrame([("a",), ("b",)], "target string")
    run = {r.target: r.layers_run for r in layers_run(found, targets).collect()}
    assert run == {"a": ["L0", "L1", "L2"], "b": ["L0", "L1", "L2", "L3", "L4", "L5"]}


def test_selection_worst_and_exit(spark):
    assert selected_layers(" L2, L9,L0 ,L2") == ["L2", "L0", "L2"]
    judged = spark.createDataFrame([("a", "clean"), ("b", "suspicious"), ("c", "malicious")], "target string, label string")
    assert worst_label(judged).first().worst == "malicious"
    codes = judged.select(*[exit_code("label", x).alias(x) for x in ("none", "suspicious", "malicious")]).collect()
    assert [tuple(r) for r in codes] == [(0, 0, 0), (0, 1, 0), (0, 2, 2)]
    assert worst_label(judged.limit(0)).first().worst is None
