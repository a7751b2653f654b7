from hypothesis import given, settings
from hypothesis import strategies as st

from tidesift.operators.rows import split_records

GOOD = 'a/b,requirements.txt,7,pkg[x,y],1.2rc1.post2.dev3+cu.12,2024-02-29'
CASES = {
    'a/b,req.txt,7,"pkg[x,y]",1.2rc1.post2.dev3+cu.12,2024-02-29': None,
    'a/b, "req.txt",7,pkg,,2024-01-01': "quoting",
    '"a ""b""/c","x\ny,z", 12 ,p,"",2024-01-01': None,
    'a/b,r.txt,"12"q,pkg,,2024-01-01': "quoting",
    'a/b,r.txt,12,pkg,,2024-01-01,': "columns",
    "": "columns",
    "a;b;c": "columns",
    'a/b,,12,pkg,,2024-01-01': "value",
    'a/b,r.txt,123456,pkg,,2024-01-01': "value",
    'a/b,r.txt,１,pkg,,2024-01-01': "value",
    'a/b,r.txt,1,_pkg,,2024-01-01': "value",
    'a/b,r.txt,1,pkg[],,2024-01-01': "value",
    'a/b,r.txt,1,p,1..2,2024-01-01': "value",
    'a/b,r.txt,1,p,1.0+CU,2024-01-01': "value",
    'a/b,r.txt,1,p,1,2023-02-29': "value",
    'a/b,r.txt,1,p,1,2023-2-9': "value",
    '"' + 'x""' * 20000 + '",r.txt,1,p,,2024-01-01': None,
    'a/b,r.txt,1,p,,2024-01-01"': "quoting",
}


def _reasons(spark, lines):
    raw = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string")
    done = split_records(raw)
    rejected = {r.raw_id: r.reason for r in done.rejected.collect()}
    assert {r.raw_id for r in done.sound.collect()} == set(range(len(lines))) - rejected.keys()
    return [rejected.get(i) for i in range(len(lines))]


def test_reasons(spark):
    assert _reasons(spark, list(CASES)) == list(CASES.values())


def test_typed_values_nulls_repeats_and_clashing_names(spark):
    line = '"a ""b""/c","x\ny,z", 12 ,p,"",2024-01-01'
    raw = spark.createDataFrame(
        [(1, line, "x", "y"), (1, line, "x", "y"), (2, None, None, None)],
        "raw_id bigint, raw_line string, errors string, _raw string",
    )
    done = split_records(raw)
    sound = done.sound.collect()
    assert len(sound) == 2
    first = sound[0].asDict()
    assert str(first.pop("declared_at")) == "2024-01-01"
    assert first == {"raw_id": 1, "target": 'a "b"/c', "source_file": "x\ny,z", "line": 12, "name": "p", "version": None}
    assert [(r.raw_id, r.errors, r.reason) for r in done.rejected.collect()] == [(2, ["columns"], "columns")]


def test_empty_table(spark):
    done = split_records(spark.createDataFrame([], "raw_id bigint, raw_line string"))
    assert done.sound.count() == done.rejected.count() == 0


def _fields(text):
    """A state machine beside the pattern."""
    out, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                j = text.find('"', i)
                if j < 0:
                    return None
                cell, i = cell + text[i:j], j + 1
                if text[i : i + 1] != '"':
                    break
                cell, i = cell + '"', i + 1
            if i < len(text) and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            j = len(text) if j < 0 else j
            cell, i = text[i:j].strip(" \t"), j
            if '"' in cell:
                return None
        out.append(cell)
        if i >= len(text):
            return out
        i += 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='ab," \n\t1', max_size=14), min_size=150, max_size=200))
def test_fields_against_a_state_machine(spark, lines):
    expected = []
    for x in lines:
        f = _fields(x)
        expected.append("quoting" if f is None else "columns" if len(f) != 6 else "value")
    assert _reasons(spark, lines) == expected
