import math
import string
from collections import Counter

from pyspark.sql import functions as F

from tidesift.functions import text as T


def _column(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.c for r in df.select("i", column(F.col("s")).alias("c")).orderBy("i").collect()]


def test_entropy_and_space(spark):
    values = ["", "aaaa", "abab", "a😀é\n", string.printable, None, " \t \x1c "]

    def bits(s):
        return 0.0 if not s else -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())

    got = _column(spark, values, T.entropy)
    assert all(a is None if b is None else math.isclose(a, bits(b), abs_tol=1e-9) for a, b in zip(got, values))
    share = _column(spark, values, T.space_share)
    assert share[0] == 1.0 and share[5] is None and share[6] == 1.0
    assert math.isclose(share[4], sum(c.isspace() for c in string.printable) / len(string.printable))


def test_requirements(spark):
    lines = ["Foo_Bar.baz[x]==1.0  # c", "a>=2; python_version", "-r x", "# only", "", "b==1.*", "c===1", "  d ~= 3", None]
    got = _column(spark, lines, lambda c: T.requirement(T.requirement_text(c)))
    assert [None if r is None else (r.name, r.version) for r in got] == [
        ("foo-bar-baz", "1.0"), ("a", None), None, None, None, ("b", None), ("c", None), ("d", None), None,
    ]


def test_lines_identifiers_and_cuts(spark):
    assert _column(spark, ["a\nb\r\nc\x0bd\n", "", "x"], T.lines_of) == [["a", "b", "c", "d"], [], ["x"]]
    names = ["_", "lol", "O0", "_x_", "_bc", "value", "__kq", "io", "_ab"]
    assert _column(spark, names, T.is_odd_identifier) == [True, True, True, True, True, False, True, True, False]
    assert _column(spark, ["a" * 9, "a" * 5], lambda c: T.cut_within(c, 5)) == ["aa...", "aaaaa"]
    assert _column(spark, ["a" * 9, "a" * 5], lambda c: T.cut_after(c, 5)) == ["aaaaa...", "aaaaa"]
    assert _column(spark, [" A_b..C- "], T.normal_name) == ["a-b-c-"]
