import random

from tidesift.llm.names import Trie, allowed_distance, cleaned, mapped_names, name_candidates


def _distance(a, b):
    """Insertions, deletions, replacements and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_against_a_table():
    r = random.Random(2)
    names = sorted({"".join(r.choice("abc-") for _ in range(r.randint(3, 9))).strip("-") or "abc" for _ in range(60)})
    trie = Trie(list(enumerate(names)))
    words = ["".join(r.choice("abc-") for _ in range(r.randint(1, 9))) for _ in range(150)] + [names[0] + "é", "ab" * 40]
    for limit in (0, 1, 2):
        for block in (400_000, 7):
            got = {}
            for word, form, distance in zip(*(x.tolist() for x in trie.search(words, limit, block))):
                if trie.alias[form] == 0:
                    place = (words[word], trie.names[trie.entry[form]])
                    got[place] = min(distance, got.get(place, 9))
            for word in words:
                for n in names:
                    if "--" in n:
                        continue
                    d = _distance(word, n)
                    longest = max(len(word.replace("-", "")), len(n.replace("-", "")))
                    assert got.get((word, n)) == (d if d <= limit and d <= allowed_distance(longest) else None), (word, n, limit)


def test_long_names_and_many_parts():
    long, parts = "q" * 70 + "-tail", "one-two-three-four-five-six-seven"
    trie = Trie([(1, long), (2, parts), (3, "a-b-c-d-e")])
    found = trie.matches([long[1:], long.replace("qq", "qz", 1), "seven.six.five.four.three.two.one", "e-d-c-b-a", "x" * 10_000, ""])
    assert [[m[0] for m in x] for x in found] == [[1], [1], [2], [3], [], []]
    assert Trie([]).matches(["abc", ""]) == [[], []]


def test_cleaning():
    for typed in ("Foo_Bar", " foo.bar\xa0", "`foo-bar`", "foo-bar[gpu,x]", "foo-bar==1.2", "foo-bar >= 2", "FOO  BAR 1.0.3", "python-foo-bar", "foo-bar-py", "Python foo-bar", "ｆｏｏ-ｂａｒ", "fo​o-bar", "f00-bar",
                  "git+https://code.example/x/foo-bar.git@v2", "fоо-bаr", "foo-bar;", "foo-bar.git", "https://code.example/x/foo-bar"):
        assert "foo-bar" in cleaned(typed), typed
    assert cleaned(" ​ ") == [] and cleaned("--") == []


def test_operator(spark):
    reference = spark.createDataFrame([(1, "kuvos-haskoup"), (2, "gifanix"), (3, "kuvos-extras"), (4, None)], "pkg_id bigint, name string")
    typed = {
        "kuvos-haskoup": None, "haskoup_kuvos": 1, "KUVOSHASKOUP": 1, "kuvo-shaskoup": 1, "gfianx": 2, "giani": 2, "gif": -1, "unrelated-name": -1, "kuvos extra": 3, "": None, "  ": None, None: None, "x" * 50_000: -1,
    }
    rows = [(i, n, 7, "e") for i, n in enumerate(typed)] + [(100, "gfianx", 7, "e")]
    deps = spark.createDataFrame(rows, "dep_id bigint, name string, pkg_id int, entry string")
    got = {r.dep_id: r.pkg_id for r in mapped_names(deps, reference).collect()}
    assert got == {i: v for i, v in enumerate(typed.values()) if v is not None} | {100: 2}
    assert got == {r.dep_id: r.pkg_id for r in mapped_names(deps, reference, block=1).collect()}
    near = {(r.dep_id, r.pkg_id, r.distance) for r in name_candidates(deps, reference).collect()}
    assert (0, 1, 0) in near and (4, 2, 2) in near and (6, None, None) in near
    for block in (1, 2):
        parts = name_candidates(deps, reference, block=block)
        assert sorted(map(str, parts.collect())) == sorted(map(str, name_candidates(deps, reference).collect())), block
    assert mapped_names(deps.limit(0), reference).count() == 0
    assert {r.pkg_id for r in mapped_names(deps, reference.limit(0)).collect()} == {-1}
