import random

import numpy as np

from tidesift.llm.leakage import FmIndex, Items, Rule, Shard, _readings, leaked_passages, removal_spans, words_of


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for n, letters in ((1, 2), (40, 3), (500, 4), (500, 90)):
        text = rng.integers(1, letters, n)
        index = FmIndex(text, sample=5)
        for size in (1, 2, 4):
            phrases = np.array([rng.integers(1, letters + 2, size) for _ in range(40)])
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases, low, high):
                expected = [i for i in range(n - size + 1) if (text[i : i + size] == phrase).all()]
                assert sorted(index.locate(np.arange(a, b))) == expected


def test_seed():
    assert Rule().seed == 6 and Rule(10, 100).seed == 10


def _brute(docs, items, rule):
    out = set()
    for d, text in docs:
        w = words_of(text or "")
        for k, item in items:
            v = words_of(item or "")
            for shift in range(-len(v), len(w)):
                total = [0]
                for q in range(len(v)):
                    p = q + shift
                    total.append(total[-1] + ((1 if w[p] == v[q] else 1 - rule.one_in) if 0 <= p < len(w) else -(10**6)))
                if any(total[b] >= total[a] for a in range(len(v)) for b in range(a + rule.min_words, len(v) + 1)):
                    out.add((d, k))
    return out


def _data(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(15, 45)))) for k in range(12)]
    docs = []
    for d in range(n):
        text = [r.choice(words) for _ in range(r.randint(0, 30))]
        part = r.choice(items)[1].split()
        a = r.randrange(len(part))
        part = part[a : a + r.randint(8, 40)]
        for _ in range(r.randint(0, 4)):
            part[r.randrange(len(part))] = r.choice([*words, "zzz"])
        docs.append((d, r.choice([" ", ", ", " **"]).join(text + part).upper()))
    return docs, items


def test_passages_against_brute_force():
    for seed, rule in ((1, Rule()), (2, Rule(9, 5)), (3, Rule(6, 6))):
        docs, items = _data(seed, 60)
        held = Items(items, rule)
        shard = Shard(held)
        for d, text in docs:
            shard.add(d, text)
        got = {(shard.keys[d], held.keys[k]) for d, k, _, _ in shard.passages()}
        assert got == _brute(docs, items, rule)


def test_operator(spark):
    docs, items = _data(4, 80)
    docs += [(900, docs[0][1]), (901, None), (902, ""), (903, "é" * 50_000), (904, ("x " * 30_000) + items[0][1] * 2)]
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id bigint, text string, item_id string, begin int")
    evals = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id bigint, text string")
    found = leaked_passages(df, evals, shard_words=300, block_items=5)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == _brute([d for d in docs if d[0] != 904], items, Rule()) | ({(904, 0)} if len(items[0][1].split()) >= 18 else set())
    texts = dict(docs)
    assert all(len(words_of(texts[r.doc_id][r.begin : r.end])) >= 18 for r in rows)
    spans = removal_spans(found).collect()
    by_doc = {}
    for s in sorted(spans, key=lambda s: (s.doc_id, s.begin)):
        assert s.begin > by_doc.get(s.doc_id, -1) and s.item_ids == sorted(set(s.item_ids))
        by_doc[s.doc_id] = s.end
    assert leaked_passages(df.limit(0), evals).count() == leaked_passages(df, evals.limit(0)).count() == 0


LEAKED = " ".join(f"word{i}" for i in range(30))


def _spans(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, LEAKED)], "item_id bigint, text string")
    return [text[r.begin : r.end] for r in removal_spans(leaked_passages(docs, items)).collect()]


def test_letters_that_fold_to_more(spark):
    """'İ' folds to a letter and a mark that is none."""
    assert _spans(spark, "İstanbul İİ xİx " * 5 + LEAKED) == [LEAKED]


def test_markup_only_separates(spark):
    marked = "".join(f'<em class="x y">word{i}</em>&nbsp;' if i % 3 == 0 else f"word{i} " for i in range(30))
    found = _spans(spark, f"<p>before</p> {marked} after")
    assert len(found) == 1 and found[0].startswith("word0") and found[0].endswith("word29")
    assert _spans(spark, f'<img alt="{LEAKED}"> <!-- note -->') == [LEAKED]


def test_long_markup():
    for filler in ("<a " * 100_000, "<!--" * 20_000, "&" * 300_000, "<a b='" * 50_000, "<" * 300_000):
        assert all(words[-1] == "end" for words in _readings(filler + " end"))
