"""Freely typed names mapped to a reference list.

The reference entries and their alias paths (without separators, with their parts in another order) form a trie. A
typed name is cleaned of what was written around it and searched in the trie with a Levenshtein automaton, whose states
are bit vectors with one bit per letter of the name. All entries within a distance that depends on length come back.
The trie is a few arrays, built once on the driver and sent to the tasks, which walk it for many names at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import ship_package, small_side, spread

# fixed values: letters of other alphabets that look like Latin ones, and digits and signs written for letters
LOOKALIKES = str.maketrans("аеорсхуікмтвнѕјԁӏɡαονιγκρτυ", "aeopcxyikmtbhsjdlgaoviykptu")
LEET = str.maketrans("013457@$", "oleastas")

_VCS = re.compile(r"^(?:git|hg|svn|bzr)\+\S*?/([^/\s@#]+?)(?:\.git)?(?:[@#]\S*)?$")
_URL = re.compile(r"^[a-z]+://\S*?/([^/\s@#?]+?)(?:\.git)?/?(?:[@#?]\S*)?$")
_EXTRAS = re.compile(r"\s*\[[^\]]*\]?")
_VERSION = re.compile(r"\s*(?:===|==|>=|<=|~=|!=|>|<|;|@\s).*$|\s+v?\d[\w.+!-]*$|[\s,]*\(.*\)\s*$")
_AROUND = " \t\r\n'\"`´‘’“”«»,;:<>()*"
_WRITTEN_BEFORE = re.compile(r"^(?:python[0-9.]*|py|pip3? install)[\s._-]+")
_WRITTEN_AFTER = re.compile(r"[\s._-]+(?:python[0-9.]*|py)$")
_SEPARATORS = re.compile(r"[\s._/-]+")


def cleaned(name: str) -> list[str]:
    """The readings of a typed name, most literal first, as lower-case parts joined by hyphens."""
    text = unicodedata.normalize("NFKC", name)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\r")
    text = text.translate(LOOKALIKES).strip().lower().translate(LOOKALIKES)
    if m := _VCS.match(text) or _URL.match(text):
        text = m[1]
    text = _EXTRAS.sub("", text.strip(_AROUND))
    text = _VERSION.sub("", text).strip(_AROUND)
    text = text.removesuffix(".git")
    readings = [text]
    bare = _WRITTEN_AFTER.sub("", _WRITTEN_BEFORE.sub("", text))
    readings.append(bare)
    readings += [r.translate(LEET) for r in (text, bare)]
    return list(dict.fromkeys(x for r in readings if (x := _SEPARATORS.sub("-", r).strip("-"))))


def allowed_distance(length: int) -> int:
    """How many edits a name of a length may have and still be meant."""
    return 0 if length < 3 else 1 if length < 6 else 2


#: By length, how many edits a name may have and still be meant, as an array for names of many lengths
_ALLOWED = np.array([allowed_distance(n) for n in range(8)])


def forms(name: str, order_parts: int) -> dict[str, int]:
    """The forms of an entry with their alias path: 0 its own, 1 without separators, 2 its parts in another order (all
    orders of up to order_parts parts, of more parts the sorted one)."""
    own = _SEPARATORS.sub("-", name.lower()).strip("-")
    parts = own.split("-")
    orders = permutations(parts) if len(parts) <= order_parts else [sorted(parts)]
    return dict.fromkeys(map("-".join, orders), 2) | {own.replace("-", ""): 1, own: 0}


class Trie:
    """The forms of reference entries as arrays. Nodes are numbered level by level, so the children of node i are those
    from first[i] to first[i + 1]; label is the letter that leads to a node, and the forms that end at it are those from
    ends[i] to ends[i + 1]."""

    def __init__(self, entries: list[tuple[int, str]], order_parts: int = 5):
        self.order_parts = order_parts
        entries = sorted(entries, key=lambda e: (e[1], e[0]))
        self.pkg_id = np.array([k for k, _ in entries], dtype=np.int64)
        self.names = [n for _, n in entries]
        rows = sorted((form, alias, i) for i, (_, n) in enumerate(entries) for form, alias in forms(n, order_parts).items())
        self.alias = np.array([r[1] for r in rows], dtype=np.int8)
        self.entry = np.array([r[2] for r in rows], dtype=np.int32)
        self.letters = np.array([len(r[0]) - r[0].count("-") for r in rows], dtype=np.int32)
        sizes = np.array([len(r[0]) for r in rows], dtype=np.int64)
        text = "".join(r[0] for r in rows)
        self.alphabet = {c: i for i, c in enumerate(sorted(set(text)), 1)}
        codes = np.array([self.alphabet[c] for c in text], dtype=np.int32)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(rows) else sizes
        self.longest = int(sizes.max(initial=0))
        node, last = np.zeros(len(rows), dtype=np.int64), 0
        labels, parents = [np.zeros(1, dtype=np.int32)], []
        for depth in range(self.longest):
            live = np.flatnonzero(sizes > depth)
            letter = codes[starts[live] + depth]
            new = np.concatenate(([True], (np.diff(node[live]) != 0) | (np.diff(letter) != 0)))
            labels.append(letter[new])
            parents.append(node[live][new])
            node[live] = last + np.cumsum(new)
            last += int(new.sum())
        self.label = np.concatenate(labels)
        children = np.bincount(np.concatenate(parents) if parents else np.zeros(0, dtype=np.int64), minlength=last + 1)
        self.first = np.concatenate(([1], 1 + np.cumsum(children))).astype(np.int32)
        order = np.argsort(node, kind="stable")
        self.alias, self.entry, self.letters = self.alias[order], self.entry[order], self.letters[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=last + 1)))).astype(np.int32)

    def search(self, words: list[str], limit: int, block: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, form, distance) of all forms within `limit` insertions, deletions, replacements and swaps of neighbours
        of a word, and within the distance that their letters allow. block: how many (word, node) are held at a time."""
        short = [i for i, w in enumerate(words) if len(w) <= min(60, self.longest + limit)]
        long = [i for i, w in enumerate(words) if 60 < len(w) <= self.longest + limit]
        step = max(1, 2_000_000 // (len(self.alphabet) + 1))
        parts = [self._search(words, short[k : k + step], limit, np.uint64, block) for k in range(0, len(short), step)]
        parts += [self._search(words, long[k : k + step], limit, object, block) for k in range(0, len(long), step)]
        return tuple(np.concatenate([p[i] for p in parts] or [np.zeros(0, dtype=np.int64)]) for i in range(3))

    def _search(self, words: list[str], chosen: list[int], limit: int, kind: type, block: int) -> tuple[np.ndarray, ...]:
        number = int if kind is object else np.uint64
        one, two = number(1), number(2)
        masks = np.zeros((len(chosen), len(self.alphabet) + 1), dtype=kind)
        for k, i in enumerate(chosen):
            row: dict[int, int] = {}
            for j, c in enumerate(words[i]):
                if code := self.alphabet.get(c):
                    row[code] = row.get(code, 0) | 2 << j
            for code, bits in row.items():
                masks[k, code] = bits
        size = np.array([len(words[i]) for i in chosen], dtype=np.int64)
        letters = np.array([len(words[i]) - words[i].count("-") for i in chosen], dtype=np.int64)
        full = np.array([number((2 << m) - 1) for m in size.tolist()], dtype=kind)
        end = np.array([number(m) for m in size.tolist()], dtype=kind)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nothing = np.zeros(len(chosen), dtype=kind)
        # a state: words, nodes, the bits of each distance, those of the node before, the mask that led here
        start = [full & number((2 << k) - 1) for k in range(limit + 1)]
        stack = [(np.arange(len(chosen)), np.zeros(len(chosen), dtype=np.int64), start, [nothing] * limit, nothing)]
        while stack:
            word, node, rows, before, last = stack.pop()
            if len(word) > block:
                half = len(word) // 2
                for cut in (slice(half), slice(half, None)):
                    stack.append((word[cut], node[cut], [r[cut] for r in rows], [b[cut] for b in before], last[cut]))
                continue
            hits += self._ending(word, node, rows, end[word], letters)
            count = self.first[node + 1] - self.first[node]
            of = np.repeat(np.arange(len(node)), count)
            if not len(of):
                continue
            child = np.arange(len(of)) + np.repeat(self.first[node] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            w = word[of]
            mask, old = masks[w, self.label[child]], [r[of] for r in rows]
            shown = full[w]
            new = [(old[0] << one) & mask]
            for k in range(1, limit + 1):
                row = (old[k] << one) & mask | old[k - 1] | old[k - 1] << one | new[k - 1] << one
                row |= before[k - 1][of] << two & last[of] & mask << one
                new.append(row & shown)
            alive = new[0] != 0
            for row in new[1:]:
                alive |= row != 0
            alive = np.flatnonzero(alive)
            if len(alive):
                stack.append((w[alive], child[alive], [r[alive] for r in new], [r[alive] for r in old[:limit]], mask[alive]))
        found = [np.concatenate([h[i] for h in hits] or [np.zeros(0, dtype=np.int64)]) for i in range(3)]
        return np.array(chosen, dtype=np.int64)[found[0]], found[1], found[2]

    def _ending(self, word: np.ndarray, node: np.ndarray, rows: list[np.ndarray], end: np.ndarray, letters: np.ndarray) -> list[tuple]:
        """The forms that end at the nodes whose state holds the whole word, at the least distance."""
        count = self.ends[node + 1] - self.ends[node]
        at = np.flatnonzero(count)
        if not len(at):
            return []
        distance = np.full(len(at), len(rows), dtype=np.int64)
        for k in range(len(rows) - 1, -1, -1):
            distance[(rows[k][at] >> end[at] & (1 if end.dtype == object else np.uint64(1))) != 0] = k
        at, distance = at[distance < len(rows)], distance[distance < len(rows)]
        of = np.repeat(np.arange(len(at)), count[at])
        form = np.arange(len(of)) + np.repeat(self.ends[node[at]] - np.concatenate(([0], np.cumsum(count[at])[:-1])), count[at])
        w = word[at][of]
        near = distance[of] <= _ALLOWED[np.minimum(np.maximum(letters[w], self.letters[form]), len(_ALLOWED) - 1)]
        return [(w[near], form[near], distance[of][near])]

    def matches(self, typed: list[str], everything: bool = True) -> list[list[tuple[int, int, int, str]]]:
        """For each typed name the entries that it can mean, best first: pkg_id, distance, alias and name. everything:
        also the near ones, where a reading is exactly a form of an entry."""
        words, of = [], []
        for i, name in enumerate(typed):
            for r in dict.fromkeys(w for r in cleaned(name) for w in (r, r.replace("-", ""), self._in_order(r))):
                words.append(r)
                of.append(i)
        owner = np.array(of, dtype=np.int64)
        word, form, distance = self.search(words, 0)
        parts = [(owner[word], form, distance)]
        open_ = np.ones(len(typed), dtype=bool)
        if not everything:
            open_[owner[word]] = False
        for limit in range(1, int(_ALLOWED.max()) + 1):
            chosen = [k for k, w in enumerate(words) if open_[of[k]] and allowed_distance(len(w) + 2) == limit]
            word, form, distance = self.search([words[k] for k in chosen], limit)
            parts.append((owner[np.array(chosen, dtype=np.int64)[word]], form, distance))
        name, form, distance = (np.concatenate([p[i] for p in parts]) for i in range(3))
        entry, alias = self.entry[form], self.alias[form]
        order = np.lexsort((entry, alias, distance, name))
        out: list[list[tuple[int, int, int, str]]] = [[] for _ in typed]
        seen: set[tuple[int, int]] = set()
        for i, e, d, a in zip(*(x[order].tolist() for x in (name, entry, distance, alias))):
            if (i, e) not in seen:
                seen.add((i, e))
                out[i].append((int(self.pkg_id[e]), d, a, self.names[e]))
        return out

    def _in_order(self, word: str) -> str:
        """The sorted form of a word of so many parts that not all their orders are in the trie."""
        parts = word.split("-")
        return word if len(parts) <= self.order_parts else "-".join(sorted(parts))


def name_candidates(
    deps: DataFrame,
    reference: DataFrame,
    name: str = "name",
    key: str = "dep_id",
    block: int = 100_000,
    everything: bool = True,
) -> DataFrame:
    """One row per typed name and entry within its distance: key, pkg_id, distance, alias, entry; and one with pkg_id null
    for a name within reach of none. everything=False leaves out the near entries of names that are exactly a form of one.

    The reference list is read in blocks of bounded size, each packed as a trie on the driver and sent to the tasks; the
    names are searched where they are, each different name of a batch once, so hot names cost nothing and, with one
    block, nothing is shuffled. However many blocks there are, the rows are the same. Null and blank names give no row;
    names equal to an entry give that entry at distance 0; rows delivered twice each give theirs.
    """
    return _candidates(deps, reference, name, key, block, everything, False)[0]


def _candidates(
    deps: DataFrame, reference: DataFrame, name: str, key: str, block: int, everything: bool, nearest: bool
) -> tuple[DataFrame, int]:
    """The rows of name_candidates, or only the nearest of each block, and the number of blocks."""
    typed = spread(deps.select(F.col(key).alias("_key"), F.col(name).alias("_name")).where(F.trim("_name") != ""))
    source = reference.select("pkg_id", "name").where(F.col("name").isNotNull()).toLocalIterator()
    parts = [_search(typed, entries, everything, nearest) for entries in iter(lambda: [tuple(r) for r in islice(source, block)], [])]
    if not parts:
        parts = [_search(typed, [], everything, nearest)]
    if len(parts) == 1:
        return parts[0].withColumnRenamed("_key", key), 1
    found = parts[0].where("pkg_id is not null")
    for part in parts[1:]:
        found = found.unionByName(part.where("pkg_id is not null"))
    none = typed.select("_key").join(found.select("_key").distinct(), "_key", "left_anti")
    return found.unionByName(none, allowMissingColumns=True).withColumnRenamed("_key", key), len(parts)


def _search(typed: DataFrame, entries: list[tuple[int, str]], everything: bool, nearest: bool) -> DataFrame:
    spark = typed.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(Trie(entries))
    schema = "_key bigint, pkg_id bigint, distance int, alias int, entry string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = sent.value, {}
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            different = names.dictionary.to_pylist()
            fresh = [n for n in different if n not in memo]
            known = memo | dict(zip(fresh, trie.matches(fresh, everything)))
            memo.update((n, known[n]) for n in fresh if len(n) <= 200)
            if len(memo) > 200_000:
                memo.clear()
            rows: list[tuple] = []
            none = [(None, None, None, None)]
            for k, i in zip(batch.column(0).to_pylist(), names.indices.to_pylist()):
                hits = known[different[i]] or none
                rows += [(k, *x) for x in (hits[:1] if nearest else hits)]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["_key", "pkg_id", "distance", "alias", "entry"]
            )

    return typed.mapInArrow(run, schema)


def mapped_names(
    deps: DataFrame, reference: DataFrame, name: str = "name", key: str = "dep_id", block: int = 100_000
) -> DataFrame:
    """One row per typed name that isn't an entry itself: key, pkg_id (-1: none is meant) and distance.

    The nearest entry is meant; among equally near ones that with the more literal form, then the first by name. With
    one block of entries nothing is shuffled.
    """
    loose = deps.join(small_side(reference.select(F.col("name").alias(name))), name, "left_anti")
    found, blocks = _candidates(loose, reference, name, key, block, False, True)
    if blocks > 1:
        hit = F.when(F.col("pkg_id").isNotNull(), F.struct("distance", "alias", "entry", "pkg_id"))
        chosen = found.groupBy(key).agg(F.min(hit).alias("_hit"))  # combined before it is shuffled
        found = chosen.select(key, "_hit.pkg_id", "_hit.distance")
    return found.select(key, F.coalesce("pkg_id", F.lit(-1).cast("bigint")).alias("pkg_id"), "distance")
