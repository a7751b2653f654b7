"""Evaluation texts leaking into a corpus: FM-indexes over shards of the corpus, searched for phrases of the items.

A shard is a bounded number of words of some documents. Its words become the numbers that the items' vocabulary gives
them (a word of no item can't be in a phrase, so it only separates), and an FM-index over these numbers answers how
often and where each phrase of the items occurs: backward search by ranks in a wavelet matrix, and positions from a
sample of the suffix array. Every hit is then extended with replaced words along its alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import ship_package, spread

_WORD = re.compile(r"[^\W_]+")
# tags, comments and entities of markup, which aren't words
_MARKUP = re.compile(
    r"<!--(?:(?!-->|<!--)(?s:.))*+-->|</?[A-Za-z][\w:-]*+(?:\s+[\w:.@-]++(?:\s*=\s*(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=]++))?)*+\s*/?>"
    r"|&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"
)


class FmIndex:
    """Over a sequence of numbers from 1; 0 is kept for its end."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        text = np.append(symbols.astype(np.int64), 0)
        n = self.n = len(text)
        order = self._suffixes(text)
        last = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        #: by level: how many ones are before each position, and the number of zeros
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = last
        for level in range(self.levels - 1, -1, -1):
            bits = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int64))))
            self.zeros.append(int(n - bits.sum()))
            row = np.concatenate((row[bits == 0], row[bits == 1]))
        self.last = last
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.sample = sample
        kept = order % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the length that is sorted by."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        k = 1
        while True:
            second = np.full(n, -1, dtype=np.int64)
            second[: n - k] = rank[k:]
            key = rank * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank = new
            k *= 2
            if rank[order[-1]] == n - 1 or k >= n:
                return np.argsort(rank, kind="stable")

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before position i."""
        start, end = np.zeros_like(i), i.copy()
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            bit = (symbol >> level) & 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row of phrases."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        known = (phrases < len(self.before) - 1).all(axis=1)
        high[~known] = 0
        live = np.flatnonzero(known)
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            dead = high[live] <= low[live]
            high[live[dead]] = low[live[dead]]
            live = live[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, walking back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        at, steps, open_ = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(open_):
            here = at[open_]
            sampled = self.kept[here + 1] > self.kept[here]
            done = open_[sampled]
            out[done] = self.positions[self.kept[at[done]]] + steps[done]
            open_ = open_[~sampled]
            here = at[open_]
            c = self.last[here]
            at[open_] = self.before[c] + self.rank(c, here)
            steps[open_] += 1
        return out


@dataclass(frozen=True)
class Rule:
    """A passage has at least min_words words, of which one in `one_in` may be replaced."""

    min_words: int = 18
    one_in: int = 10

    @property
    def seed(self) -> int:
        """The words that any passage holds in a row unchanged."""
        lengths = range(self.min_words, self.min_words + 20 * self.one_in)
        return max(1, min(-(-(n - n // self.one_in) // (n // self.one_in + 1)) for n in lengths))


class Items:
    """The phrases of a block of items, numbered."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule = rule
        self.vocabulary: dict[str, int] = {}
        self.keys: list[int] = []
        self.words: list[np.ndarray] = []
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for key, words in ((key, words) for key, text in items for words in _readings(text or "")):
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
            if len(numbers) < rule.min_words:
                continue
            for p in range(len(numbers) - rule.seed + 1):
                grams.setdefault(tuple(numbers[p : p + rule.seed]), []).append((len(self.keys), p))
            self.keys.append(key)
            self.words.append(np.array(numbers, dtype=np.int64))
        self.phrases = np.array(list(grams), dtype=np.int64).reshape(-1, rule.seed)
        places = list(grams.values())
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
        self.item = np.array([i for p in places for i, _ in p], dtype=np.int64)
        self.at = np.array([q for p in places for _, q in p], dtype=np.int64)


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]  # as many as _offsets has


def _readings(text: str) -> list[list[str]]:
    """The words of a text, and if it has markup also those outside of it."""
    plain = _without_markup(text)
    return [words_of(text)] + ([words_of(plain)] if plain != text else [])


class Shard:
    """Some documents of a corpus, and the passages of items in them."""

    def __init__(self, items: Items):
        self.items = items
        self.keys: list[int] = []
        #: the text of each reading, and which document of the shard it is of
        self.texts: list[str] = []
        self.of: list[int] = []
        self.added = 0
        self.starts: list[int] = [0]
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int, text: str) -> None:
        """A document as it is, and if it has markup also with spaces for that."""
        plain = _without_markup(text)
        for reading in (text,) if plain == text else (text, plain):
            self._add(key, reading)
        self.added += 1

    def _add(self, key: int, text: str) -> None:
        get = self.items.vocabulary.get
        numbers = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        if len(numbers) < self.items.rule.min_words or known[-1] < self.items.rule.seed:
            return
        self.keys.append(key)
        self.texts.append(text)
        self.of.append(self.added)
        self.numbers.append(numbers)
        self.starts.append(self.starts[-1] + len(numbers))
        self.size += len(numbers)

    def _runs(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Positions of words that stand in a run of known words of one document, at least as long as a seed."""
        known = words > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known, [0]))) | np.concatenate(([0], np.diff(owner), [0])))
        edge = np.unique(np.concatenate(([0], edge, [len(words)])))
        long = (np.diff(edge) >= self.items.rule.seed) & known[edge[:-1]]
        return np.flatnonzero(np.repeat(long, np.diff(edge)))

    def passages(self) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start and end of a passage as word numbers of the document)"""
        items, rule = self.items, self.items.rule
        if not self.keys or not len(items.phrases):
            return
        words = np.concatenate(self.numbers)
        starts = np.array(self.starts, dtype=np.int64)
        owner = np.repeat(np.arange(len(self.keys)), np.diff(starts))
        kept = self._runs(words, owner)
        if not len(kept):
            return
        # runs follow one another with a separator (1) between them
        gap = np.flatnonzero((np.diff(kept) > 1) | (np.diff(owner[kept]) > 0)) + 1
        place = np.insert(kept, gap, -1)
        index = FmIndex(np.insert(words[kept], gap, 1))
        low, high = index.search(items.phrases)
        hits = high - low
        phrase = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(len(phrase))
        where = place[index.locate(rows)]
        uses = np.diff(items.first)[phrase]
        use = np.repeat(items.first[phrase] - np.concatenate(([0], np.cumsum(uses)[:-1])), uses) + np.arange(uses.sum())
        where = np.repeat(where, uses)
        # one alignment for each (document, item, distance of their words)
        found = np.unique(np.stack((owner[where], items.item[use], where - items.at[use])), axis=1)
        yield from self._extend(words, starts, found)

    def _extend(self, words: np.ndarray, starts: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        items, rule = self.items, self.items.rule
        longest = max(map(len, items.words))
        table = np.full((len(items.words), longest), -1, dtype=np.int64)
        for k, w in enumerate(items.words):
            table[k, : len(w)] = w
        step = max(1, 4_000_000 // longest)
        for block in range(0, found.shape[1], step):
            doc, item, shift = found[:, block : block + step]
            at = shift[:, None] + np.arange(longest)
            inside = (at >= starts[doc][:, None]) & (at < starts[doc + 1][:, None]) & (table[item] >= 0)
            same = inside & (words[np.clip(at, 0, len(words) - 1)] == table[item])
            score = np.where(same, 1, np.where(inside, 1 - rule.one_in, -(10**6)))
            total = np.concatenate((np.zeros((len(doc), 1), dtype=np.int64), np.cumsum(score, axis=1)), axis=1)
            if longest < rule.min_words:
                continue
            least = np.minimum.accumulate(total, axis=1)[:, : longest + 1 - rule.min_words]
            for k in np.flatnonzero((total[:, rule.min_words :] >= least).any(axis=1)):
                for a, b in _intervals(total[k], rule.min_words):
                    begin = shift[k] - starts[doc[k]]
                    yield int(doc[k]), int(item[k]), int(begin + a), int(begin + b)


def _intervals(total: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The longest passages, from the left, that don't overlap."""
    a = 0
    while a <= len(total) - 1 - least:
        ends = np.flatnonzero(total[a + least :] >= total[a])
        if len(ends):
            b = a + least + int(ends[-1])
            yield a, b
            a = b
        else:
            a += 1


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    rule: Rule = Rule(),
    shard_words: int = 1_000_000,
    block_items: int = 20_000,
) -> DataFrame:
    """One row per passage: doc_id, item_id, and its first and last character (end excluded) in the document's text.

    Documents are read once for each block of items, whole, in shards of about shard_words words; nothing is shuffled.
    The items of a block are sent to every task, so their number is bounded. Null, empty and short texts give no row;
    each copy of a document gives its own rows; an item shorter than a passage can't leak. Words are folded in
    case one by one; everything between words is ignored. A text with
    markup is searched as it is and without its tags, comments and entities.
    """
    spark = docs.sparkSession
    ship_package(spark)
    found = None
    source = items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator()
    blocks = iter(lambda: [tuple(r) for r in islice(source, block_items)], [])
    for rows in blocks:
        part = _in_block(docs.select("doc_id", F.col(text).alias("_text")).where(F.length("_text") > 0), rows, rule, shard_words)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, begin int, end int")


def _in_block(docs: DataFrame, rows: list[tuple[int, str]], rule: Rule, shard_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(sent.value, rule)

        def result(shard: Shard) -> pa.RecordBatch:
            spans: dict[tuple[int, int, int], set[tuple[int, int]]] = {}
            for doc, item, a, b in shard.passages():
                words = _offsets(shard.texts[doc])
                place = (shard.of[doc], shard.keys[doc], items.keys[item])
                spans.setdefault(place, set()).add((words[a][0], words[b - 1][1]))
            out = [(key, item, *span) for (_, key, item), found in spans.items() for span in _outermost(found)]
            columns = list(zip(*out)) if out else [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "begin", "end"]
            )

        shard = Shard(items)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(key, text)
                if shard.size >= shard_words:
                    yield result(shard)
                    shard = Shard(items)
        yield result(shard)

    return spread(docs).mapInArrow(run, "doc_id bigint, item_id bigint, begin int, end int")


#: The phrases that a Python worker holds, and what they were made of
_held: list = [None, None]


def _items(rows: list[tuple[int, str]], rule: Rule) -> Items:
    if _held[0] is None or _held[0][0] is not rows or _held[0][1] != rule:
        _held[:] = (rows, rule), Items(rows, rule)
    return _held[1]


def _offsets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def _without_markup(text: str) -> str:
    """The text with spaces for tags, comments and entities, so that places stay."""
    return _MARKUP.sub(lambda m: " " * len(m[0]), text) if "<" in text or "&" in text else text


def _outermost(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that lie in no other one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def removal_spans(passages: DataFrame) -> DataFrame:
    """Overlapping passages of a document merged: doc_id, begin, end, item_ids (sorted)."""
    ordered = passages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end", "item_id"))).alias("_p")
    )
    merged = F.expr(
        "aggregate(_p, cast(array() as array<struct<begin:int,end:int,item_ids:array<bigint>>>), (spans, p) -> "
        "if(size(spans) > 0 and p.begin <= element_at(spans, -1).end, "
        "concat(slice(spans, 1, size(spans) - 1), array(named_struct('begin', element_at(spans, -1).begin, 'end', "
        "greatest(element_at(spans, -1).end, p.end), 'item_ids', array_sort(array_union("
        "element_at(spans, -1).item_ids, array(p.item_id)))))), "
        "concat(spans, array(named_struct('begin', p.begin, 'end', p.end, 'item_ids', array(p.item_id))))))"
    )
    return ordered.select("doc_id", F.inline(merged))
