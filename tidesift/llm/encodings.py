"""Texts that were decoded with another encoding than they were written in.

The corpus gives a language model: in how many different texts each word and each character occurs. A stretch of text
is then a message through a noisy channel: its characters become the bytes that the wrong encoding gave them (with
wildcards for bytes that were lost), and a Viterbi search over the lattice of what those bytes can mean in the right
encoding finds the most probable original. A text is garbled if an original explains it better than it explains itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import shared_path, ship_package, spread

# fixed values: encodings of one byte per character, and of several, that texts are written in or wrongly read with
SINGLE = (
    "cp1252", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "mac_roman",
    "cp437", "cp850", "cp1253", "cp1254",
)
MULTI = ("cp932", "euc_jp", "gb18030", "big5", "euc_kr")
LOST = "�"
#: A word of the language model occurs in at least this share of the different texts. So the model has at most
#: (mean number of different words in a text) / MIN_SHARE words, however large the corpus is.
MIN_SHARE = 1e-4
#: A word in at least this share of the texts isn't suspected of being another one, wrongly decoded.
FAMILIAR = 5e-3
#: How much less probable, in nats, the reading of a token may be that stands beside garbled ones, and how many characters
#: may be between two tokens of a stretch
NEAR, STRETCH = 5.0, 60
#: The encodings that a text was written in and read with
Pair = tuple[str, str]
WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# only from the start of a token, so that long ones are read once
_ODD = re.compile(r"(?<![^ \t\n\r\f\v])[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\n\r\f\v]*")
_MIXED = re.compile(r"[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")
_C1 = re.compile(r"[\x80-\x9f]")
# fixed values: shift sequences of encodings of seven bits, which leave nothing but ASCII
_SHIFTED = {
    "iso2022_jp": re.compile(r"\x1b\$[@B]"),
    "iso2022_kr": re.compile(r"\x1b\$\)C"),
    "utf-7": re.compile(r"\+[A-Za-z0-9+/]{3,}(?:-|$|(?=[^A-Za-z0-9+/]))"),
}
_SHIFT = re.compile(r"\x1b\$|\+[A-Za-z0-9+/]{3,}-")
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")


def corpus_units(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """kind, unit, n (the number of different texts that hold it) and wide (whether they are of several sources): words
    (`w`), characters (`c`), and one row of kind `t` that counts the texts. Without a column for the source nothing is
    wide.

    Copies of a text count once: texts are grouped by a digest, which moves each different text of a task once, and
    all units of a text are counted together, map-side first.
    """
    origin = F.xxhash64(source) if source in docs.columns else F.lit(0).cast("bigint")
    texts = (
        docs.where(F.length(text) > 0)
        .select(F.sha2(text, 256).alias("_d"), F.col(text).alias("_text"), origin.alias("_s"))
        .groupBy("_d")
        .agg(F.first("_text").alias("_text"), F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    )
    words = F.regexp_extract_all(F.lower("_text"), F.lit(f"({WORD})"), 1)
    words = F.filter(F.array_distinct(words), lambda w: F.length(w) >= 2)
    letters = F.filter(F.array_distinct(F.split("_text", "")), lambda c: c != "")
    tagged = F.flatten(
        F.array(F.transform(words, lambda w: F.concat(F.lit("w"), w)), F.transform(letters, lambda c: F.concat(F.lit("c"), c)), F.array(F.lit("t")))
    )
    units = texts.select("_low", "_high", F.explode(tagged).alias("u"))
    counts = units.groupBy("u").agg(F.count("*").alias("n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return counts.select(
        F.substring("u", 1, 1).alias("kind"), F.expr("substring(u, 2)").alias("unit"), "n", (F.col("_low") != F.col("_high")).alias("wide")
    )


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """{character: its byte}, with bytes that mean nothing as control characters, as browsers read them"""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    for b in range(0x80, 0xA0):
        if encoding.startswith("cp12"):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _swap(right: str, wrong: str) -> dict[int, str]:
    """str.translate table from what `wrong` shows to what `right` means, for the upper half"""
    table = {}
    for c, b in _bytes_of(wrong).items():
        if b >= 0x80:
            try:
                table[ord(c)] = bytes([b]).decode(right)
            except UnicodeDecodeError:
                pass
    return table


def _utf8_at(code: list[int | None], i: int) -> tuple[str, int] | None:
    """The assigned character whose UTF-8 form starts at i, none of its bytes lost, and where that ends."""
    lead = code[i]
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    form = code[i : i + size]
    if len(form) < size or not all(x is not None and 0x80 <= x < 0xC0 for x in form[1:]):
        return None
    try:
        c = bytes(form).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return (c, i + size) if len(c) == 1 and c != LOST and unicodedata.category(c) != "Cn" else None


class Model:
    """Words and characters of the corpus with their counts, and the search for originals. narrow: frequent words that a
    single source has although the corpus has several. They may be what all its texts were garbled to, so they don't
    speak for themselves."""

    #: Longer tokens aren't remembered, as they hardly come again
    REMEMBERED = 64

    def __init__(self, words: dict[str, int], characters: dict[str, int], texts: int, narrow: frozenset[str] = frozenset()):
        self.texts = max(1, texts)
        self.words = words
        self.narrow = narrow
        self.log_char = {c: math.log(n / self.texts) for c, n in characters.items()}
        self.log_char["\xa0"] = 0.0  # a space that anybody may use
        self.unseen = math.log(0.2 / self.texts)
        # what a lost byte can stand for: {a word with its non-ASCII letters lost: the most frequent such word}
        self.skeletons: dict[str, str] = {}
        for w in sorted(words, key=lambda w: (words[w], w)):
            if not w.isascii() and words[w] >= max(2, FAMILIAR * self.texts / 2):
                self.skeletons[re.sub(r"[^\x00-\x7f]", LOST, w)] = w
        #: known characters by the first byte of their UTF-8 form, for sequences with lost bytes
        self.by_lead: dict[int, list[tuple[bytes, str, float]]] = {}
        for c, p in self.log_char.items():
            if ord(c) >= 0xA0 and c != LOST:
                code = c.encode("utf-8", "ignore")
                if code:
                    self.by_lead.setdefault(code[0], []).append((code, c, p))
        for b in range(0x80, 0xA0):  # what a first wrong decoding leaves of such bytes
            self.by_lead.setdefault(0xC2, []).append((bytes([0xC2, b]), chr(b), -4.0))
        self._memo: dict[str, tuple[str, bool, frozenset[Pair]]] = {}

    def score(self, text: str, own: bool = False) -> float:
        """Log probability: of a known word as one, else of the characters. ASCII costs next to nothing. own: of a text as
        it stands, where narrow words are as good as unknown."""
        total, end = 0.0, 0
        for m in _WORD.finditer(text):
            total += sum(self.log_char.get(c, self.unseen) for c in text[end : m.start()] if c > "\x7f")
            end = m.end()
            word = m[0]
            if (n := self.words.get(word.lower())) and not (own and word.lower() in self.narrow):
                total += math.log(n / self.texts)
            else:
                total += -2.0 + sum(self.log_char.get(c, self.unseen) for c in word if c > "\x7f")
        return total + sum(self.log_char.get(c, self.unseen) for c in text[end:] if c > "\x7f")

    def _viterbi(self, code: list[int | None], shown: str) -> str | None:
        """The most probable reading, as UTF-8, of a row of bytes in which None is a lost one. Characters that weren't
        parts of such a sequence stay as shown. None: no sequence can be read."""
        n = len(code)
        best: list[tuple[float, int, str]] = [(-math.inf, 0, "")] * (n + 1)
        best[0] = (0.0, 0, "")
        for i in range(n):
            at = best[i][0]
            b = code[i]
            here = shown[i]
            stay = at + (0.0 if here < "\x80" else self.log_char.get(here, self.unseen))
            if stay > best[i + 1][0]:
                best[i + 1] = (stay, i, here)
            if b is not None and b < 0xC2:
                continue
            if b is not None and (whole := _utf8_at(code, i)):
                c, j = whole
                p = -4.0 if c < "\xa0" else self.log_char.get(c, self.unseen)
                if at + p > best[j][0]:
                    best[j] = (at + p, i, c)
            if None not in code[i : i + 4]:
                continue
            for lead in self.by_lead if b is None else (b,):
                for form, c, p in self.by_lead.get(lead, ()):
                    j = i + len(form)
                    if (
                        j <= n
                        and at + p > best[j][0]
                        and all(x is None or x == y for x, y in zip(code[i:j], form))
                        and any(x is not None for x in code[i:j])
                    ):
                        best[j] = (at + p, i, c)
        out, i, read = [], n, False
        while i:
            _, before, c = best[i]
            read |= c != shown[before:i]
            out.append(c)
            i = before
        return "".join(reversed(out)) if read else None

    def _novelty(self, read: str, token: str) -> float:
        """What a reading with characters that the corpus and the token lack costs besides: a short sequence can be valid by chance, a
        long one or several hardly."""
        sizes = [len(c.encode("utf-8", "ignore")) for c in read if c > "\xa0" and c not in self.log_char and c not in token and c != LOST]
        return {2: 10.0, 3: 5.0}.get(sizes[0], 0.0) if len(sizes) == 1 else 0.0

    def _utf8_from(self, token: str, wrong: str) -> str | None:
        """A token as UTF-8 text that was read with an encoding of single bytes."""
        table = _bytes_of(wrong)
        code = [table.get(c) if c != LOST else None for c in token]
        known = [b if b is not None else (None if c == LOST else 0) for b, c in zip(code, token)]
        if sum(1 for b in known if b is not None and b >= 0xC2) == 0:
            return None
        read = self._viterbi(known, token)
        if read is not None and wrong in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1253"):
            # letters of these alphabets form pairs by chance, so a whole run must be readable
            if any(c in table and table[c] >= 0xC0 and c in token for c in read):
                return None
        return read

    def _as_utf8(self, token: str) -> Iterator[tuple[str, Pair | None]]:
        """Readings of a token as UTF-8 text that was read with another encoding."""
        for wrong in SINGLE:
            if (read := self._utf8_from(token, wrong)) is not None:
                yield read, ("utf-8", wrong)
        for wrong in MULTI:
            try:
                raw = token.replace(LOST, "\x00").encode(wrong)
            except UnicodeEncodeError:
                continue
            code = [None if b == 0 else b for b in raw]
            if not any(b is not None and b >= 0xC2 for b in code):
                continue
            shown = "".join(chr(b) if b is not None and b < 0x80 else LOST for b in code)
            if b"\xef\xbf\xbd" in raw or raw.startswith(b"\xbf\xbd"):
                yield raw.replace(b"\x00", b"").decode("utf-8", "replace"), None
            elif (read := self._viterbi(code, shown)) and read.count(LOST) <= token.count(LOST):
                yield read, None

    def _as_single(self, token: str) -> Iterator[tuple[str, Pair]]:
        """Readings of a token as text in one encoding of single bytes that was read with another."""
        odd = {ord(c) for c in token if c > "\x7f"}
        for wrong in SINGLE:
            for right in SINGLE:
                if right == wrong:
                    continue
                table = _swap(right, wrong)
                if odd <= table.keys():
                    read = token.translate(table)
                    if read != token:
                        yield read, (right, wrong)

    def _known(self, read: str, token: str) -> bool:
        """Whether a reading is made of known words, and one that wasn't there before has four letters, or three and is
        familiar."""
        found = [m[0].lower() for m in _WORD.finditer(read)]
        before = {m[0].lower() for m in _WORD.finditer(token)}
        fresh = [
            w
            for w in found
            if w not in before and (len(w) >= 4 or len(w) == 3 and self.words.get(w, 0) >= FAMILIAR * self.texts)
        ]
        return bool(fresh) and all(w in self.words for w in found if w not in before)

    def _suspect(self, token: str) -> bool:
        """Whether a token has words with other letters than ASCII that aren't familiar, or none at all."""
        found = [m[0].lower() for m in _WORD.finditer(token)]
        strange = (self.words.get(w, 0) < FAMILIAR * self.texts or w in self.narrow for w in found if not w.isascii())
        return not found or any(strange) or all(w.isascii() for w in found)

    def _as_multi(self, token: str) -> Iterator[tuple[str, float]]:
        """Readings of a token as East Asian text that was read with an encoding of single bytes, and the gain that each
        must have: the fewer characters, the easier they come about by chance."""
        tried = set()
        for wrong in SINGLE:
            table = _bytes_of(wrong)
            if any(c not in table for c in token):
                continue
            raw = bytes(table[c] for c in token)
            if raw in tried:
                continue
            tried.add(raw)
            for right in MULTI:
                try:
                    read = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                odd = [c for c in read if c > "\x7f"]
                if len(odd) >= 2 and sum(c in self.log_char for c in odd) >= 0.9 * len(odd):
                    yield read, max(0.0, 6.0 * (4 - len(odd)))

    def _as_shifted(self, token: str) -> Iterator[str]:
        """Readings of a token with shift sequences of an encoding of seven bits that was read as ASCII."""
        for encoding, pattern in _SHIFTED.items():
            if pattern.search(token):
                try:
                    read = token.encode("ascii").decode(encoding)
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                odd = {c for c in read if c > "\x7f"}
                if odd and odd <= self.log_char.keys() and "\x1b" not in read:
                    yield read

    def under(self, pair: Pair, token: str, near: bool) -> str | None:
        """The reading of a token as text in the first encoding that was read with the second, where other tokens of its text
        are such; near: also its neighbours, so that it need not be odd by itself. None if it isn't likely."""
        right, wrong = pair
        if right == "utf-8":
            read = self._utf8_from(token, wrong)
        else:
            table = _swap(right, wrong)
            read = token.translate(table) if all(ord(c) in table for c in token if c > "\x7f") else None
        if read is None or read == token:
            return None
        before = {m[0].lower() for m in _WORD.finditer(token)}
        if before and not any(map(str.isalpha, read)) and all(len(w) < 2 or w in self.words for w in before):
            return None  # a word as it stands
        gain = self.score(read) - self.score(token, own=True)
        fresh = [m[0].lower() for m in _WORD.finditer(read) if m[0].lower() not in before]
        known = all(len(w) < 2 or w in self.words for w in fresh)
        if near:
            return read if gain > 0 or known and gain > -NEAR else None
        return read if known and gain > 0 and any(len(w) > 2 for w in fresh) and self._suspect(token) else None

    def restore(self, token: str) -> tuple[str, bool, frozenset[Pair]]:
        """(the most probable original of a token, whether the token is garbled, the encodings that it may have been written
        in and read with)"""
        known = self._memo.get(token)
        if known is None:
            known = self._restore(token)
            if len(self._memo) > 100_000:
                self._memo.clear()
            if len(token) <= self.REMEMBERED:
                self._memo[token] = known
        return known

    def _restore(self, token: str) -> tuple[str, bool, frozenset[Pair]]:
        garbled = LOST in token or bool(_C1.search(token))
        now, before = token, {token}
        pairs: frozenset[Pair] = frozenset()
        while True:  # a text can be garbled more than once
            own = self.score(now, own=True)
            best, gain = None, 0.0
            readings: list[tuple[str, Pair]] = []
            for read, pair in self._as_utf8(now):
                readings += [(read, pair)] if pair else []
                if (g := self.score(read) - own - self._novelty(read, now)) > gain or LOST in read and LOST not in now and best is None:
                    best, gain = read, max(g, gain)
            for read, least in self._as_multi(now):
                if (g := self.score(read) - own) > max(gain, least):
                    best, gain = read, g
            for read in self._as_shifted(now):
                if "\x1b" in now or self._known(read, now):
                    best, gain = read, math.inf
            if self._suspect(now):
                mixed = bool(_MIXED.search(now))
                for read, pair in self._as_single(now):
                    readings.append((read, pair))
                    g = self.score(read) - own
                    if g > max(gain, 3.0) and self._known(read, now) or mixed and g > max(gain, 1.5) and not _MIXED.search(read):
                        best, gain = read, g
            if best is None and _C1.search(now):
                plain = now.translate(_swap("cp1252", "iso8859-15") | {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)})
                best = plain if plain != now and LOST not in plain else None
            if best is None or best in before:
                break
            if now == token:
                pairs = frozenset(pair for read, pair in readings if read == best)
            now, garbled = best, True
            before.add(now)
        if LOST in now:
            now = re.sub(
                rf"[\w'’{LOST}]*{LOST}[\w'’{LOST}]*",
                lambda m: _like(self.skeletons.get(m[0].lower(), m[0]), m[0]),
                now,
            )
        return now, garbled, pairs


def _like(word: str, model: str) -> str:
    if model.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def _by_neighbours(model: Model, tokens: list[re.Match], found: list[tuple[str, bool, frozenset[Pair]]]) -> None:
    """Use the encodings of garbled tokens for the others: a text is mostly garbled in one way, and as a stretch."""
    votes = Counter(pair for _, garbled, pairs in found if garbled for pair in pairs)
    for pair, n in votes.most_common(3):
        if n < votes.most_common(1)[0][1] / 4:
            break
        for i, (_, garbled, pairs) in enumerate(found):
            if garbled and pairs and pair not in pairs and sum(votes[p] for p in pairs) < n:
                if read := model.under(pair, tokens[i][0], True):
                    again, more, _ = model.restore(read)
                    found[i] = (again if more else read, True, frozenset((pair,)))
        for order in (range(len(found)), range(len(found) - 1, -1, -1)):
            last: int | None = None
            for i in order:
                token = tokens[i]
                if not found[i][1]:
                    gap = STRETCH + 1 if last is None else max(token.start() - tokens[last].end(), tokens[last].start() - token.end())
                    if read := model.under(pair, token[0], gap <= STRETCH):
                        found[i] = (read, True, frozenset((pair,)))
                if found[i][1] and pair in found[i][2]:
                    last = i


def restore_text(model: Model, text: str) -> tuple[str, int]:
    """(the text with its garbled tokens restored, how many there were)"""
    tokens = list(_ODD.finditer(text))
    found = [model.restore(m[0]) for m in tokens]
    if any(pairs for _, garbled, pairs in found if garbled):
        _by_neighbours(model, tokens, found)
    out, at = [], 0
    for m, (read, garbled, _) in zip(tokens, found):
        if garbled:
            out += [text[at : m.start()], read]
            at = m.end()
    restored, spans = "".join([*out, text[at:]]), sum(garbled for _, garbled, _ in found)

    def one(m: re.Match) -> str:
        nonlocal spans
        read, garbled, _ = model.restore(m[0]) if m[0].isascii() and _SHIFT.search(m[0]) else (m[0], False, None)
        spans += garbled
        return read if garbled else m[0]

    return (_TOKEN.sub(one, restored) if _SHIFT.search(restored) else restored), spans


#: The model that a Python worker holds, and what it was made of
_held: list = [None, None]


def _model(units: tuple) -> Model:
    if _held[0] is not units:
        _held[:] = units, Model(*units)
    return _held[1]


def garbled_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document with at least one garbled stretch: doc_id, n_spans, restored (what can't be restored stays).

    Null and empty texts give no row, nor does plain ASCII without shift sequences; copies are judged alike, each on its
    own. The language model comes from all documents. Its words are limited by MIN_SHARE, so it can be sent to every task,
    where each Python worker makes it once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = shared_path(spark, "units")  # several steps read it
    corpus_units(docs, text).write.parquet(path)
    units = spark.read.parquet(path)
    total = units.where("kind = 't'").first()
    texts = total.n if total else 0
    least = max(2, math.ceil(MIN_SHARE * texts))
    hot = (F.col("n") >= max(2.0, FAMILIAR * texts)) & ~F.col("wide")
    model = spark.sparkContext.broadcast(
        (
            {r.unit: r.n for r in units.where((F.col("kind") == "w") & (F.col("n") >= least)).toLocalIterator()},
            {r.unit: r.n for r in units.where("kind = 'c'").toLocalIterator()},
            texts,
            frozenset(r.unit for r in units.where((F.col("kind") == "w") & hot).toLocalIterator()) if total and total.wide else frozenset(),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _model(model.value)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                restored, spans = restore_text(search, body)
                if spans:
                    rows.append((key, spans, restored))
            ids, spans_, restored_ = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(spans_, pa.int32()), pa.array(restored_, pa.string())],
                ["doc_id", "n_spans", "restored"],
            )

    odd = docs.where(F.col(text).rlike(r"[^\x00-\x7f]|\x1b\$|\+[A-Za-z0-9+/]{3,}-")).select("doc_id", F.col(text).alias("_text"))
    return spread(odd).mapInArrow(run, "doc_id bigint, n_spans int, restored string")
