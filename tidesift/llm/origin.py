"""Source files that nobody wrote by hand here: generated, minified, vendored, or bulk data saved as code.

One pass over the files gives each a row of layout statistics, which thresholds per language turn into minified, bulk
data or generated. Layout can't tell a vendored file, as it looks like any other: it is one whose text, its head comment
aside, is that of files of other owners, nearly or quite. What the head comment says of the file's origin, and a folder
for foreign code, are taken besides, for libraries that a single owner carries.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidesift.llm.files import map_files
from tidesift.session import BROADCAST_LIMIT_BYTES, plan_bytes, shared_path, ship_package, small_side, spread
from tidesift.sources.texts import decode_text

SUFFIXES = (".py", ".js")


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language. Lengths are in characters, shares of the text."""

    #: minified: lines are long on average and at most, white space is rare, and letters and digits aren't all there is
    mean_line: float
    max_line: float
    white: float
    alnum: float = 0.75
    #: data: share of encoded runs and lines of literals, or density of numeric literals among what isn't white space
    data: float = 0.6
    numbers: float = 0.42
    data_least: int = 200
    #: generated: lines that count up from the one of the same shape before (share of lines, and their number)
    counting: float = 0.4
    counting_least: int = 6


LAYOUTS = {
    ".py": Layout(mean_line=60, max_line=120, white=0.19),
    ".js": Layout(mean_line=120, max_line=300, white=0.13),
}

_STRING_BODY = re.compile(r"\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'")
# by byte of a text in UTF-8: 1 for white space, 2 for letters (all bytes beyond ASCII among them), 3 for digits, else 0
_CLASSES = np.array(
    [2 if b > 127 or chr(b).isalpha() else 3 if chr(b).isdigit() else 1 if chr(b).isspace() else 0 for b in range(256)], dtype=np.uint8
)
#: Numeric literals are looked for where at least this share of what isn't white space are digits; even hexadecimal ones
#: that are dense have more.
_FEW_DIGITS = 0.1
_NUMBER = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)(?![\w.])")
_ENCODED = re.compile(r"(?:[A-Za-z0-9+/=_-]|\\x[0-9a-fA-F]{2}){40,}")
_LITERAL = re.compile(
    r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)(?![\w.])"
    r"|[bB]?\"[^\"\s]*\"|[bB]?'[^'\s]*'|\b(?:None|True|False|null|true|false)\b"
)
_NOT_LITERAL = re.compile(r"[A-Za-z_\"']")
_DIGITS, _DIGIT = re.compile(r"\d+"), re.compile(r"\d")
_QUOTE_OR_DIGIT = re.compile(r"[\"'\d]")
_LONG = re.compile(r"\S{40}")
_QUOTED_WORD = re.compile(r"(?<=[\"'])[A-Za-z_]+")


# fixed values: how a line may start that is a literal, though with a letter
_LETTERED = ("None", "True", "False", "null", "true", "false", 'b"', "b'", 'B"', "B'")


def data_share(lines: list[str]) -> float:
    """Of the characters that aren't white space, those in encoded runs and in lines of nothing but literals."""
    bare = [line.strip() for line in lines]
    total = sum(map(len, bare))
    held = 0
    for line in bare:
        size = len(line)
        runs = sum(len(r) for r in _ENCODED.findall(line)) if size >= 40 and _LONG.search(line) else 0
        first = line[:1]
        if runs * 2 > size:
            held += size
        elif (first.isalpha() or first == "_") and not line.startswith(_LETTERED):
            held += runs
        elif _QUOTE_OR_DIGIT.search(line) and not _NOT_LITERAL.search(_LITERAL.sub("", line)):
            held += size
        else:
            held += runs
    return held / total if total else 0.0


def counting_lines(lines: list[str]) -> int:
    """How many lines have a number that is one more than in the line of the same shape before it."""
    before: dict[str, str] = {}
    hits = 0
    numbered = [line for line in lines if _DIGIT.search(line)]
    shapes = _QUOTED_WORD.sub("s", _DIGITS.sub("0", "\n".join(numbered))).split("\n")
    for line, shape in zip(numbered, shapes):
        last = before.get(shape)
        if last is not None and any(map(_follows, _DIGITS.findall(last), _DIGITS.findall(line))):
            hits += 1
        before[shape] = line
    return hits


def _follows(a: str, b: str) -> bool:
    """Whether a row of digits is one more than another, by their ends first: long ones are no numbers that are read."""
    if a[-1] != "9":
        return len(a) == len(b) and a[:-1] == b[:-1] and ord(b[-1]) == ord(a[-1]) + 1
    head = a.rstrip("9")
    nines = len(a) - len(head)
    if b[len(b) - nines :] != "0" * nines:
        return False
    return b[: len(b) - nines] == "1" if not head else len(a) == len(b) and b[: len(head) - 1] == head[:-1] and ord(b[len(head) - 1]) == ord(head[-1]) + 1


# fixed values: what head comments of generated files say. A sentence about something else may hold single words of it,
# so each pattern takes the whole formula.
GENERATED = re.compile(
    r"""(?imx)
    ^\W*@generated\b | <auto-?generated\b
    | \b(?:auto-?|automatically\s+|machine[-\s]?)generated\s+(?:by|from|with|using|code|file|on|at|,|\.|-|$)
    | ^\W*(?:this\s+(?:file|code|module)\s+(?:is|was|has\s+been)\s+)?(?:automatically\s+)?
      (?:generated|produced|created|built|written|emitted|compiled)\s+(?:automatically\s+)?(?:by|from|with|using)\s+\S
    | \b(?:code|file|module|bindings?)\s+(?:was\s+|is\s+)?(?:automatically\s+)?(?:generated|produced)\s+(?:automatically\s+)?(?:by|from)\b
    | \bmachine[-\s]written\b | \bchanges\s+will\s+be\s+(?:lost|overwritten)\b
    | \b(?:do\s+not|don't)\s+(?:edit|modify|change)\s*(?:[.!;]|$|\bby\s+hand|\bmanually|\bdirectly|\bthis\s+file)
    | \bregenerate\s+with\b | ;\s*edit\s+the\s+\S+\s+(?:template|source|schema|spec|definition|instead)
    | ^\W*source:\s*\S+\.(?:proto|idl|xsd|thrift|fbs|avsc|wsdl|ya?ml|json|g4|y|l|pyx)\b
    | \bautomatisch\s+(?:erzeugt|generiert|erstellt) | \bnicht\s+von\s+hand\s+(?:ändern|bearbeiten)
    | \b(?:généré|produit)\s+(?:automatiquement\s+)?par\b | \bne\s+pas\s+modifier\b
    | \b(?:generado|gerado)\s+(?:automáticamente|automaticamente|por)\b | \bsgenerowan\w+\s+automatycznie
    | \bавтоматически\s+(?:создан|сгенерирован)\w* | 自動生成
    """
)
# fixed values: what head comments of files from elsewhere say
TAKEN = re.compile(
    r"""(?imx)
    \b(?:copied|taken(?:\s+over)?|imported|vendored|adapted|borrowed|ported|forked|bundled)\s+(?:\w+\s+){0,2}(?:from|with)\s+(?:the\s+)?(?P<lib>[\w.-]+)
    | \b(?:bundled|vendored|local|verbatim|unmodified)\s+copy\b
    | \bupstream:\s*\S | \bupstream\s+(?:commit|version|revision)\b
    | \bredistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms\b
    """
)
_HOLDER = re.compile(
    r"(?im)copyright\s+(?:\(c\)|©)?\s*[\d,\s–-]*\s*(?:by\s+)?(?:the\s+)?(?P<holder>[\w.-]+)\s+(?:developers|contributors|authors|project|team|foundation)\b"
)
# fixed values: folders that hold what others wrote
FOREIGN = (
    "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "vendor", "_vendor", "vendored", "_vendored",
    "extern", "external", "externals", "node_modules", "bower_components", "site-packages", "bundled",
)

_HEAD_PY = re.compile(r"(?:\s*#[^\n]*\n?|\s*\n)*(?:\s*[rRuU]?(\"\"\"|''')(.*?)\1)?", re.S)
_HEAD_JS = re.compile(r"(?:\s*//[^\n]*\n?|\s*/\*.*?\*/|\s*\n)*", re.S)


def head_comment(text: str, suffix: str) -> str:
    """The comments and the docstring before the first code."""
    m = (_HEAD_PY if suffix == ".py" else _HEAD_JS).match(text)
    return m[0] if m else ""


#: The statistics of a file, in the order in which they are asked for
STATISTICS = ("mean_line", "max_line", "white", "alnum", "numbers", "data", "counting")


def _measured(text: str, lines: list[str]) -> dict[str, float]:
    raw = np.frombuffer(text.encode("utf-8", "ignore"), dtype=np.uint8)
    _, white, letters, digits = (np.bincount(_CLASSES[raw], minlength=4) / max(1, len(raw))).tolist()
    black = max(1.0, len(raw) * (1 - white))
    return {
        "mean_line": sum(map(len, lines)) / max(1, len(lines)),
        "max_line": float(max(map(len, lines), default=0)),
        "white": white,
        "alnum": letters + digits,
        "numbers": sum(map(len, _NUMBER.findall(text))) / black if digits * len(raw) >= _FEW_DIGITS * black else 0.0,
    }


def _is_minified(stats: dict[str, float], limits: Layout) -> bool:
    long = stats["mean_line"] >= limits.mean_line and stats["max_line"] >= limits.max_line
    return long and stats["white"] <= limits.white and stats["alnum"] <= limits.alnum


def layout_kind(text: str, suffix: str) -> tuple[str | None, dict[str, float]]:
    """(minified, data_blob, generated or None by layout alone, the statistics); those that an earlier one decided
    before are missing. A long text or icon in a string isn't how code is laid out, so the limits of minified files must
    hold with the strings emptied too."""
    limits = LAYOUTS[suffix]
    lines = [x for x in text.split("\n") if x.strip()]
    stats = _measured(text, lines)
    if len(text) >= limits.data_least and stats["numbers"] >= limits.numbers:
        return "data_blob", stats
    if stats["mean_line"] >= limits.mean_line and stats["max_line"] >= limits.max_line:
        bare = _STRING_BODY.sub('""', text)
        if _is_minified(_measured(bare, [x for x in bare.split("\n") if x.strip()]), limits):
            return "minified", stats
    stats["data"] = data_share(lines) if len(text) >= limits.data_least else 0.0
    if stats["data"] >= limits.data:
        return "data_blob", stats
    hits = counting_lines(lines)
    stats["counting"] = hits / max(1, len(lines))
    if hits >= limits.counting_least and stats["counting"] >= limits.counting:
        return "generated", stats
    return None, stats


def head_kind(text: str, suffix: str) -> tuple[str | None, str]:
    """(generated, vendored or None by the head comment, the library or the copyright holder that it names)"""
    head = head_comment(text, suffix)
    if not head:
        return None, ""
    if GENERATED.search(head):
        return "generated", ""
    if m := TAKEN.search(head):
        return "vendored", (m["lib"] or "").strip(".-").lower()
    if m := _HOLDER.search(head):
        return "vendored", m["holder"].lower()
    return None, ""


@dataclass(frozen=True)
class Likeness:
    """Two texts are alike if of their different runs of `words` words at least `share` are in both. Texts that share a
    band of `rows` least hashes of `bands` are compared first, which settles most near copies; what is alike without that
    is found by the runs themselves. Texts of fewer than `least` different runs are too common to be anybody's."""

    words: int = 5
    share: float = 0.8
    bands: int = 12
    rows: int = 4
    least: int = 20


_WORD = re.compile(r"\w+")
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Numbers(dict):
    """Words as numbers; a task sees the same ones again and again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = number = zlib.crc32(word.encode("utf-8", "ignore"))
        return number


_numbers = _Numbers()


def _runs(found: list[str], like: Likeness) -> np.ndarray:
    words = np.fromiter(map(_numbers.__getitem__, found), dtype=np.uint64, count=len(found))
    n = len(words) - like.words + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(like.words):
        out = (out ^ words[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingles(text: str, like: Likeness) -> np.ndarray:
    """The different runs of words of a text, as hashes."""
    return _runs(_WORD.findall(text), like)


def _has_least(text: str, like: Likeness) -> bool:
    """Whether a text has `least` different runs, which its first words mostly tell."""
    few = [m[0] for m in islice(_WORD.finditer(text), 4 * (like.least + like.words))]
    return len(_runs(few, like)) >= like.least or len(shingles(text, like)) >= like.least


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return np.random.RandomState(20).randint(0, 2**63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, like: Likeness) -> list[int]:
    """A number for each band of the least hashes of a text."""
    factors = _factors(like.bands * like.rows)
    least = np.full(len(factors), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        rows = hashes[at : at + 4096, None] * factors
        rows ^= rows >> np.uint64(31)
        rows *= _MIX
        least = np.minimum(least, rows.min(axis=0))
    keys = np.arange(1, like.bands + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(like.bands, like.rows).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist()


def body(text: str, suffix: str) -> str:
    """A file's text without its head comment, which may name who carries it and what was changed."""
    return text[len(head_comment(text, suffix)) :]


def _digest(text: str) -> tuple[int, int]:
    raw = hashlib.md5(text.strip().encode("utf-8", "ignore")).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def foreign_library(path: str) -> bool:
    """Whether a path lies below a folder for foreign code."""
    return any(p in FOREIGN for p in path.lower().split("/")[:-1])


def file_evidence(files: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row per `.py` and `.js` file, from one pass: file_id, owner (hashed), kind by layout, head or folder (or
    null), and for texts that may be carried along d1, d2 (their digest). A head that names its own owner isn't foreign."""

    def one(key: int, text: str | None, suffix: str, target: str | None, path: str | None) -> Iterator[tuple]:
        owner = (target or "").split("/")[0].lower()
        number = _digest(owner)[0]
        kind, head, named, d1, d2 = None, None, "", None, None
        if text is not None:
            kind, _ = layout_kind(text, suffix)
            head, named = head_kind(text, suffix)
        if kind is None and head == "generated":
            kind = "generated"
        original = head == "vendored" and named == owner
        if kind is None and text is not None and not original:
            own = body(text, suffix)
            if _has_least(own, like):
                d1, d2 = _digest(own)
        if kind is None and (head == "vendored" and not original or foreign_library(path or "")):
            kind = "vendored"
        yield key, number, kind, d1, d2

    schema = "file_id bigint,owner bigint,kind string,d1 bigint,d2 bigint"
    return map_files(files, SUFFIXES, one, schema, ("suffix", "target", "rel_path"), nulls=True)


def file_layout(files: DataFrame) -> DataFrame:
    """One row of layout statistics per `.py` and `.js` file: file_id and STATISTICS. data and counting are null where an
    earlier statistic decided."""

    def one(key: int, text: str, suffix: str) -> Iterator[tuple]:
        _, stats = layout_kind(text, suffix)
        yield key, *(stats.get(x) for x in STATISTICS)

    return map_files(files, SUFFIXES, one, "file_id bigint," + ",".join(f"{x} double" for x in STATISTICS), ("suffix",))


def _alike(pairs: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """a and b of those pairs of file_ids whose texts are alike."""
    ship_package(files.sparkSession)
    named = pairs.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
    texts = files.select("file_id", "content", "suffix").join(small_side(named), "file_id", "left_semi")
    both = pairs.join(texts.select(F.col("file_id").alias("a"), F.col("content").alias("ca"), F.col("suffix").alias("sa")), "a").join(
        texts.select(F.col("file_id").alias("b"), F.col("content").alias("cb"), F.col("suffix").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ca, sa, cb, sb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = shingles(body(decode_text(ca), sa), like), shingles(body(decode_text(cb), sb), like)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= like.share * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.select("a", "b", "ca", "sa", "cb", "sb").mapInArrow(run, "a bigint, b bigint")


def _text_runs(texts: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """A row per text and different run of words: run, file_id, owner (null for a text of several), as one shuffle.

    A run is the upper 40 bits of its hash. Two that fall together count as one that both texts have, and both stay, so
    pairs may be compared needlessly but none is lost.
    """
    ship_package(files.sparkSession)
    owned = texts.select("file_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("owner"))
    kept = spread(files.where("content is not null").select("file_id", "content", "suffix")).join(small_side(owned), "file_id")
    kept = kept.select("file_id", "owner", "content", "suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # so many texts' runs are held at once
                part = batch.slice(at, 500)
                found = [shingles(body(decode_text(c.as_py()), s.as_py()), like) >> np.uint64(24) for c, s in zip(part.column(2), part.column(3))]
                of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                runs = pa.array(np.concatenate(found).astype(np.int64))
                yield pa.RecordBatch.from_arrays([runs, part.column(0).take(of), part.column(1).take(of)], ["run", "file_id", "owner"])

    # joins infer this condition; as all uses have it, they share one shuffle
    return kept.mapInArrow(run, "run bigint, file_id bigint, owner bigint").where("file_id is not null").repartition("run")


def _of_several(same: WindowSpec) -> Column:
    """Whether the rows of a window are of more than one owner."""
    several = (F.min("owner").over(same) != F.max("owner").over(same)) | (F.count("owner").over(same) < F.count(F.lit(1)).over(same))
    return F.coalesce(several, F.lit(True))


def _deciding_runs(texts: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """run, file_id, owner: for each text that can be like one of another owner, runs of which each such text has one too.

    Texts that are alike have at least `share` of their runs in common, so at least that many of a text's runs are in
    texts of other owners. Most hand-written texts end here. Of the n such runs of one that is left, s of which must be
    common, any n - s + 1 that are first in an order hold a common one, if all texts are put in the same order: the
    rarest first.
    """
    runs, same = _text_runs(texts, files, like), Window.partitionBy("run")
    left = (
        runs.withColumn("_shared", _of_several(same))
        .groupBy("file_id")
        .agg(F.ceil(F.count(F.lit(1)) * F.lit(like.share) - F.lit(1e-6)).alias("_needed"), F.count_if("_shared").alias("_n"))
        .where("_n >= _needed")
        .select("file_id", "_needed")
    )
    if plan_bytes(texts.select("file_id", "low")) <= BROADCAST_LIMIT_BYTES:  # left has no more rows than these
        left = left.hint("broadcast")
    text = Window.partitionBy("file_id")
    return (
        runs.join(left, "file_id")
        .withColumn("_shared", _of_several(same))
        .withColumn("_held", F.count(F.lit(1)).over(same))
        .where("_shared")
        .withColumn("_n", F.count(F.lit(1)).over(text))
        .withColumn("_at", F.row_number().over(text.orderBy("_held", "run")))
        .where("_at <= _n - _needed + 1")
        .select("run", "file_id", "owner")
    )


def _band_pairs(texts: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """a and b: each text of one owner with the one of the least, or else greatest, owner of each of its bands. Bands are
    combined before they are shuffled, so a group of any size costs one row a task and no pairs."""

    def one(key: int, text: str, suffix: str, low: int, high: int) -> Iterator[tuple]:
        for band in band_keys(shingles(body(text, suffix), like), like):
            yield key, low, high, band

    owned = files.select("file_id", "content", "suffix").join(small_side(texts), "file_id")
    keyed = _table(map_files(owned, SUFFIXES, one, "file_id bigint,low bigint,high bigint,key bigint", ("suffix", "low", "high")), "origin-bands")
    groups = (
        keyed.groupBy("key")
        .agg(
            F.min("low").alias("g_low"), F.max("high").alias("g_high"),
            F.min_by("file_id", "low").alias("f_low"), F.max_by("file_id", "high").alias("f_high"),
        )
        .where("g_low <> g_high")
    )
    other = F.when(F.col("g_low") != F.col("low"), F.col("f_low")).otherwise(F.col("f_high"))
    return keyed.where("low = high").join(groups, "key").select(F.col("file_id").alias("a"), other.alias("b")).distinct()


def _other_pairs(deciding: DataFrame, settled: DataFrame) -> DataFrame:
    """a and b: all pairs of texts of different owners that can be alike and of which one isn't settled yet."""
    a = deciding.where("owner is not null").join(small_side(settled), "file_id", "left_anti")
    a = a.select("run", F.col("file_id").alias("_a"), F.col("owner").alias("_oa"))
    b = deciding.select("run", F.col("file_id").alias("_b"), F.col("owner").alias("_ob"))
    pairs = a.join(b, "run").where(~F.col("_oa").eqNullSafe(F.col("_ob")))
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def _alike_texts(pairs: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """file_id of the texts of those pairs that are alike, as a table of its own."""
    pairs = _table(pairs, "origin-pairs")  # as a table its size is known, and only its files are moved
    return _table(_alike(pairs, files, like).select(F.explode(F.array("a", "b")).alias("file_id")).distinct(), "origin-alike")


def _table(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def carried_texts(evidence: DataFrame, files: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """d1 and d2 of the texts that files of different owners hold, quite or nearly.

    Copies of a text become one row with the least and greatest owner, combined before they are shuffled. Texts whose runs
    are mostly one owner's alone go out. Near copies are first looked for among few texts a band, so that a library that
    thousands carry needs no pairs of all with all; each text that this doesn't settle is compared with all that can be
    like it. The words decide in both.
    """
    texts = evidence.where("d1 is not null").groupBy("d1", "d2")
    texts = _table(texts.agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.min("file_id").alias("file_id")), "origin-texts")
    deciding = _table(_deciding_runs(texts, files, like), "origin-runs")
    left = _table(texts.select("file_id", "low", "high").join(small_side(deciding.select("file_id").distinct()), "file_id", "left_semi"), "origin-left")
    settled = _alike_texts(_band_pairs(left, files, like), files, like)
    nearly = settled.unionByName(_alike_texts(_other_pairs(deciding, settled), files, like)).distinct()
    return texts.where("low <> high").select("d1", "d2").unionByName(texts.join(nearly, "file_id", "left_semi").select("d1", "d2")).distinct()


def judged_files(files: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row per `.py` and `.js` file: file_id and kind, null for hand-written source.

    A file has one kind, by the first that holds: minified, bulk data or generated by layout, generated by its head,
    vendored by its head or folder, vendored by a text that other owners have too. A file whose head names its own owner
    isn't foreign. Null content is judged by its path alone; an empty file is nobody's work and is vendored only below a
    folder for foreign code. Files delivered twice are judged each. A text that one owner alone carries, without a word
    on its origin, can't be told from that owner's own.
    """
    evidence = _table(file_evidence(files, like), "origin")  # several steps read it
    carried = carried_texts(evidence, files, like).withColumn("_carried", F.lit("vendored"))
    judged = evidence.select("file_id", "kind", "d1", "d2").join(small_side(carried), ["d1", "d2"], "left")
    return judged.select("file_id", F.coalesce("kind", "_carried").alias("kind"))


def foreign_files(files: DataFrame) -> DataFrame:
    """One row per `.py` or `.js` file that isn't hand-written here: file_id, kind. See judged_files."""
    return judged_files(files).where("kind is not null")
