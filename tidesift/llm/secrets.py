"""Credentials written into source and configuration files, and their redaction.

Places where a value is given to something named like a credential (or sent as one) yield literals. Each literal is cut
into dictionary words by a Viterbi search, with the words of the corpus itself as the dictionary; what the words leave
unexplained is the residual. A long residual is a secret, unless it is a placeholder, a reference or a known format of
digests and identifiers.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.llm.files import map_files
from tidesift.session import ship_package
from tidesift.sources.texts import decode_text
from tidesift.sources.tree import TEXT_SUFFIXES

# fixed values: words that name credentials, in several languages, and words that only do beside one of the second list
NAMES = set(
    "password passwd passwort pwd pw pass passphrase passcode kennwort losung clave contrasena contraseña senha motdepasse mdp "
    "haslo hasło пароль wachtwoord secret token apikey accesskey secretkey authtoken bearer credential credentials "
    "signingkey servicekey deploykey privatekey authkey masterkey auth authorization".split()
)
KEYS = set("key cle clé schluessel schlüssel llave clave chave klucz".split())
BESIDE_KEYS = set(
    "api access auth secret service signing sign deploy private encryption master account client storage webhook hub "
    "session admin app x license server ssh".split()
)
# fixed values: last words of names that hold something about a credential, not the credential
ABOUT = set(
    "env file path url uri name id ids len length count counter type field fields var variable header label prompt hint help "
    "policy min max regex pattern re length_ timeout ttl expires expiry expiration age class_ algorithm alg provider "
    "store manager source location dir hash digest sha sha256 md5 fingerprint checksum izer".split()
)
# fixed values: names whose values are digests, versions or identifiers
NOT_SECRET = re.compile(
    r"(?i)etag|commit|sha\d*\b|sha_?\d|md5|digest|checksum|hash|uuid|guid|fingerprint|revision|\brev\b|integrity|nonce|salt|"
    r"thumb|image|icon|public|pub_?key|version|build|tokenizer|model"
)
# fixed values: words of placeholders, known without a corpus
PLACEHOLDER_WORDS = (
    "your my here insert replace with change changeme me this todo dummy example examples redacted placeholder fill fixme "
    "tbd none null nil undefined test testing sample fake mock default value values secret token key api password passwd "
    "pwd pass passphrase user username login admin root host access auth bearer client service signing hub zugangs "
    "kennwort clave cle smtp database db mail the a an in is from of to for and or not set get enter put add some any "
    "ask owner removed hidden masked censored xxx xxxx foo bar baz string text env environment variable vault keyring config "
    "settings hunter demo empty missing unset required optional see docs readme use own real new old"
).split()
# fixed values: ways of authentication, which stand before a value
SCHEMES = {"basic", "bearer", "token", "digest", "negotiate", "apikey", "oauth", "hmac"}
# fixed values: forms of tokens that issuers publish
ISSUED = re.compile(
    r"(?<![\w+/-])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w+/])"
    r"|(?<![\w-])(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}|(?<![\w-])github_pat_\w{30,}|(?<![\w-])glpat-[\w-]{18,}"
    r"|(?<![\w-])sk-[A-Za-z0-9_-]{20,}|(?<![\w-])hf_[A-Za-z0-9]{30,}|(?<![\w-])xox[abeprs]-[\w-]{10,}"
    r"|(?<![\w-])[rsp]k_(?:live|test)_[A-Za-z0-9]{16,}|(?<![\w-])AIza[\w-]{35}|(?<![\w-])SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|(?<![\w-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|(?<![\w-])(?:npm|pypi)[_-][A-Za-z0-9_-]{30,}"
)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# header lines of an armor, as `Version: 1` or `DEK-Info: ...`, between its first line and its body
_PEM_HEADERS = re.compile(r"(?:(?:\\n|[\s#\"'|>*/,+\\])*[A-Z][A-Za-z0-9-]*:[ \t](?:(?!\\n)[^\n])*)*+")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=]|\\n|[\s#\"'|>*/,+\\])*")
_URL_LOGIN = re.compile(r"\b[a-z][a-z0-9+.-]{0,30}://[^\s/:@\"'<>{}]*+:(?P<v>[^\s/@\"'<>]++)@(?=[\w\[{$.-])", re.I)
_QUERY = re.compile(
    r"[?&;](?:(?:access|auth|api|id|refresh)[_-]?)?(?:token|key|sig|signature|secret|password|passwd|pwd|apikey|auth)=(?P<v>[^\s&\"'<>#`)\]]++)",
    re.I,
)
_SENT = re.compile(r"\b(?P<how>Bearer|Basic|Token|ApiKey)\s++(?P<v>[^\s\"'`,;)\]}]++)", re.I)
# only from the start of a word, and nothing that was read is given back, so that long lines are read once
_NAME = r"(?<![\w.-])-{0,2}(?P<n>[^\W\d][\w.-]*+)"
_STRING = r"(?P<p>[rRbBuUfF]{0,2})(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q)"
_GIVEN = re.compile(
    _NAME + r"[\"'`]?+\s*+\]?+\s*+(?::\s*+\w++\s*+=|=>|:=|=(?!=)|:(?!:))\s*+(?:\w++\s*+\+\s*+)?+(?P<call>[\w.]*+\(\s*+)?+" + _STRING
)
_DEFAULT = re.compile(
    r"(?:environ\.get|getenv|env|\.get|\.pop|config)\(\s*+[\"']" + _NAME + r"[\"']\s*+,\s*+(?:default\s*+=\s*+)?+" + _STRING
)
_BARE = re.compile(_NAME + r"[\"'`]?+\s*+(?:=(?!=)|:(?![:/]))\s*+(?P<v>[^\s\"'`(){}\[\]<>][^\s\"'`]*+)")
_SAID = re.compile(_NAME + r"\s++(?:is|was|ist|es|est|=|:)\s*+[\"'`]?+(?P<v>[^\s\"'`<>(){}]++)")
_BESIDE = re.compile(_NAME + r"\s++[`\"'](?P<v>[^\s`\"']++)[`\"']")
_TABLE = re.compile(r"\|\s*+`?+" + _NAME + r"`?+\s*+(?=\|\s*+`?+(?P<v>[^\s|`]++)`?+\s*+\|)")
_NETRC = re.compile(r"\blogin\s++\S++\s++(?P<n>password)\s++(?P<v>\S++)")
_OPENED = re.compile(_NAME + r"[\"'`]?+\s*+\]?+\s*+[=:]\s*+(?:\(|\\|[>|][-+]?\d?)?+\s*+$")
_COMPARED = re.compile(
    r"(?<![\w.\]\[\"'])(?P<n>[\w.\]\[\"']++)\s*+[!=]=\s*+" + _STRING
    + r"|compare_digest\(\s*+(?P<n2>[\w.]++)\s*+,\s*+b?+(?P<q2>[\"'])(?P<v2>(?:(?!(?P=q2)).)*+)(?P=q2)"
)
# a literal in the text, over several lines if its quotes are triple, and what may stand between two that are joined
_PIECE = re.compile(
    r"(?P<p>[rRbBuUfF]{0,2})(?:(?P<t>\"\"\"|''')(?P<w>(?s:\\.|(?!(?P=t)).)*+)(?P=t)|(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])*+)(?P=q))"
)
_PLUS = re.compile(r"[ \t]*(?:\\\n[ \t]*)?\+[ \t]*(?:\\?[ \t]*\n[ \t]*)?|[ \t]*\\\n[ \t]*")
_BREAK = re.compile(r"(?:\s|#[^\n]*\n)*+(?:\+(?:\s|#[^\n]*\n)*+)?")
# what a line with a credential holds, in lower case; some only with what stands around it
_HINTS = {
    **dict.fromkeys(
        "passw passp passc pwd kennwort losung clave contrase senha motdepasse mdp haslo hasło wachtwoord пароль secret token "
        "credential bearer apikey cle_ clé_ schl llave chave klucz api_ api- ?key &key ?sig &sig ?auth &auth compare_digest akia "
        "asia ghp_ gho_ ghu_ ghs_ ghr_ glpat- sk- hf_ xox _live_ _test_ aiza eyj npm_ pypi-".split()
    ),
    "basic ": None,
    "private key": None,
    "pass": r"pass\b[\"'\]]{0,2}\s*+[=:|`]|(?<=[_-])pass\b",
    "pw": r"\bpw\b",
    "auth": r"auth(?:orization)?[\"'\]]{0,2}\s*+[=:|`]",
    "key": r"key[\"'\]]{0,2}\s*+(?:[=:|`]\s*+(?!lambda)|is\b|$)",
    "://": r"://[^\s/:]*+:[^\s/@]*+@",
    "==": r"==\s*+b?+[\"']",
    "!=": r"!=\s*+b?+[\"']",
}


@lru_cache(maxsize=1)
def _hints() -> ahocorasick.Automaton:
    """The hints as one automaton, each with its length and what must stand around it."""
    found = ahocorasick.Automaton()
    for word, around in _HINTS.items():
        found.add_word(word, (len(word), around and re.compile(around)))
    found.make_automaton()
    return found


# fixed values: forms of digests and identifiers
_DIGEST = re.compile(r"(?i)(?:sha\d+[:-]|md5[:-])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?")
_REFERENCE = re.compile(
    r"\$\{|\$\(|^\$[A-Za-z_]\w*$|%\(\w+\)|%\w+%$|\{\{|\{%|\{\w*\}|^<[^>]*>$|^@?(?:vault|env|secret|secrets|file|ref|keyring|ssm|arn|op|kv)\b\s*[:/(]|"
    r"^(?:os\.|self\.|config|settings\.|args\.|process\.env|getpass|input\b|var\.|local\.|data\.)|^!\w+\s|^\(|\)$(?<=\(\))",
    re.I,
)
_FILLER = re.compile(r"^(?:(.)\1*|(?:\.{2,}|…|-+|_+|\*+)|(?:x|X|0|\*|•|#|-|_|\.|\s)+|(?:0?123456789?0?|abc(?:def)?\d*|12345+)|none|null|true|false|nil)$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_CAMEL = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-Z]+(?![a-z])|[^\W\d_]+|\d+")


def different_texts(files: DataFrame) -> DataFrame:
    """content and suffixes of the text files, each different content once: grouped by a digest, which moves each different
    content of a task once."""
    texts = files.where(F.col("suffix").isin(*TEXT_SUFFIXES) & F.col("content").isNotNull())
    digests = texts.select(F.sha2("content", 256).alias("_d"), "content", "suffix").groupBy("_d")
    return digests.agg(F.first("content").alias("content"), F.collect_set("suffix").alias("suffixes"))


def corpus_words(files: DataFrame) -> DataFrame:
    """word and n, the number of different text files that hold it outside of the literals at places for credentials, so
    that neither copies nor a repeated secret make a word; counted batch by batch before the counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Unexplained())
        for batch in batches:
            count: Counter[str] = Counter()
            for content, suffixes in zip(batch.column(0), batch.column(1).to_pylist()):
                text = finder.without_candidates(decode_text(content.as_py()), suffixes)
                count.update(set(_WORDS.findall(text.lower())))
            words, ns = zip(*count.items()) if count else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

    texts = different_texts(files).select("content", "suffixes")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """Words with their costs, and the cut of a literal into words and residuals."""

    #: What a character costs that no word explains, in nats
    RESIDUAL = 3.2
    #: Inside a run of letters a word has so many letters at least: shorter ones are found in any letters
    SHORTEST = 3

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values())) + len(PLACEHOLDER_WORDS)
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        for w in PLACEHOLDER_WORDS:
            self.cost[w] = min(self.cost.get(w, 99.0), math.log(total) if total < 1000 else 7.0)
        self.lengths = sorted({len(w) for w in self.cost if len(w) >= self.SHORTEST})

    def residual(self, literal: str, enough: int | None = None) -> int:
        """How many letters and digits the most probable cut of a literal into words leaves unexplained; words are made of
        letters, so each run of letters is cut by itself. Counting may end at enough."""
        text = literal.lower()
        total = sum(map(str.isdigit, text))
        for run in _LETTERS.findall(text):
            if enough is not None and total >= enough:
                break
            total += self._unexplained(run)
        return total

    def _unexplained(self, run: str) -> int:
        """Viterbi over a run of letters: a step is a word of the dictionary or one letter that none explains."""
        n = len(run)
        if n < self.SHORTEST:
            return 0 if run in self.cost else n
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(n):
            cost, rest = best[i]
            if cost + self.RESIDUAL < best[i + 1][0]:
                best[i + 1] = (cost + self.RESIDUAL, rest + 1)
            for size in self.lengths:
                j = i + size
                if j > n:
                    break
                w = self.cost.get(run[i:j])
                if w is not None and cost + w < best[j][0]:
                    best[j] = (cost + w, rest)
        return best[n][1]


class Unexplained(Dictionary):
    """No words, so that every letter and digit of a literal is residual."""

    def __init__(self) -> None:
        super().__init__({})

    def residual(self, literal: str, enough: int | None = None) -> int:
        return len(literal)


def is_credential_name(name: str) -> bool:
    """Whether something of this name holds a credential."""
    if NOT_SECRET.search(name) and not re.search(r"(?i)passw|secret", name):
        return False
    words = [w.lower() for part in re.split(r"[\W_]+", name) for w in _CAMEL.findall(part)]
    if not words:
        return False
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in ABOUT:
        return False
    joined = "".join(words)
    if words[-1] in NAMES or joined in NAMES or any(w in NAMES for w in words[-2:]):
        return True
    return any(w in KEYS for w in words) and any(w in BESIDE_KEYS for w in words)


@dataclass(frozen=True)
class Found:
    line: int
    begin: int
    end: int
    kind: str
    #: begins and ends of the further pieces of a value that is split
    more: tuple[tuple[int, int], ...] = ()


class Finder:
    """Finds the secrets of a text."""

    #: residual of a value in a place for credentials, of one that is only compared with, of a token in a form that issuers
    #: publish, and of a private key
    NAMED, COMPARED, ISSUED, KEY = 4, 16, 8, 40

    def __init__(self, dictionary: Dictionary):
        self.dictionary = dictionary

    def is_secret(self, value: str, least: int, named: bool = True) -> bool:
        value = value.strip()
        if len(value) < least or _FILLER.match(value) or _REFERENCE.search(value):
            return False
        if not named and _DIGEST.fullmatch(value):
            return False
        return self.dictionary.residual(value, least) >= least

    def find(self, text: str, suffix: str) -> list[Found]:
        """In order: line (from 1), begin and end of the value in the text, and the kind of place."""
        found: dict[tuple[int, int], tuple[str, list[tuple[int, int]]]] = {}
        taken: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b, kind, *more in self._places(text, suffix):
            spans = {(a, b), *more}
            known = {(x, y): s for x, y in spans for (v, w), s in taken.items() if x < w and v < y}
            key = next(iter(known.values()), (a, b))
            if known:  # a piece of a value that is already found
                found[key][1].extend(spans - set(known))
            else:
                found[key] = (kind, more)
            taken.update((span, key) for span in spans - set(known))
        lines, at, count = [], 0, 1
        for (a, b), (kind, more) in sorted(found.items()):
            count += text.count("\n", at, a)
            at = a
            lines.append(Found(count, a, b, kind, tuple(sorted(more))))
        return lines

    def without_candidates(self, text: str, suffixes: list[str]) -> str:
        """The text with a space for each value that is_secret takes for one under any of the suffixes."""
        out, at = [], 0
        places = (place for suffix in suffixes for place in self._places(text, suffix))
        for a, b in sorted(span for a, b, _, *more in places for span in ((a, b), *more)):
            if b > at:
                out += [text[at : max(a, at)], " "]
                at = b
        return "".join([*out, text[at:]])

    def _places(self, text: str, suffix: str) -> Iterator[tuple]:
        """Begin and end of each value, the kind of place, and begins and ends of the value's further pieces."""
        lower = text.lower()
        done = -1
        if len(lower) != len(text):  # a letter whose lower case is longer
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for last, (size, around) in _hints().iter(lower):
            start = last + 1 - size
            if start < done or around and not around.match(lower, start):
                continue
            begin = text.rfind("\n", 0, start) + 1
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            done = end
            yield from self._in_line(text, begin, end, suffix)

    def _in_line(self, text: str, begin: int, end: int, suffix: str) -> Iterator[tuple]:
        line = text[begin:end]
        if m := _PRIVATE.search(line):
            body = _PEM_BODY.match(text, _PEM_HEADERS.match(text, begin + m.end()).end())
            if self.dictionary.residual(re.sub(r"[^A-Za-z0-9+/]", "", body[0].replace("\\n", "")), self.KEY) >= self.KEY:
                last = _PRIVATE_END.match(text, body.end())
                yield begin + m.start(), last.end() if last else body.start() + len(body[0].rstrip(" \t\n\"'#|>*,\\")), "private key"
                return
        for m in ISSUED.finditer(line):
            if self.dictionary.residual(m[0], self.ISSUED) < self.ISSUED:
                continue
            yield begin + m.start(), begin + m.end(), "issued token"
        for m in _URL_LOGIN.finditer(line):
            if self.is_secret(m["v"], self.NAMED):
                yield begin + m.start("v"), begin + m.end("v"), "login in a URL"
        for m in _QUERY.finditer(line):
            if self.is_secret(m["v"], 8):
                yield begin + m.start("v"), begin + m.end("v"), "parameter of a URL"
        for m in _SENT.finditer(line):
            if m["how"].lower() == "basic":
                if self._login(m["v"]):
                    yield begin + m.start("v"), begin + m.end("v"), "header"
            elif self.is_secret(m["v"], 10) and not m["v"].isalpha():
                yield begin + m.start("v"), begin + m.end("v"), "header"
        yield from self._assigned(text, begin, end, line, suffix)
        for m in _COMPARED.finditer(line):
            name, group = (m["n"], "v") if m["v"] is not None else (m["n2"], "v2")
            if NOT_SECRET.search(name) or "f" in (m["p"] or "").lower():
                continue
            named = is_credential_name(name.strip("\"']["))
            value = m[group]
            if " " not in value and self.is_secret(value, self.NAMED if named else self.COMPARED, True):
                yield begin + m.start(group), begin + m.end(group), "comparison"

    def _assigned(self, text: str, begin: int, end: int, line: str, suffix: str) -> Iterator[tuple]:
        for m in _GIVEN.finditer(line):
            if not is_credential_name(m["n"]) or "f" in m["p"].lower() and "{" in m["v"]:
                continue
            call = (m["call"] or "").rstrip(" (")
            if re.search(r"(?i)getpass|input|environ|getenv|\bget$|config|lookup|read|open|load|prompt|join|field|argument", call):
                continue
            spans = self._pieces(text, begin + m.start("p"), suffix, begin, call_opened=m["call"] is not None)
            if not spans:
                continue
            value = "".join(text[a:b] for a, b in spans)
            if re.search(r"(?i)b64|base64|fromhex|unhex|decode", call):
                value = decoded(value) or value
            if " " in value.strip() and (value.split()[0].lower() in SCHEMES or value.replace(" ", "").isalpha()):
                continue  # sent as a header, which is looked at by itself, or prose
            if self.is_secret(value, self.NAMED):
                yield *spans[0], "assignment", *spans[1:]
        for m in _DEFAULT.finditer(line):
            if is_credential_name(m["n"]) and (spans := self._pieces(text, begin + m.start("p"), suffix, begin, True)):
                if self.is_secret("".join(text[a:b] for a, b in spans), self.NAMED):
                    yield *spans[0], "default", *spans[1:]
        comment = line.lstrip().startswith(("#", "//", "*", "--", ";", ">", "-")) or suffix in (".md", ".txt")
        hash_ = line.find("#")
        for pattern, kind in ((_NETRC, "netrc"), (_TABLE, "table"), (_SAID, "prose"), (_BESIDE, "prose"), (_BARE, "assignment")):
            if pattern is not _BARE and suffix == ".json":
                continue
            for m in pattern.finditer(line):
                if not is_credential_name(m["n"]):
                    continue
                if suffix == ".py" and not comment and not 0 <= hash_ < m.start():
                    continue
                value = m["v"].rstrip(",;" if pattern is _BARE else ".,;:")
                if value.lower() in SCHEMES or suffix == ".toml" and not comment or _FILLER.match(value) or value.startswith(("'", '"', "[", "(", "|", ">")):
                    continue
                least = self.NAMED if pattern in (_BARE, _NETRC) else 5
                if pattern in (_SAID, _BESIDE) and not re.search(r"[\d\W_]", value):
                    continue  # a word of a sentence
                if self.is_secret(value, least):
                    yield begin + m.start("v"), begin + m.start("v") + len(value), kind
        # the value may stand on the lines below
        if (m := _OPENED.search(line)) and is_credential_name(m["n"]):
            at = end + 1
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            spans = self._pieces(text, at, suffix, begin, m[0].rstrip().endswith("("))
            if not spans and suffix in (".yml", ".yaml"):
                spans = self._block(text, end + 1, line, m[0].rstrip()[-1] not in ":=")
            if spans and self.is_secret("".join(text[a:b] for a, b in spans), self.NAMED):
                yield *spans[0], "below", *spans[1:]

    def _pieces(self, text: str, at: int, suffix: str, begin: int, call_opened: bool) -> list[tuple[int, int]]:
        """Begins and ends of the literal at `at` and of those that are joined to it; of literals over several lines, those
        of the lines that aren't empty. Nothing if there is no literal, or one of several lines is text with spaces.
        begin: that of the line with the name."""
        pieces: list[tuple[int, int]] = []
        sure = None  # how many pieces are joined whatever follows
        while m := _PIECE.match(text, at):
            group = "w" if m["t"] else "v"
            if "f" in m["p"].lower() and "{" in m[group]:
                break
            pieces.append(m.span(group))
            at = last = m.end()
            if gap := _PLUS.match(text, at):
                at = gap.end()
            elif call_opened or suffix == ".py":
                at = (gap := _BREAK.match(text, at)).end()
                if "\n" in gap[0] and not call_opened and sure is None and _PIECE.match(text, at):
                    indent = len(text[begin : begin + 200]) - len(text[begin : begin + 200].lstrip(" \t"))
                    deeper = at - text.rfind("\n", 0, at) - 1 > indent
                    sure = None if deeper else len(pieces)
                    call_opened = deeper
            else:
                break
        if sure is not None and not re.compile(r"\s*[,)\]}]").match(text, last):
            pieces = pieces[:sure]  # a statement of its own follows
        return self._lines(text, pieces)

    @staticmethod
    def _lines(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if not any("\n" in text[a:b] for a, b in pieces):
            return [(a, b) for a, b in pieces if b > a]
        spans = []
        for a, b in pieces:
            for m in re.compile(r"[^\n]+").finditer(text, a, b):
                part = m[0].rstrip(" \t\\" if m.end() < b else " \t")
                lead = len(part) - len(part.lstrip())
                if part.strip():
                    spans.append((m.start() + lead, m.start() + len(part)))
        return [] if len(spans) > 1 and any(re.search(r"\s", text[a:b]) for a, b in spans) else spans

    def _block(self, text: str, at: int, line: str, scalar: bool) -> list[tuple[int, int]]:
        """Begins and ends of the lines of a YAML value below its name: of a block scalar, or of plain text."""
        indent, spans = len(line) - len(line.lstrip()), []
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            below = text[at:stop]
            word = below.strip()
            if word:
                deep = len(below) - len(below.lstrip())
                if deep == 0 or (scalar or spans) and deep <= indent or not scalar and ":" in below.split("#")[0]:
                    break
                spans.append((at + deep, at + deep + len(word)))
                if not scalar and word.startswith("-"):
                    break
            elif not scalar:
                break
            at = stop + 1
        return [] if len(spans) > 1 and any(re.search(r"\s", text[a:b]) for a, b in spans) else spans

    def _login(self, value: str) -> bool:
        plain = decoded(value)
        if plain is None:
            return False
        _, colon, secret = plain.partition(":")
        return bool(colon) and self.is_secret(secret, self.NAMED)


def decoded(value: str) -> str | None:
    """The printable text that a literal encodes as base64 or hexadecimal."""
    compact = re.sub(r"\s|\\n", "", value)
    for decode in (bytes.fromhex, lambda v: base64.b64decode(v + "=" * (-len(v) % 4), validate=True), lambda v: base64.urlsafe_b64decode(v + "=" * (-len(v) % 4))):
        try:
            plain = decode(compact).decode("utf-8")
        except (ValueError, binascii.Error):
            continue
        if plain and plain.isprintable():
            return plain
    return None


#: A word of the dictionary is in at least this share of the different text files, so the dictionary has at most
#: (mean number of different words in a file) / MIN_SHARE words.
MIN_SHARE = 2e-3


def _dictionary(files: DataFrame) -> dict[str, int]:
    ship_package(files.sparkSession)
    n = different_texts(files).count()
    least = max(3, math.ceil(MIN_SHARE * n))
    return {r.word: r.n for r in corpus_words(files).where(F.col("n") >= least).toLocalIterator()}


def credentials(files: DataFrame) -> DataFrame:
    """One row per secret value: file_id, line_no on which the value begins, begin and end in the file's text, kind.

    Reads every text file whole, twice: once for the dictionary, whose size is bounded by MIN_SHARE and which moves each
    different content once, once for the search. Null and empty content gives no row; files delivered twice give theirs each. Several secrets of a line each
    give a row, and a value in several pieces one, with begin and end of its first.
    """
    sent = files.sparkSession.sparkContext.broadcast(_dictionary(files))
    finder: list[Finder] = []

    def one(key: int, text: str, suffix: str) -> Iterator[tuple]:
        if not finder:
            finder.append(Finder(Dictionary(sent.value)))
        for x in finder[0].find(text, suffix):
            yield key, x.line, x.begin, x.end, x.kind

    schema = "file_id bigint, line_no int, begin int, end int, kind string"
    return map_files(files, TEXT_SUFFIXES, one, schema, ("suffix",))


def redacted_files(files: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """file_id, n_secrets and the text with only the secrets replaced, for each file that holds any. Line ends inside a
    secret stay, so that the lines after it keep their numbers."""
    sent = files.sparkSession.sparkContext.broadcast(_dictionary(files))
    finder: list[Finder] = []

    def one(key: int, text: str, suffix: str) -> Iterator[tuple]:
        if not finder:
            finder.append(Finder(Dictionary(sent.value)))
        secrets = finder[0].find(text, suffix)
        if secrets:
            out, at = [], 0
            for begin, end in sorted(span for x in secrets for span in ((x.begin, x.end), *x.more)):
                out += [text[at:begin], mark, "\n" * text.count("\n", begin, end)]
                at = end
            yield key, len(secrets), "".join([*out, text[at:]])

    return map_files(files, TEXT_SUFFIXES, one, "file_id bigint, n_secrets int, text string", ("suffix",))
