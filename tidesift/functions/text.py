"""Text measures and parsers as column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as white space, line ends, URLs and requirement lines
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
URL = r"(?i)((?:https?://|wss?://)[a-zA-Z0-9\-._~:/?#@!$&'()*+,;=%]+)"
WIDGET_URL = r"(?iU)(https?://[^\s\"'<>()\[\]{}]+)"
LONG_BASE64 = "[A-Za-z0-9+/=_-]{100,}"
LONG_HEX = "[0-9a-fA-F]{100,}"
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\s*\[[^\]]*\])?\s*(==|>=|<=|!=|~=|<|>)?\s*([A-Za-z0-9._+*-]*)"
VCS = r"^(?:git|hg|svn|bzr)\+"
# fixed values: names made of what looks alike, or without vowels
ODD_IDENTIFIER = r"^_+$|^_*[ol01iIO]{2,5}$|^_+[^_aeiouyAEIOUY][^aeiouyAEIOUY]{1,2}$"


def stripped(text: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


def cut_within(text: Column, size: int) -> Column:
    """At most size characters, the last three being dots where it was longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def cut_after(text: Column, size: int) -> Column:
    """The first size characters, followed by dots where it was longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text. Each different character is counted by taking it out."""
    n = F.length(text)
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: F.length(c) > 0)
    counts = F.transform(letters, lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).when(n == 0, 0.0)


def space_share(text: Column) -> Column:
    """The share of white space; 1 for empty text."""
    n = F.length(text)
    bare = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(n > 0, (n - bare) / n).when(n == 0, 1.0)


def run_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def normal_name(name: Column) -> Column:
    """A package name in lower case, with runs of `-`, `_` and `.` as one hyphen."""
    return F.regexp_replace(F.lower(stripped(name)), "[-_.]+", "-")


def normal_url(url: Column) -> Column:
    """Lower case, without slashes at the end."""
    return F.regexp_replace(F.lower(url), "/+$", "")


def is_odd_identifier(name: Column) -> Column:
    return name.rlike(ODD_IDENTIFIER)


def has_no_vowel(text: Column) -> Column:
    return ~F.lower(text).rlike("[aeiouy]")


def requirement(line: Column) -> Column:
    """struct<name, version>: the normalised name and, where it is pinned with `==`, the version; null for a line that
    doesn't start with a name."""
    name = F.nullif(F.regexp_extract(line, REQUIREMENT, 1), F.lit(""))
    operator = F.regexp_extract(line, REQUIREMENT, 2)
    version = F.regexp_extract(line, REQUIREMENT, 3)
    pinned = F.when((operator == "==") & version.rlike(r"\A[A-Za-z0-9._+-]+\z"), version)
    return F.when(name.isNotNull(), F.struct(normal_name(name).alias("name"), pinned.alias("version")))


def requirement_text(line: Column) -> Column:
    """A line of a requirements file without its comment; null if it holds no requirement at all."""
    bare = stripped(F.regexp_replace(line, "(?s)#.*$", ""))
    return F.when((F.length(bare) > 0) & ~bare.startswith("-"), bare)


def lines_of(text: Column) -> Column:
    """array<string>: the lines of a text, without an empty one after the last line end."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
