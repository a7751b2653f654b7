"""Raw export records: sound records as typed rows, the others apart with the reason.

Every field is first a nullable string. Rules run as column expressions and collect their messages in one array per
record; a record is sound when that array is empty. Everything stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One field: quoted (doubled quotes inside) or free of quotes and commas. Possessive, so the JVM matches it in a loop
#: whatever its length.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'
_RECORD = rf"\A(?:{_FIELD},)*+{_FIELD}\z"

FIELDS = ("target", "source_file", "line", "name", "version", "declared_at")

_WORD = "[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_EXTRA = "[A-Za-z0-9._-]+"
NAME = rf"\A{_WORD}(?:\[{_EXTRA}(?:,{_EXTRA})*\])?\z"
VERSION = (
    r"\A(?:[0-9]+(?:\.[0-9]+)*(?:(?:a|b|rc)[0-9]+)?(?:\.post[0-9]+)?(?:\.dev[0-9]+)?"
    r"(?:\+[a-z0-9]+(?:\.[a-z0-9]+)*)?)?\z"
)


@dataclass(frozen=True)
class Split:
    """sound: one typed row per sound record. rejected: the record and its errors. Both keep the key columns."""

    sound: DataFrame
    rejected: DataFrame


def _blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", "")


def record_fields(raw: Column) -> Column:
    """array<string> of the fields of a record that keeps the quoting rule; null for one that breaks it or is null."""
    cells = F.regexp_extract_all(F.concat(raw, F.lit(",")), F.lit(rf"(?s)({_FIELD}),"), 1)
    value = F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(_blank_trim(c)),
    )
    return F.when(raw.rlike(rf"(?s){_RECORD}"), value)


def _rules(field: dict[str, Column]) -> list[tuple[str, Column]]:
    """(message, condition that must hold) for each rule on values."""
    day = field["declared_at"]
    return [
        ("target is empty", F.length(field["target"]) > 0),
        ("source_file is empty", F.length(field["source_file"]) > 0),
        ("line isn't one to five digits", field["line"].rlike(r"\A[0-9]{1,5}\z")),
        ("name isn't well formed", field["name"].rlike(NAME)),
        ("version isn't well formed", field["version"].rlike(VERSION)),
        (
            "declared_at isn't a calendar date",
            day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & day.try_cast("date").isNotNull() & ~day.startswith("0000"),
        ),
    ]


def split_records(raw: DataFrame, key: str = "raw_id", line: str = "raw_line") -> Split:
    """Split raw records into typed rows and rejected rows.

    sound has key, the six fields (line int, declared_at date, version null where empty), nothing else; rejected has
    key, the record, errors (array<string>) and reason: `quoting` before `columns` before `value`. A null record has
    no fields, so its reason is `columns`; the empty record has one field. Other columns of the input are left out, so
    their names can't clash. Repeated records each give a row. An empty table gives two empty tables.
    """
    # the result of a generator isn't written into the expressions after it, so that a record is cut once for all rules
    cut = F.inline(F.array(F.struct(record_fields(F.col("_raw")).alias("_f"))))
    base = raw.select(F.col(key).alias("_key"), F.col(line).alias("_raw")).select("_key", "_raw", cut)
    field = {n: F.get(F.col("_f"), F.lit(i)) for i, n in enumerate(FIELDS)}
    broken = F.col("_raw").isNotNull() & F.col("_f").isNull()
    values = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in _rules(field)]),
        lambda e: e.isNotNull(),
    )
    errors = (
        F.when(broken, F.array(F.lit("quoting")))
        .when(F.coalesce(F.size("_f"), F.lit(0)) != len(FIELDS), F.array(F.lit("columns")))
        .otherwise(values)
    )
    checked = base.withColumn("_errors", errors)
    first = F.get(F.col("_errors"), F.lit(0))
    typed = {
        **field,
        "line": field["line"].try_cast("int"),
        "version": F.nullif(field["version"], F.lit("")),
        "declared_at": field["declared_at"].try_cast("date"),
    }
    return Split(
        sound=checked.where(F.size("_errors") == 0).select(
            F.col("_key").alias(key), *[c.alias(n) for n, c in typed.items()]
        ),
        rejected=checked.where(F.size("_errors") > 0).select(
            F.col("_key").alias(key),
            F.col("_raw").alias(line),
            F.col("_errors").alias("errors"),
            F.when(first.isin("quoting", "columns"), first).otherwise("value").alias("reason"),
        ),
    )
