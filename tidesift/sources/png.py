"""Workflows embedded in PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesift.session import ship_package

# fixed values: the signature of a PNG file, and the keys under which a workflow may stand, in this order
SIGNATURE = b"\x89PNG\r\n\x1a\n"
KEYS = ("workflow", "prompt", "parameters")
#: Compressed text is inflated up to so many bytes; a file that holds more in one chunk is an error.
MAX_INFLATED = 64 << 20


def _inflate(data: bytes) -> bytes:
    stream = zlib.decompressobj()
    out = stream.decompress(data, MAX_INFLATED)
    if stream.unconsumed_tail:
        raise TooLarge
    return out


class TooLarge(ValueError):
    """A chunk holds more than MAX_INFLATED bytes."""


def _chunk_text(kind: bytes, data: bytes) -> tuple[str, str] | None:
    """(keyword, text) of a text chunk; None for one that isn't well formed."""
    key, zero, rest = data.partition(b"\0")
    if not zero:
        return None
    name = key.decode("latin-1")
    try:
        if kind == b"tEXt":
            return name, rest.decode("utf-8", "replace")
        if kind == b"zTXt":
            return name, _inflate(rest[1:]).decode("utf-8", "replace")
        packed, (_language, _, after) = rest[:1] == b"\x01", rest[2:].partition(b"\0")
        _translated, zero, body = after.partition(b"\0")
        if not zero:
            return None
        return name, (_inflate(body) if packed else body).decode("utf-8", "replace")
    except zlib.error:
        return None


def png_texts(content: bytes) -> dict[str, str] | None:
    """{keyword: text} of a PNG file, the last of each; None if it isn't one. Checksums aren't checked; reading stops at
    the end chunk or where the file is cut off."""
    if not content.startswith(SIGNATURE):
        return None
    found: dict[str, str] = {}
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        if kind == b"IEND":
            break
        if kind in (b"tEXt", b"zTXt", b"iTXt") and (text := _chunk_text(kind, data)):
            found[text[0]] = text[1]
        at += 12 + size
    return found


def embedded_workflows(files: DataFrame) -> DataFrame:
    """file_id, target, rel_path, body and reason of each `.png` file: the text under the first of KEYS that it has, or
    the reason why there is none (`not a png`, `no workflow`, `too large` for a chunk of more than MAX_INFLATED bytes).
    Whether the text is a workflow is for its parser to say."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies: list[str | None] = []
            reasons: list[str | None] = []
            for content in batch.column(3):
                try:
                    texts, reason = png_texts(content.as_py() or b""), "no workflow"
                except TooLarge:
                    texts, reason = {}, "too large"
                body = next((texts[k] for k in KEYS if k in texts), None) if texts is not None else None
                bodies.append(body)
                reasons.append("not a png" if texts is None else None if body is not None else reason)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(reasons, pa.string())],
                [*batch.schema.names[:3], "body", "reason"],
            )

    kept = files.where(F.lower("suffix") == ".png").select("file_id", "target", "rel_path", "content")
    return kept.mapInArrow(run, "file_id bigint, target string, rel_path string, body string, reason string")
