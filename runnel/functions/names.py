"""Identifiers, fingerprints and the codec of page cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What names may look like.
NAME = r"\A[a-z][a-z0-9-]{2,62}\z"
NAMESPACE = r"\A[a-z][a-z0-9-]{0,62}\z"
FIELD_PATH = r"\A[^.]+(\.[^.]+)*\z"


#: Names at the edges of the rules: lengths, and each kind of character first, within and last.
SAMPLES = [
    "q", "qz", "qzt", "q" * 63, "q" * 64, "q-z", "qz-", "-qz", "q--z", "7qz", "q7z", "qz7", "Qzt", "qZt", "qzT", "_qz", "q_z", "qz_", " qz", "q z", "qz ",
    "", "left.right", "left..right", ".left", "left.", "a b.c d", "\u00e9tat", "caf\u00e9",
]


def valid_name(x: Column) -> Column:
    return x.rlike(NAME)


def valid_namespace(x: Column) -> Column:
    """An empty namespace stands for `default`."""
    return (x == "") | x.rlike(NAMESPACE)


def valid_field_path(x: Column) -> Column:
    return x.rlike(FIELD_PATH)


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def encode_cursor(sequence: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"seq": sequence}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str | None) -> int | None:
    """The sequence of a cursor; a cursor that cannot be read counts as none."""
    try:
        return int(json.loads(base64.urlsafe_b64decode(cursor or ""))["seq"])
    except (ValueError, KeyError, TypeError):
        return None


def cursor_of(sequence: Column) -> Column:
    raw = F.base64(F.concat(F.lit('{"seq":'), sequence.cast("string"), F.lit("}")).cast("binary"))
    return F.translate(raw, "+/", "-_")
