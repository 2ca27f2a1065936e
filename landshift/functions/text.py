"""Identifiers, notes and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landshift.config import NOTE_LIMIT


# The characters that stay in names of stored and downloaded files.
STORED_NAME = r"[^A-Za-z0-9_.-]"
DOWNLOAD_NAME = r"[^a-zA-Z0-9_-]"


def safe_path_id(value: Column) -> Column:
    """Item id as used in storage paths."""
    return F.regexp_replace(value, STORED_NAME, "_")


def safe_file_id(value: Column) -> Column:
    """Candidate id as used in download names; dots are replaced too."""
    return F.regexp_replace(value, DOWNLOAD_NAME, "_")


def normalize_note(note: Column) -> Column:
    """Strip all surrounding white space; an empty note becomes NULL."""
    return F.nullif(F.regexp_replace(note, r"^\s+|\s+$", ""), F.lit(""))


def note_fits(note: Column) -> Column:
    return F.coalesce(F.length(normalize_note(note)) <= NOTE_LIMIT, F.lit(True))


def parse_iso(value: Column) -> Column:
    """ISO-8601 text; a missing offset means UTC."""
    return F.try_to_timestamp(value)


def candidate_id(analysis: Column, signal: Column) -> Column:
    return F.concat(F.lit("analysis-"), analysis.cast("string"), F.lit("-signal-"), signal.cast("string"))


def words(reason: Column) -> Column:
    return F.translate(reason, "_", " ")
