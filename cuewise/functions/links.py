"""Links, file names, settings files and digests as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Media types by extension; others are video/mp4.
MEDIA = {
    ".mp4": "video/mp4", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".webm": "video/webm", ".avi": "video/x-msvideo",
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".m4a": "audio/mp4", ".flac": "audio/flac", ".ogg": "audio/ogg", ".aac": "audio/aac",
}
_ID = "([a-zA-Z0-9_-]{10,})"


def is_drive(source: Column) -> Column:
    return F.coalesce(F.trim(source).rlike(r"^(https?://drive\.google\.com/|https://docs\.google\.com/|gdrive:)"), F.lit(False))


def drive_id(source: Column) -> Column:
    """(id, type) of a drive link, URI or bare id; null where there is none."""
    s = F.trim(source)
    rest = F.regexp_replace(F.regexp_replace(s, "^gdrive:(//)?", ""), "^/+|/+$", "")
    tail = lambda x: F.regexp_replace(F.regexp_extract(x, r"^([^?]*)", 1), "^/+|/+$", "")
    found = lambda i, kind: F.struct(i.alias("id"), F.lit(kind).alias("type"))
    part = lambda pattern: F.regexp_extract(s, pattern, 1)
    folder, file, asked = part(f"/folders/{_ID}"), part(f"/(?:file|document|presentation|spreadsheets)/d/{_ID}"), part(f"[?&]id={_ID}")
    return (
        F.when(s.startswith("gdrive://") & rest.rlike("^folders?/"), found(tail(F.regexp_replace(rest, "^folders?/", "")), "folder"))
        .when(s.startswith("gdrive://") & rest.startswith("file/"), found(tail(F.regexp_replace(rest, "^file/", "")), "file"))
        .when(s.startswith("gdrive://"), found(tail(rest), "unknown"))
        .when(s.startswith("gdrive:"), found(rest, "unknown"))
        .when(folder != "", found(folder, "folder")).when(file != "", found(file, "file")).when(asked != "", found(asked, "unknown"))
        .when(s.rlike("^[a-zA-Z0-9_-]{15,}$"), found(s, "unknown"))
    )


def object_uri(uri: Column) -> Column:
    """(bucket, blob) of a gs:// URI; null for others."""
    return F.when(uri.startswith("gs://"), F.struct(F.regexp_extract(uri, "^gs://([^/]*)", 1).alias("bucket"), F.regexp_extract(uri, r"^gs://[^/]*/+([^?#]*)", 1).alias("blob")))


def media_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), extension), F.lit("video/mp4"))


def setting(line: Column) -> Column:
    """(key, value) of a line of a settings file; null for blanks, comments and lines without ``=``."""
    bare = F.regexp_replace(F.trim(line), r"^export\s+", "")
    key = F.trim(F.regexp_extract(bare, r"^([^=]*)=", 1))
    value = F.trim(F.regexp_extract(F.regexp_extract(bare, r"^[^=]*=(.*)$", 1), r"^([^#]*)", 1))
    value = F.regexp_replace(value, r"""^["']+|["']+$""", "")
    return F.when(~bare.startswith("#") & bare.contains("=") & (key != ""), F.struct(key.alias("key"), value.alias("value")))


def repaired_name(name: Column) -> Column:
    """A UTF-8 file name that was read as Latin-1, whole or in runs, read again as UTF-8 where that is possible."""

    @F.pandas_udf("string")
    def again(names: pd.Series) -> pd.Series:
        return names.map(_reread, na_action="ignore")

    return F.when(name.rlike(r"[\x{80}-\x{FF}]"), again(name)).otherwise(name)


def _reread(name: str) -> str:
    def one(text: str) -> str:
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return text

    whole = one(name)
    return whole if whole != name else re.sub("[\x80-\xff]{2,}", lambda m: one(m[0]), name)


def header_filename(header: Column, fallback: Column) -> Column:
    """The file name in a Content-Disposition header."""
    coded = F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;\r\n]+)", 1)
    quoted = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]+)"', 1)
    bare = F.regexp_extract(header, r"(?i)filename\s*=\s*([^;\r\n]+)", 1)
    strip = lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")
    plus = lambda x: F.try_url_decode(F.replace(strip(x), F.lit("+"), F.lit("%2B")))
    return F.when(coded != "", plus(coded)).when(quoted != "", plus(quoted)).when(bare != "", plus(bare)).otherwise(fallback)


def output_dir(source: Column, chosen: Column) -> Column:
    """Where an input's results go: the chosen folder, or ``output`` beside the input, never one inside another."""
    parent = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    beside = F.when(parent == "", "output").when(parent.rlike("(^|/)output$"), parent).otherwise(F.concat(parent, F.lit("/output")))
    return F.coalesce(F.nullif(chosen, F.lit("")), beside)


def first_set(*candidates: Column) -> Column:
    """The first of some settings, in order of precedence, that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])
