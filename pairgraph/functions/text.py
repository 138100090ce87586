"""Column expressions over names, hashes and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def valid_filename(name: Column) -> Column:
    """Not empty, without slashes, and no name of a folder itself."""
    return F.coalesce((F.length(name) > 0) & ~F.rlike(name, F.lit(r"[/\\]")) & ~name.isin(".", ".."), F.lit(False))


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the name ends in one of the suffixes, whatever the case."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).isin(*suffixes)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def pair_seed(seed: int, left_hash: Column, right_hash: Column) -> Column:
    """31 bits from the seed and two content hashes, the same for every partitioning."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), left_hash, right_hash).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def hex_digest(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit("^[0-9a-f]{64}$")), F.lit(False))


def clipped_label(text: Column, width: int = 24) -> Column:
    """ASCII with ? for other characters, cut to the width with three dots."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "?")
    return F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, width - 3), F.lit("..."))).otherwise(plain)


def leaks_group(filename: Column, group_id: Column) -> Column:
    """Whether a file's name begins with the label of its group."""
    return F.startswith(filename, F.concat(F.lit("g"), group_id, F.lit("_")))
