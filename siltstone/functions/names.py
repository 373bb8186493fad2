"""Column expressions on names and paths. Paths have backslashes; a null gives a null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def extension(name: Column) -> Column:
    """What follows the last dot, lowered; empty without a dot or behind a trailing one."""
    return F.lower(F.regexp_extract(name, r"(?s)\.([^.]+)\z", 1))


def kind_of(name: Column) -> Column:
    """The kind id by extension, 0 for unknown ones."""
    ext = extension(name)
    out = F.lit(fixed.KIND_IDS["skip"])
    for kind, names in fixed.EXTENSIONS.items():
        out = F.when(ext.isin(names.split()), F.lit(fixed.KIND_IDS[kind])).otherwise(out)
    return out


def needs_extractor(kind: Column) -> Column:
    return kind.between(4, 9)


def name_relevance(name: Column, query: str) -> Column:
    """How well a name answers a query found in it, at its first occurrence; 0.0 if it is not in it or empty."""
    q = query.lower()
    at = F.locate(q, F.lower(name))
    before = F.substr(name, at - 1, F.lit(1))
    size = F.char_length(name)
    place = F.when(size == len(q), fixed.NAME_EXACT).when(at == 1, fixed.NAME_PREFIX).when(before.isin(fixed.WORD_BREAKS), fixed.NAME_WORD).otherwise(0.0)
    score = 1.0 + place + fixed.NAME_COVER * len(q) / size - fixed.NAME_LENGTH * size
    return F.when((at > 0) & F.lit(bool(q)), score).otherwise(0.0)


def inside_folder(path: Column, folder: Column) -> Column:
    """Strictly inside: the folder with a separator behind it leads the path; ends of the folder's name are ignored."""
    f = F.lower(F.regexp_replace(folder, r"\\+$", ""))
    return F.lower(path).startswith(F.concat(f, F.lit("\\"))) & (F.char_length(path) > F.char_length(f) + 1)


def contains_any(path: Column, markers: list[str]) -> Column:
    return any_of([F.contains(path, F.lit(m)) for m in markers])


def ends_with_any(path: Column, endings: list[str]) -> Column:
    return any_of([F.endswith(path, F.lit(e)) for e in endings])


def rank_penalty(path: Column) -> Column:
    """The penalty of generated and vendor material, by parts and ends of the path's first characters."""
    p = F.lower(F.substring(path, 1, fixed.PENALTY_PATH_CHARS))
    return F.when(contains_any(p, fixed.PENALTY_MARKERS) | ends_with_any(p, fixed.PENALTY_ENDINGS), fixed.PENALTY).otherwise(0.0)


def in_excluded_folder(path: Column) -> Column:
    """Whether a folder above the last part of the path is of an excluded name."""
    parts = F.split(F.lower(path), r"\\")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in fixed.EXCLUDED_FOLDERS]))


def skip_reason(gone: Column, is_folder: Column, excluded: Column, name: Column) -> Column:
    """The first reason that holds not to read a file, or 'candidate'."""
    return (
        F.when(gone, "deleted").when(is_folder, "directory").when(excluded, "excluded")
        .when(F.coalesce(extension(name), F.lit("")) == "", "no_extension").when(kind_of(name) == 0, "unknown_extension").otherwise("candidate")
    )


def size_limit(kind: Column) -> Column:
    return F.when(kind.isin(1, 2, 3), fixed.TEXT_LIMIT).otherwise(fixed.OTHER_LIMIT)


def gate(attributes: Column, size: Column, kind: Column) -> Column:
    """What holds a file back, in this order: cloud, empty, too_big; else open. Unknown attributes are none."""
    cloud = F.coalesce(attributes, F.lit(0)).bitwiseAND(F.lit(fixed.CLOUD_ATTRIBUTES)) != 0
    return F.when(cloud, "cloud").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > size_limit(kind), "too_big").otherwise("open")


def magic_kind(content: Column, kind: Column) -> Column:
    """The kind by a file's first bytes, which beat its name; 0 for what is no text."""
    lead = F.hex(F.substring(content, 1, 8))
    out = kind
    out = F.when(any_of([lead.startswith(m) for m in fixed.BINARY_MAGIC]), 0).otherwise(out)
    zipped = any_of([lead.startswith(m) for m in fixed.ZIP_MAGIC])
    out = F.when(zipped, F.when(kind.isin(5, 7, 9), kind).otherwise(0)).otherwise(out)
    for k, m in fixed.MAGIC.items():
        out = F.when(lead.startswith(m), fixed.KIND_IDS[k]).otherwise(out)
    size = F.octet_length(content)
    return F.when(size == 0, 0).when(size < 4, kind).otherwise(out)


def in_user_area(path: Column, profile: str) -> Column:
    if not profile:
        return F.lit(False)
    p = F.lower(path)
    return inside_folder(p, F.lit(profile.lower())) & ~contains_any(p, fixed.OWNED)


def anonymous(path: Column, profile: str, shown: str) -> Column:
    """The profile's folder replaced for display."""
    return F.when(F.lower(path).startswith(profile.lower() + "\\"), F.concat(F.lit(shown), F.substr(path, F.lit(len(profile) + 1)))).otherwise(path)
