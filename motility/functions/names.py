"""Columns from file names: capture keys and natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(path: Column, pattern: str) -> Column:
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found.cast("long"))


def parse_capture_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``grp, volume, capture, t, k, z, c`` from names such as ``group1/3_capture2/T00005.mat``, ``group1__3_capture2__T00005__0.mat`` and ``..._t005_z003_c001.tif``.

    What a name lacks is null, and so is all of a null name.
    """
    p = F.col(path)
    return df.withColumns({
        "grp": _number(p, r"group(\d+)"), "volume": _number(p, r"(\d+)_capture\d+"), "capture": _number(p, r"_capture(\d+)"),
        "t": _number(p, r"(?:T|_t)(\d+)"), "k": _number(p, r"T\d+__(\d+)"), "z": _number(p, r"_z(\d+)"), "c": _number(p, r"_c(\d+)(?:\D|$)"),
    })


def natural_sort_key(text: Column, case_sensitive: bool = False, numbers: str = "asdigit") -> Column:
    """A key by which ``orderBy`` gives natural order: digit runs compare as whole numbers.

    ``numbers`` says where digit runs stand against other characters: ``asdigit`` as digits do, ``beforechar`` or ``afterchar``. The key is an array of
    ``(rank, num, ch)``, which compare one after the other; a name comes before its own continuations. Null texts have a null key.
    """
    rank = {"asdigit": None, "beforechar": -1, "afterchar": 1}[numbers]
    shown = text if case_sensitive else F.lower(text)
    digit = lambda x: x.rlike(r"^\d")
    ranked = (lambda x: F.when(x < "0", 0).when(digit(x), 1).otherwise(2)) if rank is None else (lambda x: F.when(digit(x), rank).otherwise(0))
    tokens = F.regexp_extract_all(shown, F.lit(r"(\d+|(?s:\D))"), F.lit(1))
    as_number = lambda x: F.when(digit(x), x.try_cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)"))
    return F.transform(tokens, lambda x: F.struct(ranked(x).alias("rank"), as_number(x).alias("num"), F.when(digit(x), "").otherwise(x).alias("ch")))


def natural_path_key(path: Column, **options) -> Column:
    """Natural order of paths: folder by folder, then name, then extension."""
    parts = F.split(path, r"[/\\]")
    last = F.element_at(parts, -1)
    extension = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    name = F.substring(last, F.lit(1), F.length(last) - F.length(extension))
    levels = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(name, extension))
    return F.transform(levels, lambda level: natural_sort_key(level, **options))
