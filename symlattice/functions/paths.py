"""File paths: languages, normal form, what is tracked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_DIR = ".symlattice"
#: Extensions of each language.
LANGUAGES = {"ts": ("ts", "mts", "cts"), "tsx": ("tsx",), "js": ("js", "jsx", "mjs", "cjs"), "py": ("py",)}
#: Extensions tried for a module, in order.
MODULE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")


def lang_of(path: Column) -> Column:
    """Language by extension, case-insensitive; null for other files."""
    found = F.lit(None).cast("string")
    for lang, ends in LANGUAGES.items():
        found = F.coalesce(found, F.when(F.lower(path).rlike(rf"\.({'|'.join(ends)})$"), F.lit(lang)))
    return found


def tracked(path: Column) -> Column:
    """Whether a relative path belongs into the graph: a known language, outside the store and .git."""
    inside = F.lit(False)
    for d in (STORE_DIR, ".git"):
        inside = inside | path.startswith(f"{d}/") | path.contains(f"/{d}/") | (path == d)
    return lang_of(path).isNotNull() & ~inside


def normalize(path: Column) -> Column:
    """Path without empty and ``.`` segments, with ``..`` resolved (beyond the top it is dropped)."""
    start = F.array().cast("array<string>")
    step = lambda out, part: F.when(part == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when((part == "") | (part == "."), out).otherwise(F.concat(out, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def strip_dot(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, rf"\.({'|'.join(MODULE_EXTENSIONS)})$", "")


def module_candidates(path: Column) -> Column:
    """Files that a module path may stand for, in order: itself, with each extension, an index file with each."""
    rel = normalize(strip_dot(path))
    stem = without_extension(rel)
    ends = [F.concat(stem, F.lit(f".{e}")) for e in MODULE_EXTENSIONS] + [F.concat(stem, F.lit(f"/index.{e}")) for e in MODULE_EXTENSIONS]
    return F.array(rel, *ends)
