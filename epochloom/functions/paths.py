"""Predicates and entities of paths held in a column."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from epochloom.functions.arrays import Col, _c
from epochloom.functions.text import non_empty

# Accepted extensions, the traversal pattern, folder and script names left out of a release.
ALLOWED_EXTENSIONS = (".bdf", ".edf", ".fif", ".parquet", ".npy", ".npz", ".csv")
TRAVERSAL = (
    r"(?i)(?:\.\.(?:[\\/]|\z)|%(?:25)?2e%(?:25)?2e(?:%(?:25)?2f|%(?:25)?5c|[\\/]|\z))"
)
CACHE_FOLDERS = ("cache", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache")
SCRIPT_SUFFIXES = (".ps1", ".sh")


def posix(path: Col) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def parts(path: Col) -> Column:
    return F.split(posix(path), "/")


def file_name(path: Col) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def subject_session(path: Col) -> tuple[Column, Column]:
    """``sub-*``/``ses-*`` entities; the file name wins over folders, the last one counts."""
    pieces = F.split(_c(path), "/")
    folders = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    name_bits = F.split(F.element_at(pieces, -1), "_")

    def last(values: Column, prefix: str) -> Column:
        return F.try_element_at(F.filter(values, lambda v: v.startswith(prefix)), F.lit(-1))

    def entity(prefix: str) -> Column:
        return F.coalesce(last(name_bits, prefix), last(folders, prefix), F.lit("unknown"))

    return entity("sub-"), entity("ses-")


def has_allowed_extension(path: Col) -> Column:
    """Exactly one suffix, and an accepted one; a leading dot starts no suffix."""
    name = F.regexp_replace(F.lower(file_name(path)), r"^\.+", "")
    suffixes = F.regexp_extract_all(name, F.lit(r"\.[^.]*"), F.lit(0))
    return (F.size(suffixes) == 1) & F.get(suffixes, F.lit(0)).isin(*ALLOWED_EXTENSIONS)


def _unquote(col: Column) -> Column:
    """Percent-decoding that leaves ``+`` and broken escapes alone."""
    guarded = F.regexp_replace(F.replace(col, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(guarded)


def decoded(path: Col, rounds: int = 5) -> Column:
    out = posix(path)
    for _ in range(rounds):
        # each round refers to the previous one once, so the expression stays linear
        out = F.transform(F.array(out), _unquote)[0]
    return out


def traversal_reason(path: Col) -> Column:
    """NULL for a safe path, else the first rule it breaks."""
    raw = _c(path)

    def parent(col: Column) -> Column:
        return F.array_contains(F.split(F.replace(col, F.lit("\\"), F.lit("/")), "/"), "..")

    return F.transform(F.array(F.struct(raw.alias("raw"), decoded(path).alias("plain"))), lambda s: (
        F.when(F.coalesce(F.length(s["raw"]), F.lit(0)) == 0, F.lit("empty"))
        .when(F.instr(s["raw"], "\x00") > 0, F.lit("nul"))
        .when(s["raw"].rlike(TRAVERSAL) | parent(s["raw"]), F.lit("traversal"))
        .when(s["plain"].rlike(TRAVERSAL) | parent(s["plain"]), F.lit("encoded-traversal"))
    ))[0]


def is_absolute(path: Col) -> Column:
    p = _c(path)
    return p.startswith("/") | p.startswith("\\") | p.rlike(r"^[A-Za-z]:")


def is_unsafe_relative(path: Col) -> Column:
    p = _c(path)
    return p.isNull() | (p == "") | is_absolute(p) | F.array_contains(parts(p), "..")


def normalise(path: Col) -> Column:
    """Forward slashes, without empty and ``.`` segments."""
    return F.array_join(F.filter(parts(path), lambda s: (s != "") & (s != ".")), "/")


def below_root(path: Col, root: Col) -> Column:
    """Path below the deepest case-insensitive match of ``root``; NULL outside it."""
    segs = F.filter(parts(path), lambda s: (s != "") & (s != "."))
    base = F.filter(parts(root), lambda s: (s != "") & (s != "."))

    def pick(s: Column) -> Column:
        p, r = s["p"], s["r"]
        lowered = F.transform(p, F.lower)
        wanted = F.transform(r, F.lower)
        last_start = F.size(p) - 1 - F.size(r)
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(last_start, F.lit(0))),
            lambda i: (last_start >= 0) & (F.slice(lowered, i + 1, F.size(r)) == wanted),
        )
        at = F.array_max(starts)
        return F.when(
            (F.size(r) > 0) & at.isNotNull(),
            F.array_join(F.slice(p, at + F.size(r) + 1, F.size(p)), "/"),
        )

    return F.transform(F.array(F.struct(segs.alias("p"), base.alias("r"))), pick)[0]


def scope_reason(path: Col, kind: Col) -> Column:
    """Why a listed path is left out of a release, NULL when it is kept.

    ``kind`` is file, dir, symlink or other. Folder rules hold for every ancestor.
    """
    segs = parts(path)

    def pick(s: Column) -> Column:
        p, k = s["p"], s["k"]
        size = F.size(p)
        name = F.lower(F.element_at(p, -1))
        folders = F.transform(
            F.when(k == "dir", p).otherwise(F.slice(p, 1, F.greatest(size - 1, F.lit(0)))), F.lower
        )
        reasons = F.filter(F.transform(folders, lambda f: (
            F.when(f == ".git", F.lit("git"))
            .when(f.isin(*CACHE_FOLDERS), F.lit("cache"))
            .when(f == "reports", F.lit("report"))
        )), lambda r: r.isNotNull())
        stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
        script = name.startswith("download") & (name.endswith(".ps1") | name.endswith(".sh"))
        return (
            F.when(F.array_contains(p, ".."), F.lit("parent-traversal"))
            .when(F.size(reasons) > 0, F.get(reasons, F.lit(0)))
            .when(k == "symlink", F.lit("symlink"))
            .when(k == "dir", F.lit(None).cast("string"))
            .when(k != "file", F.lit("non-regular"))
            .when(script, F.lit("downloader-script"))
            .when(stem == "report", F.lit("report"))
        )

    return F.transform(F.array(F.struct(segs.alias("p"), _c(kind).alias("k"))), pick)[0]


def numbered(prefix: str, number: Col, width: int) -> Column:
    """The number padded to ``width`` digits; a longer one stays whole."""
    text = _c(number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def run_number(name: Col) -> Column:
    """Numeric run entity of a file name, NULL when there is none."""
    return non_empty(F.regexp_extract(_c(name), r"_run-0*(\d+)_", 1)).cast("int")
