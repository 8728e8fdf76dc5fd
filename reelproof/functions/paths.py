"""Predicates and projections over paths: litter, containment, sidecars, names of sessions and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and files that operating systems leave behind, compared in lower case.
LITTER_DIRS = ("system volume information", "$recycle.bin", "recycler", ".trashes", ".spotlight-v100", ".fseventsd", ".temporaryitems", ".documentrevisions-v100", "found.000")
LITTER_FILES = ("thumbs.db", "desktop.ini", ".ds_store")
# Names that Windows reserves, whatever the extension.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
ILLEGAL = r'[<>:"|?*\\\x00-\x1f]'
# Files that cards of a camera keep as an index of their clips.
CARD_INDEXES = ("private/database/database.bin",)
INDEX_BYTES = 256 << 20
CLOUD_BITS = 0x441000
MTIME_SECONDS = 2


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def in_litter_dir(rel: Column) -> Column:
    """Whether any directory above the file, at any depth, is litter."""
    above = F.slice(parts(rel), F.lit(1), F.greatest(F.size(parts(rel)) - 1, F.lit(0)))
    return F.exists(above, lambda d: F.lower(d).isin(*LITTER_DIRS))


def is_litter_file(rel: Column) -> Column:
    """Whether the file itself is litter; such files are listed as skipped."""
    name = F.lower(basename(rel))
    return name.isin(*LITTER_FILES) | name.startswith("._")


def is_cloud_placeholder(attrs: Column) -> Column:
    """Whether the attribute bits say that the content is not here."""
    return F.coalesce(attrs.bitwiseAND(F.lit(CLOUD_BITS)) != 0, F.lit(False))


def relative(root: Column, path: Column) -> Column:
    """The path below root with forward slashes; null if it is not below it."""
    base = F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    full = F.translate(path, "\\", "/")
    return F.when(F.startswith(full, F.concat(base, F.lit("/"))), F.substr(full, F.length(base) + 2))


def normalise(path: Column) -> Column:
    """P5: a path as a manifest gives it, with forward slashes and no leading ./"""
    return F.regexp_replace(F.trim(F.translate(path, "\\", "/")), r"^(\./)+", "")


def is_contained(rel: Column) -> Column:
    """Whether a path stays inside its folder."""
    bad = F.exists(parts(rel), lambda c: c.isin("", ".", ".."))
    return F.coalesce(~bad & ~rel.rlike("^[A-Za-z]:") & ~F.startswith(rel, F.lit("/")), F.lit(False))


def is_sidecar(rel: Column, tool: str = "custody") -> Column:
    """The engine's own files: manifests of either dialect, session records, the probe file."""
    name = basename(rel)
    chained = F.exists(parts(rel), lambda d: F.lower(d) == "ascmhl")
    return F.when(chained, name.rlike(r"\.(mhl|xml)$")).otherwise((name == f".{tool}-write-probe") | name.rlike(rf"^{tool}_.*\.(mhl|json)$"))


def is_session_name(name: Column) -> Column:
    """A date, an underscore and a label."""
    return name.rlike(r"^\d{4}-\d{2}-\d{2}_.+")


def manifest_base(path: Column) -> Column:
    """The folder that a manifest speaks for: the parent of an ascmhl directory, else its own."""
    own = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(own.rlike(r"(?i)(^|/)ascmhl$"), F.regexp_replace(own, r"/?[^/]*$", "")).otherwise(own)


def sanitise(label: Column) -> Column:
    """a label that any file system takes: illegal characters as -, no dots or spaces at its ends, never empty."""
    plain = F.regexp_replace(label, r'[<>:"/\\|?*\x00-\x1f\x7f]', "-")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(plain), r"^\.+|\.+$", "")), F.lit("")), F.lit("session"))


def session_folder(started_at: Column, tz: Column, label: Column) -> Column:
    """P10: the operator's own date and the label."""
    day = F.date_format(F.from_utc_timestamp(started_at, tz), "yyyy-MM-dd")
    return F.concat(day, F.lit("_"), sanitise(label))


def mtimes_match(a: Column, b: Column) -> Column:
    """Whole seconds, two apart at most."""
    return F.abs(F.unix_seconds(a) - F.unix_seconds(b)) <= MTIME_SECONDS


def expected_on(slot: Column, pairing: Column) -> Column:
    """Whether a file is expected on a slot: on a card only if the pairing has it there."""
    return F.when(slot == "C1", pairing != "OnlyOnC2").when(slot == "C2", pairing != "OnlyOnC1").otherwise(F.lit(True))


def is_card_index(rel: Column, size: Column) -> Column:
    """P13"""
    return F.lower(rel).isin(*CARD_INDEXES) & (size <= INDEX_BYTES)


def kept_rel(card: Column, rel: Column) -> Column:
    """Where a card's own index is kept."""
    return F.concat(F.lit("_twin/"), card, F.lit("/"), rel)


def drive_kind(drive_type: Column) -> Column:
    """The kind of drive, by its code."""
    codes = {0: "unknown", 1: "no root", 2: "removable", 3: "fixed", 4: "network", 5: "optical", 6: "ram"}
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in codes.values()]), drive_type), F.lit("unknown"))


def is_card_like(drive_type: Column) -> Column:
    return drive_kind(drive_type) == "removable"


def is_dest_like(drive_type: Column) -> Column:
    return drive_kind(drive_type).isin("fixed", "removable", "network")


def is_verifiable(drive_type: Column) -> Column:
    """Whether reading back proves what the disk holds."""
    return drive_kind(drive_type) != "network"


def same_location(a: Column, b: Column) -> Column:
    """P20: the same place, whatever the case and trailing slashes."""
    plain = lambda c: F.lower(F.regexp_replace(F.translate(c, "\\", "/"), "/+$", ""))
    return plain(a) == plain(b)


def is_volume_root(root: Column) -> Column:
    """P21"""
    return root.rlike(r"^[A-Za-z]:[\\/]?$")


def basename(rel: Column) -> Column:
    """F6"""
    return F.element_at(parts(rel), -1)


def extension(rel: Column) -> Column:
    """what follows the last dot of the whole path, in lower case; null without a dot."""
    return F.when(rel.contains("."), F.lower(F.substring_index(rel, ".", -1)))


def subpath(root: Column, path: Column) -> Column:
    """what lies below a volume's root, or nothing."""
    return F.coalesce(relative(root, path), F.lit(""))
