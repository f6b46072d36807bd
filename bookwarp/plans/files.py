"""Carrying out an organize plan on a file system: folders are moved, files renamed, one result per book.

The plan is read row by row on the driver, which is where a library's folders are reachable.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass
class Outcome:
    """What happened to one book; paths are to be updated in the tables only where ``error`` is empty."""

    book_id: int
    proposed_path: str
    moved: bool = False
    renamed: list[str] = field(default_factory=list)
    names: list[tuple[str, str]] = field(default_factory=list)
    error: str = ""


def _moved(root: Path, row) -> tuple[bool, str]:
    source, target = root / row.current_path, root / row.proposed_path
    if not source.exists():
        return False, f"Source folder not found: {source}"
    if target.exists() and target != source:
        return False, f"Destination already exists: {target}"
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        source.rename(target)
    except OSError as error:
        return False, f"Move failed: {error}"
    return True, ""


def _renamed(folder: Path, old: str, new: str, suffix: str) -> str:
    """Renames one file and returns what went wrong."""
    source, target = folder / f"{old}.{suffix}", folder / f"{new}.{suffix}"
    if not source.exists():
        return f"Format file not found: {source}"
    if target.exists() and target != source:
        return f"Format destination already exists: {target}"
    try:
        source.rename(target)
    except OSError as error:
        return f"Format rename failed: {error}"
    return ""


def carry_out(plan: DataFrame, root: str | Path, apply: bool = False) -> list[Outcome]:
    """The outcomes for all plans with changes; without ``apply`` nothing is touched.

    A failed move leaves the book as it was; a failed rename is reported and the other files still get their names, but
    then the tables keep the former path.
    """
    root, out = Path(root), []
    for row in plan.filter("has_changes").orderBy("book_id").toLocalIterator():
        result = Outcome(row.book_id, row.proposed_path)
        out.append(result)
        if not apply:
            continue
        if row.folder_changed:
            result.moved, result.error = _moved(root, row)
            if result.error:
                continue
        for r in row.format_renames:
            if r.old_name != r.new_name:
                wrong = _renamed(root / row.proposed_path, r.old_name, r.new_name, r.format.lower())
                if wrong:
                    result.error = wrong
                else:
                    result.renamed.append(r.new_name)
                    result.names.append((r.format, r.new_name))
    return out


LARGEST_SIDE = 800


def save_cover(folder: str | Path, content: bytes) -> str:
    """Saves an image as cover.jpg in a book's folder, its larger side at most ``LARGEST_SIDE``; returns what went wrong."""
    import io

    folder = Path(folder)
    if not folder.exists():
        return f"Book folder not found: {folder}"
    if not content:
        return "No image data"
    try:
        from PIL import Image
    except ImportError as error:
        raise ImportError("Saving covers needs the optional 'Pillow' dependency - install it with: pip install Pillow") from error
    try:
        image = Image.open(io.BytesIO(content)).convert("RGB")
        image.thumbnail((LARGEST_SIDE, LARGEST_SIDE))
        image.save(folder / "cover.jpg", "JPEG", quality=90)
    except Exception as error:  # noqa: BLE001  (what an unreadable image raises is open)
        return f"Could not save cover: {error}"
    return ""
