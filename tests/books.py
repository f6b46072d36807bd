"""Books in the assembled shape from a few fields."""

from bookwarp.model import BOOK

DEFAULTS = {"uuid": "", "title": "", "title_sort": "", "authors": [], "author_sort": "", "series": None, "series_index": 0.0, "publisher": "", "pubdate": "", "isbn": "", "identifiers": {}, "languages": [], "tags": [], "comments": "", "rating": 0.0, "format_files": [], "formats": [], "has_cover": False, "path": "", "timestamp": "", "last_modified": "", "size": 0}
FIELDS = ["id", *[k for k in DEFAULTS]]


def make(spark, *rows):
    out = []
    for i, row in enumerate(rows, 1):
        row = dict(row)
        if "author" in row:
            name = row.pop("author")
            row["authors"] = [(i, name, row.pop("author_sort_name", None), "")] if name is not None else []
        if "series" in row and row["series"] is not None:
            row["series"] = (1, row["series"], row["series"], "")
        if "size" in row:
            row["size"] = int(row["size"])
        full = {"id": i, **DEFAULTS, **row}
        out.append(tuple(full[f] for f in FIELDS))
    return spark.createDataFrame(out, BOOK)
