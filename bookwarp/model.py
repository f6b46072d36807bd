"""The assembled book and the shapes of results."""

from __future__ import annotations

from dataclasses import dataclass

ENTITY = "struct<id:bigint,name:string,sort:string,link:string>"
FORMAT = "struct<format:string,name:string,size:bigint>"
BOOK = f"""id bigint, uuid string, title string, title_sort string, authors array<{ENTITY}>, author_sort string, series {ENTITY},
series_index double, publisher string, pubdate string, isbn string, identifiers map<string,string>, languages array<string>, tags array<string>,
comments string, rating double, format_files array<{FORMAT}>, formats array<string>, has_cover boolean, path string, timestamp string,
last_modified string, size bigint"""
CANDIDATE = "source string, title string, authors array<string>, isbn string, publisher string, description string, cover_url string"


@dataclass(frozen=True)
class Criterion:
    """One condition of a search: a field, an operator and a value."""

    field: str
    operator: str = "contains"
    value: str = ""
