"""Results as files for people: one CSV with a header, one JSON document, a Markdown summary, an HTML table, a page of sections.

All are for results of report size (a row per ranked candidate at most); tables go to parquet.
"""

from __future__ import annotations

import csv
import html
import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _write(path: str, text: str) -> str:
    """Write beside the target and move there, so that a reader sees the old file or the new one."""
    with open(f"{path}.part", "w", encoding="utf-8", newline="") as out:
        out.write(text)
    os.replace(f"{path}.part", path)
    return path


def number(value: float | None) -> str:
    """A score without needless zeros."""
    return "" if value is None else f"{value:g}"


def deductions(items: Column) -> Column:
    """``kind(-points)`` of a list of (kind, points), joined by semicolons."""
    return F.array_join(F.transform(items, lambda x: F.concat(x["kind"], F.lit("(-"), x["points"].cast("string"), F.lit(")"))), ";")


def _rows(df: DataFrame, order: Iterable[str]) -> tuple[list[str], Iterable[tuple]]:
    return df.columns, (tuple(r) for r in df.orderBy(*order).toLocalIterator())


def to_csv(df: DataFrame, path: str, order: Iterable[str]) -> str:
    import io

    names, rows = _rows(df, order)
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(names)
    writer.writerows(rows)
    return _write(path, out.getvalue())


def to_json(record: dict, path: str) -> str:
    return _write(path, json.dumps(record, ensure_ascii=False, indent=2, sort_keys=True, default=str))


def to_markdown(sections: DataFrame, path: str, group: str, title: str) -> str:
    """A section per group of :func:`poolcraft.operators.ranking.first_of_each`: a line per row, and how many more there are."""
    names, rows = _rows(sections, [group, "k"])
    lines, last, more = [f"# {title}"], None, 0
    for row in rows:
        values = dict(zip(names, row, strict=True))
        if values[group] != last:
            lines += ([f"… and {more} more"] if more else []) + ["", f"## {values[group]}", ""]
            last = values[group]
        more = values["more"]
        shown = ", ".join(f"{k} {number(v) if isinstance(v, float) else v}" for k, v in values.items() if k not in (group, "more", "k"))
        lines.append(f"{values['k']}. {shown}")
    return _write(path, "\n".join(lines + ([f"… and {more} more"] if more else [])) + "\n")


def to_html(df: DataFrame, path: str, order: Iterable[str], title: str) -> str:
    """A table, every cell escaped."""
    names, rows = _rows(df, order)
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(number(v) if isinstance(v, float) else '' if v is None else str(v))}</{tag}>" for v in row) + "</tr>"
    body = "\n".join([cells("th", names), *(cells("td", r) for r in rows)])
    return _write(path, f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>\n<table>\n{body}\n</table>\n")


@dataclass(frozen=True)
class Section:
    """A part of a page: the first ``most`` rows in order, and how many there are in all.

    ``links`` has a template per column, like ``https://host/{id}``, filled with a row's values; a template that is one column alone, like ``{url}``, takes the address as it stands.
    ``tops``: greatest value per key of map columns, for the length of bars.
    """

    title: str
    rows: DataFrame
    order: tuple[str, ...]
    links: Mapping[str, str] = field(default_factory=dict)
    tops: Mapping[str, float] = field(default_factory=dict)
    most: int = 1000


def _cell(value: object, tops: Mapping[str, float]) -> str:
    """A value by its type: numbers, chips of a list of strings, bars of a map, quotes of a list of records. Everything is escaped."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return number(value)
    if isinstance(value, dict):
        bars = []
        for key, v in sorted(value.items()):
            top, v = float(tops.get(key) or 0), float(v or 0)
            share = min(1.0, max(0.0, v / top)) if top > 0 else 0.0
            bars.append(f'<i class="bar{"" if v > 0 else " none"}" style="width:{round(60 * share)}px" title="{html.escape(key)}: {number(v)}{f" of {number(top)}" if top else ""}"></i>')
        return "".join(bars)
    if isinstance(value, (list, tuple)) and not isinstance(value, Row):
        if any(isinstance(v, Row) for v in value):
            quotes = "".join("<blockquote>" + "<br>".join(f"{html.escape(k)}: {html.escape(str(x))}" for k, x in v.asDict().items() if x is not None) + "</blockquote>" for v in value if v is not None)
            return f"<details><summary>{len(value)}</summary>{quotes}</details>"
        return "".join(f'<span class="chip">{html.escape(str(v))}</span>' for v in value if v is not None)
    return html.escape(str(value))


def _linked(text: str, template: str, values: Mapping[str, object]) -> str:
    """``text`` as a link, where all parts of the address are known and it is one of the web."""
    try:
        if any(v is None for k, v in values.items() if f"{{{k}}}" in template):
            return text
        whole = len(template) > 2 and template[0] == "{" and template[-1] == "}" and template[1:-1] in values
        address = str(values[template[1:-1]]) if whole else template.format(**{k: quote(str(v), safe="") for k, v in values.items()})
    except (KeyError, IndexError, ValueError):
        return text
    return f'<a target="_blank" rel="noopener noreferrer" href="{html.escape(address)}">{text}</a>' if address.lower().startswith(("https://", "http://")) else text


_STYLE = "body{font:14px sans-serif}td,th{text-align:left;padding:3px 8px;vertical-align:top}.chip{background:#eee;border-radius:8px;padding:0 6px;margin-right:4px}.bar{display:inline-block;height:8px;background:#47a;margin-right:2px}.none{background:#ccc;min-width:2px}"


def to_page(sections: Iterable[Section], path: str, title: str) -> str:
    """One HTML page of several tables; an empty one says so. A section's rows come to the driver, ``most`` of them at most."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    for section in sections:
        count = section.rows.count()
        parts.append(f"<h2>{html.escape(section.title)} ({count})</h2>")
        if not count:
            parts.append("<p>none</p>")
            continue
        names, lines = section.rows.columns, []
        for row in section.rows.orderBy(*section.order).limit(section.most).toLocalIterator():
            values = dict(zip(names, row, strict=True))
            cells = ((_cell(v, section.tops), section.links.get(k)) for k, v in values.items())
            lines.append("<tr>" + "".join(f"<td>{_linked(text, template, values) if template and text else text}</td>" for text, template in cells) + "</tr>")
        head = "<tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr>"
        parts += ["<table>", head, *lines, "</table>"] + ([f"<p>and {count - section.most} more</p>"] if count > section.most else [])
    return _write(path, "\n".join([*parts, "</body></html>", ""]))
