"""A sheet's rows as structured text, for readers that hold one sheet in memory; tables of sheets go by operators.sheets."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

from tessera.lexicon import CHINESE, Lexicon

NUMBER = re.compile(r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)(?:%|元|万元|万)?")
NOTE_MARK, SHEET_MARK = "[说明]", "[Sheet]"


def looks_numeric(value: str) -> bool:
    return NUMBER.fullmatch(value.strip().replace(",", "")) is not None


def header_row(rows: list[list[str]]) -> int:
    """The row that looks most like a header: see operators.sheets.infer_header."""
    full = [[c.strip() for c in r if c.strip()] for r in rows]
    widths = list(map(len, full))
    some = [i for i, w in enumerate(widths) if w]
    if not some:
        return 0

    def score(i: int) -> tuple[float, int, int]:
        w, least = widths[i], max(2, widths[i] // 2)
        own = len({v.casefold() for v in full[i]}) / w * 3 + sum(not looks_numeric(v) for v in full[i]) / w * 3
        near = sum(n >= least for n in widths[i + 1 : i + 4])
        return 2 * w + own + 2 * near + (4 if w >= max(2, max(widths) // 2) else 0), w, -i

    wide = [i for i in some if widths[i] >= 2]
    return max(wide, key=score) if wide and len(some) > 1 else some[0]


def unique_names(headers: list[str]) -> list[str]:
    """Blank and `unnamed` headers by position, repeats numbered."""
    seen: Counter[str] = Counter()
    out = []
    for i, h in enumerate(headers):
        name = " ".join(h.split())
        name = f"列{i + 1}" if not name or name.casefold().startswith("unnamed") else name
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def fills_down(header: str, values: list[str], lexicon: Lexicon = CHINESE) -> bool:
    """Whether a column's blanks stand for the value above: see operators.sheets.profile_columns."""
    name, full = "".join(header.split()).lower(), [v.strip() for v in values if v.strip()]
    if not name or any(h in name for h in lexicon.no_fill_columns):
        return False
    if any(h in name for h in lexicon.fill_columns):
        return True
    if len(full) < 2:
        return False
    text = sum(not looks_numeric(v) for v in full) / len(full)
    return text >= 0.7 and 1 - len(full) / len(values) >= 0.25 and max(Counter(full).values()) / len(full) >= 0.25


def filled_down(headers: list[str], rows: list[list[str]], lexicon: Lexicon = CHINESE) -> list[list[str]]:
    """Rows of the header's width with blanks filled where `fills_down` says so."""
    rows = [(r + [""] * len(headers))[: len(headers)] for r in rows]
    for j, header in enumerate(headers):
        if fills_down(header, [r[j] for r in rows], lexicon):
            above = ""
            for r in rows:
                above = r[j] = r[j].strip() or above
    return rows


def csv_line(values: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def sheet_text(name: str, rows: list[list[str]]) -> str:
    """Marker, header, notes for the rows above it, and data rows; blank rows and trailing blank columns go."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    at = header_row(rows)
    width = max(j + 1 for r in rows[at:] for j, c in enumerate(r) if c.strip())
    headers = unique_names((rows[at] + [""] * width)[:width])
    notes = [f"{NOTE_MARK} {' '.join(c.strip() for c in r if c.strip())}" for r in rows[:at]]
    return "\n".join([f"{SHEET_MARK} {name}", csv_line(headers), *notes, *map(csv_line, filled_down(headers, rows[at + 1 :]))])


def preview(content: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """Sheets of structured text again: (name, headers, rows), rows padded to the widest."""
    out: list[tuple[str, list[list[str]]]] = []
    for line in content.splitlines():
        if line.strip().startswith(SHEET_MARK):
            out.append((line.strip()[len(SHEET_MARK) :].strip(), []))
        elif line.strip() and not line.startswith(NOTE_MARK):
            if not out:
                out.append(("", []))
            out[-1][1].append(next(csv.reader([line]), []))
    found = []
    for name, lines in out:
        width = max(map(len, lines), default=0)
        padded = [r + [""] * (width - len(r)) for r in lines]
        found.append((name, padded[0] if padded else [], padded[1:]))
    return found
