"""Choosing a table for a question, from the catalog of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Weights of the heuristic.
TAG, DESCRIPTION, COMBINED, GROUPED = 3, 2, 2, 4
#: Names that a header gets when it had none; a table with half of them says little.
_GENERIC = re.compile(r"^(col|column|field|unnamed)[_ :]*\d*$")


@dataclass
class Entry:
    """A catalog row: a table's name, where it is from, what is said about it."""

    name: str
    corpus: str = ""
    columns: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    description: str = ""
    rows: int = 0
    combined: bool = False
    grouped: bool = False
    from_scan: bool = False


def reliable(entries: list[Entry]) -> list[Entry]:
    """Without tables read off pages and those with at least half generic columns; all of them if none would be left."""
    good = [e for e in entries if not e.from_scan and sum(bool(_GENERIC.match(c.lower())) for c in e.columns) * 2 < max(1, len(e.columns))]
    return good or entries


def visible(entries: list[Entry], corpus: str | None) -> list[Entry]:
    """Tables of a corpus; a script without one sees all."""
    return entries if corpus is None else [e for e in entries if e.corpus == corpus]


def score(entry: Entry, question: str) -> int:
    words = set(re.findall(r"[a-z0-9]+", question.lower()))
    said = set(re.findall(r"[a-z0-9]+", entry.description.lower()))
    return TAG * len(words & {t.lower() for t in entry.tags}) + DESCRIPTION * len(words & said) + COMBINED * entry.combined + GROUPED * entry.grouped


def choose(entries: list[Entry], question: str, corpus: str | None = None) -> Entry | None:
    """The table whose name the question holds, else the best score, grouped ones first, then the most rows and the name."""
    found = reliable(visible(entries, corpus))
    low = re.sub(r"[\s_]+", " ", question.lower())
    named = [e for e in found if re.sub(r"[\s_]+", " ", e.name.lower()) in low]
    return max(named or found, key=lambda e: (score(e, question), e.grouped, e.rows, [-ord(c) for c in e.name]), default=None)


def resolve_column(name: str, columns: list[str], aliases: dict[str, str] | None = None) -> tuple[str | None, float]:
    """A column for a name: the same 1, in another case 0.95, by alias 0.85, by at least half of its words."""
    if name in columns:
        return name, 1.0
    key = lambda s: re.sub(r"[\s_]+", "_", s.strip().lower())
    for c in columns:
        if key(c) == key(name):
            return c, 0.95
    if (target := {key(k): v for k, v in (aliases or {}).items()}.get(key(name))) in columns:
        return target, 0.85
    own = set(key(name).split("_"))
    share = {c: len(own & (w := set(key(c).split("_")))) / len(own | w) for c in columns}
    best = max(columns, key=lambda c: (share[c], [-ord(x) for x in c]), default=None)
    return (best, round(share[best], 4)) if best is not None and share[best] >= 0.5 else (None, 0.0)
