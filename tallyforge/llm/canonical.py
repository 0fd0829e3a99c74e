"""Free-entered values mapped to a canonical list.

The reference entries, their aliases and the rotations of their words ("Saw,
Panel") are paths of one trie.  A value is searched with a Levenshtein
automaton (edits: insert, delete, replace, swap of neighbours) that walks the
trie and keeps only the states within a distance that depends on the length;
all entries within it come back, the nearest one is taken.  The trie is built
from the reference list (a fixed table), each task walks it for its own rows
with a memo of values, and nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

# Words around a brand or a type that are not part of it.
LEGAL_FORMS = r"gmbh(?:\s*&\s*co\.?\s*kg)?|ag|se|kg|ltd\.?|limited|sa|s\.a\.?|inc\.?|corp\.?|llc|plc|s\.?p\.?a\.?|srl|s\.r\.l\.?|bv|b\.v\.?|oy|ab|a/s|&\s*co\.?(?:\s*kg)?"
CONDITION_WORDS = r"used|gebr\.?|gebraucht\w*|d['’]occasion|occasion|usad[oa]s?|neu|new|nuev[oa]|neuf|neuve|refurbished|reconditioned|generalüberholt|überholt|second\s*hand|cnc"
NOTHING = frozenset("- -- . ? ?? ??? / n/a na none null nil unknown unbekannt inconnu k.a. ka s/n sn no name noname various diverse divers other others andere sonstige misc miscellaneous standard see text siehe text autre autres varios otros tbc tba".split()) | {"no name", "see text", "siehe text", "without brand", "ohne marke"}


def fold(text: str) -> str:
    """Case, accents, spaces and punctuation taken away."""
    s = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe"))
    return "".join(c for c in s if c.isalnum())


def spelled(text: str) -> set[str]:
    """The folded text, also with umlauts written as two letters."""
    low = text.casefold()
    out = {fold(text), fold(low.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))}
    if "&" in text:
        out |= {fold(low.replace("&", word)) for word in ("und", "and", "et", "y", "e")}
    return out


def max_distance(length: int) -> int:
    """Edits allowed for a value of this length."""
    return 0 if length <= 3 else 1 if length <= 6 else 2


class Trie:
    """Folded reference strings with the ids they stand for."""

    __slots__ = ("nodes", "ids")

    def __init__(self) -> None:
        self.nodes: list[dict[str, int]] = [{}]
        self.ids: list[set[int]] = [set()]

    def add(self, text: str, ref_id: int) -> None:
        at = 0
        for c in text:
            nxt = self.nodes[at].get(c)
            if nxt is None:
                nxt = len(self.nodes)
                self.nodes[at][c] = nxt
                self.nodes.append({})
                self.ids.append(set())
            at = nxt
        if at:
            self.ids[at].add(ref_id)

    def exact(self, text: str) -> set[int]:
        at = 0
        for c in text:
            at = self.nodes[at].get(c, -1)
            if at < 0:
                return set()
        return self.ids[at]

    def search(self, text: str, k: int) -> dict[int, int]:
        """Every id within ``k`` edits of ``text`` with its distance.

        A state is the set of positions the automaton can be in, kept as the
        edit counts of the band around the diagonal; a branch ends when no
        position has an edit left.
        """
        if k == 0:
            return dict.fromkeys(self.exact(text), 0)
        n, found, nodes, ids, far = len(text), {}, self.nodes, self.ids, k + 1
        # (node, depth, band of this depth, band one depth up, last character)
        stack = [(0, 0, {j: j for j in range(min(k, n) + 1)}, None, "")]
        while stack:
            at, depth, row, up, last = stack.pop()
            if ids[at] and row.get(n, far) <= k:
                for i in ids[at]:
                    if row[n] < found.get(i, far):
                        found[i] = row[n]
            lo, hi = max(0, depth + 1 - k), min(n, depth + 1 + k)
            for c, nxt in nodes[at].items():
                new = {}
                for j in range(lo, hi + 1):
                    d = row.get(j, far) + 1
                    if j:
                        e = row.get(j - 1, far) + (text[j - 1] != c)
                        if e < d:
                            d = e
                        e = new.get(j - 1, far) + 1
                        if e < d:
                            d = e
                        if up is not None and j > 1 and text[j - 1] == last and text[j - 2] == c:
                            e = up.get(j - 2, far) + 1
                            if e < d:
                                d = e
                    if d <= k:
                        new[j] = d
                if new:
                    stack.append((nxt, depth + 1, new, row, c))
        return found


def _rotations(text: str) -> set[str]:
    words = [w for w in re.split(r"[\s,]+", text) if fold(w)]
    return {" ".join(words[k:] + words[:k]) for k in range(len(words))} if 1 < len(words) <= 5 else {text}


class Matcher:
    """Values against (id, name, aliases) entries."""

    def __init__(self, entries: list[tuple[int, str, str | None]], kind: str):
        self.kind, self.trie, self.words = kind, Trie(), []
        self.names: dict[int, str] = {}
        for ref_id, name, aliases in sorted(entries):
            self.names[ref_id] = name
            for text in (name, *(a.strip() for a in (aliases or "").split(";"))):
                for turned in {text, *_rotations(text)}:
                    for s in spelled(turned):
                        if s:
                            self.trie.add(s, ref_id)
                self.words.append((ref_id, [fold(w) for w in re.split(r"[\s-]+", text) if fold(w)]))
        self.match = lru_cache(maxsize=200_000)(self._match)

    def _variants(self, value: str) -> list[str]:
        """The value, then with less and less of what may surround an entry."""
        s = " ".join(value.replace("&nbsp;", " ").split()).strip(" ,;.:*!®™")
        out = [s]
        s = re.sub(r"\([^()]*\)|®|™", " ", s)
        if self.kind == "brand":
            s = re.sub(r"^\s*(?:fa\.?|firma|marke|brand|make|maker|hersteller)\s*:?\s+", "", s, flags=re.I)
            out.append(s)
            s = re.sub(r"\s+(?:mod\.?\s*)?[A-Z]{1,4}[\s.–-]*\d{2,6}\b.*$", "", s, flags=re.I)
            out.append(s)
            for _ in range(2):
                s = re.sub(rf"[\s,]+(?:{LEGAL_FORMS})\s*$", "", s.strip(" ,;.®"), flags=re.I)
                out.append(s)
            s = re.sub(r"\s+(?:used|gebraucht|occasion|usado)$", "", s, flags=re.I)
            out.append(s)
        else:
            s = re.sub(r"\b(?:19|20)\d\d\b", " ", s)
            out.append(s)
            s = re.sub(rf"(?:^|(?<=[\s,]))(?:{CONDITION_WORDS})(?=$|[\s,.])", " ", s, flags=re.I)
            s = re.sub(r"\bm/c\b", "machine", s, flags=re.I)
            out.append(s)
            t = re.sub(r"(?i)\s+machine\s*$", "", s)
            out.append(t)
            if re.search(r"[a-z]s\s*$", t, re.I):
                out.append(re.sub(r"(?i)(?:es|s)\s*$", "", t))
                out.append(re.sub(r"(?i)s\s*$", "", t))
        return list(dict.fromkeys(x.strip(" ,;.:") for x in out if fold(x)))

    def _match(self, value: str) -> int:
        low = " ".join(value.split()).casefold()
        if not fold(value) or low in NOTHING:
            return -1
        variants = self._variants(value)
        for v in variants:
            if hit := self.trie.exact(fold(v)):
                return min(hit)
        if (hit := self._abbreviated(variants)) is not None:
            return hit
        best: tuple[int, int] | None = None
        for v in variants:
            s = fold(v)
            k = max_distance(len(s))
            if best is not None:
                k = min(k, best[0])
            for ref_id, d in self.trie.search(s, k).items():
                if best is None or (d, ref_id) < best:
                    best = (d, ref_id)
        return best[1] if best else -1

    def reached(self, value: str) -> dict[int, int]:
        """Every entry within reach of a value with its least distance over the value's variants."""
        out: dict[int, int] = {}
        if fold(value) and " ".join(value.split()).casefold() not in NOTHING:
            for v in self._variants(value):
                for ref_id, d in self.trie.search(fold(v), max_distance(len(fold(v)))).items():
                    out[ref_id] = min(d, out.get(ref_id, d))
        return out

    def _abbreviated(self, variants: list[str]) -> int | None:
        """Words cut with a point: ``Horiz. Borer``."""
        for v in variants:
            if "." not in v:
                continue
            parts = [(fold(p), p.endswith(".")) for p in re.split(r"[\s-]+", v) if fold(p)]
            if not parts or not any(cut and len(p) >= 3 for p, cut in parts):
                continue
            hits = {ref_id for ref_id, words in self.words if len(words) == len(parts) and all(w.startswith(p) if cut else w == p for w, (p, cut) in zip(words, parts))}
            if len(hits) == 1:
                return hits.pop()
        return None


#: A canonical list is a reference table; the trie of a longer one would no longer be a small thing to hand to every task.
MOST_ENTRIES = 200_000


def entries_of(reference: DataFrame, id_col: str, name_col: str, alias_col: str) -> list[tuple[int, str, str | None]]:
    """A reference list: a fixed table whose size is its own, not the data's; checked before it is handed to the tasks."""
    rows = [tuple(r) for r in reference.select(id_col, name_col, alias_col).where(f"{id_col} is not null and {name_col} is not null").limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries: split the list by kind and map each part")
    return rows


_made: dict[tuple, Matcher] = {}


def matcher(entries: list[tuple[int, str, str | None]], kind: str) -> Matcher:
    """The matcher of a list, built once per worker and kept for its next tasks."""
    key = (kind, tuple(entries))
    if key not in _made:
        if len(_made) > 8:
            _made.clear()
        _made[key] = Matcher(entries, kind)
    return _made[key]


def matched(values: DataFrame, entries: dict[str, list[tuple]], field_col: str, value_col: str, carried: list[str]) -> DataFrame:
    """``values`` (field, value, carried columns) with ``ref_id``, for those that are neither null nor blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {name: matcher(rows, name) for name, rows in entries.items()}
        for b in batches:
            yield b.assign(ref_id=[matchers[f].match(v) if v.strip() else None for f, v in zip(b[field_col].array, b[value_col].array)]).dropna(subset=["ref_id"]).astype({"ref_id": "int64"})

    source = values.where(F.col(value_col).isNotNull() & F.col(field_col).isin(*entries)).select(field_col, value_col, *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return spread(source).mapInPandas(run, f"{schema}, ref_id long")


def within(values: DataFrame, entries: dict[str, list[tuple]], field_col: str, value_col: str) -> DataFrame:
    """(field, value, ref_id, distance) for every entry within the length-dependent distance of each value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {name: matcher(rows, name) for name, rows in entries.items()}
        for b in batches:
            out = [(f, v, r, d) for f, v in zip(b[field_col].array, b[value_col].array) for r, d in sorted(matchers[f].reached(v).items())]
            yield pd.DataFrame(out, columns=["field", "value", "ref_id", "distance"]).astype({"ref_id": "int64", "distance": "int64"})

    source = values.where(F.col(value_col).isNotNull() & F.col(field_col).isin(*entries)).select(field_col, value_col)
    return spread(source).mapInPandas(run, "field string, value string, ref_id long, distance long")


def map_values(rows: DataFrame, id_col: str, fields: dict[str, tuple[str, list[tuple[int, str, str | None]]]]) -> DataFrame:
    """(id, field, ref_id) for every row and field whose value is neither null nor blank.

    ``fields`` maps a field name to (column, entries).  Values without an entry
    get -1.  Of several entries within reach the nearest counts, at equal
    distance the one with the smaller id; repeated rows give repeated results;
    columns other than the named ones are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {name: matcher(entries, name) for name, (_, entries) in fields.items()}
        for b in batches:
            for name, m in matchers.items():
                ids, refs = [], []
                for id_, v in zip(b["id"].array, b[name].array):
                    if v is not None and v.strip():
                        ids.append(id_)
                        refs.append(m.match(v))
                yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "field": name, "ref_id": pd.Series(refs, dtype="int64")})

    source = rows.select(F.col(id_col).alias("id"), *[F.col(c).alias(name) for name, (c, _) in fields.items()]).where("id is not null")
    return spread(source).mapInPandas(run, "id long, field string, ref_id long")
