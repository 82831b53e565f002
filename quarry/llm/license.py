"""License notices, exact and fuzzy (operator 5).

Texts are lower-cased (A-Z), cut into words of letters, digits and bytes from
0x80 on, and joined by single blanks.  Base labels come from exact phrases.  The
fuzzy search allows each short notice a number of character edits k: the notice
is cut into k + 1 seeds, at least one of which must occur unchanged if there are
at most k edits (pigeonhole); one Aho-Corasick automaton finds all seeds of all
notices, and around each hit the regex library's bounded-error matching
verifies the edits and gives the span.

Defined results: a null text has no words and no labels; repeated rows are
treated alike; a phrase's places never overlap themselves; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices (as normalised words), their labels and the edits allowed.
NOTICES = [
    ("licensed under the mit license", "mit", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("apache license version 2 0", "apache-2", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    ("gnu general public license version 3", "gpl-3", 3),
    ("mozilla public license version 2", "mpl-2", 3),
]

#: Upper case to lower, other bytes that no word holds to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_FOLD).split()).decode("utf-8", "replace")


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that cover the notice: (offset, piece)."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    def __init__(self, notices=NOTICES):
        self.notices = notices
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(notices):
            for offset, piece in seeds(notice, k):
                found.setdefault(piece, []).append((i, offset))
        self.machine = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in notices]

    def spans(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice length) in the normalised text, in order; overlapping finds of one notice merge to the best."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.machine.iter(text):
            for i, offset in uses:
                notice, _, k = self.notices[i]
                start = end + 1 - size - offset
                a, b = max(0, start - k), min(len(text), start + len(notice) + k)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                    own[-1][0] = min(own[-1][0], a)
                else:
                    own.append([a, b])
        out = []
        for i, own in windows.items():
            notice, label, k = self.notices[i]
            while own:  # the best find of a stretch comes first; what lies before and behind it is searched again
                a, b = own.pop()
                m = self.patterns[i].search(text, a, b) if b - a >= len(notice) - k else None
                if m:
                    s, e = m.span()
                    out.append((s, e, label, sum(m.fuzzy_counts), len(notice)))
                    own += [[a, s], [e, b]]
        return sorted(out)


def base_places(text: str) -> list[tuple[int, str]]:
    """(first word, label) of every exact phrase in the normalised text."""
    padded, out = f" {text} ", []
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((padded.count(" ", 0, at), label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


_KIND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "spans array<struct<start: long, end: long, label: string, edits: long>>")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans of fuzzy finds
    (in characters of the normalised text) for every row; the score is the best find's share of unchanged characters."""
    made: list[Finder] = []
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                      ("labels", pa.string()), ("score", pa.float64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())])))])

    def look(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Finder())
        out = []
        for raw in texts.to_pylist():
            t = normalise(raw)
            base, found = base_places(t), made[0].spans(t) if t else []
            labels = {x for _, x in base}
            score = 1.0 if base else max((1 - e / n for *_, e, n in found), default=0.0)
            out.append({"n_words": t.count(" ") + 1 if t else 0, "n_base": len(base), "first_word": min((i for i, _ in base), default=None),
                        "last_word": max((i for i, _ in base), default=None), "base_labels": ",".join(sorted(labels)),
                        "labels": ",".join(sorted(labels | {x[2] for x in found})), "score": score,
                        "spans": [{"start": s, "end": e, "label": x, "edits": k} for s, e, x, k, _ in found]})
        return pa.array(out, kind)

    return docs.select("doc_id", F.arrow_udf(look, _KIND)("text").alias("f")).select("doc_id", "f.*")
