"""License scans: pigeonhole seeds find candidates, bounded-error matching verifies them.

A notice that may differ in at most k edits is split into k + 1 pieces; by the pigeonhole
principle one piece stands unchanged in every match, so an exact search for the pieces loses
nothing.  Around the hits the `regex` library matches the whole notice with at most k errors
against every span between word borders whose length allows it.  Where spans of one notice
overlap the one with the fewest edits stays, then the first, then the shortest; all others are reported.

Defined cases: null and empty texts have no words and no matches, and score 0; repeated rows are scanned
each; very long texts are scanned whole, in time that grows with their length; ties between overlapping spans
of equal edits go to the first, then the shortest; an empty table gives an empty result; other columns pass
unchanged, those with the name of an output as input_<name>.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.llm.common import annotate, strings

#: Phrases whose places are counted exactly, and their labels (fixed values).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices searched with errors: at most one edit for every EDIT_CHARS characters, or the given number
#: where one word tells two licenses apart.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("mit license", "mit"),
    ("released under the mit license", "mit"),
    ("bsd 3 clause license", "bsd"),
    ("bsd 2 clause license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("all rights reserved", "all-rights-reserved"),
)
EDIT_CHARS = 9
#: Spans of a notice whose edits a task keeps.
KNOWN_SPANS = 20_000

_WORD_BYTES = bytes(b for b in range(256) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


@dataclass
class Notice:
    phrase: str
    label: str
    edits: int
    pieces: list[tuple[bytes, int]] = field(default_factory=list)  # (piece, its offset in the phrase)
    pattern: regex.Pattern | None = None  # finds whether there is a match
    whole: regex.Pattern | None = None  # fewest edits of a given span
    known: dict[str, int] = field(default_factory=dict)  # edits of spans seen, -1 beyond the bound

    def edits_of(self, span: str) -> int:
        got = self.known.get(span)
        if got is None:
            m = self.whole.fullmatch(span)
            if len(self.known) >= KNOWN_SPANS:
                self.known.clear()
            got = self.known[span] = sum(m.fuzzy_counts) if m else -1
        return got


def compile_notices(notices=NOTICES, edit_chars: int = EDIT_CHARS) -> list[Notice]:
    out = []
    for phrase, label, *edits in notices:
        k = edits[0] if edits else len(phrase) // edit_chars
        cut = [len(phrase) * i // (k + 1) for i in range(k + 2)]
        pieces = [(phrase[a:b].encode(), a) for a, b in zip(cut, cut[1:])]
        fuzzy = rf"(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}"
        out.append(Notice(phrase, label, k, pieces, regex.compile(rf"(?<![^ ]){fuzzy}(?![^ ])"), regex.compile(rf"(?b){fuzzy}")))
    return out


def normalize(text: str) -> bytes:
    """A-Z lowered, words of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ joined by single spaces."""
    return b" ".join(text.encode("utf-8", "replace").translate(_TO_WORDS).split())


def find_places(norm: bytes, phrase: bytes) -> list[int]:
    """Byte offsets at which the phrase's words stand consecutively."""
    out, at, n = [], norm.find(phrase), len(norm)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or norm[at - 1] == 32) and (end == n or norm[end] == 32):
            out.append(at)
        at = norm.find(phrase, at + 1)
    return out


def _windows(norm: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged byte ranges between word borders that hold every match with at most `edits` errors."""
    found = []
    # an error may insert a character of up to four bytes
    slack, length = 4 * notice.edits + 1, len(notice.phrase)
    for piece, offset in notice.pieces:
        at = norm.find(piece)
        while at >= 0:
            found.append((max(at - offset - slack, 0), min(at - offset + length + slack, len(norm))))
            at = norm.find(piece, at + 1)
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        # matches begin and end at word borders, so words cut by the range's ends are left out
        begin = a if a == 0 or norm[a - 1] == 32 else norm.find(b" ", a, b) + 1
        end = b if b == len(norm) or norm[b] == 32 else norm.rfind(b" ", a, b)
        if (begin or a == 0) and end > begin:
            out.append((begin, end))
    return out


def _spans(window: str, notice: Notice) -> list[tuple[int, int, int]]:
    """(first word, end word, edits) of the matches in a window, in order, without those that overlap a better one."""
    if not notice.pattern.search(window):
        return []
    starts = [0, *(i + 1 for i, c in enumerate(window) if c == " ")]
    ends = [*(x - 1 for x in starts[1:]), len(window)]
    shortest, longest = len(notice.phrase) - notice.edits, len(notice.phrase) + notice.edits
    found = []
    for i, start in enumerate(starts):
        for j in range(bisect_left(ends, start + shortest, i), bisect_right(ends, start + longest, i)):
            edits = notice.edits_of(window[start : ends[j]])
            if edits >= 0:
                found.append((edits, i, j + 1))
    taken, out = bytearray(len(starts)), []
    for edits, i, j in sorted(found):
        if not any(taken[i:j]):
            taken[i:j] = b"\1" * (j - i)
            out.append((i, j, edits))
    return sorted(out)


def word_of(norm: bytes) -> Callable[[int], int]:
    """The number of the word that starts at a byte, for many bytes of one text."""
    spaces: list[np.ndarray] = []

    def of(at: int) -> int:
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32))
        return int(np.searchsorted(spaces[0], at))

    return of


def scan(norm: bytes, notices: list[Notice]) -> list[dict]:
    """All fuzzy matches of a normalized text, as spans in words with their edits."""
    out, number = [], word_of(norm)
    for notice in notices:
        if not any(piece in norm for piece, _ in notice.pieces):
            continue
        for a, b in _windows(norm, notice):
            window = norm[a:b].decode("utf-8", "replace")
            spans = _spans(window, notice)
            before, words = (number(a), window.split(" ")) if spans else (0, [])
            for i, j, edits in spans:
                out.append({
                    "label": notice.label, "phrase": notice.phrase, "edits": edits,
                    "start_word": before + i, "end_word": before + j, "text": " ".join(words[i:j]),
                })
    return out


MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("edits", T.IntegerType()),
    T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("text", T.StringType()),
])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base_starts", T.ArrayType(T.LongType())),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
    T.StructField("score", T.DoubleType()),
]
_MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("edits", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("text", pa.string())]))


def scan_licenses(df: DataFrame, text: str = "text", notices=NOTICES, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """Append n_words, base_starts (words), base_labels, matches (spans with edits) and score to each row.

    score: 1 for an exact base phrase, else the best 1 - edits / length over the matches, 0 without any.
    """

    def make():
        compiled = compile_notices(notices, edit_chars)
        base = [(p.encode(), label) for p, label in BASE]

        def call(columns):
            n_words, starts, labels, matches, scores = [], [], [], [], []
            for value in strings(columns[0]):
                norm = normalize(value)
                n_words.append(norm.count(b" ") + 1 if norm else 0)
                number = word_of(norm)
                at = [(number(x), label) for p, label in base if p in norm for x in find_places(norm, p)]
                found = scan(norm, compiled)
                starts.append(sorted(x for x, _ in at))
                labels.append(sorted({label for _, label in at}))
                matches.append(found)
                scores.append(1.0 if at else max((1 - m["edits"] / len(m["phrase"]) for m in found), default=0.0))
            return [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array(matches, _MATCH_ARROW), pa.array(scores, pa.float64())]

        return call

    return annotate(df, [text], FIELDS, make)


def label_string(*parts: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.concat(*parts))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        label_string(F.col("base_labels"), F.col("matches.label")).alias("labels"),
        "score",
        F.size("matches").cast("long").alias("n_matches"),
    )


def brute_force(text: str | None) -> tuple[int, list[int], list[str]]:
    """Word count, base starts and base labels by comparing word lists, for tests."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    got = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split(" ")
        for i in range(len(got) - len(p) + 1):
            if got[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(got), sorted(starts), sorted(labels)
