"""Weak supervision: quality rules vote, EM estimates how far to trust each.

Each rule votes good (1), bad (-1) or abstains (0) on features of the whole text.  All documents
are counted by vote pattern (at most 3 ** rules patterns), and expectation-maximisation over the
patterns estimates the share of good documents and each rule's accuracy on good and on bad ones
(Dawid and Skene 1979).  A document's posterior probability of being good replaces the rule that
all tests must pass.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; repeated rows are judged
each and alike; a posterior of exactly KEEP keeps; texts are read whole whatever their length; an empty table gives an
empty result; other columns pass unchanged, those with the name of an output as input_<name>.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm.common import annotate, kept_columns, materialize, rename_clashes, table
from graphloom.llm.textvec import NOT_SPACE, buffers, runs, slices, span_hashes, table256, window_hashes, words

#: The base rules (fixed values): fewest words, most percent of words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3
#: Symbols counted (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Posterior from which a document is kept.
KEEP = 0.5

_IS_SYMBOL = table256(SYMBOLS)
_IS_LINE = table256(b"\n", inside=False)
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_UPPER, _LOWER, _DIGIT = (table256(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_LETTER = _UPPER | _LOWER
_LETTER[0x80:] = True
_STRONG = table256(b"!?")

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_lower", "n_digits", "n_letters", "n_strong", "n_top_word")


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2:  # a long text is alone in its slice
        return np.array([np.count_nonzero(mask)])
    seen = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return seen[offsets[1:]] - seen[offsets[:-1]]


def _earlier_equal(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal one earlier, has any equal one) for items given by document and hash, in order."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    earlier, some = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:]] = same
    some[order[1:]] |= same
    some[order[:-1]] |= same
    return earlier, some


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by document of a slice of texts."""
    n = len(offsets) - 1
    w = words(data, offsets, NOT_SPACE)
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = _per_document(NOT_SPACE[data] & ~_CONTINUES[data], offsets)
    for name, mask in (("n_symbols", _IS_SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_letters", _LETTER), ("n_strong", _STRONG)):
        out[name] = _per_document(mask[data] & ~_CONTINUES[data] if name == "n_letters" else mask[data], offsets)
    # lines with a word, and those equal to an earlier one
    starts, ends, first = runs(_IS_LINE[data], offsets)
    lines = np.repeat(np.arange(n), np.diff(first))
    full = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, lines = starts[full], ends[full], lines[full]
    earlier, _ = _earlier_equal(lines, span_hashes(data, starts, ends))
    out["n_lines"] = np.bincount(lines, minlength=n)
    out["n_dup_lines"] = np.bincount(lines[earlier], minlength=n)
    # words covered by windows that stand more than once
    doc = w.document()
    at, h = window_hashes(w, WINDOW)
    _, some = _earlier_equal(doc[at], h)
    covered = np.zeros(len(w.hash), bool)
    for j in range(WINDOW):
        covered[at[some] + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    # occurrences of the most frequent word
    order = np.lexsort((w.hash, doc))
    top = np.zeros(n, np.int64)
    if len(order):
        new = np.concatenate([[True], (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
        begin = np.flatnonzero(new)
        np.maximum.at(top, doc[order][begin], np.diff(np.append(begin, len(order))))
    out["n_top_word"] = top
    return out


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """Votes by document and rule; between the two bounds of a rule it abstains."""
    n, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    mean, symbols = f["word_chars"] / n, f["n_symbols"] / n
    cased = np.maximum(f["n_upper"] + f["n_lower"], 1)
    upper, letters = f["n_upper"] / cased, f["n_letters"] / chars
    lines, repeated = f["n_dup_lines"] / np.maximum(f["n_lines"], 1), f["n_repeat_words"] / n
    strong, top = f["n_strong"] / n, f["n_top_word"] / n
    out = [
        _vote(f["n_words"] < LEAST_WORDS, f["n_words"] >= 2 * LEAST_WORDS),
        _vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 9)),
        _vote(symbols > 0.1, symbols < 0.02),
        _vote(upper > 0.4, upper < 0.2),
        _vote(letters < 0.75, letters > 0.88),
        _vote((lines > 0.3) | (repeated > MOST_REPEATED_PERCENT / 100), (lines < 0.1) & (repeated < 0.2)),
        _vote(strong > 0.15, strong < 0.03),
        _vote((top > 0.3) & (f["n_words"] > 10), top < 0.15),
    ]
    return np.stack(out, 1)


RULES = 8


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(RULES)).sum(1)


def all_patterns() -> np.ndarray:
    return np.array([p[::-1] for p in product((-1, 0, 1), repeat=RULES)], np.int8)


def fit(counts: np.ndarray, rounds: int = 200) -> dict:
    """EM from the number of documents by vote pattern."""
    v = all_patterns()
    prior = 0.7
    # p[class, rule, vote + 1]; at the start a single bad vote outweighs the praise of the others, and EM
    # then learns which rules cry wolf on documents that all others praise
    p = np.empty((2, RULES, 3))
    p[1] = (0.005, 0.1, 0.895)
    p[0] = (0.25, 0.1, 0.65)
    for _ in range(rounds):
        good = posterior(prior, p, v)
        weight = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 0.05, 0.95))
        for c in (0, 1):
            for k, vote in enumerate((-1, 0, 1)):
                p[c, :, k] = (weight[c] @ (v == vote) + 1) / (weight[c].sum() + 3)
        # a rule's bad vote is never taken as praise: at worst it says nothing
        low = np.minimum(p[1, :, 0], p[0, :, 0])
        p[1, :, 0] = low
        p /= p.sum(2, keepdims=True)
    return {"prior": prior, "p": p, "posterior": posterior(prior, p, v)}


def posterior(prior: float, p: np.ndarray, v: np.ndarray) -> np.ndarray:
    logit = np.full(len(v), np.log(prior) - np.log(1 - prior))
    for j in range(RULES):
        spoke = v[:, j] != 0  # an abstention says nothing
        k = v[:, j].astype(int) + 1
        vote = p[:, j, :] / (p[:, j, 0] + p[:, j, 2])[:, None]
        logit += np.where(spoke, np.log(vote[1, k]) - np.log(vote[0, k]), 0)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


FIELDS = [T.StructField(x, T.LongType()) for x in FEATURES] + [T.StructField("vote_pattern", T.IntegerType())]


def add_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the five base features and the vote pattern to each row."""

    def make():
        def call(columns):
            data, offsets = buffers(columns[0])
            got: dict[str, list[np.ndarray]] = {x: [] for x in (*FEATURES, "vote_pattern")}
            for a, b in slices(offsets):
                f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for x in FEATURES:
                    got[x].append(f[x])
                got["vote_pattern"].append(pattern_of(votes(f)))
            flat = {x: np.concatenate(v) if v else np.zeros(0, np.int64) for x, v in got.items()}
            return [pa.array(flat[x], pa.int64()) for x in FEATURES] + [pa.array(flat["vote_pattern"], pa.int32())]

        return call

    return annotate(df, [text], FIELDS, make)


def fit_documents(featured: DataFrame) -> dict:
    """The model from the counts of all documents by vote pattern (at most 3 ** RULES rows)."""
    counts = np.zeros(3**RULES)
    for pattern, n in featured.groupBy("vote_pattern").count().collect():
        counts[pattern] = n
    return fit(counts)


def judge(featured: DataFrame, model: dict) -> DataFrame:
    """Append base_failed, quality (posterior) and kept."""
    table = F.array(*[F.lit(float(x)) for x in np.round(model["posterior"], 9)])
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
    featured = rename_clashes(featured, ["base_failed", "quality", "kept"])
    out = featured.withColumn("base_failed", failed).withColumn("quality", table[F.col("vote_pattern")])
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def query(spark, sf_dir: str) -> DataFrame:
    featured = materialize(add_features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-features")
    return judge(featured, fit_documents(featured)).drop("vote_pattern")


def stage(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are kept, with their own columns, whatever their names.

    Null, empty and short texts go; equal texts stay or go together; an empty table stays empty.
    """
    renamed, restored, name = kept_columns(documents)
    featured = materialize(add_features(renamed, name["text"]), "quality-features")
    return judge(featured, fit_documents(featured)).filter("kept").select(*restored)
