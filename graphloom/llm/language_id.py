"""Multilingual mixture inference.

Training counts hashed byte n-grams of labelled texts by language.  A document is taken as a
mixture: each of its words was drawn from one language, with a likelihood that is the product of
its n-grams' probabilities.  Expectation-maximisation estimates the proportions.  The language set is the one of
highest penalised likelihood (BIC) among nested sets: the best single language, then the others in the order of their
proportions under all languages.  Sizes are tried upwards; a document leaves once its likelihood under all languages
could not pay the penalty of one more.

Training may use a bounded sample of labelled rows: `sample_rows` rows and `sample_bytes` bytes of text for all and each
language, about, chosen by hash whatever the files' layout, of the `languages` most frequent ones.  Prediction reads every
text whole, in slices of words.

Defined cases: null texts and texts without a letter are `und` with score 0; rows without a language
or text are not learned from; without any labelled row, or on an empty table, all (none) are `und`; repeated rows
count each; ties between languages go to the first by code point; very long texts are read whole; other columns
pass unchanged, those with the name of an output as input_<name>.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.llm.common import annotate, id_crc32_mod, kept_columns, trimmed
from graphloom.llm.textvec import LOWER, NOT_SPACE, buffers, mix, runs, slices

#: Labelled rows, and bytes of their texts for each language, that training reads at most.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 4_000_000
#: Languages learned at most (a model holds 0.4 MB for each).
LANGUAGES = 256
#: Hashed n-grams: sizes and buckets of each.
SIZES = (2, 3, 4)
BUCKETS = 1 << 15
#: Words longer than this many bytes count as several.
WORD_BYTES = 48
ROUNDS = 8
#: Words worked on at a time.
SLICE_WORDS = 500_000
#: Factor of the BIC penalty, which alone limits a document's set of languages.
PENALTY = 4.0
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def gram_buckets(data: np.ndarray, size: int, borders: np.ndarray | None = None) -> np.ndarray:
    """Bucket of the n-gram that ends at each byte; grams reach back over the start of a text (borders; by default the first byte) as zeros."""
    h = np.zeros(len(data), np.uint64)
    for j in range(size):
        shifted = np.zeros(len(data), np.uint64)
        shifted[j:] = data[: len(data) - j] if j else data
        if j and borders is not None:
            before = (borders[:, None] + np.arange(j)).reshape(-1)
            shifted[before[before < len(data)]] = 0
        h = (h << np.uint64(8)) | shifted
    return (mix(h + np.uint64(size << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def prepare(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters, all white space as one byte, digits as another."""
    return _PREPARE[data]


_PREPARE = LOWER.copy()
_PREPARE[[9, 10, 11, 12, 13]] = 32
_PREPARE[48:58] = 48


def train(df: DataFrame, lang: str = "lang", text: str = "text", key: str | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> dict:
    """N-gram log-probabilities by language from rows with a language and a text.

    The sample: rows whose hash (of key and text) falls under their language's share.
    """
    labelled = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.col(key) if key else F.lit(0)).alias("key"))
    by_lang = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    known = sorted(by_lang.orderBy(F.desc("n"), "lang").limit(languages).collect())
    if not known:
        return {"langs": [], "logp": np.zeros((len(SIZES), BUCKETS, 0), np.float32)}
    langs = [r["lang"] for r in known]
    index = {x: i for i, x in enumerate(langs)}
    shares = [(r["lang"], min(1.0, sample_rows / len(langs) / r["n"], sample_bytes / max(1, r["bytes"]))) for r in known]
    shares = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, share double"))  # at most `languages` rows
    uniform = F.pmod(F.xxhash64("key", "text", "lang"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = labelled.join(shares, "lang").filter(uniform < F.col("share")).select("lang", "text")

    def count(batches):
        counts: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for d, name in enumerate(names):
                raw = data[offsets[d] : offsets[d + 1]]
                if name not in counts:
                    counts[name] = [np.zeros(BUCKETS, np.int64) for _ in SIZES]
                raw = prepare(raw)
                for size, c in zip(SIZES, counts[name], strict=True):
                    c += np.bincount(gram_buckets(raw, size), minlength=BUCKETS)
        for name, got in counts.items():
            for k, c in enumerate(got):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "k", "bucket", "n"])

    sums = sample.mapInArrow(trimmed(count), "lang string, k int, bucket int, n long").groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # bounded: languages x sizes x buckets
    n = np.full((len(SIZES), BUCKETS, len(langs)), SMOOTHING, np.float64)
    if table.num_rows:
        who = np.array([index[x] for x in table["lang"].to_pylist()])
        n[table["k"].to_numpy(), table["bucket"].to_numpy(), who] += table["n"].to_numpy()
    return {"langs": langs, "logp": np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)}


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each word by language, first word of each document)."""
    starts, ends, first = runs(NOT_SPACE[data], offsets)
    if len(starts) and (long := ends - starts > WORD_BYTES).any():
        pieces = [np.arange(s, e, WORD_BYTES) for s, e in zip(starts[long], ends[long])]
        starts = np.sort(np.concatenate([starts, *[p[1:] for p in pieces]]))
        first = np.searchsorted(starts, offsets)
    out = np.zeros((len(starts), logp.shape[2]), np.float32)
    if len(starts) == 0:
        return out, first
    clean = prepare(data)
    # white space before a text's first word belongs to no word
    some = np.flatnonzero(np.diff(first))
    lead = [(offsets[d], starts[first[d]]) for d in some[starts[first[some]] > offsets[some]]]
    lead += [(offsets[d], offsets[d + 1]) for d in np.flatnonzero((np.diff(first) == 0) & (np.diff(offsets) > 0))]
    lead = np.array(lead, np.int64).reshape(-1, 2)
    reach = max(SIZES)
    for i in range(0, len(starts), SLICE_WORDS):
        to = min(i + SLICE_WORDS, len(starts))
        a, b = int(starts[i]), int(starts[to]) if to < len(starts) else len(data)
        low = max(a - reach, 0)
        part = clean[low:b]
        borders = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, b)] - low
        mute = lead[(lead[:, 1] > a) & (lead[:, 0] < b)]
        for k, size in enumerate(SIZES):
            at = gram_buckets(part, size, borders)[a - low :]
            for j in range(logp.shape[2]):
                x = logp[k, :, j][at]
                for s, e in mute:
                    x[max(s - a, 0) : e - a] = 0
                out[i:to, j] += np.add.reduceat(x, starts[i:to] - a)
    # n-grams of several sizes overlap, so their evidence is shared out
    return out / len(SIZES), first


def mixtures(ll: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: (proportions by document and language, log-likelihood of each document)."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    theta = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    total = np.zeros(len(n))
    if len(doc) == 0:
        return theta, total
    parts = []
    for i in range(0, len(doc), SLICE_WORDS):
        d = doc[i : i + SLICE_WORDS]
        begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        x = ll[i : i + SLICE_WORDS]
        top = x.max(1)
        parts.append((d, begin, top, np.exp(x - top[:, None])))
    some = n > 0
    for _ in range(rounds):
        new = np.zeros_like(theta)
        for d, begin, _, p in parts:
            q = theta[d] * p
            q /= np.maximum(q.sum(1), 1e-300)[:, None]
            new[d[begin]] += np.add.reduceat(q, begin, axis=0)
        theta[some] = new[some] / n[some][:, None]
    for d, begin, top, p in parts:
        norm = np.maximum((theta[d] * p).sum(1), 1e-300)
        total[d[begin]] += np.add.reduceat(np.log(norm) + top, begin)
    return theta, total


def _words_of(first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words of some documents, first word of each among these)."""
    n = np.diff(first)[docs]
    begin = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[:-1][docs] - begin[:-1], n) + np.arange(begin[-1]), begin


def infer(ll: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions by document over the language set that the penalised likelihood selects."""
    docs, langs = len(first) - 1, ll.shape[1]
    n, rows = np.diff(first), np.arange(docs)
    step = penalty * 0.5 * np.log(np.maximum(n, 2))
    single, most = np.zeros((docs, langs)), np.zeros(docs)
    some = np.flatnonzero(n)
    if len(some):
        at = first[:-1][some]
        for j in range(langs):
            single[some, j] = np.add.reduceat(ll[:, j].astype(np.float64), at)
        most[some] = np.add.reduceat(ll.max(1).astype(np.float64), at)
    one = single.argmax(1)
    best, chosen = single[rows, one], np.zeros((docs, langs))
    chosen[rows, one] = 1
    # no mixture is likelier than each word in its own best language
    open_ = np.flatnonzero(most - step > best + 1e-9)
    if langs < 2 or len(open_) == 0:
        return chosen
    at, begin = _words_of(first, open_)
    full, of_full = mixtures(ll[at], begin, np.ones((len(open_), langs)))
    rank = full.copy()
    rank[np.arange(len(open_)), one[open_]] = 2  # the best single language is in all sets
    order = np.argsort(np.argsort(-rank, axis=1, kind="stable"), axis=1, kind="stable")
    for k in range(2, langs + 1):
        left = np.flatnonzero(of_full - (k - 1) * step[open_] > best[open_] + 1e-9)
        if len(left) == 0:
            break
        if k == langs:
            theta, value = full[left], of_full[left]
        else:
            at, begin = _words_of(first, open_[left])
            theta, value = mixtures(ll[at], begin, (order[left] < k).astype(float))
        mine = open_[left]
        value = value - (k - 1) * step[mine]
        better = value > best[mine] + 1e-9
        best[mine[better]], chosen[mine[better]] = value[better], theta[better]
    return chosen


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("lang_score", T.DoubleType()),
    T.StructField("lang_mixture", T.MapType(T.StringType(), T.DoubleType())),
]


def identify_languages(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Append lang_pred, lang_score (its proportion) and lang_mixture (language: proportion) to each row."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)  # languages x sizes x BUCKETS floats

    def make():
        langs, logp = broadcast.value["langs"], broadcast.value["logp"]

        def call(columns):
            texts = columns[0]
            data, offsets = buffers(texts)
            rows = len(offsets) - 1
            pred, score, mixture = [UNKNOWN] * rows, np.zeros(rows), [[] for _ in range(rows)]
            for a, b in slices(offsets) if langs else ():
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ll, first = word_likelihoods(part, off, logp)
                theta = infer(ll, first)
                seen = np.concatenate([[0], np.cumsum(_ASCII_LETTERS[part])])
                letters = seen[off[1:]] > seen[off[:-1]]
                for d in range(b - a):
                    if letters[d] or _LETTER.search(bytes(part[off[d] : off[d + 1]]).decode("utf-8", "replace")):
                        j = int(theta[d].argmax())
                        pred[a + d], score[a + d] = langs[j], theta[d, j]
                        mixture[a + d] = [(langs[i], float(theta[d, i])) for i in np.flatnonzero(theta[d] > 0)]
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))]

        return call

    return annotate(df, [text], FIELDS, make)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc32_mod(doc_id, 4) == 2, F.lit(False))


def train_on_documents(documents: DataFrame) -> dict:
    return train(documents.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"), key="doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    documents = table(spark, sf_dir, "documents")
    model = train_on_documents(documents)
    found = identify_languages(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_mixture").alias("n_languages"))


#: A document of which no language makes up this share is rejected, as is one without letters.
LEAST_SHARE = 0.35


def stage(spark, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with one main language stay, with their own columns, whatever their names.

    Null texts and texts without a letter go; without any labelled row all go; repeated rows stay or go together;
    very long texts are read whole; an empty table stays empty.
    """
    renamed, restored, name = kept_columns(documents)
    marked = identify_languages(renamed, train_on_documents(documents), name["text"])
    return marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)).select(*restored)
