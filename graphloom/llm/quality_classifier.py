"""Compression classifier.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad.  A text that
resembles one of them compresses better with its dictionary.  Texts are compressed in chunks, so that the
dictionary counts throughout long texts; the difference of the compressed sizes, per byte of text, is the
feature that a logistic curve, fitted on labelled texts that the dictionaries have not seen, turns into a
probability.

Learning reads a bounded sample: SAMPLE_ROWS labelled rows of each class, of which half (DICTIONARY_SHARE)
build the dictionary and the others fit the curve.  Scoring reads every text whole.

Defined cases: null and empty texts get the calibrated score of a zero difference; labels without a row in
documents, null labels and rows without text are not learned from; several labels of one document count as
their rounded mean; without labels of both classes every score is the share of label 1 (0.5 without any);
repeated rows are scored each; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.llm.common import annotate, id_crc32_mod, materialize, strings

SAMPLE_ROWS = 3_000
#: Bytes of text that learning reads at most for each class.
SAMPLE_BYTES = 12_000_000
DICTIONARY_SHARE = 0.5
DICTIONARY_BYTES = 64 * 1024
CHUNK = 2_048
LEVEL = 3
THRESHOLD = 0.3


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes], level: int = LEVEL):
        import zstandard

        self.compress = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, text: str) -> float:
        """(size with the bad dictionary - size with the good one) per byte of text."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return 0.0
        bad, good = self.compress
        total = 0
        # chunks of equal sizes: a short last one would count for little else than its header
        n = -(-len(raw) // CHUNK)
        cut = [len(raw) * i // n for i in range(n + 1)]
        for a, b in zip(cut, cut[1:]):
            chunk = raw[a:b]
            total += len(bad(chunk)) - len(good(chunk))
        return total / len(raw)


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from chunks of texts."""
    import zstandard

    chunks = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        chunks += [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    total = sum(map(len, chunks))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 4)), chunks, k=256, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes are the dictionary
        return b"".join(chunks)[:size] or b"\0" * 8


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method with a small ridge; x is scaled by the caller."""
    w = np.zeros(2)
    a = np.stack([np.ones(len(x)), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(good: list[str], bad: list[str], share: float | None = None) -> dict:
    """Dictionaries from one part of the labelled texts, the curve from the other; `share` is that of label 1 among all labels."""
    if not good or not bad:
        share = 0.5 if share is None else share
        return {"dictionaries": None, "bias": float(np.log((share + 1e-6) / (1 - share + 1e-6))), "slope": 0.0, "scale": 1.0}
    cut = [max(1, int(len(t) * DICTIONARY_SHARE)) for t in (bad, good)]
    dictionaries = (build_dictionary(bad[: cut[0]]), build_dictionary(good[: cut[1]]))
    sizes = Sizes(dictionaries)
    texts, y = [], []
    for label, t, c in ((0, bad, cut[0]), (1, good, cut[1])):
        rest = t[c:] or t
        texts += rest
        y += [label] * len(rest)
    x = np.array([sizes.difference(t) for t in texts])
    scale = float(x.std()) or 1.0
    bias, slope = fit_logistic(x / scale, np.array(y, float))
    if share is not None:  # the sample is balanced, the corpus isn't
        n1 = sum(y)
        bias += float(np.log((share + 1e-6) / (1 - share + 1e-6)) - np.log((n1 + 1e-6) / (len(y) - n1 + 1e-6)))
    return {"dictionaries": dictionaries, "bias": bias, "slope": slope, "scale": scale}


def sample_labelled(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str], float | None]:
    """(good texts, bad texts, share of label 1): at most `rows` of each class, those with the smallest hashes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not n:
        return [], [], None
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, rows / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, rows / max(1, n.get(0, 0)))))
    # bounded by `rows` of each class and their spread, so it is broadcast
    chosen = F.broadcast(known.filter(h < share).select("doc_id", "y"))
    found = materialize(documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id"), "quality-sample")
    out: dict[int, list[str]] = {0: [], 1: []}
    for y in out:
        texts = found.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "text").select("text")
        used = 0
        for r in texts.limit(2 * rows).toLocalIterator():
            out[y].append(r["text"])
            used += len(r["text"])
            if used > SAMPLE_BYTES:
                break
    return out[1], out[0], n.get(1, 0) / sum(n.values())


FIELDS = [T.StructField("quality_score", T.DoubleType()), T.StructField("size_difference", T.DoubleType())]


def score_quality(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Append quality_score (calibrated probability of label 1) and size_difference to each row."""

    def make():
        sizes = Sizes(model["dictionaries"]) if model["dictionaries"] else None

        def call(columns):
            x = np.array([sizes.difference(t) if sizes else 0.0 for t in strings(columns[0])], float)
            z = model["bias"] + model["slope"] * x / model["scale"]
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64()), pa.array(x, pa.float64())]

        return call

    return annotate(df, [text], FIELDS, make)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc32_mod(doc_id, 5) == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = learn(*sample_labelled(documents, labels))
    scored = score_quality(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
