"""The pipeline's stages: their columns, what they drop, and all of it against brute force on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import jaccard_join, packing, quality_rules
from graphloom.llm.common import materialize

from test_operators import check_pieces, documents, jaccard_brute, near_copies, random_words  # isort: skip


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """What each stage but the last returns, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("quality", F.lit(7)).withColumn("c0", F.lit("x"))
    out = [("start", docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append((name, docs))
    return dict(out)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "mixing", "packing"]


def test_stages_keep_columns(staged):
    for df in staged.values():
        assert df.columns == staged["start"].columns


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_filters_keep_clean_documents(spark, staged, sf_dir):
    start, after = ids(staged["start"]), ids(staged["quality_rules"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    short = {r["doc_id"] for r in staged["start"].filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) < quality_rules.LEAST_WORDS).collect()}
    assert ids(staged["language_id"]) <= start
    for d in start & set(labels):
        if d not in short and labels[d] == 1:
            assert d in after
        if labels[d] == 0:
            assert d not in after


def test_one_document_of_each_component_stays(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged["quality_rules"].collect()]
    components = jaccard_brute(rows)
    assert ids(staged["jaccard_join"]) == {c for _, c in components.values()}
    assert staged["jaccard_join"].count() == len({c for _, c in components.values()})


def test_mix_repeats_rows(staged):
    sizes = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    before = {r["source"]: r["s"] for r in staged["jaccard_join"].groupBy("source").agg(F.sum(sizes).alias("s")).collect()}
    after = {r["source"]: r["s"] for r in staged["mixing"].groupBy("source").agg(F.sum(sizes).alias("s")).collect()}
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), rel=0.2)
    assert all(after[s] <= 2 * before[s] for s in after)
    assert staged["mixing"].groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_run_packs_the_mix(spark, staged, sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary_path())
    total = sum(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in staged["mixing"].select("text").collect())
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.agg({"length": "sum"}).first()[0] == total
    # documents that the mix takes twice are in the table twice; of the others each id is in one piece
    once = {r["doc_id"]: r["text"] for r in staged["mixing"].groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).filter("n = 1").collect()}
    mine = [p.asDict() for p in pieces.collect()]
    by_doc = {}
    for p in mine:
        if p["doc_id"] in once:
            by_doc.setdefault(p["doc_id"], []).append(p)
    for d, parts in by_doc.items():
        assert sum(p["length"] for p in parts) == len(lib.encode(once[d], add_special_tokens=False).ids) + 1
    assert set(by_doc) == set(once)


def test_dedup_stage_with_repeated_and_null_rows(spark):
    rows = near_copies(random.Random(9), [(10, 60), (5, 30)])
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, "a text of its own that nobody else has here"), (rows[2][0], "the same id with another text that is long enough")]
    kept = jaccard_join.stage(spark, documents(spark, rows, ("node", "component_id")), "")
    assert set(kept.columns) >= {"node", "component_id"}
    counts = {}
    for r in kept.collect():
        counts[r["doc_id"], r["text"]] = counts.get((r["doc_id"], r["text"]), 0) + 1
    assert max(counts.values()) == 1
    assert (None, "a text of its own that nobody else has here") in counts and (None, rows[1][1]) not in counts
    smallest = {c for _, c in jaccard_brute([r for r in rows[: len(rows) - 5]]).values()}
    assert smallest <= {d for d, _ in counts}


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_mix_stage_with_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(i, random_words(rng, 20), "en", "a") for i in range(40)]
    rows += [rows[3]] * 2 + [(3, None, "en", "a"), (None, "x y z", "en", None)]
    out = corpus_pipeline.mix_sources(spark, documents(spark, rows, ("copies", "row")), "")
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}
    assert out.columns == documents(spark, rows, ("copies", "row")).columns


def test_stages_pass_any_column(spark, sf_dir):
    """Maps, structs that hold maps, arrays, and names that operators use pass all stages but the last; rows stay whole."""
    rng = random.Random(2)
    lexicon = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    rows = [(i, say(120), "en", "ab"[i % 2]) for i in range(60)]
    rows += [rows[0], rows[0], (1, rows[2][1], "en", None), (None, say(130), "en", "a"), (900, None, "en", "a"), (901, "", "en", "a"), (902, say(60_000), "en", "b")]
    df = documents(spark, rows).withColumn("nested", F.struct(F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))).withColumn("a map", F.create_map(F.lit("k"), F.array("text")))
    for extra in ("size", "copies", "kept", "lang_pred", "quality", "node", "__gl_kind", "n_words", "c0"):
        df = df.withColumn(extra, F.concat(F.lit(f"{extra}:"), F.coalesce("text", F.lit("")).substr(1, 9)))
    docs, long = materialize(df, "any-columns"), 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == df.columns and docs.dtypes == df.dtypes, name
        got = docs.collect()
        assert len(got) > 30 and all(r["size"] == "size:" + (r["text"] or "")[:9] and r["__gl_kind"] == "__gl_kind:" + (r["text"] or "")[:9] for r in got), name
        assert all(r["nested"]["m"] == {"k": r["doc_id"]} and r["a map"] == {"k": [r["text"]]} for r in got)
        long += any(len(r["text"] or "") > 100_000 for r in got)
        assert name == "language_id" or all(r["text"] for r in got)
    assert long >= 3 and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 30


def test_packing_check_helper_rejects_a_gap():
    piece = {"doc_id": 1, "start": 1, "length": 1, "doc_tokens": 2, "sequence_id": 0, "offset": 0, "ids_crc32": 0}
    with pytest.raises(AssertionError):
        check_pieces([piece], {1: [5, 6]})
