"""Each text operator against brute force, an exact round trip, or held-out labels; and the cases its docstring defines."""

import hashlib
import math
import random
import re
import time
import zlib
from base64 import b32encode
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.llm import fingerprints, jaccard_join, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, textvec, token_files, tokens, warc

SPACE = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """rows: (doc_id, text[, lang[, source]]); extra columns that clash with operators' own names may be added."""
    full = [(*r, *[None, "s0"][len(r) - 2 :], len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def random_words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(vocabulary)}" for _ in range(n))


#: Nulls, empty texts, ties, repeated rows and one very long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "The same text, twice."), (5, "The same text, twice."), (6, "The same text, twice."), (None, "no id at all here"), (7, "long wörds and lines\n" * 20_000)]


def sequence(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: license scans


def test_license_base_fields_match_brute_force(spark, sf_dir):
    docs = sequence(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in license_scan.query(spark, sf_dir).collect():
        n, starts, labels = license_scan.brute_force(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels))


def edited(rng, phrase, k):
    chars = list(phrase)
    for _ in range(k):
        i = rng.randrange(1, len(chars) - 1)
        op = rng.randrange(3)
        if op == 0:
            chars[i] = rng.choice("xyzé")
        elif op == 1:
            chars.insert(i, rng.choice("xyz"))
        else:
            del chars[i]
    return "".join(chars)


def test_license_pigeonhole_loses_no_match():
    """Seeds and windows find the labels that matching every notice on the whole text finds."""
    rng = random.Random(3)
    compiled = license_scan.compile_notices()
    for _ in range(150):
        phrase, _, *_ = rng.choice(license_scan.NOTICES)
        text = f"{random_words(rng, 30)} {edited(rng, phrase, rng.randrange(4))} {random_words(rng, 30)}"
        norm = license_scan.normalize(text)
        whole = {n.label for n in compiled if n.pattern.search(norm.decode())}
        assert {m["label"] for m in license_scan.scan(norm, compiled)} == whole


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def license_spans(text, notice):
    """(first word, end word, edits) from all runs of words, the best of those that overlap."""
    words, found = text.split(" "), []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            span = " ".join(words[i:j])
            if abs(len(span) - len(notice.phrase)) <= notice.edits and (d := levenshtein(span, notice.phrase)) <= notice.edits:
                found.append((d, i, j))
    out = []
    for d, i, j in sorted(found):
        if all(j <= x or y <= i for x, y, _ in out):
            out.append((i, j, d))
    return sorted(out)


def test_license_notices_close_together():
    """Notices with more edits before a better one are found; all spans are those of brute force over all runs of words."""
    compiled = license_scan.compile_notices()
    spans = lambda text, phrase: [(m["start_word"], m["end_word"], m["edits"]) for m in license_scan.scan(license_scan.normalize(text), compiled) if m["phrase"] == phrase]
    assert len(spans("mit licence " * 50 + "mit license", "mit license")) == 51
    assert spans("the apache licence or apache license applies", "apache license") == [(1, 3, 1), (4, 6, 0)]
    rng = random.Random(7)
    for _ in range(40):
        some = rng.sample(license_scan.NOTICES, 2)
        text = " ".join(rng.choice([edited(rng, rng.choice(some)[0], rng.randrange(4)), edited(rng, rng.choice(some)[0], 1), random_words(rng, rng.randrange(1, 4))]) for _ in range(12))
        norm = license_scan.normalize(text).decode()
        for notice in compiled:
            if notice.phrase in (some[0][0], some[1][0]):
                assert spans(norm, notice.phrase) == license_spans(norm, notice)


def test_license_spans_and_odd_rows(spark):
    rows = [*ODD, (20, "A GNU Genral Public Licence. And the MIT License; all rights reserved"), (21, "the mit license mit license")]
    df = license_scan.scan_licenses(documents(spark, rows, ("score", "matches")))
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[7]["n_words"] == 80_000
    m = {x["label"]: x for x in got[20]["matches"]}
    assert {"gpl", "mit", "all-rights-reserved"} <= set(m) and m["gpl"]["edits"] == 2
    assert (m["gpl"]["start_word"], m["gpl"]["end_word"], m["gpl"]["text"]) == (1, 5, "gnu genral public licence")
    assert got[21]["base_starts"] == [1, 3] and got[21]["score"] == 1.0
    assert df.count() == len(rows) and license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_license_many_places_in_one_text():
    """Time grows with the places: a million of them in one text take seconds, a word of a megabyte with seeds inside too."""
    compiled, norm = license_scan.compile_notices((("mit license", "mit"),)), license_scan.normalize("mit license " * 1_000_000)
    began = time.perf_counter()
    found = license_scan.scan(norm, compiled)
    assert len(found) == 1_000_000 and found[-1]["start_word"] == 1_999_998 and found[7]["text"] == "mit license"
    number = license_scan.word_of(norm)
    places = [number(x) for x in license_scan.find_places(norm, b"mit license")]
    assert places[:3] == [0, 2, 4] and len(places) == 1_000_000
    assert license_scan.scan(license_scan.normalize("license" * 150_000), license_scan.compile_notices()) == []
    assert time.perf_counter() - began < 90


# 2: packing


def check_pieces(pieces, ids):
    """Each id lies in one piece; sequences are gapless and at most 1024 long.  Returns (padding, ids)."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][p["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, sum(map(len, ids.values()))


def test_packing_holds_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in sequence(spark, sf_dir, "documents").collect()}
    ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces = packing.query(spark, sf_dir).collect()
    padding, total = check_pieces(pieces, ids)
    assert padding <= 1024 and total > 100_000
    groups = {}
    for p in pieces:
        groups[p["step_group"]] = groups.get(p["step_group"], 0) + p["length"]
    assert max(groups.values()) <= packing.GROUP_IDS and sorted(groups.values())[1] > packing.GROUP_IDS // 2


@pytest.mark.parametrize("seed", range(4))
def test_packer_on_random_lengths(seed):
    rng = random.Random(seed)
    packer = packing.Packer(0)
    lengths = [rng.choice([1, 2, 127, 128, 129, 500, 1023, 1024, 1025, 5000]) for _ in range(rng.randrange(1, 400))]
    rows = []
    for i, n in enumerate(lengths):
        packer.add_document(i, np.full(n, i, "<u4").tobytes())
        if i % 50 == 0:
            packer.pack()
            rows += packer.drain()
    packer.pack(to_the_end=True)
    rows += packer.drain()
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    pieces = [dict(zip(names, r)) | {"ids_crc32": zlib.crc32(r[8])} for r in rows]
    padding, _ = check_pieces(pieces, {i: [i] * n for i, n in enumerate(lengths)})
    assert padding <= 1024


def test_packing_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 5]
    got = packing.digest(packing.pack_documents(documents(spark, rows, ("tier", "ids")).coalesce(1), packing.vocabulary_path())).collect()
    by_doc = {}
    for p in got:
        by_doc[p["doc_id"]] = by_doc.get(p["doc_id"], 0) + p["length"]
    assert by_doc[1] == by_doc[2] == 1 and by_doc[7] > 60_000 and None in by_doc
    assert packing.pack_documents(documents(spark, []), packing.vocabulary_path()).count() == 0


def test_packing_many_empty_documents():
    """Time grows with the documents: 200,000 of them with one id each take seconds, also while step groups are open."""
    began = time.perf_counter()
    packer, n = packing.Packer(0), 0
    for i in range(200_000):
        packer.add_document(i, packing.END_ID)
        if packer.waiting >= packing.POOL:
            packer.pack()
        if len(packer.out) >= packing.POOL:
            n += len(packer.drain())
    packer.pack(to_the_end=True)
    assert n + len(packer.drain()) == 200_000 and not packer.held
    assert time.perf_counter() - began < 20


# 3: language id


def test_language_on_held_out_rows(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in sequence(spark, sf_dir, "documents").collect()}
    got = [r for r in language_id.query(spark, sf_dir).collect() if r["held_out"]]
    assert got and sum(lang[r["doc_id"]] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_language_mixtures(spark):
    rng = random.Random(5)
    speak = {k: [f"{a}{b}{c}" for a in s for b in s for c in s] for k, s in {"aa": ["ka", "mo", "ti"], "bb": ["shr", "eng", "ould"], "cc": ["üß", "öch", "ein"]}.items()}
    say = lambda k, n: " ".join(rng.choice(speak[k]) for _ in range(n))
    rows = [(i, say(k, 60), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    model = language_id.train(documents(spark, rows))
    texts = [(1, say("aa", 50)), (2, say("aa", 60) + " " + say("cc", 30)), (3, say("bb", 1)), *[(i + 10, t) for i, (_, t) in enumerate(ODD)], (50, "12 34 !!"), (51, "   ")]
    got = {r["doc_id"]: r for r in language_id.identify_languages(documents(spark, texts, ("lang_mixture",)), model).collect()}
    assert got[1]["lang_pred"] == "aa" and set(got[1]["lang_mixture"]) == {"aa"}
    assert set(got[2]["lang_mixture"]) == {"aa", "cc"} and got[2]["lang_pred"] == "aa" and 0.55 < got[2]["lang_score"] < 0.8
    assert got[3]["lang_pred"] == "bb"
    for i in (10, 11, 12, 50, 51):
        assert got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())


def test_language_sets_have_no_cap(spark):
    """Texts of four and five languages get them all, and their shares; texts of one or two don't."""
    rng = random.Random(9)
    speak = {k: [f"{a}{b}{c}" for a in s for b in s for c in s] for k, s in {"aa": ["ka", "mo", "ti"], "bb": ["shr", "eng", "ould"], "cc": ["üß", "öch", "ein"], "dd": ["zza", "gli", "occ"], "ee": ["vy", "jx", "qu"]}.items()}
    say = lambda shares: " ".join(rng.choice(speak[k]) for k, n in shares.items() for _ in range(n))
    model = language_id.train(documents(spark, [(i, say({k: 60}), k) for i, k in enumerate([*speak] * 20)]))
    shares = {1: {"aa": 60, "bb": 50, "cc": 50, "dd": 40}, 2: {"aa": 60, "bb": 50, "cc": 40, "dd": 30, "ee": 20}, 3: {"ee": 200}, 4: {"dd": 120, "bb": 80}}
    got = {r["doc_id"]: r for r in language_id.identify_languages(documents(spark, [(i, say(x)) for i, x in shares.items()]), model).collect()}
    for i, x in shares.items():
        assert got[i]["lang_mixture"] == pytest.approx({k: n / sum(x.values()) for k, n in x.items()}, abs=0.03)
        assert got[i]["lang_score"] == got[i]["lang_mixture"][got[i]["lang_pred"]] and got[i]["lang_pred"] == max(x, key=x.get)


def test_language_without_labels(spark):
    model = language_id.train(documents(spark, [(1, "abc", None), (2, None, "aa")]))
    assert [r["lang_pred"] for r in language_id.identify_languages(documents(spark, [(1, "abc")]), model).collect()] == ["und"]
    assert language_id.identify_languages(documents(spark, []), model).count() == 0


def test_language_many_languages_and_bounds(spark):
    """A thousand languages are learned from without a plan that grows with them; the model keeps the most frequent ones."""
    rows = [(i, f"wort{i % 1000} satz{i % 1000}", f"l{i % 1000:03}") for i in range(3000)] + [(5000 + i, "mehr worte", "l007") for i in range(5)]
    model = language_id.train(documents(spark, rows), languages=20)
    assert len(model["langs"]) == 20 and model["langs"][0] == "l000" and "l007" in model["langs"]
    assert language_id.train(documents(spark, rows), languages=1000)["logp"].shape[2] == 1000


def test_language_sample_is_the_same_for_all_layouts(spark):
    rng = random.Random(3)
    df = documents(spark, [(i, random_words(rng, 30), "ab"[i % 2]) for i in range(400)])
    models = [language_id.train(df.repartition(n), key="doc_id", sample_rows=100, sample_bytes=5_000)["logp"] for n in (1, 7)]
    assert (models[0] == models[1]).all() and (models[0] != language_id.train(df)["logp"]).any()


def language_brute(text, model):
    """(languages, proportions, log-likelihoods by word) by loops over words and letters."""
    logp, words, out = model["logp"].astype(np.float64), [], None
    raw = bytes(language_id.prepare(np.frombuffer(text.encode(), np.uint8)))
    for m in re.finditer(rb"[^ ]+", raw):
        words += [(i, min(i + language_id.WORD_BYTES, m.end())) for i in range(m.start(), m.end(), language_id.WORD_BYTES)]
    borders = [s for s, _ in words] + [len(raw)]
    ll = np.zeros((len(words), logp.shape[2]))
    for w, (a, b) in enumerate(zip(borders, borders[1:])):
        for end in range(a, b):
            for k, size in enumerate(language_id.SIZES):
                gram = (b"\0" * size + raw[: end + 1])[-size:]
                bucket = int(language_id.gram_buckets(np.frombuffer(gram, np.uint8), size)[-1])
                ll[w] += logp[k, bucket] / len(language_id.SIZES)
    langs, step = ll.shape[1], language_id.PENALTY * 0.5 * np.log(max(len(words), 2))

    def em(allowed):
        t = allowed / allowed.sum()
        for _ in range(language_id.ROUNDS):
            q = t * np.exp(ll - ll.max(1, keepdims=True))
            t = (q / q.sum(1, keepdims=True)).mean(0)
        return t, np.log((t * np.exp(ll - ll.max(1, keepdims=True))).sum(1)).sum() + ll.max(1).sum()

    one = int(ll.sum(0).argmax())
    full, of_full = em(np.ones(langs))
    order = [one, *[int(j) for j in np.argsort(-full, kind="stable") if j != one]]
    best, out = ll.sum(0)[one], np.eye(langs)[one]
    for k in range(2, langs + 1):
        if of_full - (k - 1) * step <= best + 1e-9:
            break
        t, value = em(np.isin(np.arange(langs), order[:k]).astype(float))
        if value - (k - 1) * step > best + 1e-9:
            best, out = value - (k - 1) * step, t
    return out


def test_language_sets_and_scores_match_brute_force(spark, monkeypatch):
    """Which set is chosen, the prediction and its score, for texts in one batch, whatever their neighbours and the slices."""
    rng = random.Random(11)
    speak = {k: [f"{a}{b}" for a in s for b in s] for k, s in {"aa": ["ka", "mo", "ti"], "bb": ["shr", "eng", "ka"], "cc": ["üß", "öch", "ti"], "dd": ["zza", "eng", "mo"]}.items()}
    say = lambda k, n: " ".join(rng.choice(speak[k]) for _ in range(n))
    model = language_id.train(documents(spark, [(i, say(k, 40), k) for i, k in enumerate([*speak] * 10)]))
    texts = ["  " + say("aa", 3), say("bb", 12) + " " + say("cc", 7), "\n" + say("dd", 30) + " " + say("aa", 9) + "\t" + say("cc", 5), "x", " - \n", "kamo" * 60 + " " + say("cc", 4), say("cc", 60)]
    texts += [" ".join(say(rng.choice([*speak]), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    for words in (500_000, 7):
        monkeypatch.setattr(language_id, "SLICE_WORDS", words)
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        ll, first = language_id.word_likelihoods(np.frombuffer(b"".join(raw), np.uint8), offsets, model["logp"])
        for got, text in zip(language_id.infer(ll, first), texts, strict=True):
            if text.strip():
                assert got == pytest.approx(language_brute(text, model), abs=1e-3), text
    monkeypatch.setattr(language_id, "SLICE_WORDS", 500_000)
    for r in language_id.identify_languages(documents(spark, list(enumerate(texts))).coalesce(1), model).collect():
        theta = language_brute(r["text"], model)
        if re.search("[a-z]", r["text"]):
            assert r["lang_pred"] == model["langs"][int(theta.argmax())] and r["lang_score"] == pytest.approx(theta.max(), abs=1e-3)


def test_language_em_matches_plain_loop():
    rng = np.random.default_rng(0)
    ll, first = rng.normal(size=(50, 3)), np.array([0, 20, 20, 50])
    theta, total = language_id.mixtures(ll, first, np.ones((3, 3)), rounds=5)
    for d, (a, b) in enumerate(zip(first, first[1:])):
        if a == b:
            continue
        t = np.ones(3) / 3
        for _ in range(5):
            q = t * np.exp(ll[a:b])
            t = (q / q.sum(1, keepdims=True)).mean(0)
        assert theta[d] == pytest.approx(t)
        assert total[d] == pytest.approx(np.log((t * np.exp(ll[a:b])).sum(1)).sum())


# 4: WARC


def expected_pages(rows):
    first = {}
    for i, html in rows:
        key = html or ""
        first[key] = min(first.get(key, i), i)
    out = {}
    for i, html in rows:
        raw = (html or "").encode()
        own = first[html or ""] == i
        out[i] = (len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_warc_round_trip(spark, tmp_path, seed):
    rng = random.Random(seed)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "".join(rng.choice(["<p>ä</p>", "\r\n\r\n", "WARC/1.1\r\n", "x" * 50, fake, fake + fake, "\n"]) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "same"), (1003, "same"), (1004, "WARC/1.1\r\n"), (1005, fake), (1006, fake), (1007, "y" * 3_000_000)]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "clash") for i, h in rows], "page_id long, url string, html string, sha1 string")
    warc.write_warc(df.repartition(3), str(tmp_path / "w"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == expected_pages(rows)


def test_warc_small_splits(spark, tmp_path):
    """Records are found whole when a file is read in many parts."""
    rows = [(i, "z" * (i % 97) + "WARC/1.1\r\n" * (i % 3)) for i in range(400)]
    warc.write_warc(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected_pages(rows)


def warc_record(page_id, payload, version="1.1", length=None):
    body = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n{payload}"
    n = len(body) if length is None else length
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


def test_warc_broken_lengths_and_versions(spark, tmp_path):
    """A length that points back, or past the end, ends the chain; no record comes twice; versions 1.x are read; other files are errors."""
    read = lambda text: _read_text(spark, tmp_path, text)
    two = warc_record(1, "one") + warc_record(2, "two WARC/1.1\r\n and more")
    assert read(two) == [1, 2] == read(two.replace("WARC/1.1", "WARC/1.0"))
    back = -(len(two) - len(warc_record(1, "one")) + 20)
    assert read(two + warc_record(3, "three", length=back)) == [1, 2]
    assert read(two + warc_record(3, "three", length="x") + warc_record(4, "four")) == [1, 2]
    assert read(two + warc_record(3, "three", length=10**6)) == [1, 2]
    assert read(warc_record(1, warc_record(7, "inner") * 3) + warc_record(2, "b")) == [1, 2]
    for bad in ("no archive at all", "x" + two, "WARC/2.0\r\n\r\n"):
        with pytest.raises(ValueError, match="doesn't begin"):
            read(bad)


def _read_text(spark, tmp_path, text):
    path = tmp_path / f"a{len(list(tmp_path.iterdir()))}.warc"
    path.write_bytes(text.encode())
    return sorted(r["page_id"] for r in warc.read_warc(spark, str(path)).collect())


def test_warc_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_base32(spark):
    digest = hashlib.sha1(b"abc").hexdigest()
    got = spark.range(1).select(warc.base32_of_hex(F.lit(digest))).first()[0]
    assert got == b32encode(bytes.fromhex(digest)).decode()


# 5: token files


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 5000))
    ids = rng.integers(0, [1, 2, 300, 49_408, 2**32, 60_000][seed], n, dtype=np.uint64).astype(np.uint32)
    if seed == 2:
        ids[:: max(1, n // 7)] = 2**32 - 1  # outliers
    raw = token_files.encode_block(ids)
    assert (token_files.decode_block(raw, n) == ids).all()
    segment = token_files.encode_segment([3, 1], [n, 0], ids, block=100)
    assert (token_files.segment_block(segment, 0, block=100) == ids[:100]).all()
    if seed == 2 and n > 500:
        assert len(raw) < 2 * n  # the exceptions don't widen the block


def test_token_files_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in sequence(spark, sf_dir, "documents").collect()}
    start = 0
    got = {r["doc_id"]: r for r in token_files.query(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d in sorted(texts):
        ids = [*lib.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark, tmp_path):
    token_files.write_token_files(documents(spark, ODD, ("file", "ids")), token_files.vocabulary_path(), 2, str(tmp_path / "t"), files=3)
    back = token_files.read_token_files(spark, str(tmp_path / "t"))
    rows = back.orderBy("file", "place").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    one_line = tokens.CachedTokenizer(token_files.vocabulary_path(), lead_space=False).whole("long wörds and lines")
    assert [r["n_tokens"] for r in rows][1:4] == [1, 1, 1] and rows[-1]["n_tokens"] == 20_000 * len(one_line) // 4 + 1
    token_files.write_token_files(documents(spark, []), token_files.vocabulary_path(), 2, str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_token_files_of_many_segments(spark, tmp_path, monkeypatch):
    """Ranges are cut into files and segments; files are in the order of their numbers, not of their names."""
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 3)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    rng = random.Random(6)
    rows = [(i, random_words(rng, rng.randrange(0, 30))) for i in range(300)]
    token_files.write_token_files(documents(spark, rows), token_files.vocabulary_path(), 2, str(tmp_path / "t"), files=2)
    assert len(list((tmp_path / "t").glob("part-*"))) > 10
    got = token_files.with_global_starts(materialize(token_files.read_token_files(spark, str(tmp_path / "t")), "files")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(300))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    names = [f"/x/part-{t:05}-u-c{c:03}.txt" for t, c in [(0, 0), (0, 1), (0, 1000), (99_999, 0), (100_000, 0)]]
    numbers = [r["n"] for r in spark.createDataFrame([(x,) for x in names], "p string").select(token_files._file_number(F.col("p")).alias("n")).collect()]
    assert numbers == sorted(set(numbers))


ALPHABET = ["a", "B", "é", "É", "×", "÷", " ", "  ", "\n", "'", "s", "t", ".", ",", "1", "²", "»", "!", "ª", "Σ", "\t", "l", "L", "\xa0", "\x00", "İ", "J̌", "<|endoftext|>", "日"]


def test_added_tokens_as_the_library_does_by_default():
    from tokenizers import Tokenizer

    for path, byte_level in [(packing.vocabulary_path(), True), (token_files.vocabulary_path(), False)]:
        lib = Tokenizer.from_file(path)
        texts = ["a <|endoftext|> b", "plain <| text", "", "<", "|startoftext|>", "<|startoftext|>Some Wörds<|EndOfText|>.", "中 <|endoftext|>\n", "x<|endoftext|><|endoftext|>", "last one"]
        right = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        makers = [tokens.ByteLevelTokenizer(path), tokens.CachedTokenizer(path, lead_space=True)] if byte_level else [tokens.CachedTokenizer(path, lead_space=False)]
        for made in makers:
            assert [np.frombuffer(made.encode(t), "<u4").tolist() for t in texts] == right
        if not byte_level:
            assert [np.frombuffer(x, "<u4").tolist() for x in tokens.BatchEncoder(path).encode(pa.array(texts))] == right


def test_ids_of_every_kind_of_character_are_the_librarys():
    """Characters beside letters, digits, marks and spaces: the basic plane in part, and some of the others (all were compared once)."""
    some = [chr(i) for i in (*range(0, 0x3000), *range(0x3000, 0x10000, 5), *range(0x10000, 0x110000, 97)) if not 0xD800 <= i < 0xE000]
    fast, plain = tokens.ByteLevelTokenizer(packing.vocabulary_path()), tokens.CachedTokenizer(token_files.vocabulary_path(), lead_space=False)
    texts = ["".join(f"\na{c}a1{c}1 {c}b {c}{c} .{c}. '{c}s" for c in some[i : i + 500]) for i in range(0, len(some), 500)]
    for text, ids in zip(texts, tokens.BatchEncoder(token_files.vocabulary_path()).encode(pa.array(texts)), strict=True):
        assert fast.encode(text) == fast.slow.whole(text)
        assert ids == plain.whole(text)
    long = "of words, and 12 more\n" * 60_000
    assert fast.encode(long) == fast.slow.whole(long)


def test_cached_ids_are_the_librarys():
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    batch = tokens.BatchEncoder(token_files.vocabulary_path())
    plain = tokens.CachedTokenizer(token_files.vocabulary_path(), lead_space=False)
    fast = tokens.ByteLevelTokenizer(packing.vocabulary_path())
    lead = tokens.CachedTokenizer(packing.vocabulary_path(), lead_space=True)
    for text, ids in zip(texts, batch.encode(pa.array(texts)), strict=True):
        assert ids == plain.whole(text) == plain.encode(text)
        assert fast.encode(text) == lead.whole(text) == lead.encode(text)


# 6: mixing


def filled(sizes, weights, budget):
    """Resharing by hand: fill, fix those above their cap, share the rest again."""
    targets, free = {}, set(sizes)
    while free:
        left = budget - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = 2.0 * sizes[s]
        free -= over
    return targets


def test_mixing_targets_and_takings(spark):
    rng = random.Random(7)
    rows = [(i, random_words(rng, rng.randrange(0, 40)), "en", rng.choice(["b", "a", "a", "a", "é", None, "Z"])) for i in range(600)]
    rows += [(900, None, "en", "a"), (901, "", "en", "empty"), (902, "x y", "en", "tiny"), (5, "again", "en", "a")]
    got = mixing.mix_sources(documents(spark, rows, ("size", "key"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()))
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 40


def test_mixing_buckets_equal_one_sort(spark, monkeypatch):
    """Narrowed intervals choose what one sort by key chooses, also with few buckets, skewed weights and hot equal rows."""
    rng = random.Random(8)
    rows = [(i, random_words(rng, 5 + i % 20) + " ###" * (8 * (i % 3 == 0)), "en", "ab"[i % 5 == 0]) for i in range(3000)] + [(7, "the same words again", "en", "a")] * 700
    df = documents(spark, rows)
    takings = []
    for most, buckets in ((10**9, 1024), (1, 1024), (1, 4)):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", most)
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        got = {}
        for r in mixing.mix_sources(df).collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["copies"]
        takings.append(got)
    assert takings[0] == takings[1] == takings[2]


def test_mixing_takes_equal_rows_singly(spark, monkeypatch):
    """A source of equal rows alone comes near its target, however its rows are dealt."""
    rows = [(1, "a b c d", "en", "z")] * 1000 + [(5, "x y " * 50, "en", "a"), (6, "x z " * 50, "en", "b")]
    for parts in (1, 6):
        got = mixing.mix_sources(documents(spark, rows).repartition(parts)).filter("source = 'z'").collect()
        assert len(got) == 1000 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 4 and 4000 < got[0]["target"] < 8000


def test_mixing_matches_sql(spark, sf_dir, duck):
    from conftest import same_rows

    same_rows(mixing.query(spark, sf_dir), duck.sql(mixing.ORACLE_SQL))


def test_mixing_prefers_quality(spark):
    rows = [(i, ("good words only here " * 10) + str(i), "en", "a") for i in range(500)] + [(1000 + i, ("### $$$ %%% *** " * 10) + str(i), "en", "a") for i in range(500)]
    rows += [(5000 + i, "filler text " * 60, "en", "b") for i in range(30)] + [(9000 + i, "filler text " * 60, "en", "c") for i in range(30)]
    copies = {}
    # the small sources reach their caps, the last one gets what they leave
    rows = [(d, t, lang, {"a": "z"}.get(s, s)) for d, t, lang, s in rows]
    for r in mixing.mix_sources(documents(spark, rows)).filter("source = 'z'").collect():
        copies.setdefault(r["doc_id"] >= 1000, []).append(r["copies"])
    assert np.mean(copies[False]) > np.mean(copies[True])


def test_mixing_empty(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0


# 7: quality rules


def rule_features(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_features_match_brute_force(spark, sf_dir):
    rows = [*ODD[:-1], (70, "a b c a b c a b"), (71, "x\n\nx\n x\nx"), (72, "é# |é|\n" * 3), (73, "a b c\x0bd a b\tc")]
    docs = sequence(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in quality_rules.add_features(docs.withColumn("n_words", F.lit("clash"))).collect():
        assert tuple(r[c] for c in quality_rules.FEATURES) == rule_features(r["text"]), r["doc_id"]


def plain_votes(f):
    """The eight rules, spelled out for one document."""
    n, chars, cased, lines = max(f["n_words"], 1), max(f["word_chars"], 1), max(f["n_upper"] + f["n_lower"], 1), max(f["n_lines"], 1)
    rule = lambda bad, good: -1 if bad else int(good)
    return (
        rule(f["n_words"] < 50, f["n_words"] >= 100), rule(not 2.5 <= chars * (f["word_chars"] > 0) / n <= 12, 3 <= f["word_chars"] / n <= 9),
        rule(f["n_symbols"] / n > 0.1, f["n_symbols"] / n < 0.02), rule(f["n_upper"] / cased > 0.4, f["n_upper"] / cased < 0.2),
        rule(f["n_letters"] / chars < 0.75, f["n_letters"] / chars > 0.88),
        rule(f["n_dup_lines"] / lines > 0.3 or 2 * f["n_repeat_words"] > n, f["n_dup_lines"] / lines < 0.1 and f["n_repeat_words"] / n < 0.2),
        rule(f["n_strong"] / n > 0.15, f["n_strong"] / n < 0.03), rule(f["n_top_word"] / n > 0.3 and f["n_words"] > 10, f["n_top_word"] / n < 0.15),
    )


def test_quality_kept_matches_brute_force(spark, sf_dir):
    """Votes counted by a dictionary, EM by loops over patterns, and the verdict of every document recomputed."""
    texts = {r["doc_id"]: r["text"] or "" for r in sequence(spark, sf_dir, "documents").collect()}
    by_doc = {}
    for d, t in texts.items():
        n, chars, symbols, dup, repeated = rule_features(t)
        w, flat = WORDS.findall(t), "".join(WORDS.findall(t))
        f = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated, "n_lines": sum(bool(WORDS.search(x)) for x in t.split("\n"))}
        f |= {"n_upper": sum("A" <= c <= "Z" for c in t), "n_lower": sum("a" <= c <= "z" for c in t), "n_strong": t.count("!") + t.count("?"), "n_top_word": max((w.count(x) for x in set(w)), default=0)}
        f["n_letters"] = sum(c > "\x7f" or c.isalpha() for c in flat)
        by_doc[d] = (plain_votes(f), n < 50 or 100 * repeated > 50 * n)
    counts = {}
    for v, _ in by_doc.values():
        counts[v] = counts.get(v, 0) + 1
    prior, p = 0.7, {1: [[0.005, 0.1, 0.895]] * 8, 0: [[0.25, 0.1, 0.65]] * 8}

    def good(v):
        z = math.log(prior / (1 - prior))
        for j, x in enumerate(v):
            if x:
                share = [p[c][j][x + 1] / (p[c][j][0] + p[c][j][2]) for c in (0, 1)]
                z += math.log(share[1] / share[0])
        return 1 / (1 + math.exp(-max(-60, min(60, z))))

    for _ in range(200):
        g = {v: good(v) for v in counts}
        weight = {1: {v: n * g[v] for v, n in counts.items()}, 0: {v: n * (1 - g[v]) for v, n in counts.items()}}
        prior = min(0.95, max(0.05, sum(weight[1].values()) / sum(counts.values())))
        for c in (0, 1):
            p[c] = [[(sum(n for v, n in weight[c].items() if v[j] == x) + 1) / (sum(weight[c].values()) + 3) for x in (-1, 0, 1)] for j in range(8)]
        for j in range(8):
            p[1][j][0] = min(p[1][j][0], p[0][j][0])
        p = {c: [[x / sum(row) for x in row] for row in p[c]] for c in p}
    for r in quality_rules.query(spark, sf_dir).collect():
        v, failed = by_doc[r["doc_id"]]
        assert r["base_failed"] == failed and r["quality"] == pytest.approx(good(v), abs=1e-6)
        assert r["kept"] == (not failed and good(v) >= 0.5)


def test_quality_posterior_separates_labels(spark, sf_dir):
    quality = {r["doc_id"]: r["quality"] for r in sequence(spark, sf_dir, "labels").collect()}
    got = {r["doc_id"]: r for r in quality_rules.query(spark, sf_dir).collect()}
    for d, q in quality.items():
        r = got[d]
        if not r["base_failed"]:
            assert r["kept"] == (q == 1)
        assert not (r["base_failed"] and r["kept"])


def test_quality_em_recovers_accuracies():
    """Votes drawn from known accuracies: the estimated share of good documents and the noisy rule's weight come out."""
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.75
    fire = np.where(good[:, None], [0.01, 0.01, 0.02, 0.3, 0.01, 0.01, 0.01, 0.01], [0.7, 0.8, 0.6, 0.35, 0.5, 0.6, 0.7, 0.4])
    v = np.where(rng.random(fire.shape) < fire, -1, 1).astype(np.int8)
    counts = np.bincount(quality_rules.pattern_of(v), minlength=3**quality_rules.RULES)
    model = quality_rules.fit(counts)
    assert model["prior"] == pytest.approx(0.75, abs=0.02)
    assert model["p"][1, 3, 0] == pytest.approx(0.3, abs=0.03)
    assert ((model["posterior"][quality_rules.pattern_of(v)] > 0.5) == good).mean() > 0.98


def test_quality_empty(spark):
    featured = quality_rules.add_features(documents(spark, []).select("doc_id", "text"))
    assert quality_rules.judge(featured, quality_rules.fit_documents(featured)).count() == 0


def test_long_texts_are_worked_on_in_slices(monkeypatch):
    """What is counted and encoded doesn't depend on the size of slices, also where a word or a line is longer than one."""
    rng = random.Random(4)
    line = random_words(rng, 400)
    texts = [line + "\n" + line + "\nx\n" + "longword" * 300 + " a b c a b c " + "longword" * 300, random_words(rng, 900), "y" * 5000, "", "One two. <|endoftext|> three " * 90]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = quality_rules.features(data, offsets)
    sets = [len(set(h.tolist())) for _, h in [jaccard_join.shingle_sets(data[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:])]]
    ids = list(tokens.BatchEncoder(token_files.vocabulary_path()).encode(pa.array(texts)))
    for size in (64, 700):
        monkeypatch.setattr(textvec, "SLICE_BYTES", size)
        monkeypatch.setattr(tokens, "SLICE_BYTES", size)
        for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
            alone = quality_rules.features(data[a:b], np.array([0, b - a]))
            assert {k: int(v[0]) for k, v in alone.items()} == {k: int(v[i]) for k, v in whole.items()}
            assert len(jaccard_join.shingle_sets(data[a:b], np.array([0, b - a]))[1]) == sets[i]
            assert tokens.BatchEncoder(token_files.vocabulary_path())._long(data[a:b]) == ids[i]


# 8: fingerprints


def test_fingerprint_pairs(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"] or "") for r in sequence(spark, sf_dir, "documents").collect())
    got = {r["doc_id"]: r for r in fingerprints.query(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        # likeness again from the printed fingerprints: 16 hex digits for each anchor, whose last 23 bits are its place
        anchors = lambda x: {int(x[i : i + 16], 16) >> fingerprints.PLACE_BITS for i in range(0, len(x), 16)}
        one, two = anchors(r["fingerprint"]), anchors(r["edited_fingerprint"])
        three = anchors(got[rows[(i + 1) % len(rows)][0]]["fingerprint"])
        for near, other in ((r["near_edited"], two), (r["near_next"], three)):
            assert near == pytest.approx(len(one & other) / len(one | other) if one | other else 1.0)
    # half of the text is kept, little of it is in the next one
    far = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in far]) > 0.2 > np.mean([r["near_next"] for r in far])


def syncmers(hashes, m):
    k, s = fingerprints.K, fingerprints.S
    return [i for i in range(len(hashes) - k + 1) if min(m[i], m[i + k - s]) <= min(m[i + j] for j in range(1, k - s))]


def test_syncmer_choice_is_local(spark):
    """A passage gives the same anchors in two texts, and their places differ by its shift; the choice matches a plain loop."""
    rng = random.Random(4)
    passage = random_words(rng, 120, 100_000)
    a, b = "start here " + passage, random_words(rng, 30, 100_000) + " " + passage
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a"), 10_000).alias("a"), fingerprints.fingerprint(F.col("b"), 10_000).alias("b"), F.col("a").alias("text"))
    r = df.select("*", fingerprints.matching_places(F.col("a"), F.col("b")).alias("m"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).withColumn("s", F.expr("transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1]))")).first()
    assert len(r["m"]) > 20 and {x["b"] - x["a"] for x in r["m"]} == {28}
    places = sorted(x & ((1 << fingerprints.PLACE_BITS) - 1) for x in r["a"])
    assert places == syncmers(r["h"], r["s"])


def test_fingerprint_likeness_is_jaccard(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(20):
        x, y = rng.sample(range(200), 50), rng.sample(range(200), 60)
        pack = lambda v: sorted((h << fingerprints.PLACE_BITS) for h in v)
        rows.append((pack(x), pack(y), len(set(x) & set(y)) / len(set(x) | set(y))))
    rows += [([], [], 1.0), ([], [5 << fingerprints.PLACE_BITS], 0.0)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, j double")
    for r in df.select(fingerprints.likeness(F.col("a"), F.col("b"), 1000).alias("got"), "j").collect():
        assert r["got"] == pytest.approx(r["j"])


def test_fingerprint_holds_all_anchors(spark):
    """Long texts keep every anchor at every place; a changed word and a shared passage show at the operator's own setting."""
    rng = random.Random(8)
    passage, line = random_words(rng, 50, 100_000), random_words(rng, 9, 100_000)
    a = f"{random_words(rng, 3000, 100_000)} {passage} {random_words(rng, 3000, 100_000)}"
    b = f"{random_words(rng, 2000, 100_000)} {passage} {random_words(rng, 2000, 100_000)}"
    changed = a.split(" ")
    changed[4000] = "changed"
    texts = [(1, a), (2, " ".join(changed)), (3, b), (4, " ".join([line] * 100))]
    found = spark.createDataFrame(texts, "id long, text string").select("*", fingerprints.fingerprint(F.col("text")).alias("fp"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h"))
    got = {r["id"]: r for r in found.withColumn("s", F.expr("transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1]))")).collect()}
    for r in got.values():
        assert sorted(x & ((1 << fingerprints.PLACE_BITS) - 1) for x in r["fp"]) == syncmers(r["h"], r["s"])
    hashes = {i: {x >> fingerprints.PLACE_BITS for x in r["fp"]} for i, r in got.items()}
    pairs = spark.createDataFrame([(i, j, got[i]["fp"], got[j]["fp"]) for i, j in [(1, 2), (1, 3), (4, 4)]], "i long, j long, a array<long>, b array<long>")
    out = {(r["i"], r["j"]): r for r in pairs.select("i", "j", fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), fingerprints.matching_places(F.col("a"), F.col("b")).alias("m")).collect()}
    for (i, j), r in out.items():
        assert r["near"] == pytest.approx(len(hashes[i] & hashes[j]) / len(hashes[i] | hashes[j]))
    assert 0.99 < out[1, 2]["near"] < 1
    assert len(out[1, 3]["m"]) > 10 and {x["b"] - x["a"] for x in out[1, 3]["m"]} == {-1000}
    places = set(syncmers(got[4]["h"], got[4]["s"]))
    assert {x["a"] for x in out[4, 4]["m"]} == {x["b"] for x in out[4, 4]["m"]} == places and len(places) > 100


def test_fingerprint_odd_rows(spark):
    got = fingerprints.fingerprint_documents(documents(spark, ODD, ("fp", "range"))).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_chars"] == 0 and by_id[1]["fp"] == [] and by_id[1]["near_next"] == 1.0
    # the null id is first; the last document is followed by it
    text, first = ODD[-1][1], "no id at all here"
    half = len(text) // 2
    assert by_id[7]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + first[:half]).encode()).hexdigest()
    alone = fingerprints.fingerprint_documents(documents(spark, [(3, "only one text here, its own neighbour")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprint_hot_ids_and_equal_rows(spark):
    """Null ids, one id and equal rows that hold most of the table are dealt over ranges; each row has its next one."""
    rng = random.Random(12)
    rows = [(None, random_words(rng, 12)) for _ in range(60)] + [(7, random_words(rng, 9)) for _ in range(60)] + [(9, "the same words in all of these rows")] * 50 + [(i, random_words(rng, 8)) for i in range(10, 30)]
    df = documents(spark, rows)
    ties = {r["text"]: r["t"] for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    expected = sorted((str(d), t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))
    for ranges in (1, 13):
        got = fingerprints.with_next_document(df, ranges).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == expected
    bounds = fingerprints._bounds(df.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text").alias("tie")), 13)
    assert len({k for k, _ in bounds}) < len(bounds)


# 9: quality classifier


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = np.asarray(label) == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return (rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_classifier_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    quality = {r["doc_id"]: r["quality"] for r in sequence(spark, big, "labels").collect()}
    got = [r for r in quality_classifier.query(spark, big).collect()]
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert auc([r["score"] for r in held], [quality[r["doc_id"]] for r in held]) > 0.85


def test_classifier_without_labels_and_odd_rows(spark):
    model = quality_classifier.learn([], [], None)
    got = quality_classifier.score_quality(documents(spark, ODD, ("quality_score",)), model).collect()
    assert len(got) == len(ODD) and all(r["quality_score"] == pytest.approx(0.5) for r in got)
    rng = random.Random(1)
    good, bad = [random_words(rng, 80) for _ in range(60)], ["#$% " * 80 + str(i) for i in range(60)]
    model = quality_classifier.learn(good, bad, 0.5)
    df = documents(spark, [(1, good[0]), (2, bad[0]), (3, None), (4, "")])
    s = {r["doc_id"]: r["quality_score"] for r in quality_classifier.score_quality(df, model).collect()}
    assert s[1] > 0.5 > s[2] and s[3] == s[4]
    assert quality_classifier.sample_labelled(df, spark.createDataFrame([(9, 1), (1, None)], "doc_id long, quality int"))[:2] == ([], [])


def test_classifier_scores_match_brute_force(spark, sf_dir):
    """Learning and scoring again by hand: samples by hash, dictionaries, sizes of chunks, the curve by gradient descent."""
    import zstandard

    documents_, labels = sequence(spark, sf_dir, "documents"), sequence(spark, sf_dir, "labels")
    known = labels.filter(~quality_classifier.held_out(F.col("doc_id")))
    good, bad, share = quality_classifier.sample_labelled(documents_, known)
    texts = {r["doc_id"]: r["text"] for r in documents_.collect()}
    y = {r["doc_id"]: r["quality"] for r in known.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert sorted(good) == sorted(texts[d] for d, q in y.items() if q == 1) and sorted(bad) == sorted(texts[d] for d, q in y.items() if q == 0)
    assert share == pytest.approx(sum(y.values()) / len(y))
    model = quality_classifier.learn(good, bad, share)

    def size(raw, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))

    def difference(text):
        raw = (text or "").encode()
        n = -(-len(raw) // quality_classifier.CHUNK)
        chunks = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]
        return sum(size(c, model["dictionaries"][0]) - size(c, model["dictionaries"][1]) for c in chunks) / max(len(raw), 1)

    fit = [(difference(t), c) for c, group in ((0, bad), (1, good)) for t in group[max(1, len(group) // 2) :]]
    x, c = np.array([a for a, _ in fit]), np.array([b for _, b in fit], float)
    a = b = 0.0
    for _ in range(20_000):  # the same ridge as the operator's curve
        q = 1 / (1 + np.exp(-(a + b * x / x.std())))
        a, b = a + 0.02 * ((c - q).sum() - 1e-3 * a), b + 0.02 * (((c - q) * x / x.std()).sum() - 1e-3 * b)
    a += math.log(share / (1 - share)) - math.log(c.sum() / (len(c) - c.sum()))
    for r in quality_classifier.query(spark, sf_dir).collect():
        z = a + b * difference(texts[r["doc_id"]]) / x.std()
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-3)


# 10: Jaccard join


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, groups):
    """Groups of copies with edits around the threshold, passages that many share, chains, and others."""
    rows, passage = [], random_words(rng, 60)
    for size, words in groups:
        base = random_words(rng, words).split(" ")
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                i = rng.randrange(len(w))
                w[i] = f"new{rng.randrange(10**6)}"
            text = " ".join(w)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append(text.upper() if rng.random() < 0.2 else text)
    chain = random_words(rng, 120).split(" ")
    for i in range(12):
        rows.append(" ".join(chain[3 * i : 3 * i + 80]))
    rows += [random_words(rng, rng.randrange(1, 60)) for _ in range(60)] + [passage] * 3 + ["a b", "A  b", "a b c d", "", None]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(10 * i + 3, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 64), (2, 8), (3, 4)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, seed, frequent):
    """Also with very low bounds for frequent shingles and hubs, which send most pairs the other way."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", 5 if frequent < 64 else 256)
    rows = near_copies(random.Random(seed), [(40, 90), (25, 40), (12, 200), (6, 15), (30, 60)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, rows, ("node", "n"))).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_long_lists_become_frequent(spark, monkeypatch):
    """No frequent shingle is found in parts of the table, so long prefix lists tell of them; also where there is no room for more."""
    rows = near_copies(random.Random(5), [(60, 40), (30, 25)])
    for most, long in ((400_000, 6), (3, 4), (0, 4)):
        monkeypatch.setattr(jaccard_join, "COUNT_CHUNK", 1)
        monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", most)
        monkeypatch.setattr(jaccard_join, "LONG", long)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
        assert got == jaccard_brute(rows)


def test_jaccard_odd_rows(spark):
    got = jaccard_join.jaccard_components(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[6] == (1, 5)
    assert by_id[None][1] is None and by_id[4] == (1, 4)
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(documents(spark, [(1, "just one text with some words")])).first()["component_id"] == 1


def test_connected_components_of_a_path(spark):
    links = spark.createDataFrame([(2 * i, 2 * i + 2) for i in range(200)] + [(1001, 1003)], "x long, y long")
    got = {r["node"]: r["comp"] for r in jaccard_join.connected_components(links).collect()}
    assert {got[2 * i] for i in range(201)} == {0} and got[1003] == 1001
