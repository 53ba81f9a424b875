"""Nulls, empty tables, repeated rows, ties, long texts, extra and clashing columns."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import chat, decontaminate, embeddings, packing, pii, quality, queries, repeats, shared, shingles, simhash, toxicity, warc

DOCS = "doc_id long, text string, fp long, hash string, rep int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, blanks, repeats, a very long text, and columns whose names operators use inside."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=60_000))
    same = " ".join(words[:80])
    rows = [(1, same), (1, same), (2, same + " x"), (3, None), (4, ""), (5, " \n\t"), (None, same), (None, None), (6, long), (7, "é" * 300), (8, "a" * 5000), (9, "one two")]
    return spark.createDataFrame([(i, t, 7, "h", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)], LABELS)


def test_pii(odd, none):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0
    masked = pii.mask_pii(odd)
    assert masked.columns == odd.columns and masked.where("text is null").count() == 2


def test_pii_kinds_and_masks():
    text = "a.b@c.de, 10.0.0.1 10.0.0.999, 4111 1111 1111 1111, +1 (017) 555-7713"
    spans = pii.base_spans(text)
    assert [s[0] for s in spans] == ["email", "ip", "card", "phone"]
    assert pii.mask_text(text, spans) == "[EMAIL], [IP] 10.0.0.999, [CARD], [PHONE]"
    assert pii.base_spans("") == [] and pii.base_spans("@" * 50 + "9" * 5000) == []


def test_pii_network_adds_written_out_forms():
    (base, spans), = pii.find_all(["write to john.smith (at) example (dot) com, card 4111_1111_1111_1111 end"], pii.trained())
    assert base == [] and {"email", "card"} <= {s[0] for s in spans}


def test_pii_network_finds_nine_in_ten_of_each_kind():
    made = [pii.training_sentence(rng) for rng in [np.random.default_rng(4711)] for _ in range(1500)]
    seen, hit = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for (text, labelled), (base, spans) in zip(made, pii.find_all([t for t, _ in made], pii.trained())):
        for kind, a, b in labelled:
            if a >= 2 and b <= len(text) - 2 and not any(s[0] == kind and s[1] <= a and s[2] >= b for s in base):
                seen[kind] += 1
                hit[kind] += any(s[0] == kind and min(b, s[2]) - max(a, s[1]) >= 0.8 * (max(b, s[2]) - min(a, s[1])) for s in spans)
    assert all(hit[k] >= 0.9 * seen[k] and seen[k] > 50 for k in pii.KINDS), (hit, seen)


def test_pii_reads_the_same_spans_in_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    spoken = spark.createDataFrame([(-k, f"{'word and word ' * k} write to jo at mail.com now please, 4111_1111_1111_1111 or 10 dot 0 dot 0 dot 7 {'end ' * k}") for k in range(1, 60)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(spoken)
    part, whole = ({r["doc_id"]: r["spans"] for r in pii.find_pii(docs, whole=w).collect()} for w in (False, True))
    assert part == whole and sum(part[-k].count(":") // 2 for k in range(1, 60)) >= 0.9 * 3 * 59


def test_pii_gradients_of_the_field():
    rng = np.random.default_rng(3)
    scores, trans, tags = rng.standard_normal((5, 2, pii.TAGS)), rng.standard_normal((pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (5, 2))
    d_scores, d_trans, _ = pii.crf_gradients(scores, tags, trans)
    for array, gradient in ((scores, d_scores), (trans, d_trans)):
        for _ in range(10):
            at = tuple(rng.integers(0, n) for n in array.shape)
            array[at] += 1e-5
            above = pii.crf_gradients(scores, tags, trans)[2]
            array[at] -= 2e-5
            below = pii.crf_gradients(scores, tags, trans)[2]
            array[at] += 1e-5
            assert abs((above - below) / 2e-5 - gradient[at]) < 1e-4


def test_scores(odd, none, labels):
    for score in (toxicity.toxicity, quality.quality):
        got = score(odd, labels)
        assert got.count() == odd.count() and got.where("score < 0 or score > 1 or score is null or held_out is null").count() == 0
        assert score(none, labels).count() == 0 and score(odd, labels.limit(0)).count() == odd.count()
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxic_words_are_seen_through_disguises(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("the", "an", "er", "on", "sto", "li")) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["idiot", "moron"] if bad else []))))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "the on an 1d10t stoli"), (1001, "the i d i o t on"), (1002, "an iiidiooot on"), (1003, "the sto-li on 12.5 an")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, known).where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 1, 1002: 1, 1003: 0}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "one two"), (4, "One, TWO!"), (5, "absent words here are many more")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(odd, items).collect()}
    assert got == {(9, 1), (9, 4)}
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_decontamination_at_the_threshold(spark):
    words = [f"w{k}" for k in range(34)]  # 30 shingles
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["x", *words[:28], "y"])), (2, " ".join(["x", *words[:27], "y"])), (3, " ".join(words * 2))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_shared"] for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: 24, 3: 30}


def test_warc(spark, tmp_path):
    rows = [(1, "http://h.example/a", "<p>WARC/1.1\r\n\r\n</p>"), (2, "http://h/b", "<p>WARC/1.1\r\n\r\n</p>"), (3, None, None), (4, "not a\r\nurl", ""), (5, "http://h/c", "é" * 10), (None, "http://h/d", "x"), (1, "http://h.example/a", "<p>WARC/1.1\r\n\r\n</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("response", F.lit(2))
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_captures(pages), path)
    captures = warc.assemble(warc.read_records(spark, path))
    got = [tuple(r) for r in warc.capture_digests(captures).collect()]
    assert sorted((r[0] or 0, r[1], r[3], r[4]) for r in got) == [(0, 1, "response", None), (1, 19, "response", None), (1, 19, "response", None), (2, 19, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 20, "response", None)]
    texts = {r[0]: r[1] for r in captures.select(warc.page_of(F.col("metadata")), F.col("response.payload").cast("string")).collect()}
    assert texts[5] == "é" * 10 and texts[2] is None
    empty = str(tmp_path / "none")
    warc.write_archives(warc.plan_captures(pages.limit(0)), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_warc_keeps_small_payloads_apart(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archives(warc.plan_captures(pages, min_revisit_bytes=3), str(tmp_path / "w"))
    got = warc.capture_digests(warc.assemble(warc.read_records(spark, str(tmp_path / "w")), with_payload=False))
    assert {r["page_id"]: r["record_type"] for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_truncated_archive_ends_at_the_last_whole_record():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse_records(record * 2 + record[:-6]))) == 2 and list(warc.parse_records(b"")) == []


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, None, "c\n"), (2, 0, "assistant", "x"), (2, 1, "assistant", "y"), (3, 0, "system", "s"), (None, None, "user", "n"), (4, 1, "assistant", "late"), (4, None, "user", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    examples = chat.expand(turns)
    assert examples.where("reply is not null").count() == 4
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digest(examples).collect()}
    assert got == {1: (3, 0), 2: (2, 2), 3: (1, 0), None: (1, 0), 4: (2, 4)}
    second = examples.where("conv_id = 2 and example = 1").first()
    assert second["context"].startswith("<s>[INST] assistant\nx [/INST]</s>\n") and second["reply"] == "y"
    assert chat.digest(chat.expand(turns.limit(0))).count() == 0


def test_simhash(odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(odd).collect()}
    assert simhash.simhash_groups(odd).count() == odd.count() and (1, 1) in got and (None, 1) in got and (4, 3) in got and (5, 3) in got
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (4, 5)").count() == 0
    assert kept.where("doc_id is null").count() == 0  # their groups have members with a doc_id


def test_rows_that_share_an_id_are_told_apart(spark):
    one, two, three = ("".join(f" {c}{k}" for k in range(60)) for c in "abc")
    rows = [(3, one, 1), (5, one, 2), (5, two, 3), (None, three, 4), (None, three, 5), (7, None, 6), (8, "", 7), (9, two, 8), (9, two, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one_per_group(docs.withColumnRenamed("_n", "mark")).collect())
    assert kept == [(0, three), (3, one), (5, two), (7, None)]
    same = spark.createDataFrame([(1, one, k) for k in (4, 2, 9)], "doc_id long, text string, mark int")
    assert len({r["mark"] for _ in range(2) for r in simhash.keep_one_per_group(same).collect()}) == 1


def test_packing(odd, none):
    got = packing.pack_documents(odd, queries.tokenizer_path())
    assert got.where("doc_id = 4").first()["length"] == 1 and got.where("doc_id is null").count() == 2
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n > 2048 or n != end").count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(odd, none, keep_first):
    got = repeats.remove_repeats(odd, keep_first=keep_first)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert got.count() == odd.count() and repeats.remove_repeats(none, keep_first=keep_first).count() == 0
    assert by[3] == [(0, 0)] and by[9] == [(7, 0)]
    n, removed = by[8][0]
    assert (n, removed) == (5000, 5000) if not keep_first else removed >= 4800
    assert all(n == removed for n, removed in by[1]) or keep_first


def test_longest_previous_factors():
    rng = random.Random(6)

    def common(a, b, length):
        return next((k for k in range(min(length, len(a), len(b))) if a[k] != b[k]), min(length, len(a), len(b)))

    for turn in range(40):
        length = rng.choice((10, 12, 40))
        raw = bytes(rng.choices(b"ab", k=rng.randint(length + 5, 140))) * (1 + turn % 2)
        array, starts = np.frombuffer(raw, np.uint8), np.arange(len(raw) - length + 1)
        levels = repeats.suffix_ranks(array, length)
        want = [max((common(raw[i:], raw[j:], length) for j in range(i)), default=0) for i in starts.tolist()]
        assert repeats.longest_factors(array, levels, starts, length).tolist() == want
        earlier, later = repeats.factor_masks(array, starts, length)
        assert earlier.tolist() == [x == length for x in want]
        assert later.tolist() == [any(raw[i : i + length] == raw[j : j + length] for j in starts.tolist() if j > i) for i in starts.tolist()]


@pytest.mark.parametrize("bucket", [1, 1000])
def test_repeats_keep_the_first_copy(spark, bucket):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = text(450)
    rows = [(i, text(rng.randint(0, 250)) + passage[rng.randint(0, 60) : rng.randint(250, 450)] + text(rng.randint(0, 250))) for i in range(30)]
    rows += [(40, "x" * 900), (41, rows[3][1])]
    seen, want = set(), {}
    for i, t in rows:  # in the order of ids; the first place of a string keeps it
        covered = set()
        for p in range(len(t) - 199):
            if t[p : p + 200] in seen:
                covered.update(range(p, p + 200))
            seen.add(t[p : p + 200])
        want[i] = len(covered)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict.fromkeys(want, 0)
    for r in repeats.repeated_ranges(docs, keep_first=True, bucket=bucket).collect():
        got[r["doc_id"]] = len({x for s in r["ranges"] for x in range(s["a"], s["b"])})
    assert got == want


def test_equal_rows_share_one_list_of_ranges(spark):
    rng = random.Random(14)
    text = "".join(rng.choices("abcdefghijklmnop ", k=2400))
    for n in (20, 200):
        docs = spark.createDataFrame([(1, text)] * n + [(2, "short")], "doc_id long, text string").repartition(8)
        (row,) = repeats.repeated_ranges(docs).collect()
        assert len(row["ranges"]) < 100
    got = {(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == {(1, 2400), (2, 0)}


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_repeats_of_hot_passages(spark, bucket):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = text(420)
    rows = [(i, text(rng.randint(0, 300)) + passage[: rng.randint(150, 420)] + text(rng.randint(0, 300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {}
    for _, t in rows:
        for p in range(len(t) - 199):
            counts[t[p : p + 200]] = counts.get(t[p : p + 200], 0) + 1
    want = {}
    for i, t in rows:
        covered = set()
        for p in range(len(t) - 199):
            if counts[t[p : p + 200]] > 1:
                covered.update(range(p, p + 200))
        want[i] = len(covered)
    ranges = repeats.repeated_ranges(docs, bucket=bucket).collect()
    got = dict.fromkeys(want, 0)
    for r in ranges:
        got[r["doc_id"]] = len({x for s in r["ranges"] for x in range(s["a"], s["b"])})
    assert got == want


def test_embeddings(spark):
    v = [1.0, 0.5, -0.25]
    rows = [(1, v, 0), (2, v, 0), (3, [2 * x for x in v], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 0.0], 0), (9, [float("nan"), 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 0.5], 0), (12, [-1.0, 0.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0)).withColumn("links", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)} | {i: (0, i, True) for i in range(4, 13)}
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_blocks_of_a_hot_bucket_count_every_pair(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, [1.0 + rng.uniform(-0.2, 0.2), rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)], 0) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    close = lambda a, b: sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) >= 0.93
    want = {i: sum(close(a, b) for j, b, _ in rows if i != j) for i, a, _ in rows}
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(vectors).collect()} == want


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (103, 100), (7, 7)]
    got = dict(shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 103: 100, 105: 100}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_beyond_three_bits_are_one_group(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)]
    near, chain, far = base[:], base[:], base[:]
    near[30], near[80] = "other", "words"
    for k in (30, 80, 100):
        chain[k] = "third"
    for k in range(5, 120, 10):
        far[k] = "distant"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(chain)), (4, " ".join(far))]
    bits = [simhash.fingerprint_of(rows[0][1]) ^ simhash.fingerprint_of(t) for _, t in rows]
    assert min(b.bit_count() for b in bits[1:]) > 3
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert groups[2] == 1 and groups[4] == 4
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, g in groups.items() if i == g}


def test_a_large_bucket_of_near_copies_is_one_group(spark):
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = []
    for i in range(60):
        words = base[:]
        words[rng.randrange(200)] = f"w{i}"
        words[rng.randrange(200)] = f"v{i}"
        rows.append((i, " ".join(words)))
    groups = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in groups.collect()} == {0}


@pytest.mark.parametrize("pages", [300, 3000])
def test_a_pair_among_pages_of_one_template_is_grouped(spark, pages):
    """Pages share three quarters of their words; two of them differ from the template, and each other, by far less."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template = [word() for _ in range(160)]
    rows = [(k, " ".join([*template, *(word() for _ in range(60))])) for k in range(pages)]
    rows += [(pages + k, " ".join([*template, *(word() for _ in range(13))])) for k in range(2)]
    sets = [set(shingles.wide_hashes(*simhash.shingle_hashes(t)).tolist()) for _, t in rows[-3:]]
    assert len(sets[1] & sets[2]) >= 0.8 * len(sets[1] | sets[2]) and len(sets[0] & sets[1]) < 0.75 * len(sets[0] | sets[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = shared.cut(simhash.fingerprints(docs, with_bands=True))
    merged = shingles.merged_roots(docs, prints.select("text_hash", "n", "bands", "parity", F.col("doc_id").alias("root")))
    assert {(r["node"], r["component"]) for r in merged.collect()} == {(pages, pages), (pages + 1, pages)}


def test_parities_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(15)
    for _ in range(200):
        both, one, two = (rng.integers(0, 1 << 63, n, np.uint64) for n in rng.integers(0, 300, 3))
        a, b = np.concatenate([both, one]), np.concatenate([both, two])
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(shingles.parities(a), shingles.parities(b)))
        assert bits <= len(one) + len(two)


def test_rare_shingles_bring_all_similar_texts_together(spark):
    rng = random.Random(14)
    sets = {}
    for k in range(60):
        base = set(range(100 * (k // 10), 100 * (k // 10) + 50))
        sets[k] = {x for x in base if rng.random() > 0.08} | {1000 + 10 * k + j for j in range(rng.randint(0, 6))}
    hot = spark.createDataFrame([(k, len(x), k) for k, x in sets.items()], "text_hash long, n long, root long")
    held = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "text_hash long, shingles array<long>")
    rows = shingles.rare_shingles(hot, held, 0.8).collect()
    buckets = {}
    for r in rows:
        buckets.setdefault(r["key"], set()).add(r["text_hash"])
    met = {(a, b) for x in buckets.values() for a in x for b in x}
    similar = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(similar) > 50 and similar <= met and len(rows) < 0.5 * sum(map(len, sets.values()))


def char_model(words, weight=100):
    counts = {}
    for word in words:
        padded = f"  {word} "
        for k in range(len(padded) - 2):
            counts[padded[k : k + 3]] = counts.get(padded[k : k + 3], 0) + weight
    return toxicity.CharModel(counts)


VOCABULARY = "you are a an the on is to was that with such well he man and stupid idiot moron scum ass clown worthless".split()


def test_every_disguise_is_decoded():
    model = char_model(VOCABULARY)
    boundaries = toxicity.Boundaries(model)
    for text, want in {
        "are a m o r o n": "moron", "a s t u p i d": "stupid", "y o u i d i o t": "idiot", "m o r o n.": "moron", "so " + "a s t u p i d " * 6: "stupid",
        "i#d#i#o#t": "idiot", "m^o^r^o^n": "moron", "s%t%u%p%i%d": "stupid", "@55": "ass", "$(|_|/\\/\\": "scum",
        "mmoorroonn": "moron", "ssttuuppiidd": "stupid", "i" * 50 + "diot": "idiot", "m" + "-" * 60 + "oron": "moron",
        "such a i d i o t": "idiot", "well a m o r o n": "moron", "u r a 1 d 1 0 t": "idiot", "i  d  i  o  t": "idiot", "id iot": "idiot", "that is id iot you": "idiot",
        "iddiot": "idiot", "iidioott": "idiot", "i_d_i_o_t_" * 6: "idiot", "i d i o t " * 8: "idiot", "m0 r0n": "moron", "you_1d10t": "idiot", "w o r t h l e s s": "worthles",
    }.items():
        (tokens,) = toxicity.text_tokens([text], boundaries)
        assert any(w.startswith(want) for t in tokens for w in toxicity.token_words(t, model)), text
    assert toxicity.token_words("moron", model) == ["moron"] and toxicity.restore("", model) == []


def test_viterbi_finds_the_best_of_all_paths():
    model, rng = char_model(VOCABULARY), random.Random(8)

    def best(signs, at, state):
        if at == len(signs):
            return 0.0 if state == "  " else model.logp(state, " ")
        moves = toxicity.steps(signs, at, state, model, True, toxicity.DRAWING.search(signs) is not None)
        return max(cost + best(signs, place, to) for place, to, cost, _ in moves)

    for _ in range(60):
        signs = "".join(rng.choices("idoat10@ -_|()ss", k=rng.randint(1, 8)))
        assert abs(best(signs, 0, "  ") - toxicity._restore(signs, model, True)[0]) < 1e-9, signs


def test_boundaries_join_what_the_whole_lattice_joins():
    model, rng = char_model(VOCABULARY), random.Random(9)
    boundaries = toxicity.Boundaries(model)
    for _ in range(80):
        text = " ".join(rng.choice(("id", "iot", "mo", "ron", "stu", "pid", "you", "are", "clo", "wn", "that")) for _ in range(4))
        whole = toxicity._restore(text, model, True)[1]
        (tokens,) = toxicity.text_tokens([text], boundaries)
        read = {w for t in tokens for w in toxicity.token_words(t, model)}
        first, at = [], text.replace(" ", "")
        for w in whole:  # the words of the best path come first and spell the text
            if not at.startswith(w):
                break
            first.append(w)
            at = at[len(w):]
        assert set(first) <= read, text


def test_long_runs_are_read_to_their_end():
    model = char_model(VOCABULARY)
    boundaries = toxicity.Boundaries(model)
    (tokens,) = toxicity.text_tokens(["y o u a r e " * 2000 + "m o r o n"], boundaries)
    assert any(w.startswith("moron") for t in tokens for w in toxicity.token_words(t, model))


def test_disguised_words_of_held_out_rows_are_found(spark):
    """Nine in ten of the toxic rows that are found as written are found with their words in disguise."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model, boundaries, weights, base = toxicity.fit(docs, labels)
    held = [r["text"] for r in docs.join(labels.where("toxic = 1"), "doc_id").where(toxicity.in_fold()).collect()]
    stems = tuple(k.lstrip("=") for k in weights)
    scorer, rng = toxicity.Scorer(model, boundaries, weights, base), random.Random(1)
    swap = {"i": "1", "o": "0", "a": "@", "e": "3", "s": "$"}
    ways = (
        lambda w: " ".join(w), lambda w: "_".join(w), lambda w: "".join(swap.get(c, c) for c in w), lambda w: "".join(c * 2 for c in w),
        lambda w: w[: len(w) // 2] + "." + w[len(w) // 2 :], lambda w: w[0] + w[1] * 3 + w[2:],
    )
    found = hidden = 0
    for text, (score, _) in zip(held, list(scorer(held))):
        if score >= toxicity.THRESHOLD:
            way = rng.choice(ways)
            words = [way(w.lower()) if w.lower().startswith(stems) else w for w in text.split()]
            hidden += 1
            found += next(scorer([" ".join(words)]))[0] >= toxicity.THRESHOLD
    assert hidden >= 0.85 * len(held) > 50 and found >= 0.9 * hidden


def test_memo_of_recent_keys_asks_again_only_for_old_ones():
    asked = []
    memo = toxicity.Recent(lambda k: asked.append(k) or k * k, 3)
    assert [memo[k] for k in (1, 2, 3, 4, 1, 5)] == [1, 4, 9, 16, 1, 25]
    assert asked == [1, 2, 3, 4, 5] and len(memo) + len(memo.older) <= 6
    assert [memo[k] for k in (6, 7, 2)] == [36, 49, 4] and asked == [1, 2, 3, 4, 5, 6, 7, 2]


def test_worker_keeps_one_thing_only():
    first = shared.kept(("a", 1), list)
    assert shared.kept(("a", 1), list) is first
    shared.kept(("b", 1), list)
    assert shared.kept(("a", 1), list) is not first
    shared.release()
    assert not shared._KEPT


def test_lexicon_is_the_same_from_parts(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdeilnorstu") for _ in range(7))
    rows = [(" ".join([word(), "moron" if k % 2 else "friend", *(word() for _ in range(8))]), k % 2) for k in range(80)]
    sample = spark.createDataFrame(rows, "text string, label int")
    docs = sample.select("text")
    model = toxicity.CharModel({r["gram"]: r["n"] for r in toxicity.trigram_counts(docs).collect()})
    whole = toxicity.learn_lexicon(sample, model)
    monkeypatch.setattr(toxicity, "RECENT", 5)
    assert toxicity.learn_lexicon(sample, model) == whole
    assert whole[0]


def test_links_in_large_mixed_buckets_of_rare_shingles_are_found(spark):
    """Sets of common shingles only; a few are near one other set, and leaders of buckets seldom are among these."""
    rng = random.Random(16)
    parts = [[f"w{p}x{k}" for k in range(40)] for p in range(40)]
    rows = []
    for k in range(240):
        own = rng.sample(parts, 12)
        rows.append((2 * k, sum(own, [])))
        if k % 20 == 0:  # the same parts in another order, so what is rare in one is not in the other
            rows.append((2 * k + 1, sum(rng.sample(own, 12), [])))
    texts = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    held = {i: set(shingles.wide_hashes(*simhash.shingle_hashes(t)).tolist()) for i, t in texts}
    similar = {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])}
    assert len(similar) >= 12
    many = spark.createDataFrame([(7, i, len(x), i, len(held) - 1, 0) for i, x in held.items()], "key long, text_hash long, n long, root long, rest long, major long")
    sets = spark.createDataFrame([(i, sorted(np.array(list(x), np.uint64).view(np.int64).tolist())) for i, x in held.items()], "text_hash long, shingles array<long>")
    want = dict(shared.connected_components(spark.createDataFrame(sorted(similar), "a long, b long")).collect())
    odd = {i: shingles.parities(shingles.wide_hashes(*simhash.shingle_hashes(t))) for i, t in texts}
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    facts = spark.createDataFrame([(i, len(held[i]), [7], odd[i], i) for i in held], "doc_id long, n long, bands array<long>, parity array<long>, root long")
    assert dict(shingles.merged_roots(docs, hashed.join(facts, "doc_id").drop("doc_id")).collect()) == want
    for block in (512, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(shingles, "BLOCK", block)
            links = shingles.linked_in_blocks(many, sets, 0.8)
            assert dict(shared.connected_components(links).collect()) == want


def test_pairs_of_texts_are_joined_by_a_small_method(spark, tmp_path, capsys):
    """Filters on pairs are pushed into the join; a method of 3,600 bytes there took the compiler 0.5 GB in each executor."""
    rng = random.Random(18)
    rows = [(rng.randint(-9, 9), rng.randint(-99, 99), rng.randint(8, 12), rng.randint(0, 20)) for _ in range(300)]
    kind = "key long, text_hash long, n long, root long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "members"))
    members = spark.read.schema(kind).parquet(str(tmp_path / "members"))
    pairs = shingles._sides(members, members, 0.8)
    assert pairs.columns == ["a", "n_a", "root_a", "b", "n_b", "root_b"]
    near = lambda x, y: x[0] == y[0] and x[1] != y[1] and x[3] != y[3] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2])
    want = [sorted([x[1:], y[1:]]) for x in rows for y in rows if near(x, y)]
    assert sorted(map(tuple, pairs.collect())) == sorted((*x, *y) for x, y in want)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no code is made before the run
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        capsys.readouterr()
        shingles._sides(members, members, 0.8).dropDuplicates(["a", "b"]).explain("codegen")
        told = capsys.readouterr().out
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert "SortMergeJoin" in told and 0 < max(sizes) < 1500, sizes


def test_a_pair_of_blocks_takes_a_small_multiple_of_its_shingles():
    """Blocks of few and long sets: what is laid out at once does not grow with what they share."""
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 1 << 62, 1000)) for _ in range(200)]
    sets += [np.append(x[100:], rng.integers(0, 1 << 62, 50)) for x in sets[:150]] + [rng.integers(0, 1 << 62, 1000) for _ in range(50)]
    rows = pa.table({
        "n": [len(x) for x in sets], "first": [k < 200 for k in range(400)], "root": list(range(400)), "shingles": pa.array(sets, pa.list_(pa.int64())),
    })
    tracemalloc.start()
    links = shingles._links_of(rows, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(links["root_a"].to_pylist(), links["root_b"].to_pylist())) == [(200 + k, k) for k in range(150)]
    assert peak < 5 * rows["shingles"].nbytes


def test_only_tokens_whose_outline_holds_an_entry_are_decoded(monkeypatch):
    model = char_model(VOCABULARY)
    weights = {"stup": 2.0, "=ass": 1.0, "moro": 3.0, "mill": 1.5}
    scorer = toxicity.Scorer(model, toxicity.Boundaries(model), weights, -3.0)
    asked = []
    decode = toxicity.token_words
    monkeypatch.setattr(toxicity, "token_words", lambda token, model: asked.append(token) or decode(token, model))
    disguised = ["s.t.u.p.i.d", "sttuupiid", "a$$", "@ss", "m0r0n!", "m o r o n", "m1|l", "m!l1s", "m()ron", "stupid", "as-s", "moron²", "(stu)pid"]
    harmless = ["w0rd", "w.e.l.l", "gooodd", "h e l l o", "x-ray", "2024", "naïve!!", "", "..."]
    for token in [*disguised, *harmless]:
        want = {f for f in toxicity.word_features(decode(token, model)) if f in weights}
        assert set(scorer.entries(token)) == want, token
    assert not set(asked) & set(harmless) and {"s.t.u.p.i.d", "m o r o n", "m()ron"} <= set(asked)


def test_trigrams_are_those_of_each_word(spark):
    texts = ["Naïve, żółw (b) x1 aaa", "", None, "aaa. µm \U0001d518x ab-cd 'ab'"]
    want = {}
    for text in texts:
        for word in (w.strip(toxicity.EDGES) for w in (text or "").lower().split()):
            padded = f"  {''.join(map(toxicity.model_letter, word))} " if word.isalpha() else ""
            for k in range(len(padded) - 2):
                want[padded[k : k + 3]] = want.get(padded[k : k + 3], 0) + 1
    got = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert dict(got.collect()) == want
