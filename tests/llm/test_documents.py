"""Archives, packing, mixing, the classifier, pseudo-likelihood and the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import classifier, masked, mixing, packing, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = [f"word{i}" for i in range(300)]


# -- archives ---------------------------------------------------------------------------------------


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    long = "é\r\nWARC/1.1\r\n\r\n" * 60_000
    rows = [
        (1, "http://a/ b", "<p>x</p>", 1), (2, None, "", 2), (3, "u", None, 3), (4, "u", "<p>x</p>", 4),
        (9, "u", long, 5), (5, "u", long, 6), (7, "u", "unique", 7), (None, "u", "no id", 8), (7, "u", "unique", 9),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int").repartition(3)
    archives = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=2_000)
    chunks = warc.read_chunks(archives, chunk_bytes=10_000).collect()
    by_record = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        by_record.setdefault((c.record_id, c.record_type), []).append(c)
    kept = {}
    for i, _, html, _ in rows:
        if i is not None:
            kept[html or ""] = max(i, kept.get(html or "", i))
    want = sorted(
        (str(i), len((h or "").encode()), digest(h), "revisit" if i is not None and kept[h or ""] > i else "response",
         kept[h or ""] if i is not None and kept[h or ""] > i else None)
        for i, _, h, _ in rows
    )
    last = [c for c in chunks if c.is_last]
    assert sorted((str(c.page_id), c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in last) == want
    (big,) = [cs for cs in by_record.values() if cs[0].page_id == 9]
    assert b"".join(bytes(c.chunk) for c in big) == long.encode()
    assert max(len(c.chunk) for c in big) == 10_000
    running = b""
    for c in big:
        assert c.start == len(running)
        running += bytes(c.chunk)
        assert c.sha1_so_far == base64.b32encode(hashlib.sha1(running).digest()).decode()


def test_archives_with_a_least_size_and_of_an_empty_table(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "longer text"), (4, "u", "longer text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = warc.read_chunks(warc.write_archives(pages, str(tmp_path / "w"), least_bytes=6)).collect()
    assert sorted((r.page_id, r.record_type) for r in done) == [
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response"),
    ]
    none = warc.write_archives(pages.where("page_id > 9"), str(tmp_path / "e"))
    assert warc.read_chunks(none).count() == 0


def test_a_damaged_archive_raises():
    record = (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: text/plain\r\n"
        b"WARC-Payload-Digest: sha1:" + digest("hello").encode() + b"\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    )
    read = lambda data: list(warc.record_chunks(warc._Unpacked(io.BytesIO(data), True), 3))
    good = read(gzip.compress(record) + gzip.compress(record))
    assert [bytes(r["chunk"]) for r in good] == [b"hel", b"lo"] * 2
    for broken in (record.replace(b"hello\r\n", b"hallo\r\n"), record[:-6], record.replace(b": 5", b": 4")):
        with pytest.raises(ValueError):
            read(gzip.compress(broken))


# -- packing ----------------------------------------------------------------------------------------


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = []
    for d, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        head = (len(ids) - 1) % capacity + 1
        edges = [0, *range(head, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((str(d), p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert pieces == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(p[3] for p in pieces) // capacity)


def test_packing_keeps_every_piece_in_few_sequences(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "<|endoftext|> \n x  y"), (None, "z"), rows[0], (903, "w " * 500)]
    got = packing.packed(documents(rows).repartition(3), TOKENIZER, capacity=128).collect()
    used, least = check_packing(rows, got, 128)
    assert used <= least + max(1, least // 50)
    many = packing.packed(documents(rows), TOKENIZER, capacity=128, group_items=100).collect()
    used, least = check_packing(rows, many, 128)
    assert used <= least + max(2, least // 20)
    assert packing.packed(documents([]), TOKENIZER).count() == 0


def test_wordwise_encoding_equals_the_whole_text():
    rng = random.Random(1)
    parts = list(" \n\t\r  \x0b\x0c\x1c\x1f\x85 　ab'sé1,.!|中<>|Ġ") + ["'ll", "the", " the", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4_000)]
    texts += [" ".join(rng.choice(WORDS) + rng.choice(["", ",", ".\nThe", "?\n", "'", "é.", "9;", ".\n\nx"]) for _ in range(40)) for _ in range(100)]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    encoder = packing.WordwiseEncoder(TOKENIZER, held_bytes=20_000)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert encoder.bytes < 1_000_000  # one batch beyond the bound


def test_local_search_uses_fewer_bins_than_best_fit():
    rng = np.random.default_rng(4)
    saved = []
    for _ in range(4):
        lengths = rng.integers(300, 701, 5_000)
        fitted = packing.best_fit(lengths, 1024)
        done = packing.local_search([list(b) for b in fitted], lengths, 1024)
        assert sorted(i for b in done for i in b) == list(range(5_000))
        assert max(lengths[b].sum() for b in done) <= 1024
        saved.append(len(fitted) - len(done))
    assert min(saved) >= 0 and sum(saved) > 0


def test_local_search_empties_a_bin():
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])  # 30 in all, three bins of 10
    bins = [[0, 4], [1, 3], [2, 5], [6, 7]]
    done = packing.local_search([list(b) for b in bins], lengths, 10)
    assert len(done) == 3 and sorted(i for b in done for i in b) == list(range(8))
    assert all(lengths[b].sum() <= 10 for b in done)


# -- mixing -----------------------------------------------------------------------------------------


def raked_by_numpy(cells, powers):
    weight = {k: float(v) for k, v in cells.items()}
    total = sum(weight.values())
    weight = {k: v / total for k, v in weight.items()}
    target = []
    for axis, power in enumerate(powers):
        sums = {}
        for k, v in cells.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        raised = {x: float(v) ** power for x, v in sums.items()}
        target.append({x: v / sum(raised.values()) for x, v in raised.items()})
    for _ in range(400):
        for axis in range(3):
            held = {}
            for k, v in weight.items():
                held[k[axis]] = held.get(k[axis], 0) + v
            weight = {k: v * target[axis][k[axis]] / held[k[axis]] for k, v in weight.items()}
    ratio = {k: weight[k] / cells[k] for k in cells}
    return {k: r / max(ratio.values()) for k, r in ratio.items()}


def test_mixing_equals_plain_raking(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        source = "s0" if i % 3 == 0 else rng.choice(["s1", "s2", None])
        text = "| " * 50 if rng.random() < 0.2 else "a b c " * rng.randint(1, 300)
        rows.append((i, text, rng.choice(["en", "en", "de"]), source, 0))
    rows += [(1000, None, "en", "s1", 0), (1001, "", None, "s9", 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability int")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    cells = {}
    for r in got:
        if r.tokens:
            key = (r.source, r.lang, r.topic)
            cells[key] = cells.get(key, 0) + r.tokens
    want = raked_by_numpy(cells, [mixing.POWERS[m] for m in mixing.MARGINS])
    for r in got:
        expected = want[(r.source, r.lang, r.topic)] if r.tokens else 1.0
        assert r.probability == pytest.approx(expected, rel=1e-4)
        assert r.kept or r.probability < 1
    share = sum(r.kept for r in got) / sum(r.probability for r in got)
    assert 0.85 < share < 1.15
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert mixing.mixed(docs.where("doc_id < 0")).count() == 0
    assert mixing.keep_mixed(docs.where("text is null")).count() == 1


def test_a_rare_cell_does_not_shrink_the_corpus(spark, tmp_path):
    from tidewrack.llm import queries

    rows = [(i, "a b c " * 200, "en" if i % 4 else "de", "hot" if i % 5 else "cool", 0) for i in range(3000)]
    rows += [(9000, "one", None, "rare", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_mixed_sources(spark, str(tmp_path)).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(mixing.KEEP * total, rel=1e-6)
    assert sum(r.tokens for r in got if r.kept) > 0.9 * mixing.KEEP * total
    by = {(r.source, r.lang): r.probability for r in got}
    assert by["rare", None] == 1.0 and by["cool", "en"] > by["hot", "en"]
    kept = mixing.keep_mixed(docs, keep=mixing.KEEP)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


# -- classifier -------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(w if good else w + rng.choice(["***", "%%", "!!"]) for w in words), "de", 5))
        labels.append((i, int(good), 0))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "word1 word2", "en", 1)]
    labels += [(None, 1, 0), (3, None, 0), (n + 7, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {
        i for i in range(402) if zlib.crc32(str(i).encode()) % 5 == 0
    }
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 400]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = classifier.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_classifier_does_not_see_held_out_labels(spark):
    docs, labels = labelled(spark, 120)
    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted((str(r.doc_id), r.score) for r in classifier.quality_scores(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_classifier_without_labels_or_documents(spark):
    docs, labels = labelled(spark, 30)
    assert {r.score for r in classifier.quality_scores(docs, labels.where("false")).collect()} < {0.5} | {
        r.score for r in classifier.quality_scores(docs, labels.where("false")).collect()
    }
    assert classifier.quality_scores(docs.where("false"), labels).count() == 0


def test_pairwise_sum_identity():
    settings = classifier.Settings(words=64, rank=3)
    model = classifier.Model(settings, np.zeros((16, classifier.BINS)))
    rng = np.random.default_rng(0)
    model.v, model.w, model.w0 = rng.normal(size=model.v.shape), rng.normal(size=model.w.shape), 0.7
    i, x = np.array([3, 9, 20, 41]), rng.normal(size=4)
    plain = 0.7 + model.w[i] @ x + sum(
        model.v[i[a]] @ model.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4)
    )
    assert model.raw(i, x) == pytest.approx(plain)


# -- pseudo-likelihood ------------------------------------------------------------------------------


def test_probabilities_of_all_codes_sum_to_one():
    network = masked.Network(masked.Settings(width=4))
    rng = np.random.default_rng(1)
    network.load(rng.normal(0, 0.5, network.flat().shape).astype(np.float32))
    gap = [masked.PAD] * 2
    total = 0.0
    for lo in range(0, masked.CODES, 4096):
        streams = np.concatenate([[*gap, 5, 9, c, 7, 8, *gap] for c in range(lo, lo + 4096)]).astype(np.int32)
        total += np.exp(network.log_probabilities(streams, np.arange(4, len(streams), 9))).sum()
    assert total == pytest.approx(1.0, abs=1e-3)


def test_gradients_lower_the_loss_and_both_sides_matter():
    rng = np.random.default_rng(4)
    settings = masked.Settings(width=8, batch=256)
    network = masked.Network(settings)
    left = rng.integers(0, 20, 4000)
    text = np.stack([left, (left * 7 + 3) % 50 + 100, (left * 3) % 20 + 200], axis=1).ravel().astype(np.int32)
    stream, at = masked._stream([text], settings.reach)
    before = network.log_probabilities(stream, at).mean()
    for _ in range(6):
        for a in range(0, len(at), settings.batch):
            network.learn(stream, at[a : a + settings.batch])
    assert network.log_probabilities(stream, at).mean() > before + 6
    middle = at[1::3][:50]
    changed = stream.copy()
    changed[middle + 1] = 150
    assert network.log_probabilities(changed, middle).mean() < network.log_probabilities(stream, middle).mean()


def test_chances_hold_for_logits_far_from_zero():
    network = masked.Network(masked.Settings(width=4))
    network.p["third"] += 300
    network.p["first"][0, 1:] -= 200
    stream = np.array([masked.PAD] * 2 + [0, 1, 33] + [masked.PAD] * 2, np.int32)
    got = network.log_probabilities(stream, np.arange(2, 5))
    assert np.isfinite(got).all() and got[0] > -9 and got[1] < -60
    near = masked.Network(masked.Settings(width=4))
    assert got[0] == pytest.approx(near.log_probabilities(stream, np.arange(2, 3))[0] + np.log(32), abs=0.5)


def test_words_outside_the_vocabulary_are_looked_up_once():
    codes = masked.Codes([b"a"])
    first = codes.of([b"a", b"rare", b"rare"])
    assert first[1] == first[2] >= masked.CODES - masked.SHARED
    assert b"rare" in codes and codes.of([b"rare"])[0] == first[1]
    codes.kept = len(codes)
    codes.of([b"other"])
    assert b"other" not in codes


def test_scores_per_document(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS[:40]) for _ in range(50))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "never-seen " * 3), rows[0], (None, "word1")]
    got = masked.pseudo_likelihood(documents(rows).repartition(3)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert [(r.n_words, r.log_likelihood, r.per_word) for r in (*by[500], *by[501])] == [(0, 0.0, None)] * 2
    assert by[502][0].n_words == 3 and len({r.log_likelihood for r in by[0]}) == 1
    usual = [r.per_word for r in got if r.doc_id is not None and r.doc_id < 200]
    assert max(usual) < 0 and by[502][0].per_word < np.mean(usual)
    assert np.mean(usual) > -np.log(masked.CODES)


def test_words_outside_the_vocabulary_have_their_own_probability(documents):
    own = [f"v{i}" for i in range(masked.CODES - masked.SHARED)]
    rare = [f"r{i}" for i in range(3000)]
    # each word is a text of its own; frequent ones occur five times more, every second rare one once more
    rows = [(i, w) for i, w in enumerate(own + rare)]
    rows += [(100_000 + i, " ".join(own[i::100] * 5)) for i in range(100)]
    rows += [(200_000, " ".join(rare[::2]))]
    got = {r.doc_id: r.log_likelihood for r in masked.pseudo_likelihood(documents(rows)).collect()}
    alone = {w: np.exp(got[i]) for i, w in enumerate(own + rare)}
    assert sum(alone.values()) == pytest.approx(1.0, abs=0.02)
    groups = {}
    for i, w in enumerate(rare):
        groups.setdefault(zlib.crc32(w.encode()) % masked.SHARED, []).append((alone[w], 1 + (i % 2 == 0)))
    for group in groups.values():
        for p, n in group:
            assert p / group[0][0] == pytest.approx(n / group[0][1], rel=1e-5)


def test_models_are_averaged_by_their_words(spark):
    rows = [(p, b, float(w), np.full(4, v, np.float32).tobytes()) for p, w, v in ((0, 1, 1.0), (70, 3, 5.0)) for b in (0, 1)]
    mean = masked._averaged(spark.createDataFrame(rows, masked.TRAINED))
    assert mean.tolist() == [4.0] * 8
    assert masked._averaged(spark.createDataFrame([], masked.TRAINED)) is None


def test_scores_of_an_empty_table(documents):
    assert masked.pseudo_likelihood(documents([])).count() == 0


# -- the pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from tidewrack.llm import lines, simhash

    docs, labels = labelled(spark, 150)
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("en")).alias("lang"), F.lit("s").alias("source"),
                       F.length("text").cast("long").alias("n_chars"))
    copy = docs.where("doc_id in (1, 2, 4)").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copy).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [step.count()]
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, step, str(tmp_path))
        assert after.columns == step.columns
        rows = after.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in step.collect()}
        step = spark.createDataFrame(rows, after.schema)
        counts.append(len(rows))
        seen.append({r.doc_id for r in rows})
    good = {i for i in range(150) if i % 3 > 0}
    assert good <= seen[0] and not {i for i in range(150) if i % 3 == 0} & seen[0]
    # exact copies lose all their lines and go; what they copy stays
    assert {1, 2, 4} <= seen[1] and not {1001, 1002, 1004} & seen[1]
    assert len(seen[2] - {None}) == len({r.component_id for r in simhash.near_duplicates(
        lines.dedup_lines(docs.where(F.col("doc_id").isin(*seen[1])))).collect()})
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]
    assert all(0 < r.length <= 1024 for r in packed)
