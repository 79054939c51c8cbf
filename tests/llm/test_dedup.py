"""Line dedup, SimHash groups and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewrack.llm import components, lines, passages, simhash

WORDS = [f"w{i}" for i in range(400)]


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


# -- lines ------------------------------------------------------------------------------------------


def expected_lines(rows, threshold=0.8):
    seen, out = [], {}
    place = lambda d: (d is None, d or 0)
    for d, text in sorted(rows, key=lambda r: place(r[0])):
        if text is None:
            out[(d, text)] = None
            continue
        kept = []
        for i, line in enumerate(text.split("\n")):
            words = frozenset(w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w)
            gone = bool(words) and any(
                p < (place(d), i) and len(words & other) / len(words | other) >= threshold for p, other in seen
            )
            if words:
                seen.append(((place(d), i), words))
            if not gone:
                kept.append(line)
        out[(d, text)] = "\n".join(kept)
    return out


def line_rows():
    rng = random.Random(4)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(1, 12)):
            text.append(" ".join(varied(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 5]))))
        rows.append((d * 7, "\n".join(text)))
    # a group of near copies, a blank and an empty text, white space, nulls and a row without an id
    long = [rng.choice(WORDS) for _ in range(40)]
    rows += [(1000 + i, " ".join(varied(rng, long, 2))) for i in range(60)]
    return rows + [(2000, ""), (2001, " \n\t"), (2002, None), (None, rows[0][1]), (2003, "a\tb  c\n\nc b a\r")]


def test_lines_equal_brute_force(spark, documents):
    rows = line_rows()
    random.Random(1).shuffle(rows)
    got = lines.dedup_lines(documents(rows).repartition(5)).collect()
    want = expected_lines(rows)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.text for r in got}
    for (d, _), text in want.items():
        assert by_id[d] == text, d


def test_lines_of_a_group_that_are_not_alike_are_hardly_tried(spark, documents, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(55)]
    # a passage behind long beginnings: no two are alike, all are close to it
    rows = [(i, " ".join([f"x{rng.randrange(3000)}" for _ in range(rng.randint(6, 14))] + varied(rng, passage, 2))) for i in range(600)]
    tried, verified = [], lines._verified

    def counted(docs, candidates, *rest):
        tried.append(candidates.count())
        return verified(docs, candidates, *rest)

    monkeypatch.setattr(lines, "_verified", counted)
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(rows)).collect()}
    assert {(d, got[d]) for d, _ in rows} == {(d, text) for (d, _), text in expected_lines(rows).items()}
    assert sum(tried) < len(rows) / 4, tried


def test_lines_keep_columns_repeated_rows_and_n_chars(spark):
    rows = [(1, "a b c d e\nf", 11, "x"), (1, "a b c d e\nf", 11, "x"), (2, "e d c b a\ng", 11, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, key string")
    got = sorted(lines.dedup_lines(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text, r.n_chars, r.key, r.n_lines, r.n_removed) for r in got] == [
        (1, "a b c d e\nf", 11, "x", 2, 0), (1, "a b c d e\nf", 11, "x", 2, 0), (2, "g", 1, None, 2, 1),
    ]


def test_lines_of_an_empty_table(documents):
    assert lines.dedup_lines(documents([])).count() == 0


def test_lines_run_no_python(spark, documents):
    plan = lines.dedup_lines(documents(line_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))


# -- SimHash ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(codes, radius):
    label = dict.fromkeys(codes)
    for c in codes:
        if label[c] is None:
            label[c], todo = c, [c]
            while todo:
                x = todo.pop()
                for o in codes:
                    if label[o] is None and (x ^ o).bit_count() <= radius:
                        label[o] = c
                        todo.append(o)
    return label


def test_groups_equal_brute_force(documents):
    rng = random.Random(2)
    base = [[rng.choice(WORDS) for _ in range(120)] for _ in range(12)]
    rows = [(5 * i, " ".join(varied(rng, rng.choice(base), rng.choice([0, 1, 2])))) for i in range(150)]
    rows += [(3, None), (4, ""), (7, "one"), (8, "ONE  two x"), (9, "one two x"), (None, rows[0][1]), rows[1]]
    got = simhash.near_duplicates(documents(rows)).collect()
    codes = {r: plain_fingerprint(r[1]) for r in rows}
    label = linked(list(set(codes.values())), 3)
    smallest = {}
    for (d, _), c in codes.items():
        if d is not None:
            smallest[label[c]] = min(d, smallest.get(label[c], d))
    want = sorted((str(r[0]), f"{codes[r]:016x}", smallest[label[codes[r]]]) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.first_of_each(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(smallest.values())


def test_bk_trees_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    forest = simhash.BkForest(codes, np.zeros(len(codes), dtype=int))
    who, node = forest.within(codes, np.zeros(len(codes), dtype=int), 3)
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert set(zip(who.tolist(), node.tolist(), strict=True)) == want


def test_hot_keys_are_split_without_losing_links(spark):
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**14, 900).astype(np.int64) << 3).tolist()
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    labels = components.component_labels(simhash.links(frame, shard_rows=64)).collect()
    got = {r.node: r.label for r in labels}
    want = linked(sorted(codes), 3)
    assert {c: got.get(c, c) for c in codes} == want


def test_components_of_a_long_path(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001)]
    got = components.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_the_pipeline_drops_what_is_alike_by_verified_shingles(spark, documents, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows, pairs = [], []
    for i in range(300):
        base = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(200)]
        near = list(base)
        for at in rng.sample(range(10, 190, 10), rng.choice([2, 4, 4])):
            near[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        pairs.append(simhash.jaccard(*(simhash.shingle_set(t.encode(), 5) for _, t in rows[-2:])))
    rows += [(5000, None), (5001, " "), (None, rows[0][1]), rows[0]]
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), str(tmp_path)).collect()]
    assert len(kept) == len(set(kept)) and {2 * i for i in range(300)} <= set(kept)
    assert 5000 in kept and 5001 not in kept and None not in kept
    alike = [i for i, j in enumerate(pairs) if j >= 0.8]
    assert min(pairs[i] for i in alike) < 0.83 and len(alike) > 250
    assert sum(2 * i + 1 not in kept for i in alike) / len(alike) >= 0.95
    assert all(2 * i + 1 in kept for i, j in enumerate(pairs) if j < 0.8)


def test_alike_rows_of_a_shard_are_connected_without_unverified_links():
    sets = [np.arange(n, n + 100, dtype=np.uint64) for n in (0, 5, 15, 40, 45, 300)]
    left, right = simhash.alike_in_shard(np.zeros(6, np.uint64), sets, simhash.Alike())
    found = {frozenset(p) for p in zip(left.tolist(), right.tolist(), strict=True) if p[0] != p[1]}
    assert found == {frozenset(p) for p in ((0, 1), (1, 2), (3, 4))}


def test_groups_of_an_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


# -- repeated passages ------------------------------------------------------------------------------


def expected_passages(rows, window=50):
    first = {}
    for d, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages_equal_brute_force(documents):
    rng = random.Random(6)
    shared = [[rng.choice(WORDS) for _ in range(n)] for n in (49, 50, 51, 60, 200)]
    rows = []
    for d in range(60):
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared)[rng.choice([0, 0, 3]) :] + [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]
        rows.append((d * 3, " ".join(text)))
    rows += [(500, rows[5][1]), (501, rows[5][1].replace(" ", " \n\t", 9)), (502, None), (503, ""), (504, " \x0b ")]
    rows += [(505, "same " * 120), (506, "same " * 60), rows[7]]
    got = passages.without_repeats(documents(rows).repartition(4), slice_bytes=4096, with_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected_passages(rows)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_passages_of_rows_without_ids_and_of_empty_tables(documents):
    text = " ".join(f"x{i}" for i in range(70))
    got = passages.without_repeats(documents([(None, text), (None, text), (4, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("4", 0), ("None", 70), ("None", 70)]
    assert passages.without_repeats(documents([])).count() == 0


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 1, "k", 2.0), (2, "a b", None, None, None)],
        "doc_id long, text string, doc long, key string, h double",
    )
    assert passages.without_repeats(docs).count() == 2
    assert {r.component_id for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("z"))).collect()} == {1}


@pytest.mark.parametrize("count", [49, 50])
def test_a_passage_counts_from_fifty_words(documents, count):
    text = " ".join(f"y{i}" for i in range(count))
    got = passages.without_repeats(documents([(1, "p " + text), (2, "q " + text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 50 if count == 50 else 0)]
