"""Vector codes, hard negatives and the quality classifier against plain versions."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dqloom.llm import hard_negatives, quality_model, vector_codes
from dqloom.llm.common import met_by_key
from dqloom.llm.text_statistics import NAMES, statistics

SHAPE = "vec_id long, embedding array<float>, label int, code string, error long, id long, score double"


def frame(spark, rows):
    """Rows (id, vector, label) beside columns named like results."""
    return spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], SHAPE)


def vectors(n, dim, seed=5, labels=4):
    random = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = random.normal(size=dim) if i % 3 else np.eye(dim)[i % dim] + random.normal(size=dim) / 9
        out.append((i * 3 % n, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], int(random.integers(labels))))
    return out


ODD = [(None, [0.5] * 16, 1), (3, [0.5] * 16, None), (3, [0.5] * 16, None), (9, None, 1), (10, [], 1), (11, [0.1] * 15 + [None], 1), (12, [0.1] * 15 + [math.nan], 1),
       (13, [math.inf] * 16, 2), (14, [0.5] * 8, 2), (15, [0.0] * 16, 2), (100, [0.25] * 16, 1), (100, [0.25] * 16, 1), (700, [0.25] * 16, 1), (210, [-0.25] * 16, 2)]


def usable(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    numbers = [[math.floor(scale * x) for x in r[1]] for r in kept]
    cut = [[n[p * width:(p + 1) * width] for n in numbers] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(part, book):
        away = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p, book in enumerate(books):
            met = [[] for _ in book]
            for part in cut[p]:
                met[nearest(part, book)[0]].append(part)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(met, book, strict=True)]
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    out = [(r[0], r[2], "".join(f"{f[0]:02x}" for f in fs), sum(f[1] for f in fs)) for r, fs in zip(kept, found, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("rows", [vectors(300, 16) + ODD, vectors(9, 16), ODD, vectors(40, 16)[:1] * 50])
def test_codes_equal_a_plain_version(spark, rows):
    found, books = vector_codes.compress(frame(spark, rows).repartition(5))
    expected, digest = plain_codes(rows)
    got = [(r.id, r.label, r.code.hex(), r.error) for r in found.collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert vector_codes.books_digest(books) == digest


def test_codes_of_small_blocks_nothing_and_wrong_lengths(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    pieces = list(vector_codes._packed(4096, 16, pa.int32())(iter(pa.RecordBatch.from_pydict({
        "id": [r[0] for r in vectors(20, 16)], "label": pa.array([r[2] for r in vectors(20, 16)], pa.int32()),
        "v": [r[1] for r in vectors(20, 16)]}) for _ in range(2))))
    assert [len(p.column("ids")[0]) for p in pieces] == [7, 7, 7, 7, 7, 5]
    found, books = vector_codes.compress(frame(spark, ODD).limit(0))
    assert found.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame(spark, vectors(4, 12)))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(frame(spark, [(1, [1e30] * 8, 1)]))


def test_decoded_vectors_are_near(spark):
    rows = vectors(200, 16)
    found, books = vector_codes.compress(frame(spark, rows))
    was = {r[0]: np.array(r[1]) for r in rows}
    for r in vector_codes.decode(found, books).collect():
        away = (np.array(r.vector) - was[r.id]) * 4096
        assert abs((away ** 2).sum() - r.error) <= 2 * 16 * math.sqrt(r.error + 16)


def test_keys_beyond_the_broadcast_limit_meet_too(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 50}") for i in range(600)], "i int, k string")
    by_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = met_by_key(rows, by_key, "k").collect()
    monkeypatch.setattr("dqloom.llm.common.BROADCAST_KEYS", 3)
    large = met_by_key(rows, by_key, "k").collect()
    assert sorted(small, key=lambda r: r.i) == sorted(large, key=lambda r: r.i) and len(large) == 600


@pytest.mark.parametrize("name", ["op11", "op12"])
def test_registered_queries_equal_their_sql(spark, sf, name):
    module = {"op11": vector_codes, "op12": hard_negatives}[name]
    got = getattr(module, f"{name}_query")(spark, sf)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    wanted = connection.execute(getattr(module, f"{name}_sql")()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and wanted


def plain_negatives(rows):
    kept = [(i, r[0], r[2], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows) if r[2] is not None and r in usable([r])]
    kept = [(i, v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, n) for i, v, label, n in kept]
    out = []
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:5]
    for i, anchor, label, a in kept:
        if anchor is None or anchor % 100:
            continue
        met = [(sum(x * y for x, y in zip(a, n, strict=True)), v, other) for j, v, other, n in kept if i != j and len(n) == len(a)]
        for score, positive, _ in first(m for m in met if m[2] == label):
            fits = first(m for m in met if m[2] != label and 80 * score <= 100 * m[0] <= 100 * score)
            out += [(anchor, positive, k, negative, score, low) for k, (low, negative, _) in enumerate(fits, 1)]
    return out


def mined(df):
    return hard_negatives.mine(df.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")), "vec_id % 100 = 0")


@pytest.mark.parametrize("rows", [vectors(1200, 16) + ODD, ODD, vectors(700, 10, seed=8, labels=2) * 2, [(100 * i, [0.1, 0.2], 1) for i in range(30)]])
def test_negatives_equal_a_plain_version(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SPREAD_ROWS", 300)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, mined(frame(spark, rows)).collect()), key=order) == sorted(plain_negatives(rows), key=order)


def test_negatives_of_nothing_and_of_too_large_components(spark):
    assert mined(frame(spark, ODD).limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        mined(frame(spark, [(i * 100, [1e15] * 4, 1) for i in range(3)])).collect()


def test_bounds_shrink_the_candidates():
    random = np.random.default_rng(4)
    rows = (random.normal(size=(4000, 32)) * 0.75 ** np.arange(32) * 2000).astype(np.int64)
    block = hard_negatives.Block(np.arange(4000), np.arange(4000), np.zeros(4000, int), rows)
    seen = []

    def shrink(scores, least, greatest):
        seen.append(len(scores))
        return scores >= int(np.partition(scores, -5)[-5]) + least - greatest

    alive, scores = block.scan(rows[0], np.arange(4000), shrink)
    best = np.sort(rows @ rows[0])[-5:]
    assert seen[0] == 4000 and seen[-1] < 100 and set(best) <= set(scores.tolist())
    assert (rows[alive] @ rows[0] == scores).all()


TEXTS = [None, "", " \n\t ", "one", "A b\nA b\n\n", "the cat sat on the mat the cat sat", "ÄÖÜ straße 漢字", "x### y$$$ z", "word " * 30_000, "\x00\x01 \x7f", "1 22 333"]


def test_statistics_equal_plain_counts():
    for texts in (TEXTS, TEXTS[1:2], TEXTS[::-1]):
        found = statistics(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
        assert found.shape == (len(texts), len(NAMES)) and np.isfinite(found).all()
        for text, row in zip(texts, found, strict=True):
            row, raw = dict(zip(NAMES, row, strict=True)), (text or "").encode()
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x]
            windows = list(zip(words, words[1:], words[2:], strict=False))
            shares = {
                "share_upper": sum(65 <= b <= 90 for b in raw) / max(1, len(raw)), "share_other": sum(b > 127 for b in raw) / max(1, len(raw)),
                "log_chars": math.log1p(len(text or "")), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / max(1, len(words)),
                "longest_word": math.log1p(max(map(len, words), default=0)), "log_lines": math.log1p(len(lines)),
                "distinct_words": len(set(words)) / max(1, len(words)), "top_word": max([words.count(w) for w in set(words)], default=0) / max(1, len(words)),
                "repeated_windows": sum(windows.count(w) > 1 for w in windows) / max(1, len(windows)) if len(windows) < 999 else 1.0,
                "distinct_lines": len(set(lines)) / max(1, len(lines)), "short_words": sum(len(w) <= 3 for w in words) / max(1, len(words)),
                "odd_ends": sum(w[-1:] in b"#*$%&|<>{}[]=/\\_~^@+`" or w[-1] < 32 or w[-1] == 127 for w in words) / max(1, len(words))}
            for name, value in shares.items():
                assert row[name] == pytest.approx(value), (name, (text or "")[:40])


def test_statistics_do_not_depend_on_the_batch():
    texts = [None if t is None else t.encode() for t in TEXTS]
    together = statistics(pa.array(texts, pa.binary()))
    alone = np.concatenate([statistics(pa.array([b"before", t], pa.binary()).slice(1)) for t in texts])
    assert np.allclose(together, alone)


def test_trees_learn_and_walk_like_plain_trees():
    random = np.random.default_rng(2)
    x = random.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality_model.fit_trees(x, y)
    fresh = random.normal(size=(2000, 5))
    assert (((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0))).mean()) > 0.97
    for row, margin in zip(fresh[:20], model.margin(fresh[:20]), strict=True):
        total = model.base
        for t in range(len(model.split)):
            node = 0
            while node < model.split.shape[1]:
                node = 2 * node + 1 + bool(row[model.split[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.split.shape[1]]
        assert margin == pytest.approx(total)
    assert model.margin(np.zeros((0, 5))).shape == (0,)


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_model.op13_query(spark, "/root/testdata/sf0.01")
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    told = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, told[i]) for i, r in rows.items() if r.held_out and i in told]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    # Held-out labels must not matter.
    turned = labels.withColumn("quality", F.when(quality_model.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all(rows[r.doc_id].score == r.score for r in quality_model.score(docs.select("doc_id", "text"), quality_model.fit(docs, turned)).collect())


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, t, "old", 0.5) for i, t in enumerate(TEXTS * 4)] + [(5, "same id", "o", 0.1)] * 3,
                                 "doc_id long, text string, stats string, score double")
    labels = spark.createDataFrame([(i, i % 2 if i != 7 else None) for i in range(60)] + [(8, 1), (8, 0), (9, 1), (9, 1)], "doc_id long, quality int")
    found = quality_model.training_rows(docs, labels).collect()
    ids = [r.id for r in found]
    assert len(ids) == len(set(ids)) and 7 not in ids and 8 not in ids and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    assert len(quality_model.training_rows(docs, labels, max_train_rows=4).collect()) == 4
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    assert scored.count() == docs.count() and scored.columns == ["doc_id", "stats", "score"] and scored.filter("score is null").count() == 0
    assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), quality_model.fit(docs.limit(0), labels)).count() == 0
