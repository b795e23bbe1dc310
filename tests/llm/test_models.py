"""BPE, token store, near-duplicates, line dedup, embeddings and the pipeline against plain versions."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dqloom.llm import bpe, embedding_dedup, line_dedup, mixing, near_dedup, quality_rules, token_store
from dqloom.llm.common import connected_components, fresh_path
from dqloom.llm.hnsw import Graph, levels_of

ODD = [None, "", " ", "  lead", "a b   c", "é café é ﬁ", "<|endoftext|>hi  <|startoftext|> x<|endoftext|>y", "don't I'LL 's '",
       "ΑΣ İstanbul ßẞ", "漢字 かな 123", "\x1ca\x1fb\x85c d　e", "\U0001f468‍\U0001f469 fam", "qzxvjq" * 300,
       "</w> a</w>b", "foo\n bar\t\tbaz \n", "tail   ", "a\xa0 b", "\n\n\nx\r\n y", "a" * 20000, "foo,bar. baz;"]


def frame(spark, texts):
    rows = [(i, t, f"s{i % 3}", "old", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, decoded string, n_tokens int")


def test_bpe_equals_the_library(spark, sf):
    library = Tokenizer.from_file(bpe.word_tokenizer())
    documents = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = ODD + documents + ODD[-2:]
    got = bpe.encode(frame(spark, texts), bpe.word_tokenizer(), decoded=True)
    for r in got.collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids), repr(texts[r.doc_id])[:80]
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(got.withColumnRenamed("decoded", "was"), bpe.word_tokenizer())
    assert again.filter("decoded <> was").count() == 0
    assert bpe.encode(got.limit(0), bpe.word_tokenizer()).count() == 0


def test_forced_boundaries_cut_words():
    coder = bpe.coder(bpe.tokenizer_text(bpe.word_tokenizer()))
    assert len(coder.fragments("qzxvjq")) > 1 and coder.fragments("the") == ["the"] and coder.fragments("x") == ["x"]


def test_token_store_round_trip(spark, sf):
    library = Tokenizer.from_file(token_store.byte_tokenizer())
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD[:1]
    path = fresh_path(spark, "tokens")
    token_store.write(frame(spark, texts), path, token_store.byte_tokenizer(), partitions=5)
    start = 0
    for r in sorted(token_store.read(spark, path).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens) == (start, len(ids)), repr(texts[r.doc_id])[:80]
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    some = token_store.read(spark, path, wanted=[3, 150]).collect()
    assert sorted(r.doc_id for r in some) == [3, 150]
    hashes = {r.sha256 for r in spark.read.parquet(f"{path}/dictionary").collect()}
    assert hashes == {r.dictionary_sha256 for r in spark.read.parquet(f"{path}/blocks").collect()}


def test_token_store_of_nothing_and_of_one_id(spark):
    for texts in ([], ["same"] * 300):
        rows = frame(spark, texts).withColumn("doc_id", F.lit(7).cast("long"))
        path = fresh_path(spark, "tokens")
        token_store.write(rows, path, token_store.byte_tokenizer(), partitions=4)
        got = token_store.read(spark, path).collect()
        assert len(got) == len(texts) and sorted(r.start for r in got) == [sum(r.n_tokens for r in got[:1]) * i for i in range(len(texts))]


def test_token_encoder_sees_distinct_pieces_of_plain_texts_only(monkeypatch):
    coder = token_store.Encoder(bpe.tokenizer_text(token_store.byte_tokenizer()))
    library = Tokenizer.from_file(token_store.byte_tokenizer())

    def check(texts):
        wanted = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert coder.encode([t.encode() for t in texts]) == wanted

    parts = ["a", "The", "\u00e9\u00df", "\u00d7", " ", " ", " ", "  ", "\n", "\n\n", "\t", "!", "...", "'s", "1", "x" * 70, "<|endoftext|>", "\u6f22", "\xa0", "\x1c"]
    draw = np.random.default_rng(7)
    for most in (9, 13, len(parts), len(parts)):
        check(["".join(parts[i] for i in draw.integers(0, most, draw.integers(0, 12))) for _ in range(1500)])
    monkeypatch.setattr(coder, "_by_stretches", None)
    asked = []
    words = coder._words
    monkeypatch.setattr(coder, "_words", lambda new: asked.extend(new) or words(new))
    plain = ["Words here, words there.\nAnd words... again", "", " lead", "tail ", "a  b", "(words) \u00e9t\u00e9\u00b0 they're 12%"] * 40
    check(plain)
    check(plain)
    assert len(asked) == len(set(asked)) and b" words" in asked


def test_token_encoder_cuts_words_from_marks_digits_and_line_feeds(monkeypatch):
    coder = token_store.Encoder(bpe.tokenizer_text(token_store.byte_tokenizer()))
    library = Tokenizer.from_file(token_store.byte_tokenizer())

    def check(texts):
        wanted = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert coder.encode([t.encode() for t in texts]) == wanted

    parts = ["a", "S", "t", "ve", "\u00e9", "\u00ff", "1", "42", "\u00b2", "\u00d7", "\u00f7", "\u00aa", "\u0301", "\u03b1", "\u0663", "\u6f22",
             "\u180e", "\u200b", "\ufeff", "\U0001f468", "\x00", "\x7f", "'", "'", "''", ".", "_", "-", " ", " ", " ", "  ", "\n", "\n", "\r\n", "\t"]
    draw = np.random.default_rng(11)
    for _ in range(4):
        check(["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 14))) for _ in range(3000)])

    coder.memo.clear()
    monkeypatch.setattr(coder, "_by_stretches", None)
    words, ends = [f"{a}{b}ing" for a in "abcdefgh" for b in "klmno"], [a + b for a in ".,!?)" for b in ("", "'", '"', "\nAnd", "7")]
    check([f"So {w}{e}  is {w}" for w in words for e in ends])
    assert len(coder.memo) < len(words) + 2 * len(ends)


def shingled(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def plain_components(sets, num, den):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, met = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x):
                met[(ids[y], ids[x])] += 1
    for (x, y), m in met.items():
        if den * m >= num * (len(sets[x]) + len(sets[y]) - m):
            a, b = top(x), top(y)
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def copies(count, base_words=150, seed=3):
    """Near copies of one text with growing numbers of changed words, some shared."""
    random = np.random.default_rng(seed)
    base = [f"w{random.integers(400)}" for _ in range(base_words)]
    out = []
    for i in range(count):
        words = list(base)
        for place in random.choice(base_words, random.integers(0, 9), replace=False):
            words[place] = f"x{random.integers(12)}" if i % 2 else f"u{i}_{place}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, sf, k, num):
    texts = ODD + copies(160) + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD[:4]
    got = near_dedup.near_duplicates(frame(spark, texts), words_each=k, reach=(num, 100)).collect()
    sets = {i: shingled(t, k) for i, t in enumerate(texts)}
    expected = plain_components(sets, num, 100)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), expected[i], expected[i] == i) for i, s in sets.items()}


def test_near_duplicates_odd_ids(spark):
    a, b = "one two three four five six seven eight nine", "p q r s t u v w x"
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (None, a), (5, a), (8, None), (8, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows, words_each=3, reach=(85, 100)).collect())
    assert got == Counter({(5, 5, True): 3, (7, 5, False): 1, (9, 5, False): 1, (None, None, True): 1, (8, 8, True): 2})
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    random = np.random.default_rng(1)
    pool = near_dedup.mix(random.integers(0, 1 << 62, 900).astype(np.uint64))
    sets = [np.unique(pool[:1]), np.unique(pool[:800]), np.unique(pool[100:900])]
    sketch = near_dedup.sketches(sets)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[1] == sketch[2]).mean() - 700 / 900) < 0.15
    rows = near_dedup.band_rows(0.85)
    assert (1 - 0.85**rows) ** (120 // rows) <= 1e-6 and comb(rows, 1) > 1


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows, min_sites):
    spread = defaultdict(set)
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for text, site in rows:
        for line in (text or "").split("\n"):
            if bare(line):
                spread[bare(line)].add(site)
    bad = {line for line, sites in spread.items() if len(sites) >= min_sites}
    return [None if text is None else "\n".join(x for x in text.split("\n") if bare(x) not in bad) for text, _ in rows]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_line_dedup(spark, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", bound)
    sites = [None, *[f"site{i}" for i in range(14)]]
    rows = [(f"own {i}\n shared by {i % 15 // 5} \n\nnine {i % 9 if s else ''}\nall", s) for i, s in enumerate(sites * 2)]
    rows += [(None, "site1"), ("", "site2"), ("all", None), ("ten", "x")] + [("ten\nkeep", f"site{i}") for i in range(9)]
    df = spark.createDataFrame([(i, t, s, "z", 3) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, h string, n_lines int")
    for limit in (5, 10, 15):
        got = line_dedup.dedup_lines(df, min_sites=limit).orderBy("doc_id").collect()
        expected = plain_lines(rows, limit)
        assert [r.text for r in got] == expected
        filled = lambda t: sum(x.strip() != "" for x in (t or "").split("\n"))
        assert [(r.n_lines, r.n_removed) for r in got] == [(filled(t), filled(t) - filled(e)) for (t, _), e in zip(rows, expected, strict=True)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_one_filled_copy_leaves_near_dedup(spark, sf, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", bound)
    copied = "\n".join(" ".join(f"c{i}x{j}" for j in range(20)) for i in range(6))
    rows = [(i, copied, "en", f"s{i}", len(copied)) for i in range(12)]
    own = [" ".join(f"o{i}y{j}" for j in range(40)) for i in range(12)]
    rows += [(100 + i, f"{t}\nshared footer", "en", f"s{i}", 0) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.near(spark, corpus_pipeline.lines(spark, docs, sf), sf).collect()}
    assert kept == {0: copied} | {100 + i: t for i, t in enumerate(own)}


def test_embeddings_equal_brute_force(spark):
    random = np.random.default_rng(5)
    centres = random.standard_normal((40, 24))
    vectors = [(c + random.standard_normal(24) * s).tolist() for c in centres for s in (0.0, 0.1, 0.3, 0.45) for _ in range(20)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], vectors[0], vectors[0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors + odd)] + [(None, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    units = np.array([v for v in vectors] + [vectors[0]] * 2)
    ids = np.array([*range(len(vectors)), len(vectors) + 7, len(vectors) + 8])
    units /= np.linalg.norm(units, axis=1)[:, None]
    links = units @ units.T >= 0.9
    parent = np.arange(len(ids))
    embedding_dedup.unite(parent, *np.nonzero(links))
    component = ids[embedding_dedup.roots(parent, np.arange(len(ids)))]
    found = sum(got[i].n_links for i in ids.tolist())
    assert found >= 0.99 * (links.sum() - len(ids)) and all(got[i].n_links <= n - 1 for i, n in zip(ids.tolist(), links.sum(1), strict=True))
    assert [got[i].component_id for i in ids.tolist()] == component.tolist()
    base = len(vectors)
    assert [(got[base + k].n_links, got[base + k].component_id, got[base + k].kept) for k in range(5)] == [(0, base + k, True) for k in range(5)]
    assert (got[base + 6].n_links, got[base + 6].component_id) == (1, base + 5)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


class LosesSmallGroups:
    """A graph whose narrow beams only reach the large group (nodes below `large`)."""

    def __init__(self, vectors, large, needed):
        self.vectors, self.large, self.needed = vectors.astype(np.float32), large, needed

    def search(self, queries, beam, layer=0):
        sims = queries @ self.vectors.T
        if beam < self.needed:
            sims[:, self.large:] = -1
        ids = np.argsort(-sims, axis=1)[:, :beam].astype(np.int32)
        return ids, np.take_along_axis(sims, ids, 1)


@pytest.mark.parametrize("large", [700, 1980])
def test_audit_notices_small_groups_beside_a_large_one(large):
    random = np.random.default_rng(11)
    centre = random.standard_normal(32)
    vectors = random.standard_normal((2000, 32))
    vectors[:large] = centre + 0.02 * vectors[:large]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    assert embedding_dedup.audited_beam(LosesSmallGroups(vectors, large, 0), vectors, 0.9) == embedding_dedup.FIRST_BEAM
    assert embedding_dedup.audited_beam(LosesSmallGroups(vectors, large, 64), vectors, 0.9) == 64


def test_graph_finds_what_it_holds():
    random = np.random.default_rng(2)
    vectors = random.standard_normal((3000, 32)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    levels = np.sort(levels_of(random.random(3000)))[::-1]
    graph = Graph(vectors, levels)
    ids, _ = graph.search(vectors[:600], 24)
    assert np.mean([i in row for i, row in enumerate(ids)]) >= 0.99


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mixing", "bpe encoding"]
    first = corpus_pipeline.quality(spark, docs, sf)
    judged = {r.doc_id for r in quality_rules.op4_query(spark, sf).filter("kept").collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(judged) and first.columns == docs.columns
    second = corpus_pipeline.lines(spark, first, sf)
    before = [(r.text, r.source) for r in first.orderBy("doc_id").collect()]
    rows = second.orderBy("doc_id").collect()
    assert [r.text for r in rows] == plain_lines(before, line_dedup.MIN_SITES) and all(r.n_chars == len(r.text) for r in rows)
    third = corpus_pipeline.near(spark, second, sf)
    component = plain_components({r.doc_id: shingled(r.text, 5) for r in rows}, 80, 100)
    kept = third.collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, c in component.items() if i == c)
    fourth = corpus_pipeline.mix(spark, third, sf).collect()
    copies_of = Counter(r.doc_id for r in fourth)
    assert set(copies_of) <= {r.doc_id for r in kept} and max(copies_of.values()) <= 3 and list(fourth[0].asDict()) == docs.columns
    total = sum(len((r.text or "").split()) for r in kept)
    assert abs(sum(len(r.text.split()) for r in fourth) - total) <= 0.2 * total
    last = corpus_pipeline.run(spark, sf)
    library = Tokenizer.from_file(bpe.word_tokenizer())
    texts = {r.doc_id: r.text for r in kept}
    got = Counter((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in last.collect())
    assert got == Counter({(i, hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()): n for i, n in copies_of.items()
                           for e in [library.encode(texts[i], add_special_tokens=False).ids]})
    assert mixing.MAX_COPIES == 3


def test_pipeline_stages_of_odd_rows(spark, sf):
    rows = [(None, "a b", None, None, 3), (1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.quality(spark, docs, sf).count() == 0
    assert corpus_pipeline.lines(spark, docs, sf).count() == 4
    assert Counter(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == Counter([None, 1, 2])
    assert corpus_pipeline.mix(spark, docs, sf).filter("doc_id is null").count() <= 3
    assert corpus_pipeline.encode(spark, docs, sf).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
