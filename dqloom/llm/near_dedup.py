"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch. A document's set holds its distinct shingles. In round i every shingle is thrown
into one of `coordinates` bins by that round's hash, and a bin that is still empty keeps
its smallest value; from round `coordinates` on, round i fills bin i - coordinates with
all shingles, so no bin stays empty. Large sets are done in a round or two. The share of
equal coordinates estimates the Jaccard similarity with Chernoff-type concentration.

Banding. Coordinates are grouped into bands, as long as a pair at the threshold is missed
by all bands with a probability of at most `miss`. Documents that share a band's key are
candidates.

Verification. Equal sets are one class with one representative. Within a key no pairs are
made at first: members are compared with the key's smallest member. Components follow. Where a key still holds several, its
documents are compared across components if exact bounds allow a link at all: sizes must
be close; a shingle that no other candidate has can't be shared, which caps the
intersection; and the rarest shingles of both sets, as many as a link may leave out and one
more, must share enough. Links are confirmed on full sets. So no link between
different components goes untested.

Sets are compared by 64-bit hashes of shingles. Words are split at ASCII white space and
lower-cased A-Z. Texts are read once for sketches; the candidates' are read again.

Defined cases: null and empty texts have an empty set and link with nothing; texts with
fewer words than a shingle form one shingle; null ids link with nothing, get a null
component and are kept; rows with equal ids are one document, with links of all its texts;
columns besides id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import sliced
from .common import connected_components, ship, stored

COORDINATES = 120
MISS = 1e-6
BROADCAST_IDS = 2_000_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def seed(number: int) -> np.uint64:
    return mix(np.array([number + 1], np.uint64) * _BASE)[0]


def band_rows(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The longest bands that miss a pair at the threshold with probability <= `miss`."""
    fitting = [r for r in range(1, 17) if (1 - threshold**r) ** (coordinates // r) <= miss]
    return max(fitting, default=1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the number of words per text.

    A word's hash is a difference of prefix sums of byte values times powers, brought to
    a common power, so the whole batch takes a few vector operations.
    """
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    powers = np.cumprod(np.full(len(data) + 1, 0xD1342543DE82EF95, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[data] * powers[1:])])
    inverse = np.cumprod(np.full(len(data) + 1, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64))
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _BASE)
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, np.concatenate([[0], limits])))


def shingle_sets(texts: list[bytes], words_each: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    rolled = np.full(max(0, len(words) - words_each + 1), words_each, np.uint64)
    for k in range(words_each):
        rolled = mix(rolled * _BASE + words[k:k + len(rolled)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words_each:
            out.append(np.unique(rolled[at:at + n - words_each + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for w in words[at:at + n]:
                whole = mix(whole * _BASE + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of `coordinates` values per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    bins = np.full(len(sets) * coordinates, _MAX)
    if not len(sets):
        return bins.reshape(0, coordinates)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * coordinates):
        thrown = mix(elements ^ seed(i))
        if i < coordinates:
            place = ((thrown >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)
        else:
            place = np.full(len(thrown), i - coordinates, np.uint64)
        place = owner * coordinates + place.astype(np.int64)
        value = np.minimum(mix(thrown ^ _BASE), _MAX - np.uint64(1))
        if i:
            free = bins[place] == _MAX
            place, value = place[free], value[free]
            new = np.full(len(bins), _MAX) if len(place) else None
            if new is not None:
                np.minimum.at(new, place, value)
                bins = np.minimum(bins, new)
        else:
            np.minimum.at(bins, place, value)
        open_sets = (bins.reshape(len(sets), coordinates) == _MAX).any(axis=1)
        if not open_sets.any():
            break
        still = open_sets[owner]
        elements, owner = elements[still], owner[still]
    return bins.reshape(len(sets), coordinates)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    bands = sketch.shape[1] // rows
    keys = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), seed(1_000 + b))
        for c in range(rows):
            key = mix(key * _BASE + sketch[:, b * rows + c])
        keys[:, b] = key
    return keys


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    return (int(mix(s ^ seed(2_001)).sum(dtype=np.uint64).view(np.int64)), int(mix(s * _BASE + seed(2_002)).sum(dtype=np.uint64).view(np.int64)))


SIGNATURE = "id long, n long, lo long, hi long, keys array<long>"
SETS = "id long, n long, lo long, hi long, shingles array<long>"


def _mapped(df: DataFrame, words_each: int, threshold: float, keys: bool) -> DataFrame:
    ship(df.sparkSession)
    rows = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], words_each)
                sums = [digest(s) for s in sets]
                lists: list = sets
                if keys:
                    # A set of n can only resemble another one if n / (n + 1) reaches the threshold.
                    lists = [s[:0] for s in sets]
                    linking = [i for i, s in enumerate(sets) if len(s) and len(s) / (len(s) + 1) >= threshold]
                    for i, k in zip(linking, band_keys(sketches([sets[i] for i in linking]), rows), strict=True):
                        lists[i] = k
                flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in sums], pa.int64()),
                     pa.array([b for _, b in sums], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["id", "n", "lo", "hi", "keys" if keys else "shingles"])

    return df.mapInArrow(run, SIGNATURE if keys else SETS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5,
                    reach: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id, kept.

    Documents are linked where reach[1] * intersection >= reach[0] * union.
    """
    num, den = reach
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = stored(_mapped(texts, words_each, num / den, keys=True), "signatures")
    named = signed.filter("n > 0 and id is not null")
    classes = stored(named.groupBy("n", "lo", "hi").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys")), "classes")
    members = named.select("id", "n", "lo", "hi").join(classes.select("n", "lo", "hi", "rep"), ["n", "lo", "hi"]).select("id", "rep")
    per_id = named.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", "lo", "hi")).alias("a"), F.max(F.struct("n", "lo", "hi")).alias("b"))
    repeated = stored(per_id.filter("c > 1").select("id", (F.col("a") != F.col("b")).alias("mixed")), "repeated")
    bridges = members.join(repeated.filter("mixed").select("id"), "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last")
    candidates = stored(banded.join(shared.select("key", "first"), "key"), "candidates")
    wanted = stored(candidates.select(F.col("rep").alias("id")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    sets = _mapped(texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), words_each, num / den, keys=False)
    if not repeated.isEmpty():
        sets = sets.dropDuplicates(["id", "n", "lo", "hi"])
    sets = stored(sets.select("id", "n", "lo", "shingles"), "sets")

    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")) \
        .filter("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    sizes = sets.groupBy("id").agg(F.max("n").alias("n"))
    sizes = sizes.join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    # Ids with several texts have no bounds: any of their sets may link.
    mixed = repeated.filter("mixed").select("id", F.lit(True).alias("mixed"))
    sizes = stored(sizes.join(mixed, "id", "left").select("id", "n", "common", F.coalesce("mixed", F.lit(False)).alias("free")), "sizes")

    def possible(a: str, b: str) -> Column:
        n1, n2, c1, c2 = (F.col(f"{x}.{y}") for x, y in ((a, "n"), (b, "n"), (a, "common"), (b, "common")))
        close = den * F.least(n1, n2) >= num * F.greatest(n1, n2)
        return F.col(f"{a}.free") | F.col(f"{b}.free") | (close & (F.least(c1, c2) * (den + num) >= num * (n1 + n2)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are as similar as asked."""
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("shingles").alias("s1"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
        met = pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select(
            "a", "b", "n1", "n2", F.size(F.array_intersect("s1", "s2")).alias("met"))
        return met.filter(f"{den} * met >= {num} * (n1 + n2 - met)").select("a", "b").distinct()

    sized = candidates.alias("k").join(sizes.alias("s"), F.col("k.rep") == F.col("s.id")).select("k.*", F.col("s.n"), "s.common", "s.free")
    sized = stored(sized.filter(f"free or {den} * common >= {num} * n"), "sized")
    stars = sized.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"), "n", "common", "free").distinct().alias("y") \
        .join(sizes.alias("x"), F.col("y.a") == F.col("x.id")).filter(possible("x", "y")).select("a", "b")
    linked = stored(confirmed(stars).unionByName(bridges), "linked")
    found = stored(connected_components(linked), "components")

    # Keys that still hold several components: documents with a possible partner there, one
    # outside the key's largest component on either side, are looked at more closely.
    placed = sized.alias("k").join(found.alias("c"), F.col("k.rep") == F.col("c.node"), "left").select(
        "key", "rep", "n", "common", "free", F.coalesce("c.component", "rep").alias("comp"))
    held = stored(placed.join(_largest(placed), "key"), "held")
    beside = held.filter("comp <> main")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & possible("x", "y")
    described = [F.col(f"x.{c}") for c in ("rep", "comp", "n", "common", "free")]
    open_docs = stored(beside.alias("x").join(held.alias("y"), apart, "left_semi").select(*described).unionByName(
        held.alias("x").join(beside.alias("y"), apart, "left_semi").select(*described)).distinct(), "open")
    # Their rarest shingles decide which of them can be linked at all. A set's prefix, its
    # n - ceil(n * num / den) + 1 rarest shingles in one order for all, meets the prefix of
    # every set that is similar enough.
    spelled = sets.join(open_docs.select(F.col("rep").alias("id")), "id").select("id", "lo", F.explode("shingles").alias("s"))
    rarity = spelled.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    length = F.expr(f"size(shingles) - (size(shingles) * {num} + {den - 1}) div {den} + 1").cast("int")
    prefixes = spelled.join(rarity, "s").groupBy("id", "lo").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("shingles")).select(
        F.col("id").alias("rep"), F.size("shingles").alias("m"),
        F.transform(F.slice("shingles", F.lit(1), length), lambda x: x["s"]).alias("prefix"))
    rest = stored(open_docs.join(prefixes, "rep").select("*", F.explode("prefix").alias("key")), "prefixes")
    rest = stored(rest.join(_largest(rest), "key"), "rest")
    # Beyond what the prefixes share, sets share at most what the longer rest of them holds.
    both = F.array_intersect("x.prefix", "y.prefix")
    more = F.greatest(F.col("x.m") - F.size("x.prefix"), F.col("y.m") - F.size("y.prefix"))
    enough = (F.size(both) + more) * (den + num) >= num * (F.col("x.m") + F.col("y.m"))
    # A pair is made under the first shingle its prefixes share, and only there.
    across = rest.filter("comp <> main").alias("x").join(rest.alias("y"), apart & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & enough & (F.get(both, F.lit(0)) == F.col("x.key")))
    pairs = across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    late = confirmed(pairs)
    known = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = stored(connected_components(known.unionByName(late)), "components")

    by_class = classes.select("n", "lo", "hi", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select("n", "lo", "hi", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "lo", "hi").join(by_class, ["n", "lo", "hi"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))


def _largest(placed: DataFrame) -> DataFrame:
    """Per key with several components the one with most rows (key, main)."""
    return placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("key", "main")


def op2_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(documents, words_each=3, reach=(85, 100))
