"""Token ids in files: one shared zstandard dictionary, every document its own frame.

Documents are encoded with the tokenizers library, an end id is appended, and the ids are
serialised as little-endian unsigned integers, of 16 bits where the vocabulary allows.
A zstandard dictionary is trained on the serialised ids of a bounded sample
(`SAMPLE_DOCS` documents of at most `SAMPLE_BYTES` each, by hash of the id); it only
changes sizes, never content. Each document is one compressed frame.

A store is a folder of three Parquet tables that Spark writes and reads, on any file
system it knows:

- `blocks`: rows of up to `BLOCK_BYTES` of frames in ascending document order, with the
  documents' ids, token counts and byte offsets, and the dictionary's hash;
- `index`: per block its range of documents and the tokens before it;
- `dictionary`: the dictionary, its hash, the end id and the width of an id.

`read_documents` opens only blocks whose range holds a wanted document, and decompresses
only that document's slice of them.

Ids are sorted by a range partitioning; a hash breaks ties, so that even one id repeated
in a third of all rows spreads. Encoding runs once, before the shuffle, which then moves
compressed frames. Totals of partitions and blocks give the running token counts.

Defined cases: null and empty texts hold just the end id; null ids sort first; repeated
rows are kept, in an undefined order among themselves; an empty table makes an empty
store; other columns are not stored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import MEMO_KEY_BYTES, sliced, tokenizer_text
from .common import fresh_path, ship, stored, unit_interval

END_ID = 0
SAMPLE_DOCS = 512
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
MEMO_ENTRIES = 500_000
LEVEL = 3
STRETCH = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: ASCII and Latin-1 letters, in UTF-8, after at most one space: one word to the tokenizer.
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: ASCII punctuation; after such a word it is a word of its own to the tokenizer.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What such a word of ASCII letters may start with.
LEADS = b" ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: More than one stretch.
INNER = re.compile(rb"[^ \t-\r][ \t-\r]")
#: White space beyond ASCII, next to which a text must not be cut, in UTF-8.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Kinds of bytes, one bit each: a letter, a digit, a mark, an apostrophe, a space, other
#: ASCII white space, such without white space before it. What is not known has none.
LETTER, DIGIT, MARK, QUOTE, SPACE, BREAK, LONE = (1 << i for i in range(7))
#: The kind of each byte of a text.
KINDS = np.zeros(256, np.uint8)
#: Second bytes, after 0xC3, of Latin-1 letters in UTF-8.
LATIN = np.zeros(256, bool)
#: Whether a byte-level tokenizer's words surely end between a byte of one kind (row) and
#: one of another.
CUT = np.zeros((128, 128), bool)


def _fill_tables() -> None:
    for kind, held in ((LETTER, LEADS[1:]), (DIGIT, b"0123456789"), (MARK, MARKS), (QUOTE, b"'"), (SPACE, b" "), (BREAK, b"\t\n\v\f\r")):
        KINDS[list(held)] = kind
    LATIN[0x80:0xC0] = True
    LATIN[[0x97, 0xB7]] = False
    visible = {0: 0, LETTER: 1, DIGIT: 2, MARK: 3, QUOTE: 3}
    for kind, run in visible.items():
        CUT[kind, [SPACE, BREAK, LONE]] = True
        CUT[LONE, kind] = True
        for after, other in visible.items():
            # An apostrophe and a letter may be one word: 's.
            CUT[kind, after] = 0 < run != other > 0 and (kind, after) != (QUOTE, LETTER)


_fill_tables()


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; both bytes of a Latin-1 letter are letters."""
    out = KINDS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[LATIN[data[at + 1]]]
    out[at] = out[at + 1] = LETTER
    return out


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that can be encoded by themselves, and the last's
    end: at the texts' `bounds`; before white space after visible text; after a single
    byte of white space that is no space; between letters, digits and marks."""
    kind = kinds(data)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    at = np.flatnonzero(kind == BREAK)
    # Of a longer run the last byte goes with what follows, or not, as that may be.
    kind[at[first[at] | (kind[at - 1] & (SPACE | BREAK) == 0)]] = LONE
    first[1:-1] |= CUT.ravel()[kind[:-1].astype(np.uint16) << 7 | kind[1:]]
    return np.flatnonzero(first)


def single(pieces: pa.LargeBinaryArray) -> np.ndarray:
    """Which of the pieces are one word for sure: letters, digits or marks only, after at
    most one space. Only white space stands before a space in a piece."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[:len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[:ends[-1]]
    kind = kinds(data)
    kind[kind == 0] = LONE
    held = np.bitwise_or.reduceat(kind, ends[:-1]) & ~np.uint8(SPACE)
    spaces = np.add.reduceat(data == 0x20, ends[:-1], dtype=np.int64)
    return np.isin(held, [LETTER, DIGIT, MARK, QUOTE, MARK | QUOTE]) & (spaces < 2)


class Encoder:
    """Encodes by stretches that end before white space: no token of a byte-level
    tokenizer starts in visible text and goes on over white space. Stretches beside other
    than ASCII white space aren't cut for sure; their texts are encoded whole. Other texts
    are cut into words by their bytes' kinds, with numpy; `odd` tells which are not."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = "H" if self.library.get_vocab_size(True) <= 1 << 16 else "I"
        special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special and not t.lstrip and not t.rstrip]
        self.mark = special[0] if special else None
        #: Characters for bytes; a line feed is the space that separates words.
        self.alphabet = byte_alphabet().replace(byte_alphabet()[10], " ")
        self.words = None
        splitter = json.loads(text)["pre_tokenizer"] or {}
        if splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]:
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = WhitespaceSplit()
            self.sizes = np.zeros(self.words.get_vocab_size(), np.int64)
            for token, i in self.words.get_vocab().items():
                self.sizes[i] = len(token)
        #: Texts with this are not cut by kinds: white space beyond ASCII, added tokens.
        self.odd = None
        if self.words and not json.loads(text)["normalizer"]:
            added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
            self.odd = "|".join([OTHER_SPACE.pattern, *added])
        self.memo: dict[bytes, bytes | None] = {}
        self.old: dict[bytes, bytes | None] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts without the mark, a special token, are encoded in one
        call, with the mark between them: it ends what stands before it like a text's end."""
        if self.mark is None or any(self.mark in t for t in texts):
            return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if not texts:
            return []
        ids = np.array(self.library.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, self.code)
        ends = np.append(np.flatnonzero(ids == self.library.token_to_id(self.mark)), len(ids)).tolist()
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[a * width:b * width] for a, b in zip([0, *[e + 1 for e in ends]], ends, strict=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters, encoded in one call. A word ends where its bytes do."""
        if not words:
            return []
        joined = codecs.charmap_decode(b"\n".join(words), "strict", self.alphabet)[0]
        ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.code)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w) for w in words])) + 1
        raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
        if self.odd is None:
            return self._by_stretches(texts)
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        odd = pc.match_substring_regex(column, self.odd)
        if not pc.any(odd).as_py():
            return self._by_cuts(column)
        plain = iter(self._by_cuts(column.filter(pc.invert(odd))))
        marks = odd.to_pylist()
        other = iter(self._by_stretches([t for t, m in zip(texts, marks, strict=True) if m]))
        return [next(other) if m else next(plain) for m in marks]

    def _by_cuts(self, column: pa.LargeStringArray) -> list[bytes]:
        """Texts that may be cut by kinds: Arrow counts off the distinct pieces and puts
        their ids together; Python sees each distinct piece once."""
        bounds = np.frombuffer(column.buffers()[1], np.int64)[:len(column) + 1] if len(column) else np.zeros(1, np.int64)
        if not bounds[-1]:
            return [b""] * len(column)
        offsets = cuts(np.frombuffer(column.buffers()[2], np.uint8)[:bounds[-1]], bounds)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), column.buffers()[2]])
        coded = pieces.dictionary_encode()
        # UTF-8 holds no 0xFF, so joined by it pieces reach Python fastest.
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        distinct = pc.binary_join(every, pa.scalar(b"\xff", pa.large_binary()))[0].as_py().split(b"\xff")
        known = list(map(self.memo.get, distinct))
        missing = [i for i, ids in enumerate(known) if ids is None]
        if missing:
            learnt = self._learnt([distinct[i] for i in missing], single(coded.dictionary.take(pa.array(missing))).tolist())
            for i, ids in zip(missing, learnt, strict=True):
                known[i] = ids
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(offsets, bounds)].tolist()
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _learnt(self, pieces: list[bytes], alone: list[bool]) -> list[bytes]:
        """The ids of pieces that are not in the memo; `alone` tells which are one word."""
        ids = list(map(self.old.get, pieces))
        new = [i for i, known in enumerate(ids) if known is None]
        words = [i for i in new if alone[i]]
        for i, found in zip(words, self._words([pieces[i] for i in words]), strict=True):
            ids[i] = found
        if len(words) < len(new):
            rest = [i for i in new if not alone[i]]
            found = self._known([pieces[i] for i in rest])
            for i in rest:
                ids[i] = found[pieces[i]]
        self.memo.update(zip(pieces, ids, strict=True))
        for piece in [p for p in pieces if len(p) > MEMO_KEY_BYTES]:
            del self.memo[piece]
        return ids

    def _by_stretches(self, texts: list[bytes]) -> list[bytes]:
        split = [STRETCH.findall(t) for t in texts]
        known, out = self._known(set().union(*split)), []
        for text, stretches in zip(texts, split, strict=True):
            ids = list(map(known.__getitem__, stretches))
            out.append(self._library([text.decode()])[0] if None in ids else b"".join(ids))
        return out

    def _known(self, wanted: Iterable[bytes]) -> Mapping[bytes, bytes | None]:
        """A dictionary that holds the ids of all `wanted` stretches, or nothing for those
        whose text must be encoded whole. What is short is remembered."""
        new = self._recalled(wanted)
        marked_words, stems, letters, other, several = [], [], [], [], []
        if self.words:
            # A word with punctuation is put together from its two pieces.
            for s in new:
                stem = s.rstrip(MARKS)
                if not (stem[1:].isalpha() and stem[:1] in LEADS or LETTERS.fullmatch(stem)):
                    (several if INNER.search(s) else other).append(s)
                elif len(stem) == len(s):
                    letters.append(s)
                elif len(s) <= MEMO_KEY_BYTES:
                    marked_words.append(s)
                    stems.append(stem)
                else:
                    other.append(s)
            ends = [s[len(w):] for s, w in zip(marked_words, stems, strict=True)]
            letters += self._recalled(stems).difference(letters)
            other += self._recalled(ends).difference(other)
        else:
            other = list(new)
        found = dict(zip(letters, self._words(letters), strict=True))
        texts_of = [s.decode() for s in other]
        marked = [s for s, t in zip(other, texts_of, strict=True) if self.mark and self.mark in t]
        if marked:
            other = [s for s in other if s not in set(marked)]
            texts_of = [s.decode() for s in other]
            found |= dict(zip(marked, self._library([s.decode() for s in marked]), strict=True))
        found |= dict(zip(other, self._library(texts_of), strict=True))
        for stretch, text in zip(other, texts_of, strict=True):
            if OTHER_SPACE.search(text):
                found[stretch] = None
        memo = self.memo
        long = {s: found.pop(s) for s in [s for s in found if len(s) > MEMO_KEY_BYTES]}
        memo |= found
        if marked_words:
            memo |= {s: memo[w] + memo[e] for s, w, e in zip(marked_words, stems, ends, strict=True)}
        if several:
            cut = [STRETCH.findall(s) for s in several]
            parts = self._known(set().union(*cut))
            joined = {s: b"".join([parts[p] for p in c]) for s, c in zip(several, cut, strict=True)}
            memo |= {s: i for s, i in joined.items() if len(s) <= MEMO_KEY_BYTES}
            long |= {s: i for s, i in joined.items() if len(s) > MEMO_KEY_BYTES}
        return ChainMap(long, memo) if long else memo

    def _recalled(self, stretches: Iterable[bytes]) -> set[bytes]:
        """The stretches not yet known; those of the old generation move to the new one."""
        new = {s for s in stretches if s not in self.memo}
        again = [s for s in new if s in self.old]
        self.memo |= {s: self.old[s] for s in again}
        return new.difference(again)


def byte_alphabet() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it
    is visible in Latin-1, else the next character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


_ENCODERS: dict[str, Encoder] = {}


def encoder(text: str) -> Encoder:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(text)
    return _ENCODERS[key]


def train(samples: list[bytes]):
    """A dictionary, or nothing where there is too little to learn from."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16:
        return b""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def sample_texts(df: DataFrame, id_col: str, text_col: str) -> list[bytes]:
    """Texts of the documents with the smallest hashes among those of moderate length.

    Only hashes below a share of the whole are looked at, so that what the tasks send to
    the driver stays at a few times `SAMPLE_DOCS` texts however many tasks there are.
    """
    text = F.col(text_col).cast("binary")
    share = min(1.0, 8 * SAMPLE_DOCS / max(1, df.count()))
    chosen = df.filter(F.octet_length(text) <= SAMPLE_BYTES).select(unit_interval(F.col(id_col).cast("string")).alias("u"), text.alias("t"))
    return [bytes(r.t) for r in chosen.filter(F.col("u") <= share).orderBy("u", "t").limit(SAMPLE_DOCS).collect()]


def write(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write a store of `df`'s documents at `path`."""
    import zstandard

    spark = df.sparkSession
    ship(spark)
    text = tokenizer_text(tokenizer_path)
    coder = encoder(text)
    width, end = array(coder.code).itemsize, array(coder.code, [end_id]).tobytes()
    learnt = train([i + end for i in coder.encode(sample_texts(df, id_col, text_col))])
    key = hashlib.sha256(learnt).hexdigest()
    spec, shared = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(learnt)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value)
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False)
        for whole in batches:
            for batch in sliced(whole, "text", BATCH_BYTES):
                ids = [i + end for i in own.encode([t or b"" for t in batch.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("tie"), pa.array([len(i) // width for i in ids], pa.int32()),
                     pa.array(map(press.compress, ids), pa.binary())], names=["id", "tie", "n", "frame"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
                     F.col(text_col).cast("binary").alias("text"))
    encoded = stored(rows.mapInArrow(frames, "id long, tie long, n int, frame binary"), "frames")
    width_of_shuffle = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, counts, payload, offsets = TaskContext.get().partitionId(), 0, [], [], bytearray(), [0]
        names = ["part", "block", "doc_ids", "counts", "offsets", "payload"]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]

        def row() -> pa.RecordBatch:
            values = [part, number, ids, counts, offsets, bytes(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "frame")), strict=True):
                if ids and len(payload) + len(frame) > BLOCK_BYTES:
                    yield row()
                    number, ids, counts, payload, offsets = number + 1, [], [], bytearray(), [0]
                ids.append(i)
                counts.append(n)
                payload += frame
                offsets.append(len(payload))
        if ids:
            yield row()

    shape = "part int, block int, doc_ids array<long>, counts array<int>, offsets array<long>, payload binary"
    ordered = encoded.repartitionByRange(width_of_shuffle, "id", "tie").sortWithinPartitions("id", "tie")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    ordered.select("id", "n", "frame").mapInArrow(blocks, shape).select(
        "*", F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"), total.alias("n_tokens"),
        F.lit(key).alias("dictionary_sha256")).write.parquet(f"{path}/blocks")
    made = spark.read.parquet(f"{path}/blocks").select("part", "block", "first_doc", "last_doc", "n_tokens")
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", before(F.col("t"), [], "part").alias("ahead"))
    made.join(parts, "part").select("*", (F.col("ahead") + before(F.col("n_tokens"), ["part"], "block")).alias("start")) \
        .drop("ahead").write.parquet(f"{path}/index")
    spark.createDataFrame([(key, bytearray(learnt), end_id, width)], "sha256 string, content binary, end_id int, width int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")


def before(value: Column, within: list[str], order: str) -> Column:
    """The sum of `value` over the rows that lie before."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (tokens before it), n_tokens and ids (binary, little-endian unsigned
    32-bit) of all documents, or of the `wanted` ones."""
    ship(spark)
    learnt = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(learnt.content).hexdigest() != learnt.sha256:
        raise ValueError(f"{path}: the dictionary doesn't fit its hash")
    shared, width = spark.sparkContext.broadcast(bytes(learnt.content)), learnt.width
    only = None if wanted is None else frozenset(wanted)
    blocks, index = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/index")
    if only is not None:
        near = F.lit(False)
        for i in sorted(only):
            near = near | F.lit(i).between(F.col("first_doc"), F.col("last_doc"))
        blocks = blocks.filter(near)
    blocks = blocks.filter(F.col("dictionary_sha256") == learnt.sha256).join(index.select("part", "block", "start"), ["part", "block"]) \
        .select("start", "doc_ids", "counts", "offsets", "payload")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        open_frame = zstandard.ZstdDecompressor(dict_data=known).decompress
        for batch in batches:
            for r in range(batch.num_rows):
                start, ids, counts, offsets, payload = (c[r].as_py() for c in batch.columns)
                starts, found, size = [], [], 0
                for k, (i, n) in enumerate(zip(ids, counts, strict=True)):
                    if only is None or i in only:
                        raw = open_frame(payload[offsets[k]:offsets[k + 1]])
                        wide = raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        starts.append((i, start, n))
                        found.append(wide)
                        size += len(wide)
                    start += n
                    if size > 4 * BLOCK_BYTES:
                        yield _documents(starts, found)
                        starts, found, size = [], [], 0
                if found:
                    yield _documents(starts, found)

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def _documents(starts: list[tuple], found: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([s[i] for s in starts], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_query(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, byte_tokenizer())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
