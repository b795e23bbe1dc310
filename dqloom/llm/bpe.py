"""BPE encoding and decoding with forced boundaries.

Merges only ever build tokens of the vocabulary. So where two neighbouring bytes of a word
stand side by side inside no token at all, no merge can span them: the word may be cut
there, its fragments encoded independently and their ids concatenated, with the same ids
as for the whole word. Only a word's last fragment carries the end-of-word mark.

Texts are split at ASCII white space, which the tokenizer drops, and the encoding of each
stretch is remembered, in bounded memory per Python worker. Normalisation and the split
into words are the tokenizers library's own. Nothing is shuffled.

The tokenizer file is read by the driver and broadcast; files over `MAX_TOKENIZER_BYTES`
are refused. Special tokens that stand in a text are recognised as the library does.

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows
are encoded each; very long words cost n log n; columns named like results are replaced;
an empty table gives an empty result; a tokenizer that keeps white space, or whose special
tokens strip or normalise, raises an error.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

MAX_TOKENIZER_BYTES = 64 << 20
MEMO_ENTRIES = 200_000
MEMO_KEY_BYTES = 64
BATCH_BYTES = 2 << 20
RESULTS = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file's text."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        spec = json.loads(text)
        model, added = spec["model"], spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special tokens that strip, normalise or match whole words are not supported")
        self.library = Tokenizer.from_str(text)
        # Each look-up of these properties makes a new wrapper, so they are kept.
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        if any(c.isspace() for piece, _ in self._pieces("a b\tc") for c in piece):
            raise ValueError("the tokenizer must drop white space")
        vocabulary = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        def alone(model: BPE) -> Tokenizer:
            out = Tokenizer(model)
            out.pre_tokenizer = WhitespaceSplit()
            return out

        self.last = alone(BPE(vocabulary, merges, end_of_word_suffix=suffix or None))
        self.inner = alone(BPE(vocabulary, merges)) if suffix else self.last
        bodies = [t.removesuffix(suffix) if suffix else t for t in vocabulary]
        self.together = {a + b for t in bodies for a, b in zip(t, t[1:], strict=False)}
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.token = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in added}
        self.plain_join = spec["decoder"] is None
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _pieces(self, text: str) -> list:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return self.pre_tokenizer.pre_tokenize_str(text)

    def fragments(self, word: str) -> list[str]:
        """`word` cut at every forced boundary."""
        if all(map(self.together.__contains__, map(add, word, word[1:]))):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, from their fragments' ids in order."""
        cut = [self.fragments(w) for w in words]
        inner = iter(ids_of(self.inner, [f for fs in cut if len(fs) > 1 for f in fs[:-1]]))
        last = ids_of(self.last, [fs[-1] for fs in cut])
        return {word: end if len(fs) == 1 else b"".join([next(inner) for _ in fs[1:]]) + end
                for word, fs, end in zip(words, cut, last, strict=True)}

    def _one(self, text: str) -> bytes:
        ids = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
            elif part:
                words = [word for word, _ in self._pieces(part)]
                known = self.encode_words(list(set(words)))
                ids += [known[word] for word in words]
        return b"".join(ids)

    def encode_stretches(self, stretches: list[bytes]) -> dict[bytes, bytes]:
        """The ids of many stretches, normalised and split into words in one call.

        Joined by single spaces they stay apart: neither normalisation nor a word reaches
        over a space. Stretches with special tokens or other white space go one by one.
        """
        texts = [s.decode() for s in stretches]
        plain = [t for t in texts if t.split() == [t] and not (self.special_pattern and self.special_pattern.search(t))]
        joined = " ".join(plain)
        if self.normalizer is not None:
            joined = self.normalizer.normalize_str(joined)
        parts, out = joined.split(" "), {}
        if plain and len(parts) == len(plain):
            pieces = self.pre_tokenizer.pre_tokenize_str(joined)
            known = self.encode_words(list({word for word, _ in pieces}))
            ids = [known[word] for word, _ in pieces]
            starts = np.fromiter((start for _, (start, _) in pieces), np.int64, len(pieces))
            limits = np.cumsum([len(p) + 1 for p in parts])
            ends = np.searchsorted(starts, limits).tolist()
            out = {t.encode(): b"".join(ids[a:b]) for t, a, b in zip(plain, [0, *ends], ends, strict=False)}
        return out | {s: self._one(t) for s, t in zip(stretches, texts, strict=True) if s not in out}

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers.

        The memory of stretches has two generations, of up to `MEMO_ENTRIES` and a batch's
        new ones each; what is still met moves from the old one to the new one.
        """
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
        memo, old, split = self.memo, self.old, [t.split() for t in texts]
        new = set().union(*split).difference(memo)
        again = {s: old[s] for s in new if s in old}
        memo |= again
        found = self.encode_stretches(list(new.difference(again)))
        long = {s: found.pop(s) for s in [s for s in found if len(s) > MEMO_KEY_BYTES]}
        memo |= found
        if long:
            return [b"".join([memo[s] if s in memo else long[s] for s in stretches]) for stretches in split]
        return [b"".join(map(memo.__getitem__, stretches)) for stretches in split]

    def decode(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I").tolist()
        if self.plain_join:
            token = self.token
            return " ".join([token[i] for i in numbers])
        return self.library.decode(numbers, skip_special_tokens=False)


def ids_of(tokenizer, words: list[str], code: str = "<u4") -> list[bytes]:
    """The ids of each word. Words of a byte-level alphabet hold no white space."""
    encoding = tokenizer.encode(" ".join(words), add_special_tokens=False)
    ids = np.array(encoding.ids, code)
    raw = ids.tobytes()
    ends = (np.searchsorted(np.array(encoding.word_ids, np.int64), np.arange(1, len(words) + 1)) * ids.itemsize).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_CODERS: dict[str, ForcedBoundaryBpe] = {}


def coder(text: str) -> ForcedBoundaryBpe:
    """One coder per worker and tokenizer."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = ForcedBoundaryBpe(text)
    return _CODERS[key]


def tokenizer_text(path: str) -> str:
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path}: over {MAX_TOKENIZER_BYTES} characters, too large to broadcast")
    return text


def sliced(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about `most` bytes of `column`."""
    sizes, start, total = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)], 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _with_coder(df: DataFrame, tokenizer_path: str, column: str, outputs: tuple[str, ...], work) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    kept = [c for c in df.columns if c not in outputs]
    carried = df.select(*kept, F.col(column).cast("binary").alias("__input"))
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(c, RESULTS[c]) for c in outputs]])
    types = {"ids": pa.binary(), "n_tokens": pa.int64(), "decoded": pa.string()}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        gc.freeze()  # vocabularies needn't be searched for garbage again and again
        for whole in batches:
            for batch in sliced(whole, "__input"):
                rows = work(bpe, [x or b"" for x in batch.column("__input").to_pylist()])
                results = [pa.array([r[i] for r in rows], types[c]) for i, c in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *results], names=[*kept, *outputs])

    return carried.mapInArrow(mapped, schema)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """`df` plus `ids` (binary, little-endian unsigned 32-bit), `n_tokens` and, if asked
    for, `decoded`."""
    def work(bpe: ForcedBoundaryBpe, texts: list[bytes]) -> list[tuple]:
        return [(ids, len(ids) // 4, bpe.decode(ids) if decoded else None) for ids in bpe.encode_all(texts)]

    return _with_coder(df, tokenizer_path, text_col, ("ids", "n_tokens", "decoded")[:3 if decoded else 2], work)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """`df` plus `decoded`, from a column of ids as `encode` makes it."""
    return _with_coder(df, tokenizer_path, ids_col, ("decoded",), lambda bpe, ids: [(bpe.decode(i),) for i in ids])


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(documents, word_tokenizer(), decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
