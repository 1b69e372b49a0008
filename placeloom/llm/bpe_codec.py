"""Token ids of texts and texts of token ids, each as one narrow job without a shuffle.

Texts are cut at spaces and line feeds; a worker keeps the ids of the chunks it has met
and encodes those that are new to it together (``bpe_pairs``). Normalisation and the
cutting into words are the tokenizer file's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placeloom.llm.bpe_pairs import pairs_of, tokenizer_of

# Chunks whose ids a worker keeps; with so many more, those not met since are forgotten.
_REMEMBERED = 200_000
# Text bytes that are encoded together, and bytes of a batch that a task hands on.
_TOGETHER = 1 << 20
_BLANK = re.compile(r"\s")
_OTHER_BLANK = re.compile(r"[^\S ]")


class Codec:
    """Encodes as the tokenizers library does with the file at ``path``."""

    def __init__(self, path: str):
        self.pairs, self.tokenizer = pairs_of(path), tokenizer_of(path)
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or _BLANK.search(t["content"]) for t in added):
            raise ValueError("added tokens that look beyond their own string are not supported")
        if self.tokenizer.pre_tokenizer.pre_tokenize_str("a b \n c") != [("a", (0, 1)), ("b", (2, 3)), ("c", (6, 7))]:
            raise ValueError("only a pre-tokenizer that leaves out white space is supported")
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """The words of all chunks, as byte-level letters, and how many each chunk has."""
        normalizer, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer.pre_tokenize_str
        joined = " ".join(chunks)
        if normalizer is not None:
            joined = normalizer.normalize_str(joined)
        if len(chunks) == 1:
            pieces = [piece for piece, _ in cut(joined)]
            return pieces, [len(pieces)]
        letters = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        gaps = np.flatnonzero(letters == ord(" "))
        if len(gaps) != len(chunks) - 1 or _OTHER_BLANK.search(joined):
            # Some chunk holds white space of another kind.
            apart = [self._pieces([c])[0] for c in chunks]
            return [p for pieces in apart for p in pieces], [len(pieces) for pieces in apart]
        found = cut(joined)
        starts = np.fromiter((place[0] for _, place in found), np.int64, len(found))
        counts = np.bincount(np.searchsorted(gaps, starts), minlength=len(chunks))
        return [piece for piece, _ in found], counts.tolist()

    def _plain_ids(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of texts that hold no special string."""
        found = {"": b""}
        texts = [t for t in texts if t]
        if texts:
            pieces, counts = self._pieces(texts)
            distinct = list(dict.fromkeys(pieces))
            ids = dict(zip(distinct, self.pairs.encode(distinct)))
            flat, at = [ids[p] for p in pieces], 0
            for text, n in zip(texts, counts):
                found[text] = flat[at] if n == 1 else b"".join(flat[at : at + n])
                at += n
        return found

    def _learn(self, wanted: set[str]) -> None:
        """Make sure that ``known`` holds the ids of all wanted chunks."""
        if len(self.known) + len(wanted) > _REMEMBERED:
            self.older, self.known = self.known, {}
        new = []
        for chunk in wanted.difference(self.known):
            found = self.older.get(chunk)
            if found is None:
                new.append(chunk)
            else:
                self.known[chunk] = found
        if self.special_at is None or not self.special_at.search(" ".join(new)):
            self.known.update(self._plain_ids(new))
            return
        cut = [self.special_at.split(c) for c in new]
        plain = self._plain_ids(list({p for parts in cut for p in parts[::2]}))
        for chunk, parts in zip(new, cut):
            self.known[chunk] = b"".join([self.special[p] if k % 2 else plain[p] for k, p in enumerate(parts)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, low ones first."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        wanted = {c for chunks in cut for c in chunks}
        if not self.known.keys() >= wanted:
            self._learn(wanted)
        known = self.known
        return [b"".join([known[c] for c in chunks]) for chunks in cut]


class Decoder:
    """The tokens of ids joined by a space, as the library does where the file names no decoder."""

    def __init__(self, path: str):
        tokenizer = tokenizer_of(path)
        if tokenizer.decoder is not None:
            raise ValueError("only a tokenizer without a decoder is supported")
        names = {number: token for token, number in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = np.array([names.get(k, "") for k in range(max(names) + 1)], object)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < len(self.names)]
        return " ".join([name for name in self.names[numbers].tolist() if name])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes add up to at most ``_TOGETHER``, one row at least."""
    start, filled = 0, 0
    for at, size in enumerate(sizes):
        if at > start and filled + size > _TOGETHER:
            yield start, at
            start, filled = at, 0
        filled += size
    if start < len(sizes):
        yield start, len(sizes)


def _mapped(df: DataFrame, column: str, convert, out: T.StructField) -> DataFrame:
    """``df`` with ``convert`` of one column's values, a megabyte at a time, as column ``out``."""
    kept = [c for c in df.columns if c.lower() != out.name.lower()]
    name = "_value"
    while name in (c.lower() for c in df.columns):
        name += "_"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias(name))
    schema = T.StructType([*source.schema.fields[:-1], out])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for start, end in _groups([len(v.as_buffer()) if v.is_valid else 0 for v in values]):
                made = convert(values.slice(start, end - start).to_pylist())
                others = batch.slice(start, end - start).columns[:-1]
                yield pa.RecordBatch.from_arrays([*others, pa.array(made, arrow.types[-1])], schema=arrow)

    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: token ids as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizers file, readable on every executor, with a
    byte-level BPE model and a pre-tokenizer that leaves out white space; no begin, end
    or padding tokens are added and nothing is cut off, while special strings inside a
    text become their tokens. A null, empty or blank text has no ids (an empty value, not
    null). Repeated rows are encoded alike, an empty table stays empty, and a column of
    the name ``ids`` is replaced. A very long text is encoded whole, in one task.
    """
    def convert(texts: list) -> list[bytes]:
        return codec(tokenizer).encode([t or "" for t in texts])

    return _mapped(docs, text, convert, T.StructField(ids, T.BinaryType()))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a string column ``text``: the ids decoded, special tokens kept.

    Null and empty ids decode to an empty text; ids that the file does not know are left
    out. Repeated rows, empty tables and clashing names as in ``encode``.
    """
    def convert(values: list) -> list[str]:
        own = decoder(tokenizer)
        return [own.decode(v or b"") for v in values]

    return _mapped(encoded, ids, convert, T.StructField(text, T.StringType()))
