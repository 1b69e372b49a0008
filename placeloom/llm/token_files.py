"""Token ids in files, with a minimal perfect hash index per shard.

Documents are range partitioned by id and encoded in that order. A file holds shards,
one row each: the raw ids of consecutive documents, little-endian, in the narrowest
unsigned type that holds the vocabulary, and the index of their keys. The index is a
minimal perfect hash (hash and displace): a key's bucket gives a displacement, the
displaced hash is its slot, and a slot stores the key's fingerprint and its first
document. So a key is found in constant time without comparing keys, and a key that
is not there is told by its fingerprint. Shards know how many ids precede them in
their partition, and partitions are few, so global positions need no second pass.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from placeloom.session import scratch_path, shuffle_width

# Ids of a shard, unless one document has more.
SHARD_IDS = 1 << 19
# Words whose ids a worker remembers; with so many more, those not met since are forgotten.
_REMEMBERED = 900_000
_KEYS_PER_BUCKET = 4
_SHARD = "part int, seq int, base long, n_ids long, n_docs int, n_null int, first long, last long, width int, keys binary, ends binary, displacements binary, fingerprints binary, slots binary, payload binary"  # noqa: E501


class Encoder:
    """Encodes whole texts, each distinct word between spaces once.

    A byte-level pre-tokenizer starts a new piece at a space that follows a
    character other than white space, whatever comes before; so texts are cut there
    and the ids of the parts joined give those of the text. It also parts letters
    from a mark that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # Ids of words after a space, now and of the last generation, and of first words.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?", self._ids(list(".,;:!?"))))
        self.blank_before_space = re.compile(r"\s ")
        self.cut = re.compile(r"(?<!\s) ")

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def encode(self, text: str) -> bytes:
        """The ids of a text as raw bytes."""
        if not text:
            return b""
        parts = self.cut.split(text) if self.blank_before_space.search(text) else text.split(" ")
        head, rest = parts[0], parts[1:]
        first = self.firsts.get(head)
        if first is None:
            if len(self.firsts) >= _REMEMBERED // 8:
                self.firsts.clear()
            first = self.firsts[head] = self._ids([head])[0] if head else b""
        known = self.known
        try:
            return first + b"".join([known[p] for p in rest])
        except KeyError:
            self._learn(set(rest))
            known = self.known
            return first + b"".join([known[p] for p in rest])

    def _learn(self, wanted: set[str]) -> None:
        """Make sure that ``known`` holds the ids of all wanted words."""
        if len(self.known) + len(wanted) > _REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, marks = self.known, self.older, self.marks
        new, marked = set(), []
        for p in wanted.difference(known):
            if p in older:
                known[p] = older[p]
            elif p[-1:] in marks and p[-2:-1].isalpha():
                marked.append(p)
                if p[:-1] not in known and p[:-1] not in older:
                    new.add(p[:-1])
            else:
                new.add(p)
        known.update(zip(new, self._ids([" " + p for p in new])))
        for p in marked:
            plain = p[:-1]
            known[p] = (known[plain] if plain in known else older[plain]) + marks[p[-1]]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of splitmix64 on keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: the hash for its bucket, that for its slot, its fingerprint."""
    keys = keys.astype(np.int64).view(np.uint64)
    return _mixed(keys, 0), _mixed(keys, 1), (_mixed(keys, 2) >> np.uint64(32)).astype("<u4")


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements per bucket, and per slot the fingerprint and the key's place in ``keys``.

    ``keys`` are distinct. Buckets with most keys choose first; a bucket tries
    displacements until its keys fall on free slots.
    """
    n = len(keys)
    buckets = max(1, -(-n // _KEYS_PER_BUCKET))
    bucket_hash, slot_hash, prints = _hashes(keys)
    of_bucket = (bucket_hash % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of_bucket, kind="stable")
    bounds = np.searchsorted(of_bucket[order], np.arange(buckets + 1))
    displacements = np.zeros(buckets, "<u4")
    slot_of = np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    for bucket in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):
        members = order[bounds[bucket] : bounds[bucket + 1]]
        if not len(members):
            continue
        own, tried = slot_hash[members], 0
        while True:
            # Many displacements at a time: the last buckets find few free slots.
            tries = np.arange(tried, tried + 64, dtype=np.uint64)
            slots = (_mixed(own[None, :] ^ (tries[:, None] << np.uint64(32)), 3) % np.uint64(n)).astype(np.int64)
            fits = free[slots].all(axis=1)
            if len(members) > 1:
                ranked = np.sort(slots, axis=1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            good = np.flatnonzero(fits)
            if len(good):
                displacements[bucket] = tried + good[0]
                slot_of[members] = slots[good[0]]
                free[slots[good[0]]] = False
                break
            tried += 64
    fingerprints, places = np.zeros(n, "<u4"), np.zeros(n, "<u4")
    fingerprints[slot_of], places[slot_of] = prints, np.arange(n)
    return displacements, fingerprints, places


def find_places(keys: np.ndarray, displacements: np.ndarray, fingerprints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place of each key; -1 where the fingerprint tells that it is not there."""
    n = len(places)
    if not n:
        return np.full(len(keys), -1, np.int64)
    bucket_hash, slot_hash, prints = _hashes(keys)
    moved = displacements[(bucket_hash % np.uint64(len(displacements))).astype(np.int64)].astype(np.uint64)
    slots = (_mixed(slot_hash ^ (moved << np.uint64(32)), 3) % np.uint64(n)).astype(np.int64)
    return np.where(fingerprints[slots] == prints, places[slots].astype(np.int64), -1)


def _shard_row(part: int, seq: int, base: int, width: int, keys: list, payloads: list[bytes]) -> dict:
    """A shard: its documents in key order, null keys first."""
    sizes = np.array([len(p) // width for p in payloads], np.int64)
    ends = np.cumsum(sizes)
    nulls = sum(key is None for key in keys)
    present = np.array(keys[nulls:], "<i8")
    distinct, firsts = np.unique(present, return_index=True)  # a repeated key points to its first row
    displacements, fingerprints, places = build_index(distinct)
    return {
        "part": part, "seq": seq, "base": base, "n_ids": int(ends[-1]), "n_docs": len(keys), "n_null": nulls,
        "first": int(present[0]) if len(present) else None, "last": int(present[-1]) if len(present) else None,
        "width": width, "keys": present.tobytes(), "ends": ends.astype("<i8").tobytes(),
        "displacements": displacements.tobytes(), "fingerprints": fingerprints.tobytes(),
        "slots": (firsts[places] + nulls).astype("<u4").tobytes(), "payload": b"".join(payloads),
    }


def _encode(path: str, end_id: int, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        seq = base = filled = 0
        keys, payloads = [], []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                payload = encoder.encode(text.as_py() or "") + end
                keys.append(key.as_py())
                payloads.append(payload)
                filled += len(payload) // width
                if filled >= SHARD_IDS:
                    yield pa.RecordBatch.from_pylist([_shard_row(part, seq, base, width, keys, payloads)], schema)
                    seq, base, filled, keys, payloads = seq + 1, base + filled, 0, [], []
        if keys:
            yield pa.RecordBatch.from_pylist([_shard_row(part, seq, base, width, keys, payloads)], schema)

    return encode


@dataclass(frozen=True)
class TokenFiles:
    """Files written by ``write``, at a path of Spark's own file systems."""

    spark: SparkSession
    path: str

    def shards(self) -> DataFrame:
        return self.spark.read.schema(_SHARD).parquet(self.path)

    def _starts(self) -> DataFrame:
        """Ids before each partition: one row per partition of the write."""
        sizes = self.shards().groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
        rows, total = [], 0
        for r in sizes:
            rows.append((r.part, total))
            total += r.n
        return self.spark.createDataFrame(rows, "part int, before long")

    def documents(self) -> DataFrame:
        """Per document, read through the index: doc_id, start, n_tokens, ids_crc32."""
        out = "doc_id long, start long, n_tokens long, ids_crc32 long"
        located = self.shards().join(F.broadcast(self._starts()), "part").withColumn("base", F.col("base") + F.col("before"))
        columns = ["base", "n_null", "width", "keys", "ends", "displacements", "fingerprints", "slots", "payload"]
        return located.select(*columns).mapInArrow(_digests, out)

    def lookup(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """The ids of the first document of each key: key, ids (null if it is not there).

        Partitions are ranges of keys, so a key's partition is known from their
        bounds (one row each); within it only shards whose range holds the key are
        read, and the index gives the place.
        """
        wanted = keys.select(F.col(f"`{key}`").cast("long").alias("key")).where(F.col("key").isNotNull()).distinct()
        bounds = self.shards().groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"))
        ranges = F.broadcast(bounds.where(F.col("low").isNotNull()))
        placed = wanted.join(ranges, F.col("key").between(F.col("low"), F.col("high"))).select("key", "part")
        spans = self.shards().where(F.col("first").isNotNull()).select("part", "seq", "first", "last")
        targets = placed.join(spans, "part").where(F.col("key").between(F.col("first"), F.col("last")))
        chosen = self.shards().join(targets.select("part", "seq").distinct(), ["part", "seq"], "left_semi")
        found = (
            chosen.groupBy("part", "seq")
            .cogroup(targets.select("part", "seq", "key").groupBy("part", "seq"))
            .applyInArrow(_fetch, "key long, part int, seq int, ids array<long>")
            .groupBy("key")
            .agg(F.min_by("ids", F.struct("part", "seq")).alias("ids"))
        )
        return wanted.join(found, "key", "left")


def _arrays(row: dict) -> dict:
    return {
        "keys": np.frombuffer(row["keys"], "<i8"),
        "ends": np.frombuffer(row["ends"], "<i8"),
        "index": tuple(np.frombuffer(row[c], "<u4") for c in ("displacements", "fingerprints", "slots")),
        "ids": np.frombuffer(row["payload"], f"<u{row['width']}"),
    }


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            shard, nulls = _arrays(row), row["n_null"]
            distinct, repeats = np.unique(shard["keys"], return_counts=True)
            at = find_places(distinct, *shard["index"])
            if (at < 0).any():
                raise ValueError("a key of the shard is not in its index")
            # The rows of a key follow its first one; those without a key come first of all.
            rows = np.concatenate([np.arange(a, a + n) for a, n in zip(at, repeats)] or [np.zeros(0, np.int64)])
            rows = np.concatenate([np.arange(nulls), rows]).astype(np.int64)
            ends = shard["ends"]
            starts = np.concatenate([[0], ends[:-1]])[rows]
            raw = memoryview(shard["ids"].astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends[rows].tolist())]
            keys = pa.array([None] * nulls + np.repeat(distinct, repeats).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(starts + row["base"], pa.int64()), pa.array(ends[rows] - starts, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _fetch(shards: pa.Table, keys: pa.Table) -> pa.Table:
    out = {"key": [], "part": [], "seq": [], "ids": []}
    for row in shards.to_pylist():
        shard = _arrays(row)
        wanted = np.array(keys["key"].to_pylist(), np.int64)
        for key, at in zip(wanted.tolist(), find_places(wanted, *shard["index"]).tolist()):
            # A fingerprint can be met by chance; the stored key settles it.
            if at >= 0 and shard["keys"][at - row["n_null"]] == key:
                low = int(shard["ends"][at - 1]) if at else 0
                ids = shard["ids"][low : int(shard["ends"][at])].tolist()
                for name, value in (("key", key), ("part", row["part"]), ("seq", row["seq"]), ("ids", ids)):
                    out[name].append(value)
    kinds = (("key", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int64())))
    return pa.table([pa.array(out[name], kind) for name, kind in kinds], names=[name for name, _ in kinds])


def write(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> TokenFiles:
    """Encode all texts in ascending order of their integer id and write the files.

    ``tokenizer`` is the path of a byte-level tokenizers file, readable on every
    executor; ``end_id`` follows each document. A null text is an empty one: only
    the end id is written. Null ids come first and are not in the index. Rows that
    repeat an id are all written, in the order of their texts; the index points to
    the first. An empty table gives files without shards. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    ranged = named.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType.fromDDL(_SHARD)
    from pyspark.sql.pandas.types import to_arrow_schema

    ranged.mapInArrow(_encode(tokenizer, end_id, to_arrow_schema(schema)), schema).write.option(
        "compression", "zstd"
    ).parquet(path)
    return TokenFiles(spark, path)
