"""Removal of byte passages that repeat across documents, by suffix arrays.

A byte is removed when a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Equal strings must meet wherever they are, without
sending every suffix around:

1. Documents are dealt to blocks of bounded size. Each window of ``length`` bytes has
   a mark, the least hash among the grams inside it. Equal windows have equal marks,
   and neighbours mostly share theirs, so a block has few marks for its size.
2. Marks are dealt to buckets, which tell each block which of its marks occur in
   another block as well. Only those, and marks found twice within the block, can
   belong to repeated windows; the rest of the text is done.
3. The stretches of text behind these marks go to the bucket of their mark, each
   distinct one once per block with the documents that hold it. A stretch whose mark
   no other text has is settled by its smallest id. The others of a bucket are sorted
   in shards of bounded size: a suffix array per shard (Larsson-Sadakane), common
   prefixes (Kasai), so that windows that agree in ``length`` bytes form a group
   with a smallest id. Shards are merged by binary search of one's sorted windows
   in the other's.
4. Spans go back to the blocks, which cut them out.

A passage in very many documents costs one entry per block in a bucket, and no step
depends on how often a string occurs within a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placeloom.llm.sizes import giving_back
from placeloom.llm.suffix_arrays import common_prefixes, suffix_order
from placeloom.session import shuffle_width

# Text bytes of a block, and bytes of a shard of a bucket.
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
# Text bytes that a bucket of marks stands for, about: what one task of a bucket holds.
BUCKET_BYTES = 8 << 20
# Windows of a stretch, at most: a text that repeats one byte has one mark all along.
_STRETCH = 64
# Bits of a mark that are kept besides its bucket.
_MARK_BYTES = 5
_NO_ID = (1 << 63) - 1
# No byte of UTF-8.
_BETWEEN = 0xFF
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 14


@dataclass(frozen=True)
class Passages:
    """Strings of ``length`` bytes; marks come from grams of ``gram`` bytes."""

    length: int = 50
    gram: int = 24

    def __post_init__(self):
        if not 8 <= self.gram < self.length:
            raise ValueError("a gram has at least 8 bytes and fewer than a string")


def _packed(values: np.ndarray | bytes) -> bytes:
    return zstandard.compress(values if isinstance(values, bytes) else values.tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Per place the polynomial of the ``size`` bytes there, from runs of powers of two."""
    runs, run, out, covered = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while run <= size:
        if size & run:
            if out is None:
                out = runs
            else:
                tail = out[run:]
                out = runs[: len(tail)] * np.uint64(pow(_BASE, covered, 1 << 64)) + tail
            covered += run
        runs, run = runs[:-run] * np.uint64(pow(_BASE, run, 1 << 64)) + runs[run:], run * 2
    return out


def _least_of(values: np.ndarray, count: int) -> np.ndarray:
    """Per place the least of ``count`` values from there."""
    run = 1
    while run * 2 <= count:
        values, run = np.minimum(values[:-run], values[run:]), run * 2
    rest = count - run
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def marks(data: np.ndarray, rules: Passages) -> np.ndarray:
    """Per place the mark of the window that starts there."""
    out = np.zeros(max(len(data) - rules.length + 1, 0), np.uint64)
    # In pieces that stay in the processor's cache.
    with np.errstate(over="ignore"):
        for at in range(0, len(out), _PIECE):
            piece = data[at : min(at + _PIECE, len(out)) + rules.length - 1]
            grams = _gram_hashes(piece, rules.gram)
            grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(_BASE)
            out[at : at + _PIECE] = _least_of(grams, rules.length - rules.gram + 1)
    return out


class _Block:
    """The documents of a block in the order of id and text, and their stretches."""

    def __init__(self, rows: pa.Table):
        ids = [_NO_ID if x is None else x for x in rows["_sx_id"].to_pylist()]
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in rows["_sx_text"]]
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.texts = [texts[k] for k in self.order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.starts = self.ends - [len(t) for t in self.texts]

    def stretches(self, rules: Passages) -> _Block:
        """Find the runs of windows of one document with one mark."""
        found = marks(self.data, rules)
        n = len(found)
        fresh = np.ones(n, bool)
        fresh[1:] = found[1:] != found[:-1]
        fresh[self.starts[self.starts < n]] = True
        heads = np.flatnonzero(fresh)
        doc = np.searchsorted(self.ends, heads, "right")
        # A run ends where the next begins or its document's windows end.
        ends = np.minimum(np.append(heads[1:], n), self.ends[doc] - rules.length + 1) if n else heads
        own = ends > heads
        heads, doc, sizes = heads[own], doc[own], (ends - heads)[own]
        pieces = -(-sizes // _STRETCH)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.mark = np.repeat(found[heads], pieces)
        self.doc = np.repeat(doc, pieces)
        self.first = np.repeat(heads, pieces) + part * _STRETCH
        self.windows = np.minimum(np.repeat(sizes, pieces) - part * _STRETCH, _STRETCH)
        return self


def _split(mark: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    rest = (mark // np.uint64(buckets)) & np.uint64((1 << 8 * _MARK_BYTES) - 1)
    return (mark % np.uint64(buckets)).astype(np.int64), rest


def _as_bytes(rests: np.ndarray) -> bytes:
    return rests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_MARK_BYTES].tobytes()


def _as_marks(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _MARK_BYTES, 8), np.uint8)
    out[:, :_MARK_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _MARK_BYTES)
    return out.view("<u8").ravel()


def _send_marks(rules: Passages, buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        block = rows["_sx_block"][0].as_py()
        bucket, rest = _split(_Block(rows).stretches(rules).mark, buckets)
        order = np.lexsort((rest, bucket))
        bucket, rest = bucket[order], rest[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])
        bucket, rest = bucket[new], rest[new]
        used, starts = np.unique(bucket, return_index=True)
        parts = np.split(rest, starts[1:]) if len(used) else []
        columns = [
            pa.array(np.full(len(used), block), pa.int64()),
            pa.array(used, pa.int32()),
            pa.array([_as_bytes(p) for p in parts], pa.binary()),
        ]
        return pa.table(columns, names=["_sx_block", "bucket", "marks"])

    return send


def _shared_marks(rows: pa.Table) -> pa.Table:
    """Per block its marks that another block has too."""
    own = [_as_marks(x.as_py()) for x in rows["marks"]]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    repeated = values[counts > 1]
    kept = [m[np.isin(m, repeated, assume_unique=True)] if len(repeated) else m[:0] for m in own]
    some = [k for k, m in enumerate(kept) if len(m)]
    columns = [
        rows["_sx_block"].take(pa.array(some, pa.int64())).combine_chunks(),
        rows["bucket"].take(pa.array(some, pa.int64())).combine_chunks(),
        pa.array([_as_bytes(kept[k]) for k in some], pa.binary()),
    ]
    return pa.table(columns, names=["_sx_block", "bucket", "marks"])


def _send_stretches(rules: Passages, buckets: int):
    def send(rows: pa.Table, flags: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in ("_sx_block", "bucket", "texts", "windows", "holders", "ids", "places")}
        if rows.num_rows:
            found = _Block(rows).stretches(rules)
            bucket, rest = _split(found.mark, buckets)
            wanted = _twice(found)
            order = np.argsort(bucket, kind="stable")
            ordered = bucket[order]
            for number, data in zip(flags["bucket"].to_pylist(), flags["marks"].to_pylist()):
                low, high = np.searchsorted(ordered, [number, number + 1])
                mine = order[low:high]
                wanted[mine[np.isin(rest[mine], _as_marks(data))]] = True
            _rows_of(found, rows["_sx_block"][0].as_py(), bucket, np.flatnonzero(wanted), rules, out)
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(out[name], kind) for name, kind in zip(out, kinds)], names=list(out))

    return send


def _twice(found: _Block) -> np.ndarray:
    """Which stretches have a mark that several documents of the block hold."""
    order = np.lexsort((found.doc, found.mark))
    mark, doc = found.mark[order], found.doc[order]
    if not len(order):
        return np.zeros(0, bool)
    new = np.concatenate([[True], mark[1:] != mark[:-1]])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(order)]]) - 1
    several = doc[heads] != doc[tails]
    out = np.zeros(len(order), bool)
    out[order] = several[group]
    return out


def _rows_of(found: _Block, block: int, bucket: np.ndarray, chosen: np.ndarray, rules: Passages, out: dict) -> None:
    """One row per bucket: its distinct stretches and who holds them where."""
    raw = found.data.tobytes()
    chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
    used, starts = np.unique(bucket[chosen], return_index=True)
    for number, group in zip(used.tolist(), np.split(chosen, starts[1:])):
        holders: dict[bytes, list[int]] = {}
        for k, a, w in zip(group.tolist(), found.first[group].tolist(), found.windows[group].tolist()):
            holders.setdefault(raw[a : a + w + rules.length - 1], []).append(k)
        all_holders = np.array([k for ks in holders.values() for k in ks], np.int64)
        out["_sx_block"].append(block)
        out["bucket"].append(number)
        out["texts"].append(_packed(b"".join(holders)))
        out["windows"].append(_packed(np.array([len(t) - rules.length + 1 for t in holders], "<u1")))
        out["holders"].append(_packed(np.array([len(ks) for ks in holders.values()], "<u4")))
        out["ids"].append(_packed(found.ids[found.doc[all_holders]].astype("<i8")))
        out["places"].append(_packed(found.first[all_holders].astype("<u4")))


def window_owners(texts: list[bytes], ids: np.ndarray, rules: Passages) -> list[np.ndarray]:
    """Per text the smallest id among the texts that hold each of its windows.

    Each shard of texts gets a suffix array and common prefixes; the shards' sorted
    distinct windows are then searched for each other's.
    """
    shards, size = [[]], 0
    for k, text in enumerate(texts):
        if size + len(text) > SHARD_BYTES and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(text) + 1
    sorted_shards = [_sorted_windows([texts[k] for k in own], ids[own], rules) for own in shards if own]
    for i, one in enumerate(sorted_shards):
        for other in sorted_shards[i + 1 :]:
            at = np.minimum(np.searchsorted(other["keys"], one["keys"]), len(other["keys"]) - 1)
            same = np.flatnonzero(other["keys"][at] == one["keys"])
            low = np.minimum(one["owner"][same], other["owner"][at[same]])
            one["owner"][same] = low
            other["owner"][at[same]] = low
    out = []
    for shard in sorted_shards:
        owner = shard["owner"][shard["group"]]
        out.extend(np.split(owner, np.cumsum(shard["counts"])[:-1]))
    return out


def _sorted_windows(texts: list[bytes], ids: np.ndarray, rules: Passages) -> dict:
    """The distinct windows of a shard in order, their smallest ids, and each window's group."""
    length = rules.length
    between = bytes([_BETWEEN])
    data = np.frombuffer(between.join([*texts, b""]), np.uint8)
    order = suffix_order(data)
    prefix = common_prefixes(data, order, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text_of = np.searchsorted(ends, order, "left")
    # A window lies within its text; equal strings are so together or not at all.
    whole = order + length <= ends[np.minimum(text_of, len(ends) - 1)]
    fresh = prefix < length
    group = np.cumsum(fresh) - 1
    order, group, text_of = order[whole], group[whole], text_of[whole]
    _, heads, group = np.unique(group, return_index=True, return_inverse=True)
    owner = np.minimum.reduceat(ids[text_of], heads)
    starts = order[heads]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    keys = np.ascontiguousarray(windows).view(f"S{length}").ravel()
    back = np.argsort(order, kind="stable")  # windows in the order of the texts
    return {"keys": keys, "owner": owner, "group": group[back], "counts": sizes - length + 1}


def _find_spans(rules: Passages):
    def spans(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        least: list[int] = []
        held = []  # per row: stretch of each holder, its id, its place
        for row in rows.select(["texts", "windows", "holders", "ids", "places"]).to_pylist():
            raw = zstandard.decompress(row["texts"])
            lengths = _unpacked(row["windows"], "<u1").astype(np.int64) + rules.length - 1
            counts = _unpacked(row["holders"], "<u4").astype(np.int64)
            ids = _unpacked(row["ids"], "<i8")
            lowest = np.minimum.reduceat(ids, np.concatenate([[0], np.cumsum(counts)[:-1]])).tolist()
            ends = np.cumsum(lengths)
            numbers = []
            for a, b, low in zip((ends - lengths).tolist(), ends.tolist(), lowest):
                text = raw[a:b]
                k = place.setdefault(text, len(least))
                if k == len(least):
                    least.append(low)
                elif low < least[k]:
                    least[k] = low
                numbers.append(k)
            held.append((np.repeat(np.array(numbers, np.int64), counts), ids, _unpacked(row["places"], "<u4")))
        texts, least = list(place), np.array(least, np.int64)
        counts = np.array([len(t) for t in texts], np.int64) - rules.length + 1
        offsets = np.cumsum(counts) - counts
        flat = np.repeat(least, counts)
        # Equal windows have equal marks: a text whose mark no other text has owns its windows.
        ends = np.cumsum(counts + rules.length - 1)
        mark = marks(np.frombuffer(b"".join(texts), np.uint8), rules)[ends - counts - rules.length + 1]
        _, group, size = np.unique(mark, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(size[group] > 1)
        if len(mixed):
            owners = window_owners([texts[k] for k in mixed.tolist()], least[mixed], rules)
            for k, owner in zip(mixed.tolist(), owners):
                flat[offsets[k] : offsets[k] + counts[k]] = owner
        # Most stretches have one owner for all their windows.
        low, high = np.minimum.reduceat(flat, offsets), np.maximum.reduceat(flat, offsets)
        blocks, firsts, lasts = [], [], []
        for block, (numbers, ids, places) in zip(rows["_sx_block"].to_pylist(), held):
            whole = high[numbers] < ids
            starts, ends = [places[whole].astype(np.int64)], [places[whole] + counts[numbers[whole]] - 1 + rules.length]
            for k in np.flatnonzero(~whole & (low[numbers] < ids)).tolist():
                number = numbers[k]
                gone = flat[offsets[number] : offsets[number] + counts[number]] < ids[k]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                starts.append(places[k] + edges[0::2])
                ends.append(places[k] + edges[1::2] - 1 + rules.length)
            starts, ends = np.concatenate(starts), np.concatenate(ends)
            if len(starts):
                blocks.append(block)
                firsts.append(_packed(starts.astype("<u4")))
                lasts.append(_packed(ends.astype("<u4")))
        columns = [pa.array(blocks, pa.int64()), pa.array(firsts, pa.binary()), pa.array(lasts, pa.binary())]
        return pa.table(columns, names=["_sx_block", "starts", "ends"])

    return spans


def _whole_characters(raw: bytes, gone: np.ndarray) -> str:
    """The text left, where a character goes only if all its bytes do."""
    data = np.frombuffer(raw, np.uint8)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    lost = np.logical_and.reduceat(gone, head)
    sizes = np.diff(np.concatenate([head, [len(data)]]))
    return data[~np.repeat(lost, sizes)].tobytes().decode()


def _trim(rules: Passages, schema: pa.Schema):
    def trim(rows: pa.Table, spans: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        found = _Block(rows)
        change = np.zeros(len(found.data) + 1, np.int64)
        for row in spans.to_pylist():
            np.add.at(change, _unpacked(row["starts"], "<u4"), 1)
            np.add.at(change, _unpacked(row["ends"], "<u4"), -1)
        gone = np.cumsum(change[:-1]) > 0
        made = {"text": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for raw, start, end in zip(found.texts, found.starts.tolist(), found.ends.tolist()):
            own = gone[start:end]
            removed = int(own.sum())
            kept = found.data[start:end][~own].tobytes() if removed else raw
            made["text"].append(_whole_characters(raw, own) if removed else raw.decode())
            made["n_bytes"].append(end - start)
            made["n_removed"].append(removed)
            made["n_spans"].append(int((own[1:] & ~own[:-1]).sum() + own[0]) if removed else 0)
            made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        columns = []
        for field in schema:
            name = field.name
            if name == "_sx_text":
                columns.append(pa.array(made["text"], field.type))
            elif name.startswith("_sx_out_"):
                columns.append(pa.array(made[name.removeprefix("_sx_out_")], field.type))
            else:
                columns.append(rows[name].take(found.order).combine_chunks().cast(field.type))
        return pa.table(columns, schema=schema)

    return trim


def remove_repeats(
    docs: DataFrame, rules: Passages = Passages(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the text left after removal, n_bytes, n_removed, n_spans and kept_sha256.

    The counts and the hash are of bytes: n_bytes those of the whole text, n_spans the
    maximal removed runs, kept_sha256 the hash of the bytes left. In the text a
    character cut in two by a span is kept. Strings are judged on the input and never
    reach across documents. Rows that share an id remove nothing from each other; a
    null id counts as larger than all others; a null text is empty and comes back
    empty. An empty table gives an empty one. Other columns stay; those with one of
    the names added are replaced.
    """
    spark = docs.sparkSession
    whole = T.LongType()
    added = {"n_bytes": whole, "n_removed": whole, "n_spans": whole, "kept_sha256": T.StringType()}
    # Under names of their own, so that none can clash.
    kept = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in (text, *added)}
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    total = docs.select(F.sum(F.octet_length(body)).alias("n")).first().n or 0
    blocks, buckets = -(-total // BLOCK_BYTES) or 1, max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    identity = F.col(f"`{doc_id}`").cast("long")
    dealt = docs.select(
        *[F.col(f"`{c}`").alias(own) for c, own in kept.items()],
        identity.alias("_sx_id"),
        body.alias("_sx_text"),
        F.pmod(F.xxhash64(identity, body), F.lit(blocks)).cast("long").alias("_sx_block"),
    )
    # The same exchange serves all three uses of the documents.
    by_block = dealt.groupBy("_sx_block")
    flags = (
        by_block.applyInArrow(giving_back(_send_marks(rules, buckets)), "_sx_block long, bucket int, marks binary")
        .groupBy("bucket")
        .applyInArrow(giving_back(_shared_marks), "_sx_block long, bucket int, marks binary")
    )
    spans = (
        by_block.cogroup(flags.groupBy("_sx_block"))
        .applyInArrow(
            giving_back(_send_stretches(rules, buckets)),
            "_sx_block long, bucket int, texts binary, windows binary, holders binary, ids binary, places binary",
        )
        .groupBy("bucket")
        .applyInArrow(giving_back(_find_spans(rules)), "_sx_block long, starts binary, ends binary")
    )
    fields = [dealt.schema[c] for c in (*kept.values(), "_sx_text")]
    fields += [T.StructField(f"_sx_out_{name}", kind) for name, kind in added.items()]
    schema = T.StructType(fields)
    out = by_block.cogroup(spans.groupBy("_sx_block")).applyInArrow(giving_back(_trim(rules, to_arrow_schema(schema))), schema)
    named = [F.col(kept.get(c, "_sx_text")).alias(c) for c in docs.columns if c in (*kept, text)]
    return out.select(*named, *[F.col(f"_sx_out_{name}").alias(name) for name in added])
