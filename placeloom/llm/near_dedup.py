"""Near-duplicates by MinHash, verified on full sets.

1. Each text becomes the set of its word shingles (64-bit hashes) and the minima of
   many universal hash functions over it. Texts with equal sets form a class, and
   from here on a class is one node, named by its smallest id.
2. Bands of minima put nodes that may be alike into buckets; bands and rows are set
   so that a pair at the threshold misses every bucket with a chance below 1e-6.
3. Links are found in buckets without listing all pairs of a group. First each node
   is held against the bucket's smallest node, then against the node that has the
   most links, which in a group of copies is the text they derive from. The links
   are contracted to components, and then every pair that shares a bucket but no
   component is tried: first on signatures, in blocks, then on sets.
4. Every link is confirmed on the full sets. Components are found by alternating
   large-star and small-star.

So within a group that is already connected no further pairs are made, and no pair of
different components that shares a bucket is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.components import components
from placeloom.llm.sizes import small_side, unused
from placeloom.session import materialize

# Text bytes worked on at a time, and nodes of a bucket compared at a time.
_CHUNK_BYTES = 1 << 20
_BLOCK_NODES = 1024
_WORDS = 1 << 17
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class MinHash:
    """``shingle`` words per shingle; links from ``threshold`` per cent Jaccard.

    A pair is dropped on its signatures only when their agreement is below the
    threshold by ``slack``, some four and a half standard deviations.
    """

    shingle: int = 5
    threshold: int = 80
    bands: int = 40
    rows: int = 5
    slack: float = 0.13
    seed: int = 20_011


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [_powers(_BASE, 2), _powers(_INVERSE, 2)]


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words between the given places, of which the first is the lowest."""
    low, high = int(starts[0]), int(ends[-1])
    if len(_POWERS[0]) <= high - low:
        _POWERS[:] = [_powers(_BASE, high - low + 1), _powers(_INVERSE, high - low + 1)]
    with np.errstate(over="ignore"):
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high] + np.uint64(1)) * _POWERS[0][: high - low], out=sums[1:])
        # The sum between two places, shifted to the front, is the word's polynomial.
        return _mix((sums[ends - low] - sums[starts - low]) * _POWERS[1][starts - low] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lowered, and per text the end of its words."""
    # A blank after each text keeps words apart.
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    blank = np.concatenate([[True], _BLANK[data]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    hashes = np.zeros(len(starts), np.uint64)
    # So many words at a time, however long the text.
    for at in range(0, len(starts), _WORDS):
        hashes[at : at + _WORDS] = _polynomials(data, starts[at : at + _WORDS], ends[at : at + _WORDS])
    return hashes, np.searchsorted(starts, np.cumsum(lengths))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; with fewer words, the one of them all."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):

        def run(first: int, length: int, count: int) -> np.ndarray:
            found = np.full(count, length, np.uint64)
            for k in range(length):
                found = _mix(found * np.uint64(_BASE) ^ words[first + k : first + k + count])
            return found

        everywhere = run(0, size, max(len(words) - size + 1, 0))
        out, start = [], 0
        for end in ends.tolist():
            n = end - start
            if n >= size:
                out.append(np.unique(everywhere[start : end - size + 1]))
            else:
                out.append(run(start, n, 1) if n else np.zeros(0, np.uint64))
            start = end
    return out


def _functions(rules: MinHash) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(rules.seed))
    count = rules.bands * rules.rows
    a = random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, count, np.uint64)


def signatures(sets: list[np.ndarray], rules: MinHash) -> np.ndarray:
    """Per non-empty set the minima of a * x + b mod 2^64, their upper 32 bits."""
    a, b = _functions(rules)
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(a)), "<u4")
    with np.errstate(over="ignore"):
        for k in range(len(a)):
            # The smallest product has the smallest upper half.
            out[:, k] = np.minimum.reduceat(joined * a[k] + b[k], starts) >> np.uint64(32)
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of some ``_CHUNK_BYTES`` of text, with the texts."""
    for batch in batches:
        texts, start, size = [], 0, 0
        for k, value in enumerate(batch.column(column)):
            raw = value.as_buffer()
            texts.append(raw.to_pybytes() if raw is not None else b"")
            size += len(texts[-1])
            if size >= _CHUNK_BYTES:
                yield batch.slice(start, k + 1 - start), texts
                texts, start, size = [], k + 1, 0
        if texts:
            yield batch.slice(start), texts


def _key(members: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None


def _sign(rules: MinHash):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1):
            sets = shingle_sets(texts, rules.shingle)
            filled = [k for k, s in enumerate(sets) if len(s)]
            signed = signatures([sets[k] for k in filled], rules) if filled else []
            by_row = dict(zip(filled, signed))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([by_row[k].tobytes() if k in by_row else None for k in range(len(sets))], pa.binary()),
                    rows.column(2),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature", "text_key"],
            )

    return sign


def _sets(rules: MinHash):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches, 1):
            found = shingle_sets(texts, rules.shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([_key(s) for s in found], pa.binary()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                ],
                names=["node", "set_key", "members"],
            )

    return sets


def _confirm(rules: MinHash):
    """Keeps the pairs whose signatures do not rule a link out and whose sets confirm it."""
    least = rules.threshold / 100 - rules.slack

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for k in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in (2, 3))
                if (one == two).mean() < least:
                    continue
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (4, 5))
                if _linked(a, b, rules):
                    linked.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([left[k] for k in linked], pa.int64()), pa.array([right[k] for k in linked], pa.int64())],
                names=["u", "v"],
            )

    return confirm


def _links(pairs: DataFrame, nodes: DataFrame, rules: MinHash) -> DataFrame:
    """The pairs (u, v) that are links, confirmed on the full sets."""
    one = nodes.select(F.col("node").alias("u"), F.col("signature").alias("su"), F.col("members").alias("mu"))
    two = nodes.select(F.col("node").alias("v"), F.col("signature").alias("sv"), F.col("members").alias("mv"))
    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv", "mu", "mv")
    return joined.mapInArrow(_confirm(rules), "u long, v long")


def _unordered(pairs: DataFrame) -> DataFrame:
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    return pairs.where(F.col("u") != F.col("v")).select(*ends).distinct()


def _band_keys(signature: Column, rules: MinHash) -> Column:
    width = 4 * rules.rows
    return F.array(
        *[F.xxhash64(F.lit(k), F.substring(signature, k * width + 1, width)) for k in range(rules.bands)]
    )


_TILE = ["key", "kind", "low", "high"]
_TILE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _across(rules: MinHash):
    """Pairs of a tile whose signatures may mean a link and whose components differ.

    A pair that shares several buckets is tried in the first of its bands only. A
    tile gives one row per node in such a pair, the first one with all the pairs: so
    rows do not grow with the pairs.
    """
    least = rules.threshold / 100 - rules.slack
    width = rules.bands * rules.rows

    def across(rows: pa.Table) -> pa.Table:
        nodes, parts, sides, bands = (rows[c].to_numpy() for c in ("node", "component", "side", "band"))
        signed = np.frombuffer(b"".join(x.as_py() for x in rows["signature"]), "<u4").reshape(-1, width)
        first, second = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        pairs = []
        for i in first.tolist():
            # A block against itself (side 2) takes each pair once.
            others = second[second > i] if sides[i] == 2 else second
            others = others[parts[others] != parts[i]]
            for at in range(0, len(others), 256):
                some = others[at : at + 256]
                equal = signed[some] == signed[i]
                hits = equal.mean(axis=1) >= least
                some, equal = some[hits], equal[hits]
                shared = equal.reshape(len(some), rules.bands, rules.rows).all(axis=2)
                some = some[~shared[:, : bands[i]].any(axis=1)]
                pairs.append(np.stack([np.full(len(some), nodes[i]), nodes[some]], axis=1))
        pairs = np.concatenate([*pairs, np.zeros((0, 2))]).astype("<i8")
        involved = np.unique(pairs)
        lists = [pairs.tobytes()] + [None] * (len(involved) - 1) if len(involved) else []
        tile = [pa.array([rows[c][0].as_py()] * len(involved), t) for c, t in zip(_TILE, _TILE_TYPES)]
        return pa.table([*tile, pa.array(involved, pa.int64()), pa.array(lists, pa.binary())], names=[*_TILE, "node", "pairs"])

    return across


def _confirm_tile(rules: MinHash):
    """The pairs of a tile that are links by their full sets."""

    def confirm(rows: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for node, members in zip(rows["node"].to_pylist(), rows["members"]):
            sets.setdefault(node, []).append(np.frombuffer(members.as_buffer(), np.uint64))
        lists = {x for x in rows["pairs"].to_pylist() if x}
        u, v = [], []
        for pairs in lists:
            for one, two in np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist():
                if any(_linked(a, b, rules) for a in sets[one] for b in sets[two]):
                    u.append(one)
                    v.append(two)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return confirm


def _linked(a: np.ndarray, b: np.ndarray, rules: MinHash) -> bool:
    if len(a) > len(b):
        a, b = b, a
    # Sizes too far apart rule a link out.
    if 100 * len(a) < rules.threshold * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= rules.threshold * (len(a) + len(b) - both)


def _residual(members: DataFrame, labels: DataFrame, nodes: DataFrame, rules: MinHash) -> DataFrame:
    """The links (u, v) between different components among nodes that share a bucket."""
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = sized.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n")
    )
    rows = labelled.join(open_keys.where(F.col("parts") > 1), "key")
    # Only pairs with a member outside the bucket's main component are left to try:
    # blocks of those are held against each other and against blocks of the main one.
    minor = F.col("component") != F.col("main")
    blocks = F.ceil(F.col("n") / _BLOCK_NODES).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.select("key", "band", "node", "component", minor.alias("minor"), blocks.alias("blocks"), own.alias("own"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    inner = F.filter(every, lambda k: k >= F.col("own"))
    outer = F.filter(every, lambda k: k < F.col("own"))

    def tile(low: Column, high: Column, kind: int, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.cast("int").alias("side"))

    own_column = F.col("own")
    of_minor = F.concat(
        F.transform(inner, lambda k: tile(own_column, k, 0, F.when(k == own_column, 2).otherwise(0))),
        F.transform(outer, lambda k: tile(k, own_column, 0, F.lit(1))),
        F.transform(every, lambda k: tile(own_column, k, 1, F.lit(0))),
    )
    of_main = F.transform(every, lambda k: tile(k, own_column, 1, F.lit(1)))
    tiled = rows.select(
        "key", "band", "node", "component", F.explode(F.when(F.col("minor"), of_minor).otherwise(of_main)).alias("tile")
    ).select("key", "band", "node", "component", "tile.*")
    signed = tiled.join(nodes.select("node", "signature"), "node")
    hopeful = signed.groupBy(*_TILE).applyInArrow(
        _across(rules), "key long, kind int, low int, high int, node long, pairs binary"
    )
    with_sets = hopeful.join(nodes.select("node", "members"), "node")
    return with_sets.groupBy(*_TILE).applyInArrow(_confirm_tile(rules), "u long, v long")


def near_duplicates(
    docs: DataFrame, rules: MinHash = MinHash(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links hold from ``threshold`` per cent of shared shingles; component_id is the
    smallest id reachable. A null or blank text has no shingles and is linked with
    nothing; a text with fewer words than a shingle has one, of all its words. Rows
    with a null id are judged by no one: component_id is null, and they are kept.
    Rows that repeat an id with other texts are one node, linked with what any of
    its texts is like when the id is the smallest of that text. An empty table gives an empty one; other columns are not
    read.
    """
    return _judged(docs, rules, doc_id, text).drop("text_key")


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _judged(docs: DataFrame, rules: MinHash, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text, text_key."""
    body = _body(text)
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    keyed = named.withColumn("text_key", F.xxhash64("text"))
    signed = materialize(
        keyed.mapInArrow(
            _sign(rules), "doc_id long, n_shingles long, set_key binary, signature binary, text_key long"
        ),
        "signatures",
    )
    filled = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets have equal signatures, so that of the smallest id stands for all.
    classes = materialize(
        filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "signature")).alias("least")).select(
            "set_key", F.col("least.doc_id").alias("node"), F.col("least.signature").alias("signature")
        ),
        "classes",
    )
    banded = classes.select("node", F.posexplode(_band_keys(F.col("signature"), rules)).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where(F.col("n") > 1)
    members = materialize(banded.join(shared.select("key", "hub"), "key"), "buckets")

    # The sets of the nodes in play, made anew from their texts. Where rows repeat an
    # id with other texts, the set key tells which set goes with which signature.
    in_play = classes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = named.join(small_side(wanted), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(rules), "node long, set_key binary, members binary")
    nodes = materialize(
        sets.dropDuplicates(["node", "set_key"]).join(in_play, ["node", "set_key"]).drop("set_key"), "shingle-sets"
    )

    tried = _unordered(members.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    links = materialize(_links(tried, nodes, rules), "links")
    # The node of a bucket with most links so far is its second hub.
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    ranked = members.join(ends, "node").groupBy("key").agg(F.max_by("node", F.struct("links", "node")).alias("best"))
    again = members.join(ranked, "key").where(F.col("best") != F.col("hub"))
    again = _unordered(again.select(F.col("node").alias("u"), F.col("best").alias("v")))
    links = links.unionByName(materialize(_links(again, nodes, rules), "hub-links"))
    labels = components(links)

    late = materialize(_residual(members.select("key", "band", "node"), labels, nodes, rules), "late-links")
    if late.isEmpty():
        found = labels
    else:
        # Components already found are edges to their least node.
        stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(stars.unionByName(late))
    owners = classes.select("set_key", "node").join(found, "node", "left")
    owners = owners.select("set_key", F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.drop("signature")
        .join(owners, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            own.alias("component_id"),
            F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
            "text_key",
        )
    )


def deduplicate(docs: DataFrame, rules: MinHash = MinHash(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; all columns stay.

    Rows are told apart by id and text: where an id repeats with other texts, each
    goes or stays on its own, and of rows that repeat both one stays. A null or blank
    text is like no other, and rows with a null id are judged by no one: all of them
    stay. An empty table stays empty. No column name is reserved.
    """
    judged = materialize(_judged(docs, rules, doc_id, text).select("doc_id", "text_key", "kept"), "near-judged")
    left = _without(docs, judged.where(~F.col("kept")).distinct(), doc_id, text)
    again = judged.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    again = materialize(again.where(F.col("n") > 1), "repeated-rows")
    if again.isEmpty():
        return left
    # Only rows that repeat are shuffled.
    repeated = _without(left, again, doc_id, text, "left_semi").dropDuplicates([doc_id, text])
    return _without(left, again, doc_id, text).unionByName(repeated)


def _without(docs: DataFrame, rows: DataFrame, doc_id: str, text: str, kind: str = "left_anti") -> DataFrame:
    """``docs`` without (or with only) the rows given as doc_id and text_key."""
    own_id, own_text = unused(docs, "_row_id"), unused(docs, "_row_text")
    named = materialize(rows.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text)), "rows")
    same = (F.col(f"`{doc_id}`").cast("long") == F.col(own_id)) & (F.xxhash64(_body(text)) == F.col(own_text))
    return docs.join(small_side(named), same, kind)
