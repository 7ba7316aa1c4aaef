"""Near copies: MinHash banding over word shingles, verified on the full shingle sets.

A text is the set of its five-word shingles. Texts with equal sets are one
class and go on as one row. ``rows`` MinHash values form a band; texts that
agree in one of ``bands`` bands meet in a bucket, and the two numbers are chosen
so that a pair at the threshold meets with the wanted probability. Buckets with
the same members are looked at once. A pair is verified in the first band it
agrees in, on its whole sets; large buckets are cut into pairs of blocks, so no
task holds more than two blocks and no row lists a pair: what comes out are
link counts and one edge to a group's smallest member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, land, pieces, small, texts
from .runs import block_pairs, by_runs, may_meet, sorted_runs

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
CHUNK_BYTES = 2 << 20
# Rows of a bucket that one task compares with as many others.
BLOCK = 256
MOST_HASHES = 128


def banding(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the longest band whose number of bands still gives ``recall`` at the threshold."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, (2, n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    factors, terms = _factors(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[None, at:at + 2048] * factors
        part += terms
        low = np.minimum(low, part.min(1))
    keys = np.arange(bands, dtype=np.uint64)
    for row in low.reshape(bands, rows).T:
        keys = (keys ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Rows (doc_id, digest, size, bands) of every text with a word and an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            ids, digests, sizes, keys = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text)
                if doc_id is None or not len(found):
                    continue
                ids.append(doc_id)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                keys.append(signature(found, bands, rows))
            flat = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * bands, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "digest", "size", "bands"])
    return texts(docs).mapInArrow(run, "doc_id long, digest binary, size long, bands array<long>")


def _first_met(bands: np.ndarray, band: int) -> np.ndarray:
    """Pairs of rows that agree in this band and in none before it."""
    met = bands[:, None, band] == bands[None, :, band]
    for earlier in range(band):
        met &= bands[:, None, earlier] != bands[None, :, earlier]
    return met


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _wanted(run: pa.Table, width: int, threshold: float) -> np.ndarray:
    """Pairs to verify in this run: first met here, in these two blocks, and of sizes that allow the threshold."""
    own, size = run.column("own").to_numpy(), run.column("size").to_numpy()
    lo, hi, band = (run.column(c)[0].as_py() for c in ("lo", "hi", "band"))
    pairs = may_meet(own, lo, hi) & _first_met(_matrix(run.column("bands"), width), band)
    return pairs & (np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size) - 1e-9)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for every document with an id.

    ``class_id`` is the smallest doc_id among all documents reachable over
    links, ``n_links`` the number of other documents whose shingle sets have a
    Jaccard similarity of at least ``threshold`` with this one, equal texts
    included. Texts without a word are linked to nothing. NULL ids cannot be
    named and are left out; rows that repeat an id count once, its texts each
    on their own. Case and white space do not matter; other columns are ignored.
    """
    bands, rows = banding(threshold, recall)
    signed = land(signatures(docs, bands, rows).distinct(), "near-signatures")
    classes = land(signed.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.min_by("bands", "doc_id").alias("bands"),
        F.first("size").alias("size")), "near-classes")
    # Two different texts under one id, each the smallest of its class, stay apart by their digest.
    node = F.xxhash64("digest")
    nodes = classes.select(node.alias("node"), "rep", "copies", "size", "bands")
    exploded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = exploded.groupBy("band", "key").agg(
        F.count("*").alias("members"), F.sum(F.col("node").cast("decimal(38,0)")).alias("total"), F.bit_xor("node").alias("mixed"))
    buckets = buckets.filter("members > 1").groupBy("members", "total", "mixed").agg(F.min(F.struct("band", "key")).alias("first"))
    buckets = land(buckets.select("first.band", "first.key", "members"), "near-buckets")
    members = exploded.join(buckets, ["band", "key"]).join(nodes.select("node", "size", "bands"), "node")
    split = block_pairs(members, "node", "members", BLOCK)
    run_keys = ["band", "key", "lo", "hi"]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, run_keys):
            pairs = _wanted(run, bands, threshold)
            keep = pairs.any(0) | pairs.any(1)
            if keep.any():
                yield from run.filter(pa.array(keep)).select([*run_keys, "own", "node"]).to_batches()
    taking = by_runs(split.select(*run_keys, "own", "node", "size", "bands"), *run_keys).mapInArrow(
        involved, "band int, key long, lo int, hi int, own int, node long")
    taking = land(taking, "near-involved")
    # Sets of the texts involved, made again from their documents rather than stored for all.
    needed = land(taking.select("node").distinct().join(nodes, "node").join(
        classes.select(F.xxhash64("digest").alias("node"), "digest"), "node"), "near-needed")
    sources = needed.select(F.col("rep").alias("doc_id"), "digest", "node")
    full = texts(docs).join(small(sources), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            nodes_, found = [], []
            for digest, number, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "node", "text")), strict=True):
                own = shingles(text)
                if xxhash.xxh3_128_digest(own.tobytes()) == digest:
                    nodes_.append(number)
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes_, pa.int64()), "set": pa.array(found, pa.list_(pa.int64()))})
    stored = land(full.select("digest", "node", "text").mapInArrow(sets, "node long, set array<long>").dropDuplicates(["node"]), "near-sets")
    loaded = taking.join(stored, "node").join(needed.select("node", "size", "bands", "rep", "copies"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, run_keys):
            pairs = _wanted(run, bands, threshold)
            links = _linked(run, pairs, threshold)
            if not links.any():
                continue
            links |= links.T
            copies, rep = run.column("copies").to_numpy(), run.column("rep").to_numpy()
            counts = links.astype(np.int64) @ copies
            linked = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "node": run.column("node").to_numpy()[linked], "rep": rep[linked], "links": counts[linked], "near": _roots(links, rep)[linked]})
    links = land(by_runs(loaded.select(*run_keys, "own", "node", "size", "bands", "set", "rep", "copies"), *run_keys).mapInArrow(
        verify, "node long, rep long, links long, near long"), "near-links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("near").alias("b")).distinct(), "near-groups")
    by_class = (classes.select("digest", "rep", "copies", F.xxhash64("digest").alias("node"))
                .join(counted, "node", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                .select("digest", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    judged = signed.select("doc_id", "digest").join(by_class, "digest").groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    everyone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return everyone.join(judged, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _linked(run: pa.Table, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the wanted pairs reach the threshold, counted on whole sets."""
    lists = run.column("set").combine_chunks()
    flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    starts = starts - starts[0]
    size = np.diff(starts)
    links = np.zeros_like(pairs)
    for row in np.flatnonzero(pairs.any(1)):
        others = np.flatnonzero(pairs[row])
        own = flat[starts[row]:starts[row + 1]]
        for other in others:
            theirs = flat[starts[other]:starts[other + 1]]
            # Both are sorted by unsigned value; as a set operation only equality counts.
            shared = np.intersect1d(own, theirs, assume_unique=True).size
            links[row, other] = shared >= threshold * (size[row] + size[other] - shared) - 1e-9
    return links


def _roots(links: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Smallest id reachable within one run."""
    lowest = rep.copy()
    while True:
        step = np.minimum(lowest, np.where(links, lowest[None, :], np.iinfo(np.int64).max).min(1))
        if (step == lowest).all():
            return lowest
        lowest = step
