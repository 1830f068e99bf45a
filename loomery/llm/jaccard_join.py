"""All near-duplicate links on word shingles, exact: size-banded tiles with bitmap signatures.

Documents are sets of hashed five-word shingles. Texts with equal sets form a class, of which one row is
searched for. Under one global order of shingles, the prefixes of two sets that are similar enough
share a shingle; each shingle of a prefix is a tile, with its documents in bands of size.

Two orders are used, one after the other. The first needs only the third of the shingles with the smallest hashes:
these come first, by the number of documents that have them, then the others by value. Documents whose prefix
shares nothing are done with. The second order is by counts of all shingles of the
documents that are left, so that a passage shared by many stands behind a document's own words, and a
shingle's place bounds what two sets can still share: each entry of a tile has a largest size of partner.

A tile of n documents never becomes n * n pairs. First each tile is compared with its leader alone, the
document with the smallest share of shingles of its own; what links gets a common label. Then only documents of one
tile with different labels are left: the smaller one is looked up in the bands of size that the larger one's place
allows. A pair passes the bitmap bound: signatures hold parities of hashed buckets, 1024 or more for larger
sets, and the bits in which two differ are at most the size of the sets' symmetric difference. Survivors meet in an exact
intersection of their sorted arrays. Links make components by alternating stars.

Counts, leaders and labels of a tile are combined in each task before they are shuffled and come back by an equi join,
which AQE can split; nothing gathers a tile in one task.

Defined cases: a null text or one without words has an empty set and is linked with nothing;
fewer words than a shingle give one shingle; repeated rows are a class; null ids get a null
component; an empty table gives an empty result; other columns are ignored. Shingles are 64-bit
hashes, sets 128-bit digests, of which tiles and links carry the first 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.common import forget, maybe_in, without, written
from loomery.llm.components import components

WIDTH = 5
SIGNATURE_WORDS = 16  # of 64 bits, at least
_LOW = -(2**63) + 2**64 // 3  # a third of all shingles are below it; a prefix is about a quarter of its set
_SLICE_BYTES = 1 << 20
_BAND = float(np.log(1.03))  # sizes of a band differ by 3 percent at most
_M64 = 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (SipHash) of all words of the (A-Z lower-cased) texts, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    h = pd.util.hash_array(distinct, categorize=False)[codes]
    real = np.array([len(w) > 0 for w in distinct], dtype=bool)[codes]
    if not real.all():  # empty words before or behind white space
        of = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(of[real], minlength=len(counts)).astype(np.int64)
        h = h[real]
    return h, counts


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    h, counts = word_hashes(texts)
    k = np.uint64(0xD6E8FEB86659FD93)
    joint = h.copy()
    for i in range(1, width):
        joint[: len(h) - i] *= k
        joint[: len(h) - i] += h[i:]
    joint = _mix(joint).view(np.int64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(joint[at : at + n - width + 1]))
        elif n:
            short = reduce(lambda a, x: a * int(k) % _M64 + int(x), h[at : at + n].tolist(), n) % _M64
            out.append(_mix(np.array([short], dtype=np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of hashed buckets: 1024 of them, or four times as many as often as the set is larger."""
    words = SIGNATURE_WORDS
    while 64 * words < len(shingles):
        words *= 4
    bits = np.bincount(_mix(shingles.view(np.uint64)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _differing_bits(a: str, b: str) -> Column:
    """Bits in which two signatures differ; the wider one is folded (its bucket numbers lose their upper bits)."""
    words = F.lit(SIGNATURE_WORDS)
    x, y = F.col(a), F.col(b)
    short = reduce(add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SIGNATURE_WORDS)])

    def count(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, z: s + z)

    def folded(wide: Column, w: Column) -> Column:
        part = lambda k: F.slice(wide, w * k + 1, w)
        xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
        return xor(xor(part(0), part(1)), xor(part(2), part(3)))

    n, m = F.size(x), F.size(y)
    return F.when((n == words) & (m == words), short).when(n == m, count(x, y)).when(n == m * 4, count(folded(x, m), y)).when(m == n * 4, count(x, folded(y, n))).otherwise(0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(whole):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES)))
            yield whole.slice(at, to - at)
            at = to


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def prefix_length(n: int, num: int, den: int) -> int:
    """Elements that a set of n can't all lack, if it shares num / den of them at least."""
    return n - -(-n * num // den) + 1


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _low_shingles(docs: DataFrame, width: int, t: int) -> DataFrame:
    """(row, id, n, digest, key, low, n_low): the first n_low of low are the set's shingles below _LOW; where
    they are fewer than a prefix, low goes on to its length. low is null for a set that the task has met before
    with an id, and for rows without an id: these are in no tile, and stand for no other row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, row = set(), TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            digests, keys, lows, n_lows = [_digest(s) for s in sets], [], [], []
            for s, digest, has_id in zip(sets, digests, batch.column("id").is_valid().to_pylist()):
                keys.append(None if digest is None else _key(digest))
                if digest is None or not has_id or digest in met:
                    lows.append(None)
                    n_lows.append(None)
                    continue
                met.add(digest)
                n_lows.append(int(np.searchsorted(s, _LOW)))
                lows.append(s[: max(n_lows[-1], prefix_length(len(s), t, 100))])
            rows = pa.array(range(row, row + len(sets)), pa.int64())
            row += len(sets)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("id"), pa.array(map(len, sets), pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(n_lows, pa.int32())],
                names=["row", "id", "n", "digest", "key", "low", "n_low"],
            )

    return docs.mapInArrow(run, f"row long, id {docs.schema['id'].dataType.simpleString()}, n int, digest binary, key long, low array<bigint>, n_low int")


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, n, shingles, signature) of the texts; a task gives each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in _slices(batches):
            new = {_digest(s): s for s in shingle_sets(batch.column("text"), width) if len(s)}
            new = {d: s for d, s in new.items() if d not in met}
            met.update(new)
            sets = list(new.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_key, new), pa.int64()), pa.array(map(len, sets), pa.int32()), _lists(sets), _lists([signature(s) for s in sets])], names=["key", "n", "shingles", "signature"]
            )

    return docs.mapInArrow(run, "key long, n int, shingles array<bigint>, signature array<bigint>")


def _shared(entries: DataFrame) -> DataFrame:
    """(h, c) for the h of two entries or more, which are counted in each task before they are shuffled."""
    return entries.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")


def _prefix_size(n: Column, t: int) -> Column:
    return n - F.ceil(n * F.lit(t) / F.lit(100)) + 1


def _not_alone(base: DataFrame, t: int) -> DataFrame:
    """(key): the documents whose prefixes under the first order share a shingle with another document's."""
    low = F.col("h") < _LOW
    entry = base.where("low is not null").select("key", "n", "n_low", F.posexplode("low").alias("place", "h"))
    at = F.when(low, F.col("n_low")).otherwise(F.col("place")).cast("int")
    entry = entry.select("h", "key", "n", at.alias("at"))
    common = written(_shared(entry), "shared-low")
    counts = common.select(F.col("h").alias("of"), "c")
    shared = maybe_in(entry, F.col("h"), common.select("h")).join(counts, F.col("h") == F.col("of")).drop("of")
    # shingles of one document alone come first; only how many there are matters
    one = W.partitionBy("key")
    ranked = shared.withColumn("rank", F.dense_rank().over(one.orderBy(~low, "c", "h")))
    alone = F.col("at") - F.coalesce(F.max(F.when(low, F.col("rank"))).over(one), F.lit(0))
    pos = F.when(low, alone + F.col("rank") - 1).otherwise(F.col("at"))
    placed = written(ranked.withColumn("pos", pos).where(F.col("pos") < _prefix_size(F.col("n"), t)).select("h", "key"), "low-prefixes")
    tiles = placed.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select(F.col("h").alias("of"))
    found = written(placed.join(tiles, F.col("h") == F.col("of")).select("key").distinct(), "not-alone")
    forget(common, placed)
    return found


def _tiles(sets: DataFrame, t: int) -> DataFrame:
    """(h, key, n, pos, shared): the shingles of prefixes under the second order that two documents have, their
    places, and how many shingles of the document any other has."""
    entry = sets.select("key", "n", F.explode("shingles").alias("h"))
    counts = _shared(entry).withColumnRenamed("h", "of")
    shared = entry.join(counts, F.col("h") == F.col("of")).drop("of")
    one = W.partitionBy("key")
    ranked = shared.withColumn("rank", F.dense_rank().over(one.orderBy("c", "h")))
    ranked = ranked.withColumn("shared", F.max("rank").over(one)).withColumn("pos", F.col("n") - F.col("shared") + F.col("rank") - 1)
    return ranked.where(F.col("pos") < _prefix_size(F.col("n"), t)).select("h", "key", "n", "pos", "shared").distinct()


def _least_overlap(na: Column, nb: Column, t: int) -> Column:
    return F.ceil((na + nb) * F.lit(t) / F.lit(100 + t))


def _largest(n: Column, to_come: Column, t: int) -> Column:
    """The size of the largest set that a set of n can be similar to, if to_come of its shingles at most are shared."""
    return (F.floor(to_come * F.lit(100 + t) / F.lit(t)) - n).cast("int")


def _smallest(n: Column, t: int) -> Column:
    return F.ceil(n * F.lit(t) / F.lit(100)).cast("int")


def _two(df: DataFrame) -> list[DataFrame]:
    """df with its columns renamed for the two sides of a join."""
    return [df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns]) for x in "ab"]


def _links(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: the bitmap bound first, then the exact test."""
    light_a, light_b = _two(sets.select("key", "n", "signature"))
    seen = pairs.join(light_b, F.col("b") == F.col("key_b")).join(light_a, F.col("a") == F.col("key_a"))
    possible = _differing_bits("signature_a", "signature_b") <= F.col("n_a") + F.col("n_b") - 2 * _least_overlap(F.col("n_a"), F.col("n_b"), t)
    near = written(seen.where(possible).select("a", "b").distinct(), "near")
    whole_a, whole_b = _two(sets.select("key", "shingles"))
    both = near.join(whole_b, F.col("b") == F.col("key_b")).join(whole_a, F.col("a") == F.col("key_a"))
    both = both.select("a", "b", (F.size("shingles_a") + F.size("shingles_b")).alias("total"), F.size(F.array_intersect("shingles_a", "shingles_b")).alias("common"))
    links = written(both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * t).select("a", "b").distinct(), "links")
    forget(near)
    return links


def _leader_pairs(tiles: DataFrame, t: int) -> DataFrame:
    """(a, b): the leader a of each tile with each other document that its size allows."""
    own = (F.col("n") - F.col("shared")) / F.col("n")
    lead = tiles.groupBy("h").agg(F.min(F.struct(own.alias("own"), "key", "n", "shared")).alias("l")).select(F.col("h").alias("of"), "l")
    met = tiles.join(lead, F.col("h") == F.col("of")).where(F.col("key") != F.col("l.key"))
    n, m = F.col("n"), F.col("l.n")
    fit = (m >= _smallest(n, t)) & (m <= _largest(n, F.col("shared"), t)) & (n >= _smallest(m, t)) & (n <= _largest(m, F.col("l.shared"), t))
    return met.where(fit).select(F.col("l.key").alias("a"), F.col("key").alias("b")).distinct()


def _other_pairs(tiles: DataFrame, label: DataFrame, t: int) -> DataFrame:
    """(a, b): documents of one tile with different labels, for which their sizes and places allow a link."""
    labelled = tiles.join(label, F.col("key") == F.col("node"), "left").select("h", "key", "n", "pos", F.coalesce("component", "key").alias("label"))
    mixed = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(F.col("h").alias("of"))
    rows = labelled.join(mixed, F.col("h") == F.col("of")).withColumn("most", _largest(F.col("n"), F.col("n") - F.col("pos"), t)).select("h", "key", "n", "label", "most")
    rows = written(rows, "mixed-tiles")

    def band(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / _BAND).cast("int")

    large, small = _two(rows)
    small = small.where("most_b >= n_b").withColumn("band_b", band(F.col("n_b")))
    to = F.least("n_a", "most_a")
    large = large.withColumn("least_a", _smallest(F.col("n_a"), t)).where(to >= F.col("least_a"))
    large = large.withColumn("band_a", F.explode(F.sequence(band(F.col("least_a")), band(to))))
    fit = F.col("n_b").between(F.col("least_a"), to) & (F.col("n_a") <= F.col("most_b"))
    first = F.struct("n_b", "key_b") < F.struct("n_a", "key_a")
    met = large.join(small, (F.col("h_a") == F.col("h_b")) & (F.col("band_a") == F.col("band_b")) & (F.col("label_a") != F.col("label_b")) & fit & first)
    pairs = written(met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct(), "candidates")
    forget(rows)
    return pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = WIDTH) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) for each row."""
    t = percent
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = written(_low_shingles(slim, width, t), "low-shingles")
    # of each class one row is searched for: the first of those that a task has met first
    heads = base.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.when(F.col("n_low").isNotNull(), F.col("row"))).alias("first"), F.first("key").alias("key"))
    heads = written(heads, "classes")
    firsts = heads.select("digest", "first")
    later = base.where("n_low is not null").select("row", F.col("digest").alias("d")).join(firsts, F.col("d") == F.col("digest")).where("row > first").select("row")
    later = written(later, "later")
    one_each = without(base.where("n_low is not null"), "row", later)

    keys = _not_alone(one_each, t)
    chosen = written(one_each.select("id", F.col("key").alias("k")).join(keys, F.col("k") == F.col("key"), "left_semi").select("id").distinct(), "chosen")
    texts = maybe_in(slim, F.col("id"), chosen).join(chosen.select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi")
    sets = written(_whole_sets(texts, width), "sets")
    tiles = written(_tiles(sets, t), "tiles")
    edges = _links(_leader_pairs(tiles, t), sets, t)
    rest = _other_pairs(tiles, components(edges), t)
    more = _links(rest, sets, t)
    linked = components(edges.unionByName(more))
    # components of keys, named by the smallest id
    named = linked.join(heads.select("key", "rep"), F.col("node") == F.col("key")).select("component", "node", "rep")
    names = named.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "of")
    of_key = named.join(names, F.col("component") == F.col("of")).select("node", "least").distinct()
    classes = heads.join(of_key, F.col("key") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    forget(later, keys, chosen, sets, tiles, rest)

    members = base.select("id", F.col("n").cast("long").alias("n_shingles"), "digest")
    out = members.join(classes, F.col("digest") == F.col("of"), "left")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id is the smallest of its component; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col, **options)
    return without(docs, id_col, written(found.where("component_id <> id").select("id"), "near-copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
