"""MinHash near-duplicate groups by min-max hashing.

Every permutation keeps both its minimum and its maximum over a document's shingle set, so 65 hash evaluations per shingle give
130 signature values; both agree between two sets with probability equal to their Jaccard similarity. Bands of values propose
candidates, laid out for the threshold: 26 bands of 5 at 0.85, where a pair at the threshold is missed with probability
(1 - 0.85^5)^26 = 2e-7; 32 bands of 4 at 0.80, (1 - 0.80^4)^32 = 5e-8.

Documents with the same shingle set are one class from the start. Inside a band bucket, members are first compared with one hub
(linear in the bucket). Buckets that still hold several components compare only members of different components on one-byte
signatures; pairs that may reach the threshold are confirmed on full sets. Small buckets give their pairs (at most SMALL per
member) to a join with the sets. Large ones bring the sets of two blocks of bounded size together in one row and confirm there, each
pair only in the first band its members share, and return links alone. So a group of copies that are close to each other
costs a linear number of rows, one whose members stay just under the threshold is never written out as pairs, and no link
between different texts is given up for it.

Defined results: null, empty or blank text has no shingles and links with nothing; a text of fewer than five words is one
shingle; rows that repeat a doc_id each get the component of their own text (classes with the same smallest doc_id are one node);
a row without doc_id keeps a null component, is linked with nothing and is kept; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.llm.components import connected_components
from votepanel.llm.hashing import U, WordIds, mix, odd_constants, shingle_set
from votepanel.session import cut_lineage

PERMUTATIONS, SHINGLE_WORDS, LEAST_PERCENT = 65, 5, 80
VALUES = 2 * PERMUTATIONS
#: Chance that a pair at the threshold shares no band, at most.
MISS = 5e-7
#: Members of a small bucket; members, and their shingles, of a block of a large one.
SMALL, BLOCK, BLOCK_SHINGLES = 64, 1024, 500_000


def layout(percent: int) -> tuple[int, int, int]:
    """Bands, values per band, and signature values that must agree before a pair is confirmed on full sets.

    Bands hold as many values as MISS allows; the values that must agree are 5.5 standard deviations under those expected."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the bands are laid out for similarities of 0.{LEAST_PERCENT} and more")
    s = percent / 100
    rows = max(r for r in range(1, 6) if (1 - s**r) ** (VALUES // r) <= MISS)
    return VALUES // rows, rows, math.floor(VALUES * s - 5.5 * math.sqrt(VALUES * s * (1 - s)))


def _signatures(percent: int):
    n_bands, rows, _ = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signature_batches(batches, n_bands, rows)

    return run


def _signature_batches(batches: Iterator[pa.RecordBatch], n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    ids, a, c = WordIds(), odd_constants(PERMUTATIONS, 11), odd_constants(rows, 23)
    of_band = mix(np.arange(1, n_bands + 1, dtype=np.uint64))
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(ids.of((text.as_py() or "").encode().lower().split()), SHINGLE_WORDS)
            d1 = d2 = bands = sig = None
            if len(s):
                low, high = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, np.uint64)
                for k in range(0, len(s), 4096):
                    p = s[k : k + 4096, None] * a
                    np.minimum(low, p.min(axis=0), out=low)
                    np.maximum(high, p.max(axis=0), out=high)
                values = mix(np.stack([low, high], axis=1).ravel())
                bands = mix((values[: n_bands * rows].reshape(n_bands, rows) * c).sum(axis=1, dtype=np.uint64) + of_band).view(np.int64)
                sig = (values & U(255)).astype(np.uint8).tobytes()
                d1, d2 = (int(mix(s ^ U(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x5BD1E995, 0x27D4EB2F))
            for col, v in zip(out, (doc_id, len(s), d1, d2, bands, sig), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
        )


def signatures(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2, bands, sig)``: set size, 128-bit set digest, band hashes, one byte per signature value."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signatures(percent), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for batch in batches:
        sets = [shingle_set(ids.of((t.as_py() or "").encode().lower().split()), SHINGLE_WORDS).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = _common(a, b)
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(u, v)`` whose full sets have 100 * intersection >= percent * union. One row per pair on the way, never more."""
    left = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv")), "v")
    both = left.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su")), "u")
    return both.select("u", "v", "su", "sv").mapInArrow(_confirm(percent), "u long, v long")


def _agree(percent: int):
    _, _, min_agree = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= min_agree))

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _across(percent: int, confirm: bool):
    """Pairs between different components of one pair of blocks, which comes as one row of lists.

    ``confirm``: members bring their bands and sets, and only confirmed pairs are returned, in the first band they share."""
    _, _, min_agree = layout(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, i, j, members = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), batch.column(3)[row].values
                node, label, size, side = (members.field(k).to_numpy() for k in ("node", "label", "n_shingles", "side"))
                sig = np.frombuffer(b"".join(members.field("sig").to_pylist()), np.uint8).reshape(len(node), -1)
                if confirm:
                    bands = members.field("bands").flatten().to_numpy().reshape(len(node), -1)
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.field("shingles")]
                left = np.flatnonzero(side == i)
                right = left if i == j else np.flatnonzero(side == j)
                us, vs = [], []
                for k in range(0, len(left), 64):
                    a = left[k : k + 64]
                    lo, hi = np.minimum(size[a][:, None], size[right]), np.maximum(size[a][:, None], size[right])
                    ok = (label[a][:, None] != label[right]) & (100 * lo >= percent * hi)
                    x, y = np.nonzero(ok if i != j else ok & (node[a][:, None] < node[right]))
                    for p in range(0, len(x), 65536):
                        xs, ys = a[x[p : p + 65536]], right[y[p : p + 65536]]
                        near = (sig[xs] == sig[ys]).sum(axis=1) >= min_agree
                        xs, ys = xs[near], ys[near]
                        if confirm and len(xs):
                            shared = bands[xs] == bands[ys]
                            here = bands[xs, shared.argmax(axis=1)] == h
                            xs, ys = xs[here], ys[here]
                            linked = np.zeros(len(xs), bool)
                            for n, (q, r) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True)):
                                common = _common(sets[q], sets[r])
                                linked[n] = 100 * common >= percent * (len(sets[q]) + len(sets[r]) - common)
                            xs, ys = xs[linked], ys[linked]
                        us.append(node[xs])
                        vs.append(node[ys])
                u, v = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Components of the links 100 * |A & B| >= percent * |A | B| between shingle sets.

    Returns every row's ``doc_id, n_shingles, component_id`` (smallest doc_id reachable, itself included) and ``kept`` (doc_id =
    component_id). ``percent`` of 80 or more; the bands are laid out for it.
    """
    sig = cut_lineage(signatures(docs, percent), "signatures")
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(live.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    reps = live.join(classes.select(F.col("node").alias("doc_id"), "d1", "d2", "n_shingles"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    reps = reps.select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands").dropDuplicates(["node", "bands"])
    banded = reps.select("node", "n_shingles", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.min("node").alias("hub")).where("n > 1")
    members = cut_lineage(banded.join(shared, "h"), "buckets")
    sigs = cut_lineage(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "n_shingles", "sig", "bands"), "sigs")
    # sets of all bucket members, from whole texts, once for both confirmations
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = sigs.select(F.col("node").alias("doc_id")).distinct().hint("merge")  # the same plan at every size
    sets = cut_lineage(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")

    def side(name: str) -> DataFrame:
        return sigs.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sig").alias(f"s_{name}"))

    star = members.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    star = star.join(side("v"), "v").join(side("u"), "u").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    links = cut_lineage(confirmed(star.select("u", "v", "s_u", "s_v").mapInArrow(_agree(percent), "u long, v long"), sets, percent), "links")
    first = connected_components(links)

    # buckets that still hold more than one component
    labels = members.select("node").distinct().join(first, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    labelled = cut_lineage(members.drop("hub").join(labels, "node"), "labelled")
    mixed = labelled.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("h")
    rest = labelled.join(mixed, "h", "left_semi")
    keys = ["h", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
    small = rest.where(F.col("n") <= SMALL).join(sigs.select("node", "sig").dropDuplicates(["node"]), "node").withColumn("side", F.lit(0)).withColumn("other", F.lit(0))
    small = small.groupBy(*keys).agg(F.collect_list(F.struct("node", "label", "n_shingles", "side", "sig")).alias("members"))
    pairs = small.mapInArrow(_across(percent, False), "u long, v long").distinct()
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    large = rest.where(F.col("n") > SMALL).join(sigs.select("node", "sig", "bands").dropDuplicates(["node"]), "node").join(sets.select(F.col("doc_id").alias("node"), "shingles").dropDuplicates(["node"]), "node")
    large = large.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.groupBy(*keys).agg(F.collect_list(F.struct("node", "label", "n_shingles", "side", "sig", "bands", "shingles")).alias("members"))
    more = confirmed(pairs, sets, percent).unionByName(large.mapInArrow(_across(percent, True), "u long, v long"))
    component = connected_components(links.unionByName(more))

    by_class = classes.join(component, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "node").alias("component"))
    tagged = sig.join(by_class, ["d1", "d2", "n_shingles"], "left")
    return tagged.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")), F.lit(True)).alias("kept"),
    )


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole ``documents`` table at similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
