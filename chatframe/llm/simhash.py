"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has, bit by bit, the majority of the 64-bit hashes of its shingles.
Fingerprints link at ``max_bits`` or fewer differing bits.  The 64 bits are cut into
segments with a radius each; if the radii and one per segment add up to more than
``max_bits``, two linked fingerprints are within the radius in some segment.  So each
fingerprint is entered under its segments and looks up the Hamming ball around them; what it
fetches is verified on all bits.  Longer segments hold fewer entries a key and need larger
balls: three segments suit up to about 2**25 distinct fingerprints, two beyond.

Equal fingerprints are one node from the start, however many documents share them.

Null and empty texts have no words and the fingerprint 0; fewer words than a shingle are one
shingle; null ids take part, and a component of null ids alone has a null id; equal rows
each keep a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import components, split_ball, stored

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """As an unsigned integer."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(map(len, words), lambda a, b: a + b + 1)]
    starts = [0, *(e + 1 for e in ends)]
    counts, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, n, 65_536):
        some = zip(starts[at : min(n, at + 65_536)], ends[at : at + 65_536])
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in some])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, text_key, fp)``; text_key: a hash of the text, fp: the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(
        run, "doc_id long, text_key long, fp long"
    )


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints within ``max_bits``, from distinct ``fp``."""
    if segments < 2:
        raise ValueError("a segment has to be shorter than the fingerprint")
    radii = [(max_bits + 1 + i) // segments - 1 for i in range(segments)][::-1]
    cut = [(i, *s) for i, (s, r) in enumerate(zip(split_ball(64, [max(r, 0) for r in radii]), radii)) if r >= 0]

    def key(at: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)

    def ball(i: int, at: int, width: int, masks: list[int]) -> Column:
        """The keys to look up in segment ``i``."""
        near = F.array(*(F.lit(m).cast("long") for m in masks))
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("s"), key(at, width).bitwiseXOR(m).alias("k")))

    entry = [F.struct(F.lit(i).alias("s"), key(at, width).alias("k")) for i, at, width, _ in cut]
    probe = [ball(*segment) for segment in cut]
    entries = fps.select(F.col("fp").alias("b"), F.explode(F.array(*entry)).alias("e")).select("b", "e.s", "e.k")
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probe)).alias("p")).select(
        "a", F.col("p.s").alias("ps"), F.col("p.k").alias("pk")
    )
    near = (F.col("s") == F.col("ps")) & (F.col("k") == F.col("pk")) & (F.col("a") < F.col("b"))
    return probes.join(entries, near & (distance(F.col("a"), F.col("b")) <= max_bits)).select("a", "b").distinct()


def classes(rows: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """``(fp, component)`` for every fingerprint in ``rows``; component: one of its fingerprints."""
    nodes = stored(rows.select("fp").distinct(), "nodes")
    member = components(links(nodes, max_bits, segments))
    return stored(
        nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("component", "fp").alias("component")
        ),
        "classes",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id in the component of every document."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    of = classes(rows, max_bits, segments)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    smallest = stored(
        first.join(of, "fp").groupBy("component").agg(F.min("first").alias("component_id")), "smallest"
    )
    ids = stored(of.join(smallest, "component").select("fp", "component_id"), "components")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """The documents with all their columns, one of each component: that with the smallest id.

    Null ids come last; of rows with equal id and text one stays.  Texts meet only the keys of
    rows to leave out.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    of = classes(rows, max_bits, segments)
    keys = rows.groupBy("fp", "doc_id", "text_key").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    ranked = stored(keys.withColumn("rank", rank), "keys")
    of_fp = ranked.groupBy("fp").agg(F.min("rank").alias("best"))
    best = stored(of_fp.join(of, "fp").groupBy("component").agg(F.min("best").alias("best")), "best")
    judged = stored(
        ranked.join(stored(of.join(best, "component").select("fp", "best"), "best-of"), "fp").select(
            F.col("rank.none").alias("none"), F.coalesce("rank.id", F.lit(0)).alias("id"), "text_key",
            (F.col("rank") == F.col("best")).alias("stays"), "n",
        ),
        "judged",
    )
    keyed = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_key"),
    )
    same = ["none", "id", "text_key"]
    left = keyed.join(stored(judged.filter("not stays").select(same), "left-out"), same, "left_anti")
    repeated = stored(judged.filter("stays and n > 1").select(same), "repeated")
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(same)
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select("doc.*")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
