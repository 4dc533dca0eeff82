"""Near-duplicates by MinHash bands, odd sketches and exact sets.

A text's set is its distinct shingles of `words` words. SAMPLES MinHash values make BANDS band keys,
and are also folded into an odd sketch: a bitmap where each (number, value) flips one bit, so that
the bits set in the XOR of two bitmaps tell how many values differ, most precisely where few do.
Pairs from bands are estimated by their sketches, and what may reach the limit is confirmed on the
full sets of both texts.

Copies first become classes of equal sets, with one representative. No band lists all its pairs:

1. Every member of a band is compared with the band's smallest id. Confirmed links give components.
2. Bands whose members are still in different components are looked at again: only members outside
   the component of the band's smallest id, its strays, are compared with members of other
   components. A link within a component adds nothing, and any other link has a stray on one side,
   so together the steps find all components that comparing all pairs would. Strays meet the others
   in blocks of at most about BLOCK_SHINGLES a side: first by sketch, in the first band they share,
   which keeps of a block only the rows with a promising partner; then those rows by full set. A
   stray keeps one link to each component. So what is written grows with the members of bands, not
   with their pairs.

With five values a band and forty bands, two sets at the limit of 0.8 meet in no band once in eight
million times. Sketches leave out pairs that differ in MAX_ODD bits or more, five deviations beyond
what the limit lets expect.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text of
fewer words is one shingle. A row without id is its own component, without id. Rows with one id and
different texts are compared by their texts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, mix64, small_batches, stored
from .components import components

BANDS, BAND_VALUES = 40, 5
SAMPLES = BANDS * BAND_VALUES
SKETCH_BITS = 256
MAX_ODD = 104
LIMIT_PERCENT = 80
MEMORY_WORDS = 400_000
BLOCK_SHINGLES = 2_000_000
# Up to so many ids (32 MB) are sent to the texts; more are met by a shuffle of both.
BROADCAST_IDS = 4_000_000
SCHEMA = (
    "doc_id BIGINT, n BIGINT, d1 BIGINT, d2 BIGINT, bands ARRAY<BIGINT>, "
    "s0 BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT"
)
SKETCH = ("s0", "s1", "s2", "s3")
BLOCK_COLUMNS = ["band", "i", "j", "rep", "component", "n", *SKETCH, "stray"]

_rng = np.random.default_rng(20)
FACTORS = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * 2 + 1)[:, None]
OFFSETS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
NUMBERS = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


class ShingleHasher:
    """Distinct 64-bit shingle hashes of a text."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def shingles(self, lowered: bytes) -> np.ndarray:
        # bytes.split() parts at exactly \x20 and \x09 to \x0D.
        parts = lowered.split()
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for word in parts:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        width = min(self.words, len(parts))
        total = np.full(len(parts) - width + 1, width, np.uint64)
        for i in range(width):
            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(total)])
        return np.unique(total)


def min_hash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    result = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(result, (FACTORS * x[None, at : at + 2048] + OFFSETS).min(axis=1), out=result)
    return result


def band_keys(sample: np.ndarray) -> np.ndarray:
    rows = sample.astype(np.uint64).reshape(BANDS, BAND_VALUES)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_VALUES):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    places = mix64(NUMBERS | sample.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def estimated_similarity(odd_bits: int) -> float:
    """What the number of differing sketch bits says of the sets' similarity."""
    left = 1 - 2 * odd_bits / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(left)) if left > 0 else 0.0


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Set size, set digest, band keys and odd sketch of every row."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in byte_rows(batch.column(1), lower=True):
                shingles = hasher.shingles(text)
                sizes.append(len(shingles))
                raw = shingles.tobytes()
                digests.append((xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)))
                sample = min_hash(shingles)
                bands.append(band_keys(sample) if len(shingles) else None)
                sketches.append(odd_sketch(sample))
            pairs = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            empty = np.array(sizes) == 0
            sketch = np.array(sketches, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(pairs[:, 0], mask=empty),
                    pa.array(pairs[:, 1], mask=empty),
                    pa.array(bands, pa.list_(pa.int64())),
                    *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4)),
                ],
                names=["doc_id", "n", "d1", "d2", "bands", *SKETCH],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(sign, SCHEMA), "near-signatures")


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (x, y) whose set sizes and odd sketches let them reach the limit."""

    def side(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("n", *SKETCH)]
        return reps.select(F.col("rep").alias(name), *columns)

    odd: Column = F.lit(0)
    for c in SKETCH:
        odd = odd + F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}")))
    sizes = 100 * F.least("x_n", "y_n") >= LIMIT_PERCENT * F.greatest("x_n", "y_n")
    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    return joined.where((odd < MAX_ODD) & sizes).select("x", "y").distinct()


def _sets(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Full sets of the texts whose `id` is among ids. Only these texts are read again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(words)
        for batch in batches:
            sets = [hasher.shingles(t).tobytes() for t in byte_rows(batch.column(1), lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "members"])

    # Written first, so that their number is known before the texts would be shuffled.
    ids = stored(ids, "near-wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(texts.join(ids, "id", "left_semi").mapInArrow(build, "id BIGINT, members BINARY"), "near-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs whose full sets reach the limit."""
    pairs = stored(pairs, "near-pairs")
    sets = _sets(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), docs, words, id_col, text_col)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= LIMIT_PERCENT * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (
        pairs.join(sets.select(F.col("id").alias("x"), F.col("members").alias("x_set")), "x")
        .join(sets.select(F.col("id").alias("y"), F.col("members").alias("y_set")), "y")
        .select("x", "y", "x_set", "y_set")
    )
    return stored(both.mapInArrow(confirm, "x BIGINT, y BIGINT"), "near-links")


def _near(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray of a block with the members of other components whose sizes and sketches let
    them reach the limit, by their places in the block."""
    component, n = block["component"].to_numpy(), block["n"].to_numpy()
    sketch = np.stack([block[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)
    stray = block["stray"].to_numpy()
    members = np.flatnonzero(~stray)
    for a in np.flatnonzero(stray):
        odd = np.bitwise_count(sketch[members] ^ sketch[a]).sum(axis=1)
        least, most = np.minimum(n[members], n[a]), np.maximum(n[members], n[a])
        near = members[(component[members] != component[a]) & (odd < MAX_ODD) & (100 * least >= LIMIT_PERCENT * most)]
        if len(near):
            yield a, near


def _block_candidates(block: pa.Table) -> list[pa.RecordBatch]:
    """Rows of a block that have a promising partner in it, met in no earlier band."""
    band = block["band"][0].as_py()
    bands = np.concatenate([c.flatten().to_numpy() for c in block["bands"].chunks]).reshape(-1, BANDS)
    keep = np.zeros(len(block), bool)
    for a, near in _near(block):
        first = (bands[near] == bands[a]).argmax(axis=1)
        near = near[bands[a][first] == band]
        keep[near] = True
        keep[a] |= len(near) > 0
    return block.select(BLOCK_COLUMNS).filter(pa.array(keep)).combine_chunks().to_batches(len(block))


def _block_links(block: pa.Table) -> list[pa.RecordBatch]:
    """Links between the strays of a block and its members of other components."""
    rep, component, n = (block[c].to_numpy() for c in ("rep", "component", "n"))
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in block["members"]]
    links = []
    for a, near in _near(block):
        values = np.concatenate([sets[b] for b in near])
        at = np.minimum(np.searchsorted(sets[a], values), len(sets[a]) - 1)
        common = np.add.reduceat((sets[a][at] == values).astype(np.int64), np.cumsum(n[near]) - n[near])
        near = near[100 * common >= LIMIT_PERCENT * (n[a] + n[near] - common)]
        _, one_each = np.unique(component[near], return_index=True)
        links.extend((rep[a], rep[b]) for b in near[one_each])
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return [pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in range(2)], names=["x", "y"])]


def _by_block(work: Callable[[pa.Table], list[pa.RecordBatch]]) -> Callable:
    """`work` done on every block; the rows of a block arrive one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if waiting and tuple(keys[start]) != last:
                    yield from work(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(batch.slice(start, end - start))
                last = tuple(keys[start])
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    return run


def stray_links(open_: DataFrame, reps: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Links (x, y) between strays and members of other components, of open bands given as rows
    of band, rep, component and main."""
    rows = open_.join(reps.select("rep", "n", "bands", *SKETCH), "rep").withColumn("stray", F.col("component") != F.col("main"))
    blocks = lambda size: F.ceil(F.sum(size) / BLOCK_SHINGLES).cast("int")
    sizes = rows.groupBy("band").agg(
        blocks("n").alias("m_blocks"), blocks(F.when(F.col("stray"), F.col("n"))).alias("s_blocks")
    )
    rows = stored(rows.join(sizes, "band"), "near-open-rows")
    place = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["band", "rep", "component", "n", "bands", *SKETCH]
    strays = rows.where("stray").select(*columns, "stray", place("s_blocks").alias("i"), every("m_blocks").alias("j"))
    members = rows.select(*columns, F.lit(False).alias("stray"), every("s_blocks").alias("i"), place("m_blocks").alias("j"))
    met = strays.unionByName(members).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.select(*BLOCK_COLUMNS).schema)
    met = stored(met.mapInArrow(_by_block(_block_candidates), schema), "near-stray-candidates")
    sets = _sets(met.select(F.col("rep").alias("id")).distinct(), docs, words, id_col, text_col)
    # An id may have several texts; each goes with the signature of its size.
    sets = sets.withColumns({"rep": F.col("id"), "n": F.expr("octet_length(members) div 8"), "h": F.xxhash64("members")})
    sets = sets.dropDuplicates(["rep", "n", "h"]).drop("id", "h")
    met = met.join(sets, ["rep", "n"]).select(*BLOCK_COLUMNS, "members")
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return stored(met.mapInArrow(_by_block(_block_links), "x BIGINT, y BIGINT"), "near-stray-links")


def near_duplicates(
    docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = signatures(docs, words, id_col, text_col)
    reps = stored(
        rows.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands", *SKETCH))),
        "near-classes",
    )
    members = reps.select(F.explode("bands").alias("band"), "rep")
    shared = stored(
        members.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c"),
        "near-bands",
    )
    met = stored(members.join(shared, "band"), "near-members")
    stars = met.where("rep <> leader").select(F.col("leader").alias("x"), F.col("rep").alias("y")).distinct()
    links = confirmed(_promising(stars, reps), docs, words, id_col, text_col)
    found = components(links, "x", "y")

    labels = found.select(F.col("id").alias("rep"), "component")
    placed = met.join(labels, "rep", "left").select(
        "band", "rep", "leader", F.coalesce("component", "rep").alias("component")
    )
    placed = stored(placed, "near-placed")
    split = (
        placed.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "rep").alias("main"))
        .where("low <> high")
        .select("band", "main")
    )
    split = stored(split, "near-split-bands")
    open_ = stored(placed.join(split, "band").select("band", "rep", "component", "main"), "near-open")
    more = stray_links(open_, reps, docs, words, id_col, text_col)
    if not more.isEmpty():
        found = components(found.select(F.col("component").alias("x"), F.col("id").alias("y")).unionByName(more), "x", "y")

    classes = stored(
        reps.select("d1", "d2", "rep")
        .join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("d1", "d2", F.coalesce("component", "rep").alias("component")),
        "near-components",
    )
    result = rows.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.col("doc_id").eqNullSafe(own).alias("kept"),
    )
