"""MinHash near-dedup (operator 1): b-bit signatures, band candidates, exact confirmation, components.

1. One pass over the texts makes each document's set of distinct word shingles,
   hashed to 64 bits, and keeps its size, a 128-bit digest of the set, the low
   four bits of each of 128 minima packed in eight longs, and twenty band keys
   (25 for links under 0.85) of five full minima each. Documents with equal sets are one class.
2. In each band bucket the least class is compared with every other member: a
   star, linear in the bucket. The signatures must agree in enough bits (counted
   on the packed words, corrected for the chance of equal low bits), then the
   full shingle sets decide.
3. Buckets whose members now lie in one component need nothing more. In the
   others, the pairs of members of different components that the star left out
   are estimated block against block, on the signatures alone; the members that
   may link, and no others, then bring their texts, and full sets decide. What a
   task returns are members or links, never pairs.

A pair of similarity 0.85 shares no band of twenty with probability below 1e-5,
and its estimate falls under the cut-off with probability 1.1e-5. For a pair of
similarity 0.8, 25 bands and its cut-off, both probabilities are below 5e-5.

Confirmation streams members past one head text at a time; heads with many
members are dealt to several tasks. Only texts of candidate pairs are shuffled.
Blocks are bounded in members and in shingles.

Cases: null, empty and white-space texts have an empty set and link with
nothing; texts of fewer words than a shingle have one shingle, the whole
sequence. Rows with a null doc_id get a null component and are kept. Rows that
share a doc_id are compared as documents of their own, and count as kept when
that doc_id is the least of their component. An empty table gives an empty
result. Texts are used whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, drop, materialise, numbered, release_tools, semi_join, small_enough, text_buffers
from lodestrata.llm.components import components
from lodestrata.llm.textops import LOWER, hash_spans, mix64, words

PERMUTATIONS, BITS, BANDS, BAND_ROWS = 128, 4, 20, 5
#: As many bands of BAND_ROWS as fit in PERMUTATIONS, for links under LINK_PERCENT.
MOST_BANDS = PERMUTATIONS // BAND_ROWS
#: Similarity that a link needs, in hundredths, and how far below it an estimate may lie.
LINK_PERCENT, ESTIMATE_SLACK = 85, 0.15
WORDS = 5
#: Members of one head that one task confirms; members and shingles of a block of a bucket.
CHUNK, BLOCK, BLOCK_SHINGLES = 64, 1024, 1 << 20

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 32, (3, PERMUTATIONS), np.uint32) | np.uint32(1)
_GRAM = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(64)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    h = hash_spans(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = max(0, len(h) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += h[k : k + n] * _GRAM[k]
    mix64(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:  # the whole sequence, told apart from shingles by its length
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x += h[k : k + 1] * _GRAM[k - a]
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each permutation over each set (no set is empty)."""
    flat = np.concatenate(sets).astype(np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    v, w = np.empty_like(flat), np.empty_like(flat)
    for k in range(PERMUTATIONS):
        np.multiply(flat, _SEEDS[0, k], out=v)
        v += _SEEDS[1, k]
        np.right_shift(v, np.uint32(16), out=w)
        v ^= w
        v *= _SEEDS[2, k]
        np.right_shift(v, np.uint32(15), out=w)
        v ^= w
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def pack_low_bits(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of the minima, sixteen to a long."""
    per = 64 // BITS
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(least), b + 1, np.uint64)
        for r in range(BAND_ROWS):
            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + least[:, b * BAND_ROWS + r])
        keys[:, b] = k
    return keys.view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, hi long, lo long, sig array<long>, bands array<long>"


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, n_bands: int = BANDS) -> DataFrame:
    """One row for each document; sig and bands are null for empty sets."""

    def run(batches):
        release_tools()
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in blocks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                full = np.array([len(s) > 0 for s in sets], bool)
                digest = np.array([np.frombuffer(hashlib.blake2b(s.data, digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                sig, bands = np.zeros((0, PERMUTATIONS * BITS // 64), np.int64), np.zeros((0, n_bands), np.int64)
                if full.any():
                    least = minima([s for s in sets if len(s)])
                    sig, bands = pack_low_bits(least), band_keys(least, n_bands)
                place = np.cumsum(full) - 1

                def lists(a, place=place, full=full):
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), a.shape[1]).cast(pa.list_(pa.int64())) if len(a) else pa.array([[]], pa.list_(pa.int64()))
                    return rows.take(pa.array(np.maximum(place, 0), mask=~full))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists(sig), lists(bands)],
                    ["doc_id", "n_shingles", "hi", "lo", "sig", "bands"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNATURES)


def _estimate(a: str, b: str):
    """Similarity by the bits of two packed signatures: equal low bits, less those equal by chance."""
    fold = int("1" * (64 // BITS), 16)
    different = None
    for k in range(PERMUTATIONS * BITS // 64):
        x = F.expr(f"{a}[{k}] ^ {b}[{k}]")
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)) if BITS == 4 else x
        n = F.bit_count(y.bitwiseAND(F.lit(fold)))
        different = n if different is None else different + n
    chance = 1 / (1 << BITS)
    return (1 - different / F.lit(PERMUTATIONS) - chance) / (1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose sizes and signatures allow a link."""
    x = reps.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx"))
    y = reps.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy"))
    return pairs.join(x, "x").join(y, "y").filter(_may_link(percent)).select("x", "y")


def _may_link(percent: int):
    sizes = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return sizes & (_estimate("sx", "sy") >= percent / 100 - ESTIMATE_SLACK)


def confirm(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, percent: int = LINK_PERCENT, size: int = WORDS) -> DataFrame:
    """The pairs (x, y), materialised before, whose full shingle sets have the needed similarity; doc_id is unique."""
    ids = materialise(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "ids")
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = materialise(semi_join(own, ids, "id"), "texts")
    heads = materialise(pairs.groupBy("x").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "heads")
    members = pairs.join(F.broadcast(heads) if small_enough(heads) else heads, "x").withColumn("chunk", F.pmod(F.xxhash64("y"), F.col("chunks"))).join(texts.select(F.col("id").alias("y"), "text"), "y")
    by_chunk = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(texts.select(F.col("id").alias("x"), "text"), "x")
    rows = by_chunk.select("x", "chunk", F.lit(None).cast("long").alias("y"), "text").unionByName(members.select("x", "chunk", "y", "text"))

    def run(batches):
        head = None
        for batch in batches:
            xs, ys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raw, offsets = text_buffers(batch.column(3))
            found = []
            for i, j in blocks(offsets):
                for k, s in enumerate(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size), i):
                    if ys[k] is None:
                        head = s
                        continue
                    at = np.searchsorted(head, s)
                    same = int((head[np.minimum(at, len(head) - 1)] == s).sum())
                    if 100 * same >= percent * (len(head) + len(s) - same):
                        found.append((xs[k], ys[k]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["x", "y"])

    # Within (x, chunk) the head, whose y is null, comes first.
    links = materialise(rows.repartition("x", "chunk").sortWithinPartitions("x", "chunk", F.col("y").asc_nulls_first()).mapInArrow(run, "x long, y long"), "links")
    drop(ids, texts, heads)
    return links


def _groups(batches, keys: int):
    """Tables of the consecutive rows that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            if new[a] and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


PAIRED = "bucket long, i long, j long, rep long, block long, head long, component long, n long, sig array<long>, bands array<long>"


def confirm_within(rows: DataFrame, docs: DataFrame, text: str, doc_id: str, percent: int, size: int) -> DataFrame:
    """Links (x, y) between members of different components of one bucket that their star left out.

    ``rows`` (materialised): bucket, head, of_head (the head's component), rep, component, n, sig, bands.
    Members of the head's component, most of a hot bucket, are linked with each other already: they are dealt
    in blocks once, and the others meet them and each other, block by block. A first pass estimates all pairs of two blocks on the packed
    signatures and keeps the members that may link; these alone bring their texts to a second one, which
    tests the likely pairs on the full sets, likeliest first, but for those connected meanwhile. A pair is
    tested in its first common band.
    """
    main = F.col("component") == F.col("of_head")
    parts = lambda those: F.greatest(F.ceil(F.count(F.when(those, 1)) / BLOCK), F.ceil(F.sum(F.when(those, F.col("n"))) / BLOCK_SHINGLES), F.lit(1))
    weight = materialise(rows.groupBy("bucket").agg(parts(main).alias("mains"), parts(~main).alias("others")), "weight")
    dealt = rows.join(F.broadcast(weight) if small_enough(weight) else weight, "bucket")
    own = F.xxhash64("rep")
    dealt = dealt.withColumn("block", F.when(main, -F.pmod(own, "mains") - 1).otherwise(F.pmod(own, "others")))
    # The blocks that a member meets: for one of the head's component those of the others, for another all.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(main, F.lit(0)).otherwise(-F.col("mains")), F.col("others") - 1)))
    names = [c.split()[0] for c in PAIRED.split(", ")]
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *names[3:])

    def narrow(batches):
        for table in _groups(batches, 3):
            likely = _likely_within(table, percent)
            at = np.unique(np.array([k for _, a, b in likely for k in (a, b)], np.int64))
            if len(at):
                yield from table.take(pa.array(at)).to_batches()

    order = ("bucket", "i", "j", "rep")
    chosen = materialise(dealt.repartition("bucket", "i", "j").sortWithinPartitions(*order).mapInArrow(narrow, PAIRED), "chosen")
    ids = materialise(chosen.select(F.col("rep").alias("id")).distinct(), "ids")
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = materialise(semi_join(source, ids, "id").withColumnRenamed("id", "rep"), "texts")

    def run(batches):
        for table in _groups(batches, 3):
            yield _links(table, percent, size)

    links = materialise(chosen.join(texts, "rep").select(*names, "text").repartition("bucket", "i", "j").sortWithinPartitions(*order).mapInArrow(run, "x long, y long"), "links")
    drop(weight, chosen, ids, texts)
    return links


def _likely_within(table: pa.Table, percent: int) -> list[tuple[float, int, int]]:
    """See :func:`confirm_within`: (less the estimate, a, b) for the rows of two blocks that may link and have not been compared."""
    bucket, i, j, rep, block, head, component, n = (table.column(k).to_numpy() for k in range(8))
    lists = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    sig, bands = lists("sig").view(np.uint64), lists("bands")
    across, chance, fold, likely = i[0] != j[0], 1 / (1 << BITS), np.uint64(int(("0" * (BITS - 1) + "1") * (64 // BITS), 2)), []
    for a in range(len(rep) - 1):
        if rep[a] == head[a]:
            continue
        later = slice(a + 1, None)
        x = sig[later] ^ sig[a]
        y = x.copy()
        for k in range(1, BITS):
            y |= x >> np.uint64(k)
        different = np.bitwise_count(y & fold).sum(1, dtype=np.int64)
        estimate = (1 - different / PERMUTATIONS - chance) / (1 - chance)
        ok = (estimate >= percent / 100 - ESTIMATE_SLACK) & (component[later] != component[a]) & (rep[later] != head[a])
        ok &= (np.minimum(n[later], n[a]) * 100 >= np.maximum(n[later], n[a]) * percent) & ((block[later] != block[a]) | (not across))
        if ok.any():
            at = np.flatnonzero(ok)
            first = (bands[at + a + 1] == bands[a]).argmax(1)
            at = at[bands[a][first] == bucket[0]]
            likely += [(-estimate[k], a, int(k) + a + 1) for k in at]
    return likely


def _links(table: pa.Table, percent: int, size: int) -> pa.RecordBatch:
    """See :func:`confirm_within`; the members of two blocks that may link, with their texts."""
    likely = _likely_within(table, percent)
    rep, component, texts = table.column("rep").to_numpy(), table.column("component").to_numpy(), table.column("text").combine_chunks()
    likely.sort()
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c] = up.get(up[c], up[c])
        return c

    sets: dict[int, np.ndarray] = {}

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            raw, offsets = text_buffers(texts.slice(k, 1))
            sets[k] = shingle_sets(raw, offsets, size)[0]
        return sets[k]

    found = []
    for _, a, b in likely:
        ca, cb = root(int(component[a])), root(int(component[b]))
        if ca == cb:
            continue
        s, t = shingles(a), shingles(b)
        same = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
        if 100 * same >= percent * (len(s) + len(t) - same):
            up[max(ca, cb)] = min(ca, cb)
            found.append((int(rep[a]), int(rep[b])))
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["x", "y"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = LINK_PERCENT, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    own, row = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    signed = materialise(signatures(own, "text", row, size, BANDS if percent >= LINK_PERCENT else MOST_BANDS), "signatures")
    if "_written_at" not in own.__dict__:  # doc_id is the number
        out = _components(signed, own, row, percent, size)
        return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    names = materialise(own.select(row, F.col("doc_id").alias("id")), "names")
    nameless = names.filter("id is null").select(F.col(row).alias("doc_id"))
    named = _components(signed.join(names.filter("id is not null").select(F.col(row).alias("doc_id")), "doc_id", "left_semi"), own, row, percent, size)
    out = named.join(names.select(F.col(row).alias("doc_id"), "id"), "doc_id").join(names.select(F.col(row).alias("component_id"), F.col("id").alias("least")), "component_id")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    none = F.lit(None).cast("long")
    rest = signed.join(nameless, "doc_id", "left_semi").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)


def _components(signed: DataFrame, docs: DataFrame, row: str, percent: int, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id for :func:`signatures`'s rows of unique, non-null numbers."""
    some = signed.filter("n_shingles > 0")
    classes = materialise(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    first = classes.select(F.col("rep").alias("doc_id"))
    reps = materialise(some.join(first, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "bands"), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    heads = materialise(buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    # A hot bucket is no task's burden where the heads are broadcast; more of them are a plain side of a join that Spark can split.
    members = materialise(buckets.join(F.broadcast(heads) if small_enough(heads) else heads, "bucket"), "members")
    star = members.filter("rep != head").select(F.col("head").alias("x"), F.col("rep").alias("y")).distinct()
    tested = materialise(star, "star")
    likely = materialise(_likely(tested, reps, percent), "likely")
    links = confirm(likely, docs, "text", row, percent, size)
    found = components(links, "x", "y")

    # What the stars left out: pairs of one bucket in different components.
    labelled = members.filter("size > 2").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max(F.when(F.col("rep") == F.col("head"), F.col("component"))).alias("of_head"))
    mixed = materialise(mixed.filter("a != b").select("bucket", "of_head"), "mixed")
    open_rows = materialise(labelled.join(F.broadcast(mixed) if small_enough(mixed) else mixed, "bucket").join(reps, "rep"), "open")
    if not open_rows.isEmpty():
        links = links.unionByName(confirm_within(open_rows, docs, "text", row, percent, size))
        found = components(links, "x", "y")

    label = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").filter("copies > 1 or component is not null")
    label = materialise(label.select("hi", "lo", F.coalesce("component", "rep").alias("component")), "label")
    drop(classes, heads, members, tested, likely, mixed, open_rows, reps)
    # Empty sets share one digest and link with nothing: they pass by the join.
    linked = some.join(F.broadcast(label) if small_enough(label) else label, ["hi", "lo"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return linked.unionByName(signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
