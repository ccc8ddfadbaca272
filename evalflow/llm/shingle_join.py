"""Exact n-gram Jaccard self-join by universe-partition pigeonhole.

A document is the set of its distinct word shingles. For the sizes of a
band, two sets that reach the similarity differ in at most H shingles.
Shingles are hashed into segments; with more than H segments some segment
is equal in both sets, and with a budget of H + 1 shared out as 1 for
"equal" and 2 for "at most one deletion", some segment keeps within its
share. A document signs its segments in each band that a partner's size
can put the pair in.

Allocation by cost: bands with H of 1 or 2 have segments so small that
equality says little, so their first segment is signed with its
one-deletion neighbourhood; the others use equality and have spare
segments. A document leaves its spare share to empty segments (never
signed) and to its most frequent signatures, whose buckets it need not
search: what it has left still exceeds H.

Buckets give candidates. Small ones give their pairs; of a large one each
member meets the member with most company elsewhere, after which only
documents that cannot spare the bucket meet those of other components
there, in tiles of bounded size that give out plausible pairs alone. So
copies of one passage or document are linked through few pairs, and no
link between components is lost. A pair is plausible if its sizes and its
parity sketches allow the similarity: every shingle flips one bit, so
sketches differ in no more bits than sets in shingles. A sketch has
``BITS`` bits, doubled while the set has half as many shingles again, up
to ``DOUBLINGS`` times; of two sketches the longer is folded to the other's
length.
Plausible pairs are verified on the full shingle sets: one of each set
first, then those that would still join components.

That gives components. A document's number of links takes more: both ends
of a link lie in one component, so ``linked_groups`` compares all pairs of
distinct sets within each, on the full sets, in tiles of two blocks that
give sums of links and never pairs. This is quadratic in the distinct sets
of a component.

Equal sets are one class from the start. Shingles are compared by 64-bit
hashes. Null and empty texts, and texts without words, have no shingles
and link with nothing; rows that share a doc_id are one document, and rows
without one have a component only through an equal set that has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalflow.llm.shared import components, in_filter, key_filter, returning, small_batches, step
from evalflow.llm.textbatch import Words, blocks, mix, shingle_sets, signed

SHINGLE, PERCENT = 4, 85
#: Sizes of a band grow by this factor.
BAND = 1.3
#: Members up to which a bucket gives all its pairs.
SMALL = 16
#: Bits of a small set's parity sketch, and how often they are doubled at most.
BITS, DOUBLINGS = 1024, 6
#: Members of a block, of a large bucket or component; a tile has two blocks.
BLOCK = 512
#: Shingles of a component's block, about.
BLOCK_SHINGLES = 1 << 21
#: Shingles that a tile compares at a time.
COLUMNS = 2048

_U = np.uint64


class Schemes:
    """Bands of set sizes and how each signs, for a similarity in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.upper = [6]
        while len(self.upper) < 110:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] * BAND)))
        self.most = [(100 - percent) * (u + 100 * u // percent) // (100 + percent) for u in self.upper]
        self.spare_empty = [1 + h // 24 if h > 2 else 0 for h in self.most]
        self.spare_hot = [1 + h // 16 if h > 2 else 0 for h in self.most]
        self.segments = [h if h <= 2 else h + 1 + a + b for h, a, b in zip(self.most, self.spare_empty, self.spare_hot)]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.upper, n, "left"))

    def bands(self, n: int) -> range:
        """Bands that the smaller set of a pair with one of n shingles can lie in."""
        return range(self.band(-(-self.percent * n // 100)), self.band(n) + 1)

    def signatures(self, shingles: np.ndarray) -> list[np.ndarray]:
        """Per band signatures; the last byte names the band."""
        out = []
        with np.errstate(over="ignore"):
            value = mix(shingles ^ _U(0x6A09E667F3BCC909))
            for b in self.bands(len(shingles)):
                h, m = self.most[b], self.segments[b]
                if not h:
                    continue
                salt = mix(np.array([b + 1], _U))[0]
                segment = (mix(shingles + salt) % _U(m)).astype(np.int64)
                total = np.zeros(m, _U)
                np.add.at(total, segment, value)
                code = mix(total ^ (mix(np.arange(m, dtype=_U) + salt)))
                if h > 2:
                    filled = np.bincount(segment, minlength=m) > 0
                    if m - filled.sum() <= self.spare_empty[b]:
                        code = code[filled]
                else:  # the first segment allows one deletion
                    less = total[0] - value[segment == 0]
                    code = np.unique(np.concatenate((code, mix(less ^ mix(salt + np.zeros(1, _U))))))
                out.append((code & ~_U(255)) | _U(b))
        return out


def class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums of hashes that identify each set."""
    with np.errstate(over="ignore"):
        return (
            np.array([mix(s).sum(dtype=_U) for s in sets], _U),
            np.array([mix(s ^ _U(0xBB67AE8584CAA73B)).sum(dtype=_U) for s in sets], _U),
        )


def keyed_sets(column: pa.Array, k: int):
    """Per block (first row, sets, keys)."""
    for row, data, offsets in blocks(column):
        sets = shingle_sets(Words(data, offsets), k)
        yield row, sets, *class_keys(sets)


def sketch_level(n: int) -> int:
    """How often the bits of a sketch of n shingles are doubled."""
    return min(DOUBLINGS, max(0, (2 * n - 1) // (3 * BITS)).bit_length())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits as int64 words; each shingle flips one."""
    bits = BITS << sketch_level(len(shingles))
    bit = (mix(shingles ^ _U(0x3C6EF372FE94F82B)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same set's sketch of so many words."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def classes(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, a, b, sketch): size, keys and parity sketch of every row's set."""

    def run(batches):
        for batch in batches:
            parts = [([len(s) for s in sets], signed(a), signed(b), [parity_sketch(s) for s in sets]) for _, sets, a, b in keyed_sets(batch.column(1), k)]
            n, a, b = (np.concatenate([np.asarray(p[j], np.int64) for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
            sketches = [s for p in parts for s in p[3]]
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b), lists], names=["doc_id", "n", "a", "b", "sketch"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(returning(run), f"doc_id {id_type}, n long, a long, b long, sketch array<long>")


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    one = reps.select("a", F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = reps.select(F.col("a").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    words = F.least(F.size("s1"), F.size("s2"))

    def fold(s: str) -> F.Column:  # sizes that allow the similarity lie within one doubling
        halves = F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(s) > words, halves).otherwise(F.col(s))

    differ = F.aggregate(F.zip_with(fold("s1"), fold("s2"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    sizes = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    return pairs.join(one, "a").join(two, "b").where(sizes & (differ * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent))).select("a", "b")


def tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): plausible pairs within a bucket, of different components, one of which needs the bucket.

    members: (sig, a, n, sketch, comp, needed). A bucket's members are dealt
    to blocks, and every two blocks meet in a tile.
    """
    blocks_ = members.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.hash("a"), F.col("blocks"))
    dealt = (
        members.join(blocks_, "sig")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own") == F.least("own", "other"), "a", "n", "sketch", "comp", "needed")
        .toDF("sig", "x", "y", "first", "a", "n", "sketch", "comp", "needed")
    )

    def tile(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).to_numpy()
        first, same = col("first"), group.column("x")[0] == group.column("y")[0]
        _, comp = np.unique(col("comp"), return_inverse=True)
        key, n, needed = col("a"), col("n"), col("needed").astype(bool)
        sketches = [np.asarray(x.values).view(_U) for chunk in group.column("sketch").chunks for x in chunk]
        size = np.array([len(x) for x in sketches])
        # every sketch at its own length and folded to the shorter ones that others have
        at = {w: np.array([folded(x, w) if len(x) >= w else np.zeros(w, _U) for x in sketches]) for w in np.unique(size).tolist()}
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        out = [np.zeros((0, 2), np.int64)]
        for i in left:
            j = right[right > i] if same else right
            j = j[(comp[j] != comp[i]) & (needed[j] | needed[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent)]
            differ = np.zeros(len(j), np.int64)
            common = np.minimum(size[j], size[i])
            for w in np.unique(common).tolist():
                of = common == w
                differ[of] = np.bitwise_count(at[w][j[of]] ^ at[w][i]).sum(1, dtype=np.int64)
            j = j[differ * (100 + percent) <= (n[j] + n[i]) * (100 - percent)]
            out.append(np.stack((np.minimum(key[i], key[j]), np.maximum(key[i], key[j])), 1))
        a, b = np.concatenate(out).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("sig", "x", "y").applyInArrow(tile, "a long, b long")


def signature_rows(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, a) of every set, equal sets once for each task."""

    def run(batches):
        schemes, seen = Schemes(percent), set()
        for batch in batches:
            for _, sets, a, b in keyed_sets(batch.column(0), k):
                sigs, owners = [], []
                for s, x, y in zip(sets, a.tolist(), b.tolist()):
                    if len(s) and (x, y) not in seen:
                        seen.add((x, y))
                        found = schemes.signatures(s)
                        sigs += found
                        owners.append((x, sum(map(len, found))))
                if sigs:
                    owner = np.repeat(np.array([x for x, _ in owners], _U), [c for _, c in owners])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(signed(owner))], names=["sig", "a"])

    return documents.select("text").mapInArrow(returning(run), "sig long, a long")


def packed_texts(documents: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(a, b, n, z): zstd text of every set that may be among ``wanted`` (a), equal sets once for each task."""
    maybe = documents.sparkSession.sparkContext.broadcast(key_filter(wanted, "a"))

    def run(batches):
        seen, pack = set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            column = batch.column(0)
            for row, sets, a, b in keyed_sets(column, k):
                out = []
                for i in np.flatnonzero(in_filter(maybe.value, signed(a))).tolist():
                    s, x, y = sets[i], int(a[i]), int(b[i])
                    if len(s) and (x, y) not in seen:
                        seen.add((x, y))
                        out.append((i, len(s), pack.compress(column[row + i].as_py().encode())))
                if out:
                    at = [i for i, _, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(a[at])), pa.array(signed(b[at])), pa.array([n for _, n, _ in out], pa.int64()), pa.array([z for *_, z in out], pa.binary())],
                        names=["a", "b", "n", "z"],
                    )

    return documents.select("text").mapInArrow(returning(run), "a long, b long, n long, z binary")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): ids of the pairs (a, b of set keys) whose sets reach the similarity."""
    left = texts.select("a", F.col("rep").alias("u"), F.col("z").alias("z1"))
    right = texts.select(F.col("a").alias("b"), F.col("rep").alias("v"), F.col("z").alias("z2"))
    joined = pairs.join(left, "a").join(right, "b").select("u", "v", "z1", "z2")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        sets: dict[bytes, np.ndarray] = {}

        def set_of(z: bytes) -> np.ndarray:
            if z not in sets:
                if len(sets) > 256:
                    sets.clear()
                text = pa.array([unpack.decompress(z)], pa.large_binary())
                sets[z] = next(s[0] for _, s, _, _ in keyed_sets(text, k))
            return sets[z]

        for batch in batches:
            keep = []
            for i in range(len(batch)):
                x, y = set_of(batch.column(2)[i].as_py()), set_of(batch.column(3)[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    id_type = texts.schema["rep"].dataType.simpleString()
    return joined.mapInArrow(returning(run), f"a {id_type}, b {id_type}")


def settled(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets (``classes``), the distinct sets (a, b, n, rep, sketch) and the components (node, component) of their reps."""
    rows = step(classes(small_batches(documents), k), "join-classes")
    reps = step(rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")).where("rep is not null"), "join-sets")

    # Buckets: of a small one its members, of a large one a row for each.
    same = Window.partitionBy("sig")
    spread = signature_rows(documents, k, percent).select(
        "sig", "a", F.min("a").over(same).alias("low"), F.max("a").over(same).alias("high"), F.count("*").over(same).alias("cost")
    )
    buckets = step(
        spread.where("low <> high")
        .groupBy("sig", F.when(F.col("cost") > SMALL, F.col("a")).alias("big"))
        .agg(F.array_sort(F.collect_set("a")).alias("members"), F.first("cost").alias("cost"))
        .withColumn("sig", F.when(F.col("big").isNotNull(), F.col("sig"))),
        "join-buckets",
    )
    members = buckets.where("big is null").select("members").distinct()
    inside = members.select(
        F.explode(
            F.flatten(
                F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
            )
        ).alias("p")
    ).select("p.a", "p.b")
    large = buckets.where("big is not null").select("sig", F.col("big").alias("a"), "cost")
    company = large.groupBy("a").agg(F.sum("cost").alias("company"))
    centre = large.join(company, "a").groupBy("sig").agg(F.max(F.struct("company", "a")).alias("c")).select("sig", F.col("c.a").alias("centre"))
    starred = large.join(centre, "sig").where("a <> centre").select(F.least("a", "centre").alias("a"), F.greatest("a", "centre").alias("b"))
    pairs = step(plausible(inside.union(starred).distinct(), reps, percent).distinct(), "join-pairs")

    # First each set meets its plausible partner of most company; then, of the other pairs, those of different components.
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    best = both.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("degree", "b")).alias("m"))
    first = best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()

    def texts_of(found: DataFrame) -> DataFrame:
        wanted = found.select("a").union(found.select(F.col("b").alias("a"))).distinct()
        keyed = packed_texts(documents, k, wanted).join(wanted, "a").join(reps.drop("sketch"), ["a", "b", "n"])
        return keyed.dropDuplicates(["a", "b", "n"])

    first = step(first, "join-pairs")
    edges = step(verified(first, step(texts_of(first), "join-texts"), k, percent), "join-links")
    linked = components(edges, "join-components")

    # Large buckets: who cannot spare them meets the other components there.
    spare = F.array(*(F.lit(s) for s in Schemes(percent).spare_hot))
    band = F.col("sig").bitwiseAND(F.lit(255)).cast("int")
    ranked = large.withColumn("band", band).withColumn(
        "needed", F.row_number().over(Window.partitionBy("a", "band").orderBy(F.col("cost").desc(), "sig")) > F.get(spare, F.col("band"))
    )
    tight = ranked.groupBy("a", "band").agg(F.max("needed").alias("tight")).where("tight").select("a", "band")
    placed = reps.select("a", "rep", "n", "sketch").join(linked, F.col("rep") == F.col("node"), "left").select("a", "n", "sketch", F.coalesce("component", "rep").alias("comp"))
    of = placed.select("a", "comp")
    apart = pairs.join(of, "a").withColumnRenamed("comp", "x").join(of.withColumnRenamed("a", "b"), "b").where("x <> comp").select("a", "b")
    held = step(ranked.join(tight, ["a", "band"]).join(placed, "a").select("sig", "a", "n", "sketch", "comp", "needed"), "join-tight")
    mixed = held.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
    rest = step(apart.union(tile_pairs(held.join(mixed, "sig"), percent)).distinct(), "join-pairs")
    if not rest.isEmpty():
        more = step(verified(rest, step(texts_of(rest), "join-texts"), k, percent), "join-links")
        linked = components(edges.union(more), "join-components")

    return rows, reps, linked


def named(rows: DataFrame, sets: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` with what ``sets`` say of their sets, n_shingles and component_id."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    joined = rows.join(sets, ["a", "b", "n"], "left").join(linked, F.col("rep") == F.col("node"), "left")
    return joined.withColumn("n_shingles", F.col("n")).withColumn("component_id", component)


def similar_groups(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``documents``."""
    rows, reps, linked = settled(documents, k, percent)
    return named(rows, reps.drop("sketch"), linked).select("doc_id", "n_shingles", "component_id")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of ``left`` reach the similarity with which of ``right``, or of ``left`` itself."""
    sets, rows = left + (right or []), len(left)
    size = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    kept = often[code]
    row, column = np.repeat(np.arange(len(sets)), size)[kept], (np.cumsum(often) - 1)[code[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    starts = np.arange(0, int(often.sum()), COLUMNS)
    ends = np.searchsorted(column, starts + COLUMNS)
    both = np.zeros((rows, len(right or left)), np.float32)  # exact up to 2^24 shingles
    for start, low, high in zip(starts.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        held = np.zeros((len(sets), min(COLUMNS, int(column[high - 1]) + 1 - start)), np.float32)
        held[row[low:high], column[low:high] - start] = 1
        both += held[:rows] @ (held[rows:] if right else held).T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:rows, None] + (size[rows:] if right else size)[None, :] - both)


def set_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, links): with how many documents of other sets each set is linked, by tile.

    members: (comp, comp_blocks, a, b, copies, z), the sets of components
    with more than one. The sets of a component of one block meet in a bin
    that other components share; a larger component's are dealt to blocks,
    and every two blocks meet in a tile. So each pair meets once.
    """
    one = F.col("comp_blocks") == 1
    bins = max(1, -(-members.where(one).count() // BLOCK))
    own = F.when(one, 0).otherwise(F.pmod(F.hash("a", "b"), "comp_blocks"))
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("comp_blocks") - 1)))
        .select(
            one.alias("shared"), F.when(one, F.pmod("comp", F.lit(bins))).otherwise(F.col("comp")).alias("place"),
            F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("first"), "comp", "a", "b", "copies", "z",
        )
    )

    def tile(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        texts = pa.array([unpack.decompress(z) for z in group.column("z").to_pylist()], pa.large_binary())
        sets = [s for _, found, _, _ in keyed_sets(texts, k) for s in found]
        comp, first, copies = (group.column(c).to_numpy() for c in ("comp", "first", "copies"))
        same = group.column("x")[0] == group.column("y")[0]
        links = np.zeros(len(sets), np.int64)
        order = np.argsort(comp, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            left, right = (at, at) if same else (at[first[at]], at[~first[at]])
            if not len(left) or not len(right):
                continue
            near = similar([sets[i] for i in left], None if same else [sets[i] for i in right], percent)
            if same:
                np.fill_diagonal(near, False)
            else:
                links[right] += near.T @ copies[left]
            links[left] += near @ copies[right]
        found = np.flatnonzero(links)
        return pa.table({"a": group.column("a").take(pa.array(found)), "b": group.column("b").take(pa.array(found)), "links": pa.array(links[found])})

    return dealt.groupBy("shared", "place", "x", "y").applyInArrow(tile, "a long, b long, links long")


def linked_groups(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each row of ``documents``.

    n_links is the number of other documents whose sets reach the
    similarity, equal sets included; a doc_id with several sets counts once
    for each.
    """
    rows, reps, linked = settled(documents, k, percent)
    ids = rows.where("n > 0 and doc_id is not null").select("a", "b", "n", "doc_id").distinct()
    copies = ids.groupBy("a", "b", "n").agg(F.count("*").alias("copies"))
    sets = step(reps.drop("sketch").join(copies, ["a", "b", "n"]), "join-sets")
    of = sets.join(linked, F.col("rep") == F.col("node"), "left").withColumn("comp", F.xxhash64(F.coalesce("component", "rep"))).drop("node", "component")
    size = of.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks_ = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = step(of.join(size.select("comp", blocks_.alias("comp_blocks")), "comp"), "join-members")
    texts = packed_texts(documents, k, wanted).join(wanted.drop("rep"), ["a", "b", "n"]).dropDuplicates(["a", "b", "n"])
    found = step(set_links(step(texts, "join-texts"), k, percent), "join-links")
    near = found.groupBy("a", "b").agg(F.sum("links").alias("links"))
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0)) - F.when(F.col("copies").isNotNull() & F.col("doc_id").isNotNull(), 1).otherwise(0)
    return named(rows, sets.join(near, ["a", "b"], "left"), linked).select("doc_id", "n_shingles", "component_id", n_links.cast("long").alias("n_links"))
