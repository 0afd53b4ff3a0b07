"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures; bit counts bound the overlap from
above before sorted arrays are intersected. A signature's bits grow with its set, and two of different widths
are compared at the smaller one.

Documents of one shingle set are one class. Sets of a size band are cut into so many segments of the hash
range that two sets of the wanted similarity must agree in one of them that is not empty: their symmetric
difference has at most H shingles, and there are more than H segments. (A set with more empty segments than
there are to spare is entered under those too.) Sets that agree in a segment of a band form a tile.

In a tile every set is first compared with the tile's smallest; what links is one component. Only tiles that
still hold several components have their pairs across components compared as well, signature by signature
in blocks within tasks; a pair leaves its task only if the bound allows a link, and is then checked once.
So a tile of copies costs one comparison for each member, and no link between different sets is lost.

Tiles are found in one shuffle: each task sorts its own keys, keeps one set for each of them and passes on
the others as they are, so that a key that a third of the rows share brings one row for each task's block.

Edge cases: a null, empty or blank text has an empty set, which links with nothing, not even its like; with
fewer words than ``n`` the whole sequence is the one shingle; rows repeated are linked; very long
texts are worked through whole; columns other than doc_id and text are ignored; an empty table gives no rows. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm.common import TEXTS, Staging, documents
from cartoflux.llm.components import components

#: What op4 is asked for; the pipeline's stage takes five words and 80 instead.
WORDS, PERCENT = 4, 85
#: A signature has a power of two of bits: at least so many for each shingle, and at least so many in all.
BITS_EACH, LEAST_BITS = 4, 512
#: Sets of a tile that are compared with each other in one task.
TILE_BLOCK = 1024
#: Rows of pairs of blocks that one call compares, on average.
BUCKET_ROWS = 10_000
#: Each size band's largest size is so many times its smallest.
BAND_RATIO = 1.3
#: Keys that a task sorts at a time.
BLOCK_KEYS = 1_000_000


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: splits at space and 9 to 13, lower-cases A-Z
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-n])]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends[n - 1 :], strict=True)], np.uint64))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def signature(shingles: np.ndarray) -> bytes:
    width = max(LEAST_BITS, 1 << (BITS_EACH * len(shingles) - 1).bit_length()) if len(shingles) else LEAST_BITS
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(marks: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of words of one width in bytes; a wider one's parts are laid on one another."""
    out = np.empty((len(marks), width // 8), "<u8")
    for i, mark in enumerate(marks):
        words = np.frombuffer(mark, "<u8")
        out[i] = words if len(mark) == width else np.bitwise_or.reduce(words.reshape(-1, width // 8), axis=0)
    return out


class Bands:
    """Which segments sets of a size are cut into. A pair belongs to the band of its smaller set."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lowest = [1]

    def band(self, size: int) -> int:
        while self.lowest[-1] <= size:
            self.lowest.append(max(self.lowest[-1] + 1, int(self.lowest[-1] * BAND_RATIO)))
        return bisect_right(self.lowest, size) - 1

    def bands(self, size: int) -> range:
        """The bands of the smallest partner that a set of this size can have, up to its own."""
        return range(self.band(-(-self.percent * size // 100)), self.band(size) + 1)

    @lru_cache(maxsize=4096)  # noqa: B019  one for each process
    def cut(self, band: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Segments to spare for empty ones; the segments' borders; a salt for each."""
        self.band(self.lowest[band])
        high = self.lowest[band + 1] - 1
        both = high + 100 * high // self.percent
        # of a + b shingles, percent / (100 + percent) at least are common: what differs is at most
        differ = both * (100 - self.percent) // (100 + self.percent)
        # so many are empty by chance that hardly any set has more
        spare, low = 0, self.lowest[band]
        for _ in range(3):
            empty = (differ + 1 + spare) * np.exp(-low / (differ + 1 + spare))
            spare = int(np.ceil(empty + 3 * np.sqrt(empty))) if differ else 0
        count = differ + 1 + spare
        borders = np.array([(i << 64) // count for i in range(1, count)], np.uint64)
        salts = _mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 32))
        return spare, borders, salts


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def segment_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """A 48-bit key for each segment of each band that the set may meet a partner in."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(shingles), dtype=np.uint64)])
    out = []
    for band in bands.bands(len(shingles)):
        spare, borders, salts = bands.cut(band)
        at = np.concatenate([[0], np.searchsorted(shingles, borders), [len(shingles)]])
        full = np.diff(at) > 0
        if len(full) - full.sum() > spare:
            full[:] = True
        out.append(_mix(np.diff(sums[at]) ^ salts)[full] >> np.uint64(16))
    return np.concatenate(out)


def _tree(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key's smallest set (keys, sets), and the others hung on it (keys, sets, smallest)."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    keys, sets = keys[new], sets[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    hub = sets[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else sets
    return keys[first], sets[first], keys[~first], sets[~first], hub[~first]


_BLOCKS = "bucket int, kind int, x binary, y binary, z binary, nulls binary"
_ROWS = "kind int, x long, y long, z long"


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = ["bucket", "kind", "x", "y", "z", "nulls"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _scanner(n: int, percent: int, buckets: int):
    """Blocks of (documents: id, set, size), of (key, set) by the key's bucket, and of (key, set, smallest)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        docs, keys, sets, held, seen = [], [], [], 0, set()

        def flush():
            rows = []
            spread = int(docs[0][1]) % buckets
            ids, nulls, own, sizes = [np.array(c) for c in zip(*((i or 0, i is None, s, m) for i, s, m in docs), strict=True)]
            rows.append((spread, 0, ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), nulls.astype("u1").tobytes()))
            if keys:
                k, s, kept, others, hub = _tree(np.concatenate(keys).astype("<i8"), np.repeat(np.array(sets, "<i8"), [len(x) for x in keys]))
                if len(kept):
                    rows.append((spread, 1, kept.tobytes(), others.tobytes(), hub.tobytes(), b""))
                bucket = k % buckets
                order = np.argsort(bucket, kind="stable")
                k, s, bucket = k[order], s[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket)) + 1
                for kk, ss, b in zip(np.split(k, at), np.split(s, at), bucket[np.concatenate([[0], at])].tolist(), strict=True):
                    rows.append((b, 2, kk.tobytes(), ss.tobytes(), b"", b""))
            docs.clear(), keys.clear(), sets.clear(), seen.clear()
            return _blocks(rows)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py() or b"", n)
                own = set_id(shingles)
                docs.append((i, own, len(shingles)))
                if len(shingles) and own not in seen:
                    seen.add(own)
                    keys.append(segment_keys(shingles, bands))
                    sets.append(own)
                    held += len(keys[-1])
                if held >= BLOCK_KEYS or len(docs) >= 200_000:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return scan


def _gather(table: pa.Table) -> pa.Table:
    """A bucket's blocks: documents and hung sets as rows, and each key's sets hung on its smallest."""
    out, keys, sets = [[], [], [], []], [], []
    for kind, x, y, z, nulls in zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y", "z", "nulls")), strict=True):
        x, y, z = (np.frombuffer(v, "<i8") for v in (x, y, z))
        if kind == 2:
            keys.append(x)
            sets.append(y)
            continue
        missing = np.frombuffer(nulls, "u1").astype(bool) if kind == 0 else np.zeros(len(x), bool)
        for column, values in zip(out, (pa.array(np.full(len(x), kind, "i4")), pa.array(x, mask=missing), pa.array(y), pa.array(z)), strict=True):
            column.append(values)
    if keys:
        _, _, k, others, hub = _tree(np.concatenate(keys), np.concatenate(sets))
        for column, values in zip(out, (np.full(len(k), 1, "i4"), k, others, hub), strict=True):
            column.append(pa.array(values))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.chunked_array(c, k) for c, k in zip(out, kinds, strict=True)], names=["kind", "x", "y", "z"])


def _prepared(n: int):
    """(set, size, signature, text) of the documents that stand for a set; a repeated doc_id's other texts go."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, marks = [], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_set(text.as_py() or b"", n)
                keep.append(set_id(shingles) == own)
                sizes.append(len(shingles))
                marks.append(signature(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), batch.column(1)], names=["id", "n", "mark", "text"]
            ).filter(pa.array(keep))

    return prepare


def overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Each bit set on one side only stands for a shingle, at least, that the other side lacks."""
    alone = lambda x, y: np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - alone(a, b), nb - alone(b, a))


#: Rounds in which a tile's components are joined by best pairs, before all pairs across them are compared.
FORESTS = 2
#: Pairs, and bytes of signatures, that are compared at a time; pairs that are held before they are thinned out.
PAIRS, MARK_BYTES, HELD = 16_384, 1 << 21, 1 << 16


def _forest(pairs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of pairs (a, b, component of a, of b, share by the bound) those that would join components, best first: fewer
    than there are components. What is left of some pairs may be thinned out again with others."""
    columns = [np.concatenate(c) for c in zip(*pairs, strict=True)]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept, order = [], np.argsort(-columns[4], kind="stable")
    for k, of_a, of_b in zip(order.tolist(), columns[2][order].tolist(), columns[3][order].tolist(), strict=True):
        x, y = top(of_a), top(of_b)
        if x != y:
            root[x] = y
            kept.append(k)
    return tuple(c[kept] for c in columns)


def _once(pairs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([np.empty(0, np.int64), *(p[c] for p in pairs)]) for c in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _tile_pairs(percent: int, forest: bool):
    """Pairs of two blocks of a tile that are of different components and may link by the bound, for all the
    pairs of blocks of a bucket; all of them, or as many as join the components if all do link."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("i", "ascending"), ("j", "ascending")])
        ids, part, sizes = (table.column(c).to_numpy() for c in ("m", "c_m", "n"))
        tile, own, first, second = (table.column(c).to_numpy() for c in ("tile", "own", "i", "j"))
        listed = table.column("mark").to_pylist()
        new = (np.diff(tile) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
        out: list[tuple[np.ndarray, ...]] = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high == low:
                continue
            i, j = first[low], second[low]
            marks = folded(listed[low:high], min(map(len, listed[low:high])))
            step = max(1, min(PAIRS, MARK_BYTES // (8 * marks.shape[1])))
            left, right = low + np.flatnonzero(own[low:high] == i), low + np.flatnonzero(own[low:high] == j)
            found, held = [], 0
            for at in range(0, len(left), 64):
                rows = left[at : at + 64]
                # signatures are compared only for pairs whose sizes and components leave a link possible
                small = np.minimum(sizes[rows, None], sizes[None, right])
                near = (100 * small >= percent * np.maximum(sizes[rows, None], sizes[None, right])) & (part[rows, None] != part[None, right])
                near &= (i != j) | (ids[rows, None] > ids[None, right])
                a, b = np.nonzero(near)
                for part_at in range(0, len(a), step):
                    x, y = rows[a[part_at : part_at + step]], right[b[part_at : part_at + step]]
                    most = overlap_bound(marks[x - low], marks[y - low], sizes[x], sizes[y])
                    whole = sizes[x] + sizes[y] - most
                    k = np.flatnonzero(100 * most >= percent * whole)
                    x, y = x[k], y[k]
                    pair = (np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]))
                    found.append((*pair, part[x], part[y], most[k] / np.maximum(whole[k], 1)) if forest else pair)
                    held += len(k)
                    if forest and held > HELD:
                        found = [_forest(found)]
                        held = len(found[0][0])
            if found:
                out += [_forest(found)] if forest else found
        return pa.table([pa.array(c, pa.int64()) for c in _once(out)], names=["a", "b"])

    return compare


def _bounded(percent: int):
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            width, most = np.minimum([len(x) for x in a], [len(x) for x in b]), np.empty(len(batch), np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                most[at] = overlap_bound(folded([a[i] for i in at.tolist()], w), folded([b[i] for i in at.tolist()], w), na[at], nb[at])
            yield batch.select([0, 1]).filter(pa.array(100 * most >= percent * (na + nb - most)))

    return bounded


def _linked(n: int, percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=512)(lambda text: shingle_set(text, n))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = known(x.as_py()), known(y.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return linked


def _texts(ids: DataFrame, sets: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(id, n, mark, text) of the sets asked for."""
    chosen = sets.join(ids, "id").select("id", F.col("doc").alias("__doc"))
    found = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__doc"))).select("id", "text")
    return found.mapInArrow(_prepared(n), "id long, n long, mark binary, text binary")


def _side(held: DataFrame, end: str, *columns: str) -> DataFrame:
    return held.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])


def _links(near: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that link."""
    both = near.join(_side(held, "a", "text"), "a").join(_side(held, "b", "text"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_linked(n, percent), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the smallest doc_id that links lead to."""
    spark = docs.sparkSession
    stage = Staging(spark, "jaccard", TEXTS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    buckets = max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = texts.mapInArrow(_scanner(n, percent, buckets), _BLOCKS).groupBy("bucket").applyInArrow(_gather, _ROWS)
    found = stage.table(found, "found")
    listed = found.filter("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("id"), F.col("z").alias("n_shingles"))
    sets = stage.table(listed.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("doc")), "sets")
    tiles = found.filter("kind = 1").select(F.col("x").alias("tile"), F.col("y").alias("a"), F.col("z").alias("b"))

    # every set of a tile against the tile's smallest
    stars = stage.table(tiles.select("a", "b").distinct(), "stars")
    needed = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    held = stage.table(_texts(needed, sets, texts, n), "texts")
    near = stars.join(_side(held, "a", "mark", "n"), "a").join(_side(held, "b", "mark", "n"), "b")
    near = near.select("a", "b", "mark_a", "n_a", "mark_b", "n_b").mapInArrow(_bounded(percent), "a long, b long")
    near = stage.table(near.distinct(), "near")
    links = stage.table(_links(near, held, n, percent), "links")
    part = stage.table(components(links, stage, "c"), "part")

    def placed(df: DataFrame, end: str) -> DataFrame:
        known = part.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
        return df.join(known, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))

    # a tile hangs together, so it holds several components only if some set does not link with its hub
    apart = placed(placed(stars, "a"), "b").filter("c_a <> c_b").select("a", "b")
    mixed = tiles.join(apart, ["a", "b"]).select("tile").distinct()
    members = tiles.join(mixed, "tile")
    members = members.select("tile", F.col("a").alias("m")).unionByName(members.select("tile", F.col("b").alias("m"))).distinct()
    members = stage.table(members, "members")
    # sets that agree in many segments meet in as many tiles: of tiles of the same sets one is compared
    sizes = members.groupBy("tile").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("m")).alias("same"))
    chosen = stage.table(sizes.groupBy("size", "same").agg(F.min("tile").alias("tile")).select("tile", "size"), "tiles")
    members = stage.table(members.join(chosen, "tile"), "chosen")
    marked = held.select(F.col("id").alias("m"), "n", "mark").join(members.select("m").distinct(), "m").dropDuplicates(["m"])
    marked = stage.table(marked, "marked")
    # a large tile is compared block by block; each pair of blocks goes to one bucket, beside others
    rows = members.withColumn("blocks", F.ceil(F.col("size") / TILE_BLOCK).cast("int"))
    total = rows.agg(F.sum("blocks")).first()[0] or 0
    own = F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)

    def compared(part: DataFrame, forest: bool, name: str) -> DataFrame:
        known = marked.join(part.select(F.col("id").alias("m"), F.col("component").alias("c_m")), "m", "left").withColumn("c_m", F.coalesce("c_m", "m"))
        met = rows.join(known, "m").select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "m", "own", "c_m", "n", "mark")
        met = met.withColumn("bucket", F.pmod(F.xxhash64("tile", "i", "j"), F.lit(max(1024, total // BUCKET_ROWS))))
        across = stage.table(met.groupBy("bucket").applyInArrow(_tile_pairs(percent, forest), "a long, b long").distinct(), f"across{name}")
        more = stage.table(_links(across, held, n, percent), f"more{name}")
        edges = part.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        found = stage.table(components(edges, stage, f"d{name}"), f"whole{name}")
        stage.drop(f"across{name}", f"more{name}")
        return found

    # first only as many pairs as join the components if they link, so a group of many components that link with each
    # other is one before all pairs across what is left are compared
    for turn in range(FORESTS):
        part = compared(part, True, str(turn))
    whole = compared(part, False, "")
    stage.drop("stars", "texts", "near", "links", "part", "members", "tiles", "chosen", "marked", *[f"whole{t}" for t in range(FORESTS)])

    least = sets.join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = least.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = least.join(smallest, "component").select("id", "component_id")
    return listed.join(classes, "id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link to one of a smaller doc_id; of a doc_id repeated with one text
    one row stays, and rows without a doc_id all stay."""
    found = jaccard_components(docs.select("doc_id", "text"), n, percent)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("as"))
    once = rows.join(kept, F.col("of") == F.col("kept"), "left_semi").dropDuplicates(["of", "as"])
    return once.unionByName(rows.filter("of IS NULL")).select("row.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), WORDS, PERCENT)
