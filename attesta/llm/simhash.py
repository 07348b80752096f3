"""SimHash near-dedup with BK-trees over shards of fingerprints.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's word shingles. Two fingerprints that differ in at
most three bits agree in at least one of their four 16-bit bands, so each distinct fingerprint goes to four shards, one
for each band's value, and every link lies within a shard. Each shard gets a BK-tree (children keyed by their integer
Hamming distance to the parent), and a search follows only edges within the radius of the distance found. Trees of all
shards of a task are built and searched level by level with numpy. The shards are dealt by a shuffle and each tree
stays in the task that built it: broadcasting them would send the fingerprints of all documents through the driver. A
shard of more than ``SHARD_ROWS`` fingerprints is split again by four bands of its other bits, which loses no link.

Copies never multiply: trees hold distinct fingerprints, a shard reports a star for each group it connects (fewer rows
than fingerprints), and the stars are joined to components by alternating large-star and small-star rounds, each
written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; component_id is the
smallest non-null doc_id reachable, null if there is none; rows that repeat a doc_id each get a row; other columns are
ignored by :func:`near_groups`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, checked_broadcast, lean

#: Words of a shingle; bits that may differ; fingerprints of a shard before it is split; tree visits held at once.
WORDS, RADIUS, SHARD_ROWS, VISITS = 3, 3, 100_000, 2_000_000
#: The wide form: words of a shingle; bits of 128 that may differ; tables of sampled bits, as many at every size; rows
#: of a token up to which its pairs are formed without a look at their parities.
WIDE_WORDS, WIDE_RADIUS, WIDE_TABLES, FEW = 5, 26, 12, 32
#: Share of all shingle hashes up to which what links carry with them is on disk at a time; more links go in parts.
CARRIED = 0.25


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of UTF-8 text. ``bytes.lower`` and ``bytes.split`` know ASCII letters and ``[\\x20\\x09-\\x0D]`` alone."""
    parts = text.lower().split()
    if not parts:
        return 0
    n, counts, digest = max(1, len(parts) - words + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        shingles = zip(*(parts[start + i : stop + i] for i in range(words)), strict=False) if len(parts) >= words else [parts]
        h = np.fromiter([digest(b" ".join(s), 42) for s in shingles], np.uint64, stop - start)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class Forest:
    """BK-trees of many shards. ``shard`` is sorted; fingerprints (rows of 64-bit words) within a shard are distinct."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius, n = fps.reshape(-1, 1) if fps.ndim == 1 else fps, radius, len(shard)
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.size = np.repeat(np.diff(np.r_[edge, n]), np.diff(np.r_[edge, n]))
        self.root = np.repeat(edge, np.diff(np.r_[edge, n]))
        codes, children, self.above = [], [], []
        nodes, head = np.arange(n), self.root
        while (rest := nodes != head).any():
            nodes, head = nodes[rest], head[rest]
            d = self._distance(nodes, head)
            self.above.append((nodes[d <= radius], head[d <= radius]))
            code = head * 1024 + d
            order = np.argsort(code, kind="stable")
            nodes, code = nodes[order], code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            codes.append(code[first])
            children.append(nodes[first])
            head = np.repeat(nodes[first], np.diff(np.r_[first, len(nodes)]))
        code, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, children))
        order = np.argsort(code)
        self.code, self.child = code[order], child[order]

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(1, np.int64)

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, of each query and the other nodes of its own shard."""
        q, node = queries, self.root[queries]
        while len(q):
            d = self._distance(q, node)
            hit = (d <= self.radius) & (q != node)
            yield q[hit], node[hit]
            lo = np.searchsorted(self.code, node * 1024 + np.maximum(d - self.radius, 0))
            n = np.searchsorted(self.code, node * 1024 + d + self.radius, "right") - lo
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def _search(self, label: np.ndarray, queries: np.ndarray, visits: int) -> np.ndarray:
        cost = np.cumsum(self.size[queries])
        for part in np.split(queries, np.flatnonzero(np.diff(cost // visits)) + 1) if len(queries) else []:
            for a, b in self.near(part):
                label = _connected(label, a, b)
        return label

    def groups(self, visits: int = VISITS) -> np.ndarray:
        """For each node the first node of its group: those connected by links within its shard.

        Nodes are first linked to the parents and further ancestors within the radius. Nodes without any search the
        tree. Then a shard's largest group is settled, as each pair with a node outside it is found from there: only
        nodes outside search. A dense group of near copies is so joined without all its pairs.
        """
        n = len(self.fps)
        label, free = np.arange(n), self.size > 1
        for a, b in self.above:
            label = _connected(label, a, b)
            free[a] = False
        label = self._search(label, np.flatnonzero(free), visits)
        count = np.bincount(label, minlength=n)
        order = np.lexsort((count[label], self.root))
        last = np.flatnonzero(np.r_[self.root[order][1:] != self.root[order][:-1], True]) if n else order
        largest = np.zeros(n, np.int64)
        largest[self.root[order[last]]] = label[order[last]]
        return self._search(label, np.flatnonzero((label != largest[self.root]) & ~free & (self.size > 1)), visits)

    def stars(self, visits: int = VISITS) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is connected to an earlier one of its shard, with the first of its group."""
        label = self.groups(visits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return self.fps[moved], self.fps[label[moved]]


def _connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def _stars(radius: int, width: int):
    """A function over rows (shard, fp) sorted by shard: whole shards are taken together, the last waits for more."""

    def words(column: pa.Array) -> np.ndarray:
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)
        return column.to_numpy().view(np.uint64).reshape(-1, 1)

    def column(fps: np.ndarray, binary: bool) -> pa.Array:
        return pa.array([x.tobytes() for x in fps], pa.binary()) if binary else pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fps, binary = np.zeros(0, np.int64), np.zeros((0, width), np.uint64), width > 1

        def out(n: int) -> pa.RecordBatch:
            u, v = Forest(shard[:n], fps[:n], radius).stars()
            return pa.RecordBatch.from_arrays([column(u, binary), column(v, binary)], ["u", "v"])

        for batch in batches:
            shard = np.concatenate([shard, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, words(batch.column(1))])
            if len(shard) > 200_000 and shard[0] != shard[-1]:
                n = int(np.searchsorted(shard, shard[-1]))
                yield out(n)
                shard, fps = shard[n:], fps[n:]
        yield out(len(shard))

    return run


def _bits(col, at: int, width: int):
    return F.shiftrightunsigned(col, at).bitwiseAND(F.lit((1 << width) - 1))


def shards(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, fp) of distinct fingerprints ``fp``. There are at most 2**18 first-level shards, whatever the input."""
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(b << 16).cast("bigint") + _bits("fp", 16 * b, 16) for b in range(4)])).alias("shard"))
    large = F.broadcast(rows.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.lit(True).alias("large")))
    band = F.shiftright("shard", 16).cast("int") * 16
    # The 48 bits without the band's own: those above it are moved down over it.
    below = F.expr("fp & (shiftleft(1L, cast(shiftright(shard, 16) as int) * 16) - 1)")
    above = F.expr("if(shiftright(shard, 16) = 3, 0L, shiftrightunsigned(fp, cast(shiftright(shard, 16) as int) * 16 + 16))")
    other = below.bitwiseOR(F.expr("0L") + F.call_function("shiftleft", above, band))
    finer = F.array(*[F.lit(1 << 40).cast("bigint") + F.col("shard") * (1 << 14) + F.lit(b << 12) + _bits(other, 12 * b, 12) for b in range(4)])
    return rows.join(large, "shard", "left").select(F.explode(F.when(F.col("large"), finer).otherwise(F.array("shard"))).alias("shard"), "fp")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, root): for each node of ``edges (u, v)`` but the roots, the smallest node connected with it.

    Least neighbours are written before they are joined back: both sides of each join are then plain tables, and Spark
    can split the rows of a node with very many neighbours. The rounds end when all edges lead to nodes that have none.
    """

    def least(e: DataFrame) -> DataFrame:
        return scratch.keep(e.groupBy("u").agg(F.min("v").alias("m")))

    def several(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")

    down = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not down.join(down.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or not several(down).isEmpty():
        # Large star: each node hands its larger neighbours to its least one. An edge is seen from its smaller end.
        near = least(down.select(F.col("v").alias("u"), "v").unionByName(down))
        large = down.join(near.withColumnRenamed("u", "v"), "v").select("u", F.least("v", "m").alias("v"))
        large = scratch.keep(large.distinct())
        # Small star: each node hands its smaller neighbours, and itself, to its least one.
        small = least(large)
        joined = large.join(small, "u")
        moved = small.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, down = down, scratch.keep(moved.distinct())
        for done in (old, near, large, small):
            scratch.drop(done)
    return down.select("u", F.col("v").alias("root"))


def _settle(prints: DataFrame, classes: DataFrame, stars: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, fp, component_id from fingerprints (doc_id, fp), their classes (fp, first) and the links."""
    found = components(stars, scratch)
    found = found.unionByName(found.select(F.col("root").alias("u"), "root").distinct())
    linked = scratch.keep(classes.join(found.withColumnRenamed("u", "fp"), "fp").select("fp", "first", "root"))
    # Written, so that the joins deal plain tables and Spark can split the rows of a common root or fingerprint.
    least = scratch.keep(linked.groupBy("root").agg(F.min("first").alias("least")))
    linked = linked.join(least, "root").select("fp", "least")
    known = scratch.keep(classes.join(linked, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    scratch = scratch or Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    dealt = shards(classes.select("fp"), shard_rows)
    stars = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "fp").mapInArrow(lean(_stars(RADIUS, 1)), "u bigint, v bigint")
    return _settle(prints, classes, stars, scratch)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of a text, all at once: sums over a word of its bytes' numbers times powers of a base."""

    BASE, CHUNK = 0x9E3779B97F4A7C15, 1 << 20
    _SPACE = re.compile(rb"[ \t-\r]")

    def __init__(self):
        rng = np.random.default_rng(42)
        self.numbers = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
        self.space = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        back = pow(self.BASE, -1, 1 << 64)
        self.powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (self.BASE, back))

    def __call__(self, text: bytes) -> np.ndarray:
        text, at, out = text.lower(), 0, []
        while at < len(text):
            cut = self._SPACE.search(text, at + self.CHUNK) if len(text) > at + self.CHUNK else None
            end = cut.start() if cut else len(text)
            out.append(self._words(np.frombuffer(text, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _words(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self._powers(2 * len(data))
        blank = np.r_[True, self.space[data], True]
        start, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        total = np.r_[np.uint64(0), np.cumsum(self.numbers[data] * self.powers[: len(data)])]
        return _mixed((total[end] - total[start]) * self.inverse[start])


def wide_shingles(text: bytes, words: int = WIDE_WORDS, hasher: WordHasher | None = None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles, each of the hashes of its words in their order."""
    h = (hasher or WordHasher())(text)
    if not len(h):
        return h
    width = min(words, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total += h[i : len(h) - width + 1 + i] * np.uint64(WordHasher.BASE * (2 * i + 1) % (1 << 64))
        total = (total << np.uint64(23)) | (total >> np.uint64(41))
    total = np.sort(_mixed(total))
    return total[np.r_[True, total[1:] != total[:-1]]]


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """128 majority bits over a text's distinct shingles, so that the share of equal bits follows their Jaccard index."""
    counts = np.zeros(128, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        h = hashes[start : start + (1 << 15)]
        both = np.stack([h, _mixed(h ^ np.uint64(0x5851F42D4C957F2D))], 1)
        counts += np.unpackbits(both.view(np.uint8), axis=1).sum(0, np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def sampled_keys(n: int, tables: int = WIDE_TABLES) -> list[list[int]]:
    """Bit places of each table, for ``n`` fingerprints. Keys grow with log2(n), so that shards do not; tables do not grow.

    Texts that differ in a few words agree in most tables; pairs near the threshold meet in few, and those that meet in
    none are left to the prefix filter.
    """
    bits = max(16, math.ceil(math.log2(max(2, n))) - 6)
    rng = np.random.default_rng(42)
    return [sorted(rng.choice(128, bits, replace=False).tolist()) for _ in range(tables)]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard index of two sorted sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _parity(hashes: np.ndarray) -> bytes:
    """1024 bits, each the parity of the hashes that fall on it: two maps differ in at most as many bits as the sets do."""
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & 1023, minlength=1024) & 1).astype(np.uint8)).tobytes()


def _long_parity(hashes: np.ndarray) -> bytes | None:
    """As :func:`_parity` on two bits a hash or more, as 1024 are all alike for long texts; None for up to 512 hashes."""
    if len(hashes) <= 512:
        return None
    width = 1 << (2 * len(hashes) - 1).bit_length()
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def _long_match(a: bytes, b: bytes, both: int) -> bool:
    """As :func:`_may_match` for two maps of :func:`_long_parity`; the larger is folded to the smaller. ``both``: hashes of both."""
    a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= both


def _parts(links: DataFrame, most: float, each) -> list[DataFrame]:
    """``links (u, v, n_u, n_v)`` in parts of about ``most`` bytes, at ``each`` bytes a shingle of both ends."""
    size = links.agg(F.coalesce(F.sum(F.col("n_u") + F.col("n_v")), F.lit(0))).first()[0] * each
    n = max(1, math.ceil(size / max(most, 1)))
    return [links.where(F.pmod(F.xxhash64("u"), F.lit(n)) == i) if n > 1 else links for i in range(n)]


def _hashed(rows: DataFrame) -> DataFrame:
    """(id, hashes) of rows (text): the name of a shingle set and its sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, len(batch), 256):
                sets = [wide_shingles(t or b"", WIDE_WORDS, hasher) for t in batch.column(0).slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(_names(sets)), pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "hashes"])

    return rows.select("text").mapInArrow(lean(run), "id bigint, hashes binary")


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)


def _verified(links: DataFrame, classes: DataFrame, base: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """The ``links (u, v, n_u, n_v)`` of sets with a Jaccard index of 0.8 or more.

    ``classes``: (id, th) with the hash of one text of each set; ``base``: (text, th). Only linked texts are read again,
    in parts of links that carry about ``most`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    out = []
    for part in _parts(links, most, 8):
        ends = scratch.keep(part.select(F.col("u").alias("id")).unionByName(part.select(F.col("v").alias("id"))).distinct())
        wanted = scratch.keep(classes.join(checked_broadcast(ends), "id", "left_semi").select("th"))
        held = scratch.keep(_hashed(base.join(checked_broadcast(wanted), "th", "left_semi").dropDuplicates(["th"])).dropDuplicates(["id"]))
        pairs = part.select("u", "v").join(held.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u")
        pairs = pairs.join(held.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v").select("u", "v", "a", "b")
        out.append(scratch.keep(pairs.mapInArrow(lean(run), "u bigint, v bigint")))
        for done in (ends, wanted, held):
            scratch.drop(done)
    return reduce(DataFrame.unionByName, out)


def _place_counts(counted: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of 2**16 places; common shingles stand out at any size.

    ``counted``: one row a task, ``counts`` with its number for each place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << 16)), pa.array(total)], ["place", "n"])

    counted = counted.select("counts").mapInArrow(lean(run), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[counted["place"].to_numpy()] = counted["n"].to_numpy()
    return out


def _runs(make):
    """A function over batches sorted by their first column: ``make`` gets columns of whole runs and gives pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            token = table.column(0).to_numpy()
            n = int(np.searchsorted(token, token[-1])) if len(token) else 0
            if n:
                yield from make(table.slice(0, n))
            rest = table.slice(n)
        if rest is not None and len(rest):
            yield from make(rest)

    return run


def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(token, id, many) of the tokens with more than one id; ``many`` if they are more than ``FEW``."""
    token, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
    new = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])]
    token, ids = token[new], ids[new]
    edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    some = size > 1
    yield pa.RecordBatch.from_arrays([pa.array(token[some]), pa.array(ids[some]), pa.array(size[some] > FEW)], ["token", "id", "many"])


def _pairs_of_few(token: np.ndarray, ids: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a token's ids in different groups whose sizes allow an index of 0.8; at most ``FEW`` ids a token."""
    order = np.lexsort((size, token))
    token, ids, group, size = token[order], ids[order], group[order], size[order]
    found, at = [], np.arange(len(token))
    for step in range(1, FEW):
        at = at[at + step < len(token)]
        # Sizes ascend within a token: once one is too large for a row, all behind it are.
        at = at[(token[at] == token[at + step]) & (5 * size[at] >= 4 * size[at + step])]
        if not len(at):
            break
        here = at[group[at] != group[at + step]]
        a, b = ids[here], ids[here + step]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a minimum spanning forest over the groups of ``label``; of equal weights the first goes."""
    order = np.argsort(weight, kind="stable")
    kept, rest = [], np.arange(len(order))
    while True:
        x, y = label[a[order[rest]]], label[b[order[rest]]]
        rest, x, y = rest[x != y], x[x != y], y[x != y]
        if not len(rest):
            return order[np.sort(np.concatenate(kept))] if kept else order[:0]
        least = np.full(len(label), len(order))
        np.minimum.at(least, np.concatenate([x, y]), np.concatenate([rest, rest]))
        kept.append(np.unique(least[least < len(order)]))
        label = _connected(label, a[order[kept[-1]]], b[order[kept[-1]]])


def _across(whole: bool):
    """A function over tables (token, id, grp, n, bits): (u, v) of each token's ids in different groups whose sizes, and
    parities if they are many, allow an index of 0.8.

    ``whole``: all pairs of tokens of many ids, else a spanning forest of them, of the likeliest: as many as ids at most.
    """

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, ids, group, size = (table.column(i).to_numpy() for i in range(4))
        many = table.column(4).is_valid().to_numpy()
        u, v = _pairs_of_few(token[~many], ids[~many], group[~many], size[~many])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if not many.any():
            return
        token, ids, group, size = (x[many] for x in (token, ids, group, size))
        bits = np.frombuffer(b"".join(table.column(4).drop_null().to_pylist()), "<u8").reshape(-1, 16)
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for a, b in _pairs_of_many(group[lo:hi], size[lo:hi], bits[lo:hi], whole):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][a]), pa.array(ids[lo:hi][b])], ["u", "v"])

    return run


def _pairs_of_many(group: np.ndarray, size: np.ndarray, bits: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of :func:`_across` of one token, as places, in pieces."""
    _, first, place, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    # Each pair of two groups has an end outside the largest; of two such ends the earlier one looks for the other.
    rank = np.where(place == count.argmax(), len(group), np.arange(len(group)))
    parts, held = [], 0

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        some = slice(None) if whole else _forest(first[place], a, b, weight)
        return a[some], b[some], weight[some]

    for i in np.flatnonzero(rank < len(group)).tolist():
        j = np.flatnonzero((rank > i) & (group != group[i]) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])))
        j = j[_may_match(bits[j], bits[i], size[j], size[i])]
        if len(j):
            parts.append((np.full(len(j), i), j, np.bitwise_count(bits[j] ^ bits[i]).sum(1, np.int64) / (size[j] + size[i])))
            held += len(j)
        if held > 100_000 + 2 * len(group):
            a, b, weight = taken()
            if whole:
                yield a, b
            # A forest of all pairs lies within the forest of some and the other pairs.
            parts = [] if whole else [(a, b, weight)]
            held = 0 if whole else len(a)
    if parts:
        yield taken()[:2]


def _may_match(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether parities allow an index of 0.8: then at most a ninth of both sizes is in one set alone."""
    return 9 * np.bitwise_count(a ^ b).sum(1, np.int64) <= n + m


def _pruned(links: DataFrame, info: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """The distinct ``links (u, v)``, with the sizes ``n_u`` and ``n_v``, whose sizes and parities allow an index of 0.8.

    The short parities come first; the long ones of what they leave are dealt in parts of about ``most`` bytes.
    """

    def ends(pairs: DataFrame, *columns: str) -> DataFrame:
        for name in "uv":
            pairs = pairs.join(info.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns]), name)
        return pairs

    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = ends(pairs, "n", "bits").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")
    schema = "u bigint, v bigint, n_u bigint, n_v bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, 16) for i in (4, 5))
            yield batch.select(["u", "v", "n_u", "n_v"]).filter(pa.array((5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & _may_match(a, b, n, m)))

    def run_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(2, 6)), strict=True)
            ok = [not a.is_valid or not b.is_valid or _long_match(a.as_py(), b.as_py(), n.as_py() + m.as_py()) for n, m, a, b in rows]
            yield batch.select(["u", "v", "n_u", "n_v"]).filter(pa.array(ok, pa.bool_()))

    pairs, out = scratch.keep(pairs.mapInArrow(lean(run), schema)), []
    for part in _parts(pairs, most, 0.5):
        part = ends(part, "wide").select("u", "v", "n_u", "n_v", "wide_u", "wide_v")
        out.append(scratch.keep(part.mapInArrow(lean(run_long), schema)))
    scratch.drop(pairs)
    return reduce(DataFrame.unionByName, out)


def _shared_tokens(base: DataFrame, counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, id, many) with a token in common for each pair of an index of 0.8 or more.

    Such a pair shares a shingle among the first n - ceil(0.8 n) + 1 of each, in any one order of all shingles. Common
    shingles come last in it, so that a passage of many texts brings no pairs.
    """
    spark = base.sparkSession
    common = spark.sparkContext.broadcast(_place_counts(counted))  # 2**16 numbers
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, hasher = common.value, WordHasher()
        for batch in batches:
            for start in range(0, len(batch), 500):
                sets, tokens, owners = [wide_shingles(t or b"", WIDE_WORDS, hasher) for t in batch.column(0).slice(start, 500).to_pylist()], [], []
                for i, h in zip(_names(sets).tolist(), sets, strict=True):
                    if n := len(h):
                        first = np.lexsort((h, count[(h & np.uint64(0xFFFF)).astype(np.int64)]))[: n - (4 * n + 4) // 5 + 1]
                        tokens.append(h[first].view(np.int64))
                        owners.append(np.full(len(first), i, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "id"])

    tokens = base.select("text").mapInArrow(lean(run), "token bigint, id bigint")
    return scratch.keep(tokens.repartition(parts, "token").sortWithinPartitions("token", "id").mapInArrow(lean(_runs(_shared)), "token bigint, id bigint, many boolean"))


def _prefix_links(shared: DataFrame, info: DataFrame, scratch: Scratch, most: float, whole: bool) -> DataFrame:
    """Candidates (u, v, n_u, n_v) of different groups that share a token; of tokens of many ids all only if ``whole``."""
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Parities travel only with tokens of many texts; the others' few pairs get them once, afterwards.
    known = shared.join(info.select("id", "grp", "n", "bits"), "id").select("token", "id", "grp", "n", F.when(F.col("many"), F.col("bits")).alias("bits"))
    pairs = known.repartition(parts, "token").sortWithinPartitions("token", "id").mapInArrow(lean(_runs(_across(whole))), "u bigint, v bigint")
    return _pruned(pairs, info, scratch, most)


def wide_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WIDE_WORDS, radius: int = WIDE_RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, fp (of its shingle set), component_id, for texts of a Jaccard index of 0.8 or more over their shingles.

    Such texts mostly differ in up to ``radius`` of 128 bits, too many for bands that must agree. Shards are then keyed
    by sampled bits in a fixed number of tables; trees and stars are as in :func:`near_groups`. The stars are candidates
    only: each link is held against the exact index of the shingle sets (64-bit hashes of distinct shingles). Pairs that
    the stars miss are found by a prefix filter, which loses none, between the groups linked so far, and verified alike.
    Where many texts share a token it first gives a forest of its pairs, so that a large group of near copies is joined by
    as many links as it has texts; then all pairs whose texts are still in different groups.
    So keys and tokens of a text do not grow with the number of texts, and no document goes that has no partner at 0.8.
    """
    if words != WIDE_WORDS:
        raise ValueError("the wide form takes shingles of five words")
    scratch = scratch or Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).withColumn("th", F.xxhash64("text"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, places, kind = WordHasher(), np.zeros(1 << 16, np.int64), None
        names = ["doc_id", "th", "id", "fp", "n", "bits", "wide", "counts"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = [wide_shingles(t, WIDE_WORDS, hasher) for t in part.column(1).to_pylist()]
                places += np.bincount((np.concatenate(sets) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                columns = [pa.array(_names(sets)), pa.array(list(map(wide_fingerprint, sets)), pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array(list(map(_parity, sets)), pa.binary()), pa.array(list(map(_long_parity, sets)), pa.binary()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], names)
        if kind is not None:
            one = [pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())), pa.array([places.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names)

    kept = scratch.keep(base.mapInArrow(lean(sets_of), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, th bigint, id bigint, fp binary, n bigint, bits binary, wide binary, counts binary"))
    sets, counted = kept.where("counts IS NULL").drop("counts"), kept.where("counts IS NOT NULL")
    classes = scratch.keep(sets.groupBy("id").agg(F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in ("th", "fp", "n", "bits", "wide")]))
    most = CARRIED * 8 * (classes.agg(F.sum("n")).first()[0] or 0)
    prints = scratch.keep(classes.groupBy("fp").agg(F.min("id").alias("least")))
    tables = sampled_keys(prints.count())

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, power = np.array(tables), 1 << np.arange(len(tables[0]), dtype=np.int64)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                fps = batch.column(0).slice(start, 2000).to_pylist()
                bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8)).reshape(-1, 128).astype(np.int64)
                key = np.stack([bits[:, p] @ power for p in places], 1) + (np.arange(len(places)) << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array([f for f in fps for _ in places], pa.binary())], ["shard", "fp"])

    dealt = prints.select("fp").mapInArrow(lean(keys_of), "shard bigint, fp binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = dealt.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(lean(_stars(radius, 2)), "u binary, v binary").distinct()
    stars = stars.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    stars = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(classes.join(prints, "fp").select(F.col("id").alias("u"), F.col("least").alias("v")))
    near = _verified(_pruned(stars, classes, scratch, most), classes, base, scratch, most)
    shared = _shared_tokens(base, counted, scratch)
    for whole in (False, True):
        found = components(near, scratch)
        info = scratch.keep(classes.join(found.withColumnRenamed("u", "id"), "id", "left").select("id", "n", "bits", "wide", F.coalesce("root", "id").alias("grp")))
        links = _prefix_links(shared.where("many") if whole else shared, info, scratch, most, whole)
        # What is known of groups goes on as one link an id.
        near = found.withColumnRenamed("root", "v").unionByName(_verified(links, classes, base, scratch, most))
        scratch.drop(info)
        if shared.where("many").isEmpty():
            break
    ids = sets.select("doc_id", F.col("id").alias("fp"))
    return _settle(ids, classes.select(F.col("id").alias("fp"), "first"), near, scratch)


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups=wide_groups) -> DataFrame:
    """The rows whose doc_id is the smallest of their component, with all their columns.

    Rows that repeat a doc_id are one document and stay or go together; rows without a doc_id stay.
    """
    scratch = Scratch(docs.sparkSession)
    groups = groups(docs, id_col=id_col, text_col=text_col, scratch=scratch)
    gone = scratch.keep(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    scratch.only(gone)
    gone = checked_broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
