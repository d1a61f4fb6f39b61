r"""N-gram Jaccard self-join with token-combination prefixes.

A document's set is its distinct word shingles (words: A-Z in lower case, cut
at ASCII white space); with fewer words than a shingle, all of them as one;
without words, empty and linked with nothing. Two documents link when
100 * intersection >= percent * union. Documents with equal sets are one class.

Candidates. Shingles are ordered by the number of documents that have them,
rarest first. Of a set of n shingles a partner may miss at most
t = n - ceil(percent * n / 100). A prefix is the first shingles in that order,
extended until it guarantees a common signature: a rare shingle counts 1 and is
a signature by itself; frequent ones (more than RARE documents) are dealt into
hash groups, a group of c counts c - 1, and its signatures are its pairs, for
if two are common, so is their pair. The prefix ends when the counts exceed t.
Shingles of one document come first and never need to be sent anywhere, so a
document with more than t of its own drops out. How many groups there are
depends on the larger set's size; a set near a power of two is entered twice.

Kinds. Only shingles of several documents can be common, so classes with the
same shared shingles (a kind) have the same intersection with any other set,
and of a kind the smallest class links whenever a larger one does. So only the
smallest class of each kind is entered, and the others follow from their sizes:
within the kind by the number of its shared shingles, and to another kind by
the intersection of the two smallest classes. A prefix that reaches the frequent
shingles holds all of its set's rare ones, so two such sets either meet at a
rare shingle or have only frequent ones in common. Hence lists of frequent
signatures hold just the smallest class of those with the same frequent
shingles; again the others follow from their sizes, and so do the larger classes
of a kind that don't link with its smallest. Lists of rare signatures
have at most RARE members. (Shared shingles are told by the range and 32 more
bits of the hash; every intersection is of the full hashes.)

Links. Classes of one signature aren't paired all with all at once: each is
tried against one pivot of the list, links are closed to components, and lists
that lie within one component are done, as are lists with the same members as
another; when other pivots bring no more, the pairs still between components
are all tried, once each, and those of kinds with a class that hasn't linked by
its size, where sizes let it link. Every pair that could link is either tried
or known to be connected.

Defined cases: a null text is the empty text; null ids are allowed and stand
for no component's least id unless all its ids are null; rows of equal ids each
get a row; very long texts are read whole; an empty table gives no rows; other
columns are ignored, or pass through in one_of_each.

How it scales: shingles travel packed, sorted and compressed, in ranges of the
hash, and only those of several documents travel back. Every group that a task
holds is a range or a chunk of bounded size. Nothing is broadcast but a Bloom
filter of at most BLOOM_BITS bits; what it lets through by chance is dropped by
a join. Components are found by alternating stars, cut in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import connected, cut, explode_salts, frugal, salt_bits, salt_of
from tracelet.llm.words import WordHashes, mix, shingles

SHINGLE, PERCENT = 5, 75
RARE = 32
CHUNK_DOCS, CHUNK_SHINGLES = 16_000, 1_500_000
SHINGLES_A_RANGE = 1_000_000
BYTES_A_SHINGLE = 7
BLOOM_BITS = 1 << 27
STAR_ROUNDS = 3
WORK = 4  # pivots are tried as long as more pairs a list's member than this are to be looked at
FIRST = 32
NO_ID = -(1 << 63)


def sets(hashes: WordHashes, text: str | None) -> np.ndarray:
    return np.unique(shingles(hashes.of(text or ""), SHINGLE))


def class_of(s: np.ndarray) -> int:
    """A set's class; signed, as Spark's long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def missable(n: np.ndarray | int):
    return n - (PERCENT * n + 99) // 100


def _pack(*arrays: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(data)
    kinds = [np.dtype(k) for k in kinds]
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


def _ranges(docs: DataFrame, text_col: str) -> int:
    """Bits of the hash that name a range of it."""
    total = docs.agg(F.sum(F.octet_length(text_col))).collect()[0][0] or 0
    return max(4, min(20, int(np.ceil(np.log2(max(1, total / BYTES_A_SHINGLE / SHINGLES_A_RANGE))))))


PACKED = "range int, chunk long, data binary"


def _deal(bits: int):
    """Rows of documents to packed rows by hash range; range -1 has the documents of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, k = WordHashes(), TaskContext.get().partitionId() << 24, 0
        ids, classes, sizes, found = [], [], [], []

        def chunk() -> pa.RecordBatch:
            rows = [(-1, base + k, _pack(np.array(ids, np.int64), np.array(classes, np.int64), np.array(sizes, np.int64)))]
            first = {c: i for i, c in reversed(list(enumerate(classes)))}  # copies within the chunk are dealt once
            own = [i for i in range(len(ids)) if first[classes[i]] == i and sizes[i]]
            if own:
                s = np.concatenate([found[i] for i in own])
                who = np.repeat(np.array(own, np.uint16), [len(found[i]) for i in own])
                order = np.argsort(s)
                s, who = s[order], who[order]
                part = (s >> np.uint64(64 - bits)).astype(np.int64)
                low = (s >> np.uint64(32 - bits)).astype(np.uint32)
                stops = np.searchsorted(part, np.arange((1 << bits) + 1))
                for r in np.flatnonzero(np.diff(stops)).tolist():
                    a, b = stops[r], stops[r + 1]
                    rows.append((r, base + k, _pack(np.diff(low[a:b], prepend=np.uint32(0)), who[a:b])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["range", "chunk", "data"])

        total = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = sets(hashes, t.as_py())
                ids.append(NO_ID if i is None else i)
                classes.append(class_of(s))
                sizes.append(len(s))
                found.append(s)
                total += len(s)
                if len(ids) >= CHUNK_DOCS or total >= CHUNK_SHINGLES:
                    yield chunk()
                    k, total = k + 1, 0
                    ids, classes, sizes, found = [], [], [], []
        if ids:
            yield chunk()

    return run


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows with equal values of a column, which lie together."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By range: sends back to each chunk its shingles that several documents have, with their numbers."""
    names, kinds = ["range", "chunk", "data"], (pa.int32(), pa.int64(), pa.binary())
    for rows in _groups(batches, 0):
        if rows[0][0] < 0:
            out = rows
        else:
            parts = [_unpack(d, np.uint32, np.uint16) for _, _, d in rows]
            low = [np.cumsum(p[0], dtype=np.uint32) for p in parts]
            values = np.concatenate(low)
            order = np.argsort(values, kind="stable")
            s = values[order]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.append(starts, len(s)))
            docs = np.empty(len(s), np.uint32)
            docs[order] = np.repeat(n, n)
            out, at = [], 0
            for (r, chunk, _), v, (_, who) in zip(rows, low, parts):
                d = docs[at : at + len(v)]
                at += len(v)
                if (many := d > 1).any():
                    out.append((r, chunk, _pack(v[many], d[many], who[many])))
        for a in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 500]), kinds)], names)


def frequent_prefix(tokens: np.ndarray, wanted: int, groups: int) -> list[np.ndarray]:
    """The shortest prefix of tokens whose groups count at least wanted, by group."""
    of = (mix(tokens) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    new = np.ones(len(tokens), bool)
    new[1:] = of[order][1:] != of[order][:-1]
    first = np.zeros(len(tokens), bool)
    first[order[new]] = True
    counts = np.cumsum(~first)
    end = int(np.searchsorted(counts, wanted)) + 1 if len(counts) and counts[-1] >= wanted else len(tokens)
    return [tokens[:end][of[:end] == g] for g in np.unique(of[:end])]


def schemes(n: int) -> list[int]:
    """Of a set of n: of the larger set of a pair, the size's power of two."""
    own = n.bit_length() - 1
    most = 100 * n // PERCENT
    return [own] if most.bit_length() - 1 == own else [own, own + 1]


def _sign(bits: int):
    """By chunk: rows (row, x, class, n, kind): row 0 the documents (x: id), row 1 the classes that may link (x: number of shared shingles), row 2 the rare signatures (x) of the smallest class of each kind in the chunk, rows 3 and 4 the same for frequent shingles and kinds by them, row 3 without those that link with the smallest class of their kind in row 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            head = next(d for r, _, d in rows if r < 0)
            ids, classes, sizes = _unpack(head, np.int64, np.int64, np.int64)
            yield _rows(0, ids, classes, sizes, np.zeros(len(ids), np.int64))
            parts = [(r, *_unpack(d, np.uint32, np.uint32, np.uint16)) for r, _, d in rows if r >= 0]
            if not parts:
                continue
            token = np.concatenate([(np.uint64(r) << np.uint64(32)) | v.astype(np.uint64) for r, v, _, _ in parts])
            docs = np.concatenate([p[2] for p in parts])
            who = np.concatenate([p[3] for p in parts]).astype(np.int64)
            shared = np.bincount(who, minlength=len(ids))
            wanted = missable(sizes) + 1 - (sizes - shared)  # what is left after the shingles of one document
            keep = (wanted > 0)[who]
            token, docs, who = token[keep], docs[keep], who[keep]
            order = np.lexsort([token, docs, who])
            token, docs, who = token[order], docs[order], who[order]
            starts = np.searchsorted(who, np.arange(len(ids) + 1))
            able = np.flatnonzero(np.diff(starts))
            if not len(able):
                continue
            rank = np.arange(len(who)) - starts[who]
            rare = docs <= RARE
            rares = np.bincount(who[rare], minlength=len(ids))

            def smallest(who_can: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Kinds by the shared shingles from `first` on, and which documents are the smallest of theirs."""
                kind, top = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                kind[who_can] = [class_of(np.sort(token[first[i] : starts[i + 1]])) for i in who_can.tolist()]
                order = who_can[np.lexsort([classes[who_can], sizes[who_can], kind[who_can]])]
                top[order[np.diff(kind[order], prepend=kind[order[:1]] + 1) != 0]] = True
                return kind, top

            kind, top = smallest(able, starts[:-1])
            yield _rows(1, shared[able], classes[able], sizes[able], kind[able])
            single = np.flatnonzero(rare & (rank < wanted[who]) & top[who])
            for a in range(0, len(single), 100_000):
                o = who[single[a : a + 100_000]]
                yield _rows(2, mix(token[single[a : a + 100_000]]).view(np.int64), classes[o], sizes[o], kind[o])
            reach = wanted > rares
            # of a kind, all but those that link with its smallest class by their sizes, for these have its links
            own_top = np.zeros(len(ids), np.int64)
            tops = np.flatnonzero(top)
            at = np.argsort(kind[tops])
            own_top[able] = tops[at][np.searchsorted(kind[tops], kind[able], sorter=at)]
            alone = PERCENT * (sizes + sizes[own_top]) > (100 + PERCENT) * shared
            reach = np.flatnonzero(reach & (np.diff(starts) > 0) & (top | alone))
            if not len(reach):
                continue
            kind, top = smallest(reach, starts[:-1] + rares)
            yield _rows(3, shared[reach] - rares[reach], classes[reach], sizes[reach], kind[reach])
            signs, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i in np.flatnonzero(top).tolist():
                tokens = token[starts[i] + rares[i] : starts[i + 1]]
                for scheme in schemes(int(sizes[i])):
                    for group in frequent_prefix(tokens, int(wanted[i] - rares[i]), max(1, (1 << scheme) // 16)):
                        group = np.sort(group)
                        a, b = np.triu_indices(len(group), 1)
                        signs.append(mix(mix(group[a] + np.uint64(scheme)) + group[b]))
                        owner.append(np.full(len(a), i))
            sign, own = np.concatenate(signs), np.concatenate(owner)
            for a in range(0, len(sign), 100_000):
                o = own[a : a + 100_000]
                yield _rows(4, sign[a : a + 100_000].view(np.int64), classes[o], sizes[o], kind[o])

    return run


def _rows(row: int, x: np.ndarray, c: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row, np.int32)), pa.array(x.astype(np.int64)), pa.array(c), pa.array(n.astype(np.int32)), pa.array(kind)], ["row", "x", "class", "n", "kind"])


def _class_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(class, shingles array<long>) of the classes in wanted (class, id): read from the documents with those ids, as a Bloom filter tells."""
    n = wanted.count()
    bits = min(BLOOM_BITS, max(1 << 10, 1 << int(16 * n).bit_length()))
    places = F.array(F.pmod(F.xxhash64("id"), F.lit(bits)), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(bits)))
    words = wanted.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
    got = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    sieve = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            p, q = (batch.column(j).to_numpy() for j in (2, 3))
            in_p, in_q = ((sieve.value[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) for x in (p, q))
            at = np.flatnonzero((in_p & in_q).astype(bool))
            for a in range(0, len(at), 200):
                part = at[a : a + 200]
                s = [sets(hashes, batch.column(1)[i].as_py()).view(np.int64) for i in part.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array([class_of(x.view(np.uint64)) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["id", "class", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    rows = rows.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(bits)).alias("q"))
    read = rows.mapInArrow(frugal(run), "id long, class long, shingles array<long>")
    return cut(read.join(wanted, ["id", "class"], "left_semi").dropDuplicates(["class"]).select("class", "shingles"))


def _fits(sizes: str, common: str) -> str:
    """Whether sets whose sizes add up to `sizes` link with so many shingles in common."""
    return f"{PERCENT} * ({sizes}) <= {100 + PERCENT} * {common}"


def _verify(pairs: DataFrame, class_sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link, with their sizes na and nb and the number of common shingles."""
    b = class_sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    a = class_sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return met.filter(_fits("na + nb", "common"))


def _pivot_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """From (t, x, class, n, own, most, comp, rest) pairs (a, b) of classes in different components, one of which is the pivot of this turn of a list (t, x).

    The pivot is the class with the least share of shingles of its own, which is nearest to the others; in the last turn any.
    Pairs whose sizes can't fit with the shingles that either could have in common are left out.
    """
    centre = F.lit(0) if turn == STAR_ROUNDS - 1 else F.col("own") / F.col("n")
    order = F.struct(centre.alias("far"), F.xxhash64("class", F.lit(turn)).alias("h"), F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("most").alias("most2"), F.col("comp").alias("comp2"))
    pivots = lists.groupBy("t", "x").agg(F.min(order).alias("p")).select("t", "x", "p.class2", "p.n2", "p.most2", "p.comp2")
    met = lists.join(pivots, ["t", "x"]).filter("comp <> comp2").filter(_fits("n + n2", "least(most, most2)")).groupBy("class", "class2").agg(F.count("*").alias("k"))
    if turn == 0:  # the partner of most lists
        met = met.groupBy("class").agg(F.max_by("class2", F.struct("k", "class2")).alias("class2"))
    return met.select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct()


def _main(lists: DataFrame) -> DataFrame:
    """(t, x, main, held, k) of each list: its largest component, how many members that has, and how many the list has."""
    by_comp = lists.groupBy("t", "x", "comp").agg(F.count("*").alias("k"))
    return by_comp.groupBy("t", "x").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("k")).select("t", "x", F.col("m.comp").alias("main"), F.col("m.k").alias("held"), "k")


def _all_pairs(lists: DataFrame) -> DataFrame:
    """All pairs (a, b) of classes that share a list, are in different components and could link by their sizes, and those that the larger classes of a kind could link through.

    Members of a list's largest component needn't be held against each other, so a list is joined with those of its members
    that are outside. A pair is made in the first list that both are in, as their FIRST first lists tell; a pair that has
    none of these in common is made in each.
    """
    firsts = lists.groupBy("t", "class").agg(F.slice(F.array_sort(F.collect_set("x")), 1, FIRST).alias("firsts"))
    lists = cut(lists.join(firsts, ["t", "class"]).join(_main(lists).select("t", "x", "main"), ["t", "x"]).withColumn("outside", F.expr("comp <> main or rest is not null")))
    names = ("class", "n", "most", "comp", "rest", "firsts", "outside")
    other = lists.select("t", "x", *[F.col(c).alias(c + "2") for c in names])
    common = "least(most, most2)"
    through = [f"coalesce({_fits(s, common)}, false)" for s in ("rest + n2", "rest2 + n")]
    wanted = [
        "class <> class2 and (class < class2 or not outside2)",
        f"(comp <> comp2 or {' or '.join(through)})",
        _fits("n + n2", common),
        "x = coalesce(array_min(array_intersect(firsts, firsts2)), x)",
    ]
    met = lists.filter("outside").join(other, ["t", "x"]).filter(" and ".join(wanted))
    return met.select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct()


def _open_lists(lists: DataFrame) -> DataFrame:
    """The lists that reach over several components, or hold several classes one of which has classes of its kind left; of lists with the same members (and what those could have in common), one.

    A class leaves a list where even the smallest member is too large for what the two could have in common (most).
    """
    least = lists.groupBy("t", "x").agg(F.min("n").alias("n0"))
    lists = lists.join(least, ["t", "x"]).filter(_fits("n + n0", "most")).drop("n0")
    marks = [F.bit_xor(F.xxhash64("class", "most", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
    wide = lists.groupBy("t", "x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rest").alias("l"), F.count("*").alias("k"), *marks).filter("lo < hi or (l is not null and k > 1)")
    one = wide.groupBy("t", "m0", "m1", "k").agg(F.min("x").alias("x")).select("t", "x")
    return cut(lists.join(one, ["t", "x"], "left_semi"))


def _work(lists: DataFrame) -> tuple[int, int]:
    """Members of all lists, and pairs that _all_pairs would look at."""
    total, pairs = _main(lists).agg(F.sum("k"), F.sum(F.expr("(k - held) * k"))).first()
    return total or 0, pairs or 0


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    bits = _ranges(docs, text_col)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(frugal(_deal(bits)), PACKED)
    counted = dealt.repartition(parts, F.when(F.col("range") < 0, F.col("chunk")).otherwise(F.col("range").cast("long"))).sortWithinPartitions("range", "chunk").mapInArrow(frugal(_count), PACKED)
    signed = cut(counted.repartition(parts, "chunk").sortWithinPartitions("chunk", "range").mapInArrow(frugal(_sign(bits)), "row int, x long, class long, n int, kind long"))

    base = signed.filter("row = 0").select(F.col("x").alias("id"), "class", "n")
    first = base.groupBy("class").agg(F.min("id").alias("id"))
    links, rests, tops, lists = None, [], [], None
    for members in (1, 3):
        able = signed.filter(F.col("row") == members).groupBy("kind", "class", "n").agg(F.min("x").alias("shared"))
        smallest = able.groupBy("kind").agg(F.min(F.struct("n", "class", "shared")).alias("s")).select("kind", F.col("s.class").alias("top"), F.col("s.n").alias("top_n"), (F.col("s.n") - F.col("s.shared")).alias("own"), F.col("s.shared").alias("most"))
        others = cut(able.join(smallest, "kind").filter("class <> top").withColumn("linked", F.expr(_fits("n + top_n", "shared"))))
        sure = others.filter("linked").select(F.col("class").alias("a"), F.col("top").alias("b"))
        links = sure if links is None else links.union(sure)
        rests.append(others.filter("not linked").select("top", "class", "n"))
        tops.append(smallest.select("kind", F.col("top").alias("class"), "own", "most"))
    left = rests[0].union(rests[1]).groupBy(F.col("top").alias("class")).agg(F.min("n").alias("rest"))
    for t, smallest, signatures in zip((0, 1), tops, (2, 4)):
        entered = signed.filter(F.col("row") == signatures).select("x", "class", "n", "kind").distinct().join(smallest, ["kind", "class"])
        entered = entered.join(left, "class", "left").select(F.lit(t).alias("t"), "x", "class", "n", "own", "most", F.col("class").alias("comp"), "rest")
        lists = entered if lists is None else lists.union(entered)
    lists = _open_lists(lists)
    total, work = _work(lists)
    class_sets, met, turn = None, None, 0
    if total:
        class_sets = _class_sets(docs, id_col, text_col, cut(lists.select("class").union(rests[1].select("class")).distinct().join(first, "class")))
    while total and turn < STAR_ROUNDS and work > WORK * total:
        new = cut(_verify(_pivot_pairs(lists, turn), class_sets))
        met = new if met is None else met.union(new)
        roots = connected(met.select("a", "b")).withColumnRenamed("node", "class")
        lists = _open_lists(lists.drop("comp").join(roots, "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root"))
        before, turn = work, turn + 1
        total, work = _work(lists)
        if 2 * work > before:  # what is left doesn't meet in pivots
            break
    if total:
        new = cut(_verify(_all_pairs(lists), class_sets))
        met = new if met is None else met.union(new)
    if met is not None:
        both = met.select("a", F.col("b").alias("top"), "na", "common").union(met.select(F.col("b").alias("a"), F.col("a").alias("top"), F.col("nb").alias("na"), "common"))
        room = F.expr(f"{100 + PERCENT} * common - {PERCENT} * na")
        widest = both.groupBy("top").agg(F.max(F.struct(room.alias("room"), "a")).alias("w")).select("top", "w.room", "w.a")
        by_size = rests[0].join(widest, "top").filter(f"{PERCENT} * n <= room").select(F.col("class").alias("b"), "a").select("a", "b")
        # of these the intersection may have lost the rare shingles of the smallest classes, so they are tried
        near = cut(rests[1].join(both, "top").filter(_fits("n + na", "common")).filter("a <> class").select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct())
        links = links.union(met.select("a", "b")).union(by_size).union(_verify(near, class_sets).select("a", "b"))

    salted = base.withColumn("salt", salt_of(F.col("id")))
    roots = connected(links)
    classes = base.groupBy("class").agg(F.min(_real("id")).alias("least"), salt_bits(salt_of(F.col("id"))).alias("bits"))
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("class", "component", explode_salts(F.col("bits")).alias("salt"))
    out = salted.filter("n > 0").join(named, ["class", "salt"], "left").select("id", "n", "component")
    out = out.union(salted.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(_real("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), _real("component").alias("component_id"))


def _real(c: str):
    """Null ids travel as the least long."""
    return F.nullif(F.col(c), F.lit(NO_ID))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; rows without words or id stay; the same columns."""
    found = components(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    lost = found.filter("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(lost, id_col, "left_anti").select(docs.columns)
