"""SimHash near-dedup through an inverted index on byte positions.

Two 64-bit fingerprints that differ in at most four bits share at least four of their eight positional bytes. Distinct fingerprints
are posted under 34 of the 56 sets of three positional bytes, two at least of any four bytes: who shares four bytes meets under two sets, who
shares only three under one at most. The meetings of each pair are tallied, pairs under the guaranteed two go, and the rest is verified bit by
bit. The other 22 sets would tell no more. Postings of single bytes would meet in a 256th of all pairs at every size; sets of three meet in a
2**24th. Crowded lists are posted anew under one byte more.

For a similarity instead of a number of bits, texts are linked by this index first: fingerprints of their distinct shingles are posted, counted
and compared bit by bit, and linked pairs are verified by all shingles. Alike texts may differ in more bits than that. Those that are left in
different components are therefore posted under their first shingles too, in an order that holds for all texts, the rarest first: two texts of enough resemblance share three of them, as many first ones are posted as that takes. Count filtering tallies for each pair
the postings that it shares at places where alike texts of their sizes do; pairs under the guaranteed three go, and the rest is verified by
all shingles. Texts with the same set of shingles, however often each is repeated, are one node. No pair is lost whatever the order is; that rare
ones come first keeps lists short.

A list of postings is linked in two steps so that a large group never emits its pairs. First every member is compared with the head of one
of its lists. Then only members that this left in different components are compared, and never two members of the list's largest
component. No link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOOKED_UP_MOST, join_groups, never_broadcast, release, settle, shuffle_width, unused, whole
from .components import components

#: Words of a shingle, differing bits of a link, and the seed of the shingles' XXH64.
WORDS, DISTANCE, SEED = 4, 4, 42
POSITIONS = 8
#: Sets of three positions that aren't posted: no four positions hold more than two of them, so that two of any four's sets are left.
UNPOSTED = frozenset(tuple(map(int, s)) for s in "014 015 026 027 034 037 056 057 125 126 127 135 137 147 236 245 246 345 356 367 457 467".split())
#: Fingerprints beyond which postings hold four bytes instead of three, and members beyond which a list is posted anew with one byte more.
WIDE_FROM, CROWDED = 1 << 24, 512
#: Shingles that are hashed at a time.
BLOCK = 1 << 16
#: By similarity: words of a shingle, and the least resemblance (shared distinct shingles over all).
SIMILAR_WORDS, RESEMBLANCE = 5, 0.8
#: Bits of a node's number, and the thousandths of its shingles by which texts count as equally central.
NODE_BITS, LIKE_CENTRAL = 53, 16
#: Shingles that two alike texts share among their first at least, if they share as many.
MEETINGS = 3
#: Shingles that are counted together, and the count from which and the number up to which common ones are ordered by their counts.
#: They decide how long lists get, not what is found.
COUNTED, COMMON_FROM, COMMON_MOST = 1 << 21, 3, 200_000
#: Documents that are compared with one in a task, turns of comparing members with the head of their list, and pairs for each posting
#: that may be left for all pairs to be compared after fewer turns.
SHARE_ROWS, STAR_TURNS, PAIRS_EACH = 256, 3, 1


def sets_of_positions(width: int) -> list[tuple[int, ...]]:
    """All sets of so many positions. Fingerprints that share m positional bytes meet under as many of them as m holds."""
    return list(combinations(range(POSITIONS), width))


def posted_sets(width: int) -> list[tuple[int, ...]]:
    """The sets of so many positions that fingerprints are posted under."""
    return [s for s in sets_of_positions(width) if s not in UNPOSTED]


def least_meetings(width: int, distance: int = DISTANCE, sets: list[tuple[int, ...]] | None = None) -> int:
    """Under how many sets of positions, all if none are given, two fingerprints meet at least that differ in at most so many bits, each in
    a byte of its own."""
    sets = sets_of_positions(width) if sets is None else sets
    return min(sum(set(s) <= set(same) for s in sets) for same in combinations(range(POSITIONS), POSITIONS - distance))


def _hashed(text: str, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, block by block."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lower() is A-Z alone, split() is at [\x20\x09-\x0D]
    if not parts:
        return
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, w = ends - sizes, min(words, len(parts))
    n, hashed = len(parts) - w + 1, xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        till = min(n, at + BLOCK)
        yield np.array([hashed(joined[a:z], SEED) for a, z in zip(starts[at:till].tolist(), ends[at + w - 1 : till + w - 1].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint. A bit is 1 if more than half of the shingles' hashes have it; no words give 0."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in _hashed(text, words):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def set_fingerprint(shingles: np.ndarray) -> int:
    """As ``fingerprint``, of a text's distinct shingles' hashes: repeats have no weight, as they have none in the resemblance."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        h = shingles[at : at + BLOCK]
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = pa.array([fingerprint(x.as_py(), words) for x in b.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), prints], ["doc_id", "print"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and print."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), "doc_id long, print long")


def _byte(x: Column, p: int) -> Column:
    return F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255))


def _key(x: str | Column, k: int, positions: tuple[int, ...]) -> Column:
    """The number of a set of positions, and the bytes there, as one long."""
    column = F.col(x) if isinstance(x, str) else x
    return reduce(lambda a, p: F.shiftleft(a, 8).bitwiseOR(_byte(column, p)), positions, F.lit(k).cast("long"))


def _posted_under(x: Column, sets: list[tuple[int, ...]]) -> Column:
    return F.explode(F.array(*[_key(x, k, s) for k, s in enumerate(sets)]))


def _linked(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _mixed(member: DataFrame) -> DataFrame:
    """Members of lists that hold several components, with the list's members and its largest component; settled."""
    parts = member.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return settle(member.join(lists.select("key", F.col("main.part").alias("main"), "members"), "key"))


def _apart(mixed: DataFrame, *more: str) -> DataFrame:
    """Once for each list, all pairs of its members in different components; one side's columns are named with _a."""
    small = mixed.where("part <> main").select(*[F.col(c).alias(f"{c}_a") for c in ("key", "node", "part", *more)])
    once = (F.col("part") == F.col("main")) | (F.col("node_a") < F.col("node"))  # those outside the largest component meet from either side
    return small.join(mixed, (F.col("key_a") == F.col("key")) & (F.col("part_a") != F.col("part")) & once)


def counted(meetings: DataFrame, least: int) -> DataFrame:
    """Count filtering: the pairs (u, v) that meet often enough; ``meetings`` has a row for each list that two fingerprints share."""
    return meetings.groupBy("u", "v").agg(F.count(F.lit(1)).alias("tally")).where(F.col("tally") >= least).select("u", "v")


def _finer(crowded: DataFrame, width: int) -> DataFrame:
    """Members of crowded lists, posted anew under their list and one more byte: who shares enough bytes shares one of the others too."""
    others = [F.array(*[F.lit(p) for p in range(POSITIONS) if p not in s]) for s in posted_sets(width)]
    own = F.element_at(F.array(*others), F.shiftrightunsigned("key", 8 * width).cast("int") + 1)
    byte = lambda p: F.expr("shiftrightunsigned(node, 8 * p)").bitwiseAND(F.lit(255))
    placed = crowded.select("node", "part", "key", F.explode(own).alias("p"))
    return placed.select("node", "part", F.xxhash64("key", "p", byte("p")).alias("key"))


def print_links(prints: DataFrame, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (u, v) of distinct fingerprints with a head of one of their lists, the components (node, component) that these make, and the
    links between those components; ``prints`` has print."""
    width = 3 if prints.count() <= WIDE_FROM else 4
    sets = posted_sets(width)
    dealt = prints.repartition(shuffle_width(prints.sparkSession))  # fingerprints are few bytes in few partitions, postings many
    posted = dealt.select(F.col("print").alias("node"), _posted_under(F.col("print"), sets).alias("key"))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head")).where("size > 1").select("key", "head")
    met = settle(posted.join(never_broadcast(lists), "key"))
    release(prints.sparkSession)
    stars = met.where((F.col("node") != F.col("head")) & _linked(F.col("node"), F.col("head"))).select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    stars = settle(stars)
    first = settle(components(stars))
    mixed = _mixed(met.drop("head").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))
    pair = (F.greatest("node_a", "node").alias("u"), F.least("node_a", "node").alias("v"))
    few = counted(_apart(mixed.where(F.col("members") <= crowded)).select(*pair), least_meetings(width, sets=sets))
    many = mixed.where(F.col("members") > crowded)
    if width < POSITIONS - DISTANCE and not many.isEmpty():  # with one byte more they share enough, without being counted
        many = _mixed(_finer(many, width))
    crossing = few.unionByName(_apart(many).select(*pair).distinct()).where(_linked(F.col("u"), F.col("v"))).distinct()
    return stars, first, settle(crossing)


def link_prints(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(node, component) of distinct fingerprints that have links; ``prints`` has print."""
    stars, first, crossing = print_links(prints, crowded)
    return first if crossing.isEmpty() else components(stars.unionByName(crossing))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashed(text, words)])).view(np.int64)


def set_print(shingles: np.ndarray) -> bytes:
    """Equal for equal sets of distinct shingles alone."""
    return hashlib.sha256(np.sort(shingles).tobytes()).digest()[:16]


def prefix_size(n: int) -> int:
    """Of n shingles in an order that holds for all texts, how many first ones hold ``MEETINGS`` that a text of enough resemblance has among
    its own first; all, if that is more than there are."""
    return min(n, n - math.ceil(RESEMBLANCE * n - 1e-6) + MEETINGS)


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several of some thousand neighbouring texts have, and how many do."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])

    held, size = [], 0
    for b in batches:
        for text in b.column("text"):
            held.append(shingle_hashes(text.as_py(), words))
            size += len(held[-1])
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of all documents have, sorted, and how many have them, as far as neighbours share them. The driver gets
    ``COMMON_MOST`` at most: those of a count that would be more than that aren't ordered by it."""
    n = docs.select(whole().alias("text")).mapInArrow(partial(_counted, words=words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    n = settle(n.where(F.col("n") >= COMMON_FROM))
    step = F.floor(8 * F.log2("n")).cast("int")
    least, found = None, 0
    for r in n.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # one row for each step of the counts' logarithm
        if (found := found + r["count"]) > COMMON_MOST:
            break
        least = r["step"]
    rows = n.where(step >= least).toPandas().sort_values("key") if least is not None else pd.DataFrame({"key": [], "n": []})
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, common: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each text's first shingles, the rarest first; ``common`` is sorted."""
    for b in batches:
        prints, bits, sizes, firsts = [], [], [], []
        for text in (x.as_py() for x in b.column("text")):
            h = shingle_hashes(text, words)
            prints.append(set_print(h))
            bits.append(set_fingerprint(h))
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                h = h[np.lexsort((h, np.where(common[at] == h, count[at], 0)))]
            sizes.append(len(h))
            firsts.append(h[: prefix_size(len(h))])
        cols = [pa.array(prints, pa.binary()), pa.array(bits, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *cols], ["doc_id", "mark", "print", "bits", "size", "first"])


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark of the text by which it is found again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("mark"), whole().alias("text"))


def prefixes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, print, bits (the fingerprint of the distinct shingles), size (their number) and first: enough of them, in one order for all
    rows, that any two texts of enough resemblance share one of their first."""
    common, count = common_shingles(docs, words)
    found = partial(_prefixes, words=words, common=common, count=count)
    return _marked(docs).mapInArrow(found, "doc_id long, mark long, print binary, bits long, size long, first array<long>")


def _verified(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a group's first document, then those that are compared with it; of repeated rows the first counts."""
    head, own, before = None, np.empty(0, np.int64), None
    for b in batches:
        us, vs = [], []
        for v, share, node, text in zip(b.column("v").to_pylist(), b.column("share").to_pylist(), b.column("node").to_pylist(), b.column("text"), strict=True):
            if (v, share, node) == before:
                continue
            before, h = (v, share, node), shingle_hashes(text.as_py(), words)
            if node == v:
                head, own = (v, share), h
            elif head == (v, share):
                both = len(np.intersect1d(own, h, assume_unique=True))
                if both >= RESEMBLANCE * (len(own) + len(h) - both):
                    us.append(node)
                    vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def resembling(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those pairs of nodes (u, v) whose documents share enough of their distinct shingles. Texts move, which are shorter than their
    shingles: that of u once for each pair, that of v once for each ``SHARE_ROWS`` of its pairs."""
    shares = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).alias("shares"))
    dealt = settle(pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), "shares").alias("share")))
    ends = dealt.select("v", "share", F.col("u").alias("node")).unionByName(dealt.select("v", "share", F.col("v").alias("node")).distinct())
    wanted = settle(ends.join(nodes.select("node", "least_id", F.col("mark").alias("least_mark")), "node"))
    wanted = F.broadcast(wanted) if wanted.count() <= LOOKED_UP_MOST else wanted
    rows = _marked(docs)
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(F.col("least_id")) & (F.col("mark") == F.col("least_mark"))).select("v", "share", "node", "text")
    grouped = texts.repartition(shuffle_width(docs.sparkSession), "v", "share").sortWithinPartitions("v", "share", F.col("node") != F.col("v"), "node")
    return grouped.mapInArrow(partial(_verified, words=words), "u long, v long")


def near_in_bits(reps: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v) whose fingerprints are equal or linked: each node with the first of its fingerprint, and of fingerprints each with
    the nearest head of its lists and one in another component, if it has such links. ``reps`` has node and bits."""
    prints = settle(reps.groupBy("bits").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    stars, _, crossing = print_links(prints.select(F.col("bits").alias("print")))
    nearest = lambda links: links.groupBy("u").agg(F.min(F.struct(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))), "v")).alias("best")).select("u", "best.v")
    of = lambda end: prints.select(F.col("bits").alias(end), F.col("first").alias(f"{end}_first"))
    linked = nearest(stars).unionByName(nearest(crossing)).join(of("u"), "u").join(of("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    equal = join_groups(reps.select("bits", "node"), prints.where("n > 1"), "bits", "n").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return linked.unionByName(equal).distinct()


def _size(place: str) -> Column:
    return F.shiftrightunsigned(place, 32)


def _least_shared(x: Column, y: Column) -> Column:
    """Shingles that texts with x and y distinct ones share at least, if they are alike."""
    return F.ceil(RESEMBLANCE / (1 + RESEMBLANCE) * (x + y) - 1e-6)


def _possible(u: str, v: str) -> Column:
    """Whether two texts that share the shingle at these places can be alike by it: of as many shingles as alike texts of these sizes share,
    the first ``MEETINGS`` lie in so much of either text's beginning."""
    at = lambda p: F.col(p).bitwiseAND(F.lit((1 << 32) - 1))
    least = _least_shared(_size(u), _size(v))
    return (at(u) < _size(u) - least + MEETINGS) & (at(v) < _size(v) - least + MEETINGS)


def tallied(meetings: DataFrame) -> DataFrame:
    """Count filtering: pairs (u, v) that meet as often as alike texts of their sizes do at least; ``meetings`` has u, v, size_u and size_v for
    each shared posting by which they can be alike."""
    least = F.least(F.lit(MEETINGS), _least_shared(F.col("size_u"), F.col("size_v")))
    met = meetings.groupBy("u", "v").agg(F.count(F.lit(1)).alias("tally"), F.max("size_u").alias("size_u"), F.max("size_v").alias("size_v"))
    return met.where(F.col("tally") >= least).select("u", "v", "tally")


def _starred(member: DataFrame, turn: int) -> DataFrame:
    """Of each list one head, a text with few rare shingles, which is like most others; each member that isn't in its head's component, with
    the head that it meets most often. Heads of later turns are others of those."""
    share = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) * ((1 << 10) - 1) / _size("place")
    mask = F.lit(int(np.random.default_rng(turn).integers(1 << NODE_BITS)) if turn else 0)
    packed = F.shiftleft(F.floor(share / (1 if turn == 0 else LIKE_CENTRAL)), NODE_BITS).bitwiseOR(F.col("node").bitwiseXOR(mask))
    heads = member.groupBy("key").agg(F.min(packed).bitwiseAND(F.lit((1 << NODE_BITS) - 1)).bitwiseXOR(mask).alias("head"))
    with_head = member.join(heads, "key")
    of_head = with_head.where("node = head").select("key", F.col("place").alias("head_place"), F.col("part").alias("head_part"))
    met = with_head.where("node <> head").join(of_head, "key").where((F.col("part") != F.col("head_part")) & _possible("place", "head_place"))
    met = tallied(met.select(F.col("node").alias("u"), F.col("head").alias("v"), _size("place").alias("size_u"), _size("head_place").alias("size_v")))
    return met.groupBy("u").agg(F.max(F.struct("tally", "v")).alias("best")).select("u", F.col("best.v").alias("v"))


def _placed(member: DataFrame, part: DataFrame) -> DataFrame:
    """Members of lists with the components that they are in."""
    return member.join(part, "node", "left").select("key", "node", "place", F.coalesce("component", "node").alias("part"))


def link_similar(reps: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, component) of nodes that have links; ``reps`` has node, bits, size and first, ``nodes`` node, least_id and mark."""
    links = settle(resembling(near_in_bits(reps.select("node", "bits")), nodes, docs, words))
    links, part = (None, None) if links.isEmpty() else (links, settle(components(links)))
    release(docs.sparkSession)
    place = F.shiftleft(F.col("size"), 32).bitwiseOR(F.col("at").cast("long"))
    rows = reps.select("node", "size", F.posexplode("first").alias("at", "key")).select("key", "node", place.alias("place"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    met = settle(rows.join(never_broadcast(shared), "key"))
    release(docs.sparkSession)
    postings, mixed = met.count(), None
    member = met.withColumn("part", F.col("node")) if part is None else _placed(met, part)
    for turn in range(STAR_TURNS):
        found = settle(resembling(_starred(member, turn), nodes, docs, words))
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        part = settle(components(links))
        # lists of one component alone stay so
        member = _placed(member.drop("part"), part)
        mixed = _mixed(member)
        release(docs.sparkSession)
        early = mixed.where(_possible("place", "place")).groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("part") != F.col("main")).cast("long")).alias("small"))
        if (early.agg(F.sum(F.col("all") * F.col("small"))).first()[0] or 0) <= PAIRS_EACH * postings:
            break
        member = mixed.drop("main", "members")
    mixed = _mixed(member) if mixed is None else mixed
    crossing = _apart(mixed, "place").where(_possible("place_a", "place"))
    pair = (F.greatest("node_a", "node").alias("u"), F.least("node_a", "node").alias("v"))
    crossing = tallied(crossing.select(*pair, _size("place_a").alias("size_u"), _size("place").alias("size_v")))
    crossing = settle(resembling(crossing.select("u", "v"), nodes, docs, words))
    release(docs.sparkSession)
    if not crossing.isEmpty():
        return components(crossing if links is None else links.unionByName(crossing))
    return part if part is not None else crossing.select(F.col("u").alias("node"), F.col("v").alias("component"))


def similar_rows(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """doc_id, print (of the set of shingles) and component_id of every row, as ``similar_documents`` links them."""
    rows = settle(prefixes(docs, words).withColumn("uid", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("least")
    nodes = rows.groupBy("print").agg(F.min("uid").alias("node"), least, F.count(F.lit(1)).alias("n"))
    nodes = settle(nodes.select("print", "node", "n", F.col("least.doc_id").alias("least_id"), F.col("least.mark").alias("mark")))
    reps = rows.withColumnRenamed("uid", "node")
    several = nodes.where("n > 1").select("print", "node", "n")
    copies = join_groups(rows.select("print", "uid"), several, "print", "n").where("uid <> node").select(F.col("uid").alias("node"))
    n = copies.count()
    if n:
        reps = reps.join(F.broadcast(copies), "node", "left_anti") if n <= LOOKED_UP_MOST else reps.join(nodes.select("node"), "node", "left_semi")
    part = link_similar(reps.select("node", "bits", "size", "first"), nodes.select("node", "least_id", "mark"), docs, words)
    named = nodes.join(part, "node", "left").select("print", "n", "least_id", F.coalesce("component", "node").alias("part"))
    ids = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = settle(named.join(ids, "part").select("print", "n", "component_id"))
    return join_groups(rows.select("doc_id", "print"), named, "print", "n").select("doc_id", "print", "component_id")


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """doc_id and component_id of every row, linked by the resemblance of their word shingles instead of by a few bits. Odd rows are as in
    ``near_duplicates``; documents without words have equal sets and are linked."""
    return similar_rows(docs, words).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Null texts count as empty; without words the fingerprint is zero and is linked like any other; fewer words than a shingle has
    are one shingle. A null doc_id stays null and is no component's id unless all its rows have none. Repeated rows each get a row;
    an empty table gives an empty result; further columns are ignored.
    """
    rows = settle(fingerprints(docs, words))
    prints = settle(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    part = link_prints(prints.select("print")).withColumnRenamed("node", "print")
    named = prints.join(part, "print", "left").select("print", "n", "least_id", F.coalesce("component", "print").alias("part"))
    ids = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = settle(named.select("print", "n", "part").join(ids, "part").select("print", "n", "component_id"))
    return join_groups(rows, named, "print", "n").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """``docs`` without those that are not the first of their component by similarity; their columns stay as they are.

    Rows are told apart by doc_id; where one stands before several rows, by their shingles too: each component keeps one row of its
    first doc_id, and a row that goes takes no other with it. Rows without doc_id stay. An empty table gives an empty result.
    """
    found = settle(similar_rows(docs, words))
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    drop = F.broadcast(drop) if drop.count() <= LOOKED_UP_MOST else drop
    shared = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if shared.isEmpty():
        return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    shared = settle(shared)
    single = docs.join(shared, "doc_id", "left_anti").join(drop, "doc_id", "left_anti").select(*docs.columns)

    @F.pandas_udf("binary")
    def print_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: set_print(shingle_hashes(t, words)))

    (own,) = unused(docs, 1)
    first = found.where("doc_id = component_id").select("doc_id", F.col("print").alias(own)).distinct()
    kept = docs.join(shared, "doc_id", "left_semi").withColumn(own, print_of(whole())).join(first, ["doc_id", own], "left_semi")
    return single.unionByName(kept.dropDuplicates(["doc_id"]).select(*docs.columns))
