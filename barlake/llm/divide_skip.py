"""N-gram Jaccard join by T-occurrence search (DivideSkip), as components.

A text is the set of its five-word shingles; two texts link if 100 * common >= 80 * all, that is if
they share T = ceil(4 (n + m) / 9) shingles. Texts of equal sets are one class from the start.

Lists. A class is in the inverted list of each shingle of its prefix, which has the first
n - ceil(0.8 n) + l shingles in the order of their names, l being a tenth of n: two classes that link share
l' shingles of both prefixes, the smaller l of the two. So, as in DivideSkip, each class can leave
out its longest lists, l(ceil(0.8 n)) - 1 of them (common passages mostly), and still must meet every
class it links with in one of its short lists.

Candidates. Every class is compared with the hub of its lists first (the member whose lists are
longest together), so that most families join at once. Lists with members of several components go
on: in rounds in which each class names the one other component's member that may be nearest, until a
round joins nothing; then once with all members of other components. Tests never cross the driver
and are not repeated. Within a list, lengths and the parities of how many shingles fall into each of
1,024 bins (each bin of different parity holds one shingle that the two don't share) rule out most
pairs before a row is made of them. Lists of the same classes are one (known by their number and two
sums of hashes), and long lists are dealt as pairs of blocks.

T-occurrence. A query and its candidates' sets become inverted lists of the query's shingles. The L
longest, L = T / (0.01 log2(M) + 1) with M the longest length, are set aside; a heap merges the
others; candidates found in T - L of them are probed in the long ones by binary search, until they
have T or can't.

Rows: null, empty and wordless texts have no shingles and stay alone. Texts of fewer than five words
are one shingle. Null ids take part and get the smallest known id of their component, null if none
has one. Repeated rows are one class and come back each. A shingle is known by 64 bits of words known
by a 64-bit digest.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.lists import PAIRS, open_pairs
from barlake.llm.names import doubled, paired
from barlake.llm.order_minhash import components
from barlake.llm.shared import cut, release, small_batches, small_side

WORDS = 5
# Fixed values of the task: two sets link if 100 * common >= 80 * all.
SHARE, WHOLE = 80, 100
#: A prefix is longer than needed by the size over this, and as many long lists can be left out.
LONGER = 10
PARITY_WORDS = 16
#: Words that a task remembers; candidates of one search.
REMEMBERED, CANDIDATES = 400_000, 256
#: Cost of a probe against that of a merge step, as in DivideSkip.
PROBE = 0.01


def needed(n: int, m: int) -> int:
    """Least number of common shingles of two sets that link."""
    return wanted(n + m)


def wanted(total):
    """The same for the sum of the two sizes."""
    return -(-SHARE * total // (SHARE + WHOLE))


def least_needed(n):
    """The same over all sizes of the other set."""
    return -(-SHARE * n // WHOLE)


def spare(n):
    """Shingles of a prefix beyond those needed."""
    return np.maximum(n // LONGER, 1)


class Words(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        name = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return name


def shingle_set(text: str | None, names: Words) -> np.ndarray:
    """Sorted names of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    if len(words) >= WORDS:
        return np.unique(doubled(known, 1, WORDS))
    name = np.full(1, len(words), np.uint64)
    for word in known:
        name = paired(name, np.array([word]))
    return name if len(words) else known


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of shingles falls into bin b."""
    odd = np.bincount((tokens >> np.uint64(20)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _key(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


DESCRIBED = "id long, at long, node binary, n int, prefix array<long>, parity binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = Words()
    for batch in small_batches(batches, 2):
        sets = [shingle_set(t, names) for t in batch.column(2).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        ends = np.minimum(sizes, sizes - least_needed(sizes) + spare(sizes))
        offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *(s[:k] for s, k in zip(sets, ends))]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([_key(s) for s in sets], pa.binary()), pa.array(sizes.astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
             pa.array([parity(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["id", "at", "node", "n", "prefix", "parity"])


def _sets_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose set is that of the node: an id may have several texts."""
    names = Words()
    for batch in small_batches(batches, 1):
        sets = [shingle_set(t, names) for t in batch.column(1).to_pylist()]
        own = [k for k, node in enumerate(batch.column(0).to_pylist()) if _key(sets[k]) == node]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())),
                                          pa.array([sets[k].tobytes() for k in own], pa.binary())], names=["node", "tokens"])


# ---------------------------------------------------------------- T-occurrence

def t_occurrence(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Places of the `sets` that link with `query`, all sorted and distinct."""
    if not sets:
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    place = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[place] == flat
    place, owner = place[hit], owner[hit]
    order = np.argsort(place, kind="stable")  # owners stay in order within a list
    edges = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    runs = owner[order].tolist()
    lists = sorted((runs[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())), key=len)
    wanted = [needed(len(query), len(s)) for s in sets]
    least = min(wanted)
    if len(lists) < least:
        return []
    aside = min(int(least / (PROBE * math.log2(len(lists[-1]) + 1) + 1)), least - 1)
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    counts: dict[int, int] = {}
    for found in heapq.merge(*short):
        counts[found] = counts.get(found, 0) + 1
    linked = []
    for found, count in counts.items():
        if count < wanted[found] - aside:
            continue
        for k in range(len(long) - 1, -1, -1):  # the longest first: it holds most candidates
            if count >= wanted[found] or count + k + 1 < wanted[found]:
                break
            at = bisect_left(long[k], found)
            count += at < len(long[k]) and long[k][at] == found
        if count >= wanted[found]:
            linked.append(found)
    return sorted(linked)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) of neighbouring a: the pairs that link."""
    for batch in batches:
        names, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        queries, tokens = batch.column(2), batch.column(3)
        edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        linked = []
        for low, high in zip(edges[:-1], edges[1:]):
            for at in range(low, high, CANDIDATES):
                sets = [np.frombuffer(tokens[k].as_py(), np.uint64) for k in range(at, min(at + CANDIDATES, high))]
                linked += [at + k for k in t_occurrence(np.frombuffer(queries[at].as_py(), np.uint64), sets)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(linked, pa.int64())),
                                          batch.column(1).take(pa.array(linked, pa.int64()))], names=["a", "b"])


# ---------------------------------------------------------------- classes and links

def _number() -> Column:
    return F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long").alias("no")


class Join:
    """The classes of `docs`, their short lists, and the search for links between classes.

    In lists a class goes by `no`, seven bytes of its name; where two classes have the same, both
    stand for it.
    """

    def __init__(self, docs: DataFrame):
        self.texts = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("at"), "text")
        self.described = cut(self.texts.mapInArrow(_describe, DESCRIBED))
        self.nodes = cut(self.described.where("node IS NOT NULL").groupBy("node").agg(
            F.min("id").alias("id"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("parity").alias("parity"),
            F.count("*").alias("rows")).select("node", _number(), "id", "at", "n", "parity", "rows"))
        self.members = cut(self._short_lists())
        release(docs.sparkSession)

    def _short_lists(self) -> DataFrame:
        """(token, no, weight) of each class and each of its short lists; of lists of the same classes one."""
        several = small_side(cut(self.nodes.where("rows > 1").select("node")))
        described = self.described.where("node IS NOT NULL").select("node", "n", "prefix")
        prefixes = described.join(several, "node", "left_anti").unionAll(
            described.join(several, "node", "left_semi").dropDuplicates(["node"]))
        postings = prefixes.select(_number(), "n", F.explode("prefix").alias("token"))
        lists = postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
        smaller = F.ceil(F.col("n") * SHARE / WHOLE)
        own = F.array_sort(F.collect_list(F.struct("size", "token")))
        mine = postings.join(lists, "token").groupBy("no", "n").agg(own.alias("lists"), F.sum("size").alias("weight"))
        left_out = F.greatest(F.floor(smaller / LONGER).cast("int"), F.lit(1)) - 1
        kept = F.slice("lists", F.lit(1), F.greatest(F.size("lists") - left_out, F.lit(0)))
        short = cut(mine.select("no", "weight", F.explode(kept["token"]).alias("token")))
        names = [F.sum(F.xxhash64("no", F.lit(k)).cast("decimal(38,0)")).alias(f"name{k}") for k in range(2)]
        same = (short.groupBy("token").agg(F.count("*").alias("size"), *names).where("size > 1")
                .groupBy("size", "name0", "name1").agg(F.min("token").alias("token")).select("token"))
        return short.join(same, "token", "left_semi")

    def hub_pairs(self) -> DataFrame:
        """Each class with the hub of each of its lists."""
        hubs = self.members.groupBy("token").agg(F.max(F.struct("weight", "no")).alias("hub"))
        met = self.members.join(hubs.select("token", F.col("hub.no").alias("hub")), "token").where("no != hub")
        pairs = met.select(F.least("no", "hub").alias("x"), F.greatest("no", "hub").alias("y")).distinct()
        named = self.nodes.select("no", "node")
        pairs = (pairs.join(named.select(F.col("no").alias("x"), F.col("node").alias("p")), "x")
                 .join(named.select(F.col("no").alias("y"), F.col("node").alias("q")), "y"))
        return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    def open_pairs(self, roots: DataFrame, every: bool) -> DataFrame:
        """Pairs of different components that share a short list and may link."""
        known = self.nodes.select("no", "node", "n", "parity")
        return open_pairs(self.members.select(F.col("token").alias("list"), "no").join(known, "no").drop("no"), roots, every, wanted)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the written `pairs` that link."""
        wanted = small_side(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                                .join(self.nodes.select("node", "at"), "node")))
        sets = cut(self.texts.join(wanted, "at").select("node", "text").mapInArrow(_sets_of_nodes, "node binary, tokens binary")
                   .dropDuplicates(["node"]))
        both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a"))
        found = cut(both.select("a", "b", "x", "y").sortWithinPartitions("a").mapInArrow(_search, PAIRS))
        del wanted, sets, both
        release(pairs.sparkSession)
        return found

    def roots(self) -> DataFrame:
        """(node, root) of all classes that link with another."""
        tested = cut(self.hub_pairs())
        found = components(self.linked(tested))
        for every in (False, True):
            while True:
                pairs = cut(self.open_pairs(found, every).join(tested, ["a", "b"], "left_anti"))
                if pairs.isEmpty():
                    break
                more = self.linked(pairs)
                tested = cut(tested.unionAll(pairs))
                if not more.isEmpty():
                    found = components(more, found)
                if every or more.isEmpty():  # all have been tested, or the next round would name the same
                    break
        return found


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, root, component) of every document.

    `node` is its class, `root` tells the components apart, `component` is the smallest id in it; the
    three are null without words.
    """
    join = Join(docs)
    placed = cut(join.nodes.select("node", "id").join(join.roots(), "node", "left")
                 .select("node", "id", F.coalesce("root", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))
    named = placed.join(smallest, "root").select(F.col("node").alias("own"), "root", "component")
    own = F.coalesce("node", F.xxhash64("at").cast("string").cast("binary"))  # no class has such a name
    return (join.described.select(F.col("id").alias("doc_id"), "n", "node", own.alias("own")).join(named, "own", "left").drop("own"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: the size of its set and the smallest id of its component, its own if it is alone."""
    return joined(docs.select("doc_id", "text")).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
