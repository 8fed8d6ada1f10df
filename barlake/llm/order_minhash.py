"""Near-duplicate documents by order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it occurred before.
A sketch takes the four labelled shingles of least hash and keeps them in the order of the text;
texts that share a sketch share four shingles in the same order. Sixteen sketches, each a bucket of
its own, miss a long pair of similarity 0.8 about twice in ten thousand, and shorter ones more often:
15 times with 8 common shingles of 10, 5 times with 16 of 20, 3 times with 40 of 50.

Of two similar texts with 4 to 7 shingles in the shorter one, or 8 and 9, the longer has one shingle
more. So texts of 4 to 8 shingles have one more bucket for their whole sequence, and texts of 5 to 9
one for each sequence with one shingle left out: these pairs always meet.

Similarity keeps order too: with L the length of the longest common subsequence of the shingles of
two texts, it is L / (n1 + n2 - L), the share of common shingles if none changed places. A pair is
verified by an alignment restricted to the band outside of which no similar pair can align.

Before that, the parities of how many shingles of a text fall into each of 2,048 bins bound the number
of shingles that two texts do not share: each bin of different parity holds one at least. Pairs
above what the similarity allows are dropped on sight.

Buckets are never turned into all their pairs. First every member is compared with the hub, the
member whose buckets are largest together. Links become components; a bucket whose members are all in
one component is done. In the others each member is compared with the one of another component that
may be nearest, for a few rounds; then once with all of other components, so no link between
different components is lost.

Rows: documents of equal words are one class from the start, and go on as one row. A text of fewer
than five words is one shingle. Null, empty and wordless texts have no shingles and stay alone. The
group of a document is the smallest id in its component; null ids are ignored in that.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.lists import open_pairs
from barlake.llm.names import MULTIPLIER, doubled, mixed, paired
from barlake.llm.packed import firsts
from barlake.llm.shared import cut, release, small_batches, small_side, tidy, utf8
from barlake.llm.words import words_of
from barlake.sources.scratch import drop_kept, kept

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 16
KEPT = 4
#: Shingles of the texts that get a bucket for their sequence; those with one more get some without one.
SHORT = range(KEPT, 9)
#: Rounds in which each member of a bucket names the nearest of another component, before the one for all.
NEAREST_ROUNDS = 3
#: 64-bit words of parities of a text.
PARITY_WORDS = 32
#: Words that are compared before all others.
FIRST_WORDS = 8
#: Links that one task of a round of components takes, both ways counted.
EDGES_OF_A_TASK = 200_000
#: Bits of hash that are looked at first: enough for this many shingles of a text on average.
EXPECTED = 16


def shingles_of(names: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of all shingles and the offsets of each text in them."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = bounds[text] + np.arange(offsets[-1]) - offsets[text]
    padded = np.concatenate([names, np.zeros(words, np.uint64)])
    found = doubled(padded, 1, words)[at]
    for k in np.flatnonzero((counts > 0) & (counts < words)):  # a short text is one shingle
        name = np.uint64(counts[k])
        for word in names[bounds[k]:bounds[k + 1]]:
            name = paired(np.array([name]), np.array([word]))[0]
        found[offsets[k]] = name
    return found, offsets


def labelled(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Names that also tell the occurrence of a shingle within its text."""
    order = np.lexsort((names, text))
    fresh = firsts(names[order]) | firsts(text[order])
    first = np.flatnonzero(fresh)
    turn = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    found = np.empty_like(names)
    found[order] = names[order] + turn.astype(np.uint64) * MULTIPLIER
    return mixed(found)


def _least(values: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the KEPT smallest values of each text, ordered by text and place."""
    sizes = np.diff(offsets)
    share = np.minimum(1.0, EXPECTED / np.maximum(sizes, 1))
    limit = np.where(share < 1, share * 2.0 ** 64, 0).astype(np.uint64)
    limit[share >= 1] = np.uint64(2 ** 64 - 1)
    some = np.flatnonzero(values <= limit[text])
    found = np.bincount(text[some], minlength=len(sizes))
    short = np.flatnonzero(found < np.minimum(sizes, KEPT))
    if len(short):  # too few below the limit: all places of these texts
        some = some[~np.isin(text[some], short)]
        some = np.concatenate([some, *(np.arange(offsets[k], offsets[k + 1]) for k in short)])
    order = np.lexsort((values[some], text[some]))
    some = some[order]
    first = np.flatnonzero(firsts(text[some]))
    rank = np.arange(len(some)) - np.repeat(first, np.diff(np.append(first, len(some))))
    return np.sort(some[rank < KEPT])


def sketches(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SKETCHES ordered sketches of each text, as names."""
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    label = labelled(names, text) if len(names) else names
    found = np.zeros((len(sizes), SKETCHES), np.uint64)
    factors = mixed(np.arange(101, 101 + SKETCHES, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    for s in range(SKETCHES if len(names) else 0):
        places = _least(label * factors[s], text, offsets)
        owner = text[places]
        first = np.flatnonzero(firsts(owner))
        count = np.diff(np.append(first, len(owner)))
        name = np.full(len(first), s + 1, np.uint64)
        for k in range(KEPT):
            has = count > k
            name[has] = paired(name[has], label[places[first[has] + k]])
        found[owner[first], s] = mixed(name)
    return found


def short_buckets(names: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Names of the sequences of each short text: the whole one, and those without one shingle."""
    found = [np.zeros(0, np.int64)] * (len(offsets) - 1)
    sizes = np.diff(offsets)
    for k in np.flatnonzero((sizes >= SHORT.start) & (sizes <= SHORT.stop)):
        own, size = names[offsets[k]:offsets[k + 1]].tobytes(), int(sizes[k])
        sequences = {own} if size in SHORT else set()
        if size - 1 in SHORT:
            sequences |= {own[:8 * i] + own[8 * i + 8:] for i in range(size)}
        found[k] = np.array([int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True)
                             for x in sorted(sequences)], np.int64)
    return found


SKETCH = "id long, at long, key long, node binary, n int, buckets array<long>, parity array<long>"


def parities(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """PARITY_WORDS words for each text: bit b is set if an odd number of its shingles falls into bin b."""
    found = np.zeros((len(offsets) - 1, PARITY_WORDS), np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bin_ = names >> np.uint64(64 - (PARITY_WORDS * 64).bit_length() + 1)
    np.bitwise_xor.at(found, (text, (bin_ >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bin_ & np.uint64(63)))
    return found.view(np.int64)


def _sequence_keys(words: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each text's sequence of words; None without words."""
    return [blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(bounds[:-1], bounds[1:])]


def _sketch(batches):
    for batch in small_batches(batches, 3):
        _, _, words, bounds = words_of(*utf8(batch.column(3)))
        names, offsets = shingles_of(words, bounds)
        found, more = sketches(names, offsets).view(np.int64), short_buckets(names, offsets)
        buckets = np.concatenate([[0], np.cumsum([SKETCHES + len(x) for x in more])]).astype(np.int32)
        each = np.arange(batch.num_rows + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(_sequence_keys(words, bounds), pa.binary()),
             pa.array(np.diff(offsets).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(buckets), pa.array(np.concatenate(
                 [found[:0].ravel(), *(x for both in zip(found, more) for x in both)]))),
             pa.ListArray.from_arrays(pa.array(each * PARITY_WORDS), pa.array(parities(names, offsets).ravel()))],
            names=["id", "at", "key", "node", "n", "buckets", "parity"])


def _shingles_of_nodes(batches):
    """Shingles of the texts whose words are those of the node: an id may have several texts."""
    for batch in small_batches(batches, 1):
        _, _, words, bounds = words_of(*utf8(batch.column(1)))
        names, offsets = shingles_of(words, bounds)
        keys, nodes = _sequence_keys(words, bounds), batch.column(0).to_pylist()
        some = [k for k in range(len(nodes)) if keys[k] == nodes[k]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some, pa.int64())),
             pa.array([names[offsets[k]:offsets[k + 1]].tobytes() for k in some], pa.binary())],
            names=["node", "shingles"])


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie at most `band` places apart.

    Bit-parallel: bit i of a row says that the length grows at a[i]; each element of b is one step.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        match = places.get(x, 0)
        if match:
            match &= (window << (j - band)) if j >= band else (window >> (band - j))
            if match:
                hit = row & match
                row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the ordered similarity of two shingle sequences is at least `least`."""
    total = len(a) + len(b)
    needed = least * total / (1 + least)
    if min(len(a), len(b)) < needed - 1e-9:
        return False
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(nx[i], ny[j]).sum() < needed - 1e-9:  # no alignment can have more
        return False
    low = 0
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    low = int(differ[0]) if len(differ) else size
    differ = np.flatnonzero(a[low:][::-1][:size - low] != b[low:][::-1][:size - low])
    high = int(differ[0]) if len(differ) else size - low
    a, b = a[low:len(a) - high], b[low:len(b) - high]  # equal ends align
    return low + high + common_subsequence(a, b, int(total - 2 * needed + 1e-9)) >= needed - 1e-9


def _verify(least: float):
    def task(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                             names=["a", "b"])
    return task


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The similar ones of the written `pairs` (a, b) of nodes; each is a row of `nodes` and has its
    text in the row `at` of `texts`."""
    wanted = small_side(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                            .join(nodes.select("node", "at"), "node")))
    rows = cut(texts.join(wanted, "at").select("node", "text")
               .mapInArrow(tidy(_shingles_of_nodes), "node binary, shingles binary").dropDuplicates(["node"]))
    both = (pairs.join(rows.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(rows.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    found = cut(both.select("a", "b", "x", "y").mapInArrow(tidy(_verify(least)), "a binary, b binary"))
    del wanted, rows, both
    release(pairs.sparkSession)
    return found


def _wanted(least: float):
    """Least number of common shingles of two texts whose sizes add up to a total."""
    return lambda total: np.ceil(total * (least / (1 + least)) - 1e-9).astype(np.int64)


def _moved(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The links between the roots of the ends of `edges`, each once; none within a root."""
    a, b = (roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b"))
    return (edges.join(a, "a", "left").join(b, "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a != b").distinct())


def _composed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, moved) of `nodes` with the roots of their roots, if these have others."""
    return (nodes.join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("node", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved")))


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes with links, the root being the smallest node of the component.

    In a round every node goes over to its smallest neighbour, if that is smaller, and on to the last
    where that goes; only the links between what is left are read in the next round. After two rounds
    at most half of the nodes are left. Each round is written as a table: through a checkpoint Spark
    would carry what it infers about the columns from round to round, more each time. Links are (a, b).

    `before` are the components of earlier links, which are not read again.
    """
    both = links.select("a", "b").unionAll(links.select("b", "a")).where("a != b")
    edges = kept(both.distinct() if before is None else _moved(both, before))
    rounds, most = [], 1 if before is None else before.count() // EDGES_OF_A_TASK + 1
    while count := edges.count():
        tasks = count // EDGES_OF_A_TASK + 1  # a small graph leaves a few files a round, not one for each of many tasks
        most = max(most, tasks)
        near = edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
        roots = kept(_composed(near, near).coalesce(tasks))
        while roots.where("moved").limit(1).count():  # twice as far each time
            after = kept(_composed(roots, roots).coalesce(tasks))
            drop_kept(roots)
            roots = after
        left = kept(_moved(edges, roots).coalesce(tasks))
        drop_kept(edges)
        rounds.append(roots)
        edges = left
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))  # no links, no nodes
    for roots in reversed(rounds):
        found = _composed(roots, found).drop("moved")
    if before is not None:
        found = _composed(before, found).drop("moved").unionAll(found.join(before, "node", "left_anti"))
    found = kept(found.coalesce(most))
    for table in (*rounds, edges):
        drop_kept(table)
    release(links.sparkSession)
    return found


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, at, key, node, root, group) of every document.

    `group` is the smallest id of all documents similar to it, or to documents similar to it, and so
    on; `root` tells the groups apart. `node` is the key of its words. All three are null without
    words. `at` is the id, or a hash of the text if that is null, and `key` a hash of the text.
    """
    texts = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("at"),
                        F.xxhash64("text").alias("key"), "text")
    sketched = cut(texts.mapInArrow(tidy(_sketch), SKETCH))
    nodes = cut(sketched.where("node is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("buckets").alias("buckets"),
        F.first("parity").alias("parity")))
    texts = texts.select("at", "text")
    entries = nodes.select("node", "n", F.posexplode("buckets").alias("sketch", "name")).select(
        F.xxhash64(F.least("sketch", F.lit(SKETCHES)), "name").alias("bucket"), "node", "n")  # sequences meet in any place
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sized = cut(entries.join(shared, "bucket").select("bucket", "node", "size"))
    weights = sized.groupBy("node").agg(F.sum("size").alias("weight"))
    members = cut(sized.join(weights, "node").select(F.col("bucket").alias("list"), "node", "weight"))
    known = nodes.select("node", "n", "parity")

    def may_be(a: str, b: str) -> Column:
        """Whether the lengths and parities of two texts allow the similarity."""
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        allowed = (n + m) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
        x, y = F.col(f"{a}parity"), F.col(f"{b}parity")
        some = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(FIRST_WORDS)), F.lit(0))  # drops most at once
        differ = F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))),
                             F.lit(0), lambda total, bits: total + bits)
        return ((F.least(n, m) >= F.lit(least) * F.greatest(n, m))  # all of the shorter would match
                & (some <= allowed) & (differ <= allowed))

    def named(side: str) -> DataFrame:
        return known.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_parity"))

    # the original of a family shares more buckets with its copies than they share with each other
    hubs = members.groupBy("list").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    met = members.join(hubs, "list").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    tested = cut(met.distinct().join(named("a"), "a").join(named("b"), "b").where(may_be("a_", "b_")).select("a", "b"))
    found = components(_verified(tested, texts, nodes, least))
    described = members.select("list", "node").join(known, "node")
    for every in (*[False] * NEAREST_ROUNDS, True):  # the last round leaves nothing out, however few were before it
        pairs = cut(open_pairs(described, found, every, _wanted(least)).join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        more = _verified(pairs, texts, nodes, least)
        tested = cut(tested.unionAll(pairs))
        if not more.isEmpty():
            found = components(more, found)
    placed = cut(nodes.join(found, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("id").alias("group"))
    named = small_side(cut(placed.join(smallest, "root").select(F.col("node").alias("own"), "root", "group")))
    own = F.coalesce("node", F.xxhash64("at").cast("string").cast("binary"))  # none has such a key
    return (sketched.select(F.col("id").alias("doc_id"), "at", "key", "node", own.alias("own"))
            .join(named, "own", "left").drop("own"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` with one document of each group: that of the smallest id, or without ids
    that of the smallest hash. Documents without words stay; of repeated rows one stays."""
    found = cut(near_duplicates(docs, least).where("root is not null"))
    order = F.struct(F.col("doc_id").isNull(), F.col("at"), F.col("key"))
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    marked = cut(found.join(first, "root").select("at", "key", (order == F.col("first")).alias("stays")))
    gone = small_side(cut(marked.where("not stays").select("at", "key").distinct()))
    twice = cut(marked.where("stays").groupBy("at", "key").count().where("count > 1").select("at", "key"))
    keyed = docs.withColumns({"__at": F.coalesce("doc_id", F.xxhash64("text")), "__key": F.xxhash64("text")})

    def those(side: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(side.select(F.col("at").alias("__at"), F.col("key").alias("__key")), ["__at", "__key"], how)

    left = those(gone, "left_anti", keyed)
    if not twice.isEmpty():
        left = those(twice, "left_anti", left).unionByName(
            those(twice, "left_semi", left).dropDuplicates(["__at", "__key"]))
    return left.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document: the smallest id of its group, which is its own if nothing is similar."""
    found = near_duplicates(docs.select("doc_id", "text"))
    group = F.coalesce("group", "doc_id")
    return found.select("doc_id", group.alias("group_id"), group.eqNullSafe(F.col("doc_id")).alias("first"))
