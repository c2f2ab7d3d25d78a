"""Near-duplicate groups by bottom-k sketches from one hash function.

* A document's set is its distinct word shingles, as 64-bit hashes; its sketch is
  the ``k`` smallest of their upper halves. Documents of equal sets are one class from the start.
* Inverted lists: each two neighbours in a sketch's order make one key. Of two
  documents with the similarity asked for, two neighbouring values of their
  union's sketch are in both but for a chance of about 2e-7 at ``k`` = 48; for
  sets no larger than ``k`` it is certain. In each list, every class is paired with the
  most central one, which is in most lists. Lists of up to ``SHORT`` classes then give
  all their pairs that would still join two groups.
* The sketch of the union, made from both sketches, estimates each pair's
  similarity; pairs more than ``SIGMAS`` standard errors below the threshold go.
* The rest is decided by exact Jaccard on the full sets.
* A long list whose members are then in one group is done. In any other, members of
  different groups are compared, block by block, so that no task holds more than two
  blocks of a list. Those members have wider sketches (``WIDE`` values, for most texts
  the whole set), so that hardly a pair is passed on that is not similar. A pair is
  passed on by the smallest key it shares only. Each class first gives its best pairs,
  one for each other group before a second for any; once those are decided, classes
  that had more give more of what is still apart, until none has any left. So what is
  passed on grows with the classes, and no pair that could join two groups is left out.

How sure it is: a pair of exactly the threshold's similarity falls below the estimate
that is asked for (20 of 48 values) with a chance of 2e-7, and more similar pairs far
more rarely. Links are decided on sets of 64-bit hashes of the shingles.

Defined results. A null or empty text, or one of white space only, has no set and
is linked with nothing. A text with fewer words than a shingle has one shingle,
all its words. A null id has a null component and is linked with nothing; rows
that repeat an id are one document, linked by the texts of any of them (``n_shingles``
is each row's own). Other columns are not read. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import few, pieces, release, thrifty, written
from quillspark.llm.graph import components

WORDS, THRESHOLD, K = 5, 75, 48
SHORT, SIGMAS, BLOCK = 6, 5.4, 2048
#: Values of the sketches that members of long lists have; pairs that each gives first, and how many times as many each time after.
WIDE, FIRST, MORE = 1024, 3, 16
#: Columns and pairs looked at together.
STEP = 2048
#: Bits of the filter that spares texts without a candidate the shuffle (2 MB, whatever the input).
FILTER_BITS = 24
_P = np.uint64(0x9E3779B97F4A7C15)
_KNOWN = 200_000
_PAD = 1 << 40
#: Bytes of sets that are passed on together.
_BYTES = 8 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > _KNOWN:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (signed order)."""
    h = word_hashes(text.encode().lower().split(), known)
    n = min(words, len(h))
    if not n:
        return np.zeros(0, dtype=np.int64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mixed(out * _P + h[k : len(h) - n + 1 + k])
    return np.unique(out.view(np.int64))


def _signatures(k: int, words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for part in pieces(parts, 1):
            sizes, digests, sketches = [], [], []
            for x in part.column(1):
                found = shingle_set(x.as_py() or "", known, words)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketches.append(np.unique((found >> 32).astype(np.int32))[:k].copy())
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
            values = np.concatenate([*sketches, np.zeros(0, dtype=np.int32)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_shingles", "digest", "sketch"])

    return run


def _postings(reps: DataFrame) -> DataFrame:
    """A row for each class and key: ``rep``, ``key``."""
    keys = F.expr("zip_with(slice(sketch, 1, size(sketch) - 1), slice(sketch, 2, size(sketch) - 1), (a, b) -> shiftleft(cast(a AS BIGINT), 32) | (b & 4294967295L))")
    return reps.filter(F.size("sketch") > 1).select("rep", F.explode(keys).alias("key"))


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stars, held)`` of classes (``rep``, ``sketch``): pairs ``a`` < ``b`` of each list's
    members with its most central one, and the lists (``key``, ``rep``, ``length``), written."""
    postings = _postings(reps)
    lengths = postings.groupBy("key").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    held = written(postings.join(lengths, "key"))
    many = held.filter("length > 2")
    ranked = many.join(many.groupBy("rep").agg(F.count(F.lit(1)).alias("rank")), "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("rep")).alias("back"))).alias("hub"))
    members = many.join(hubs.select("key", (-F.col("hub.back")).alias("hub")), "key").filter("hub != rep")
    return members.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct(), held


def close(held: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs ``a`` < ``b`` of short lists whose members are not in one group yet."""
    node = groups.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    placed = held.filter(F.col("length") <= SHORT).join(node, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    apart = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "c"))).alias("all"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high")
    one = apart.select("all", F.posexplode("all").alias("i", "x"))
    two = one.select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(SHORT))).alias("y")).filter("x.c != y.c AND x.rep < y.rep")
    return two.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _floor(threshold: int, k: int) -> float:
    """Estimate from ``k`` values below which a pair is ruled out."""
    t = threshold / 100
    return t - SIGMAS * (t * (1 - t) / k) ** 0.5


def completed(lists: DataFrame, groups: DataFrame, wide: DataFrame, threshold: int, k: int, most: int) -> DataFrame:
    """Pairs of long lists that may still join two groups, by blocks. ``wide``: ``rep``,
    ``n``, ``sketch`` of ``WIDE`` values. ``more`` marks the pairs of a class that has more
    than the ``most`` it gives."""
    node = groups.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    placed = lists.select("key", "length", "rep").join(node, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    split = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("key")
    members = placed.join(split, "key").join(wide, "rep")
    n = F.ceil(F.col("length") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    tasks = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = tasks.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c", "sketch")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(parts):
            if (found := _likely(group, threshold, k, most)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "estimate", "more"])

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(thrifty(compare), "a long, b long, estimate double, more boolean")
    return pairs.groupBy("a", "b").agg(F.max("estimate").alias("estimate"), F.max("more").alias("more"))


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal (key, i, j) together; they come sorted. A group is two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        names = np.stack([part.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                name = tuple(names[a].tolist())
                if held and name != last:
                    yield pa.concat_batches(held)
                    held = []
                held.append(part.slice(a, b - a))
                last = name
    if held:
        yield pa.concat_batches(held)


def _common(rows: np.ndarray, x: np.ndarray, y: np.ndarray, pad: int) -> np.ndarray:
    """How many values each row of ``x`` shares with each of ``y``; ``rows`` are padded."""
    at, cols = np.nonzero(rows != pad)
    _, value, count = np.unique(rows[at, cols], return_inverse=True, return_counts=True)
    fine = count[value] > 1
    at, value = at[fine], (np.cumsum(count > 1) - 1)[value[fine]]
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    n = int(value[-1]) + 1 if len(value) else 0
    for start in range(0, n, STEP):
        a, b = np.searchsorted(value, (start, start + STEP))
        held = np.zeros((len(rows), min(STEP, n - start)), dtype=np.float32)
        held[at[a:b], value[a:b] - start] = 1
        out += held[x] @ held[y].T
    return out


def _estimates(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of the union's sketch that both sketches hold, and the union's size up to
    ``k``; padded, a row for each pair."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    fresh = np.concatenate([np.ones((len(both), 1), dtype=bool), ~again], axis=1)
    kept = (np.cumsum(fresh, axis=1, dtype=np.int32) <= k) & (both != _PAD)
    size = (fresh & kept).sum(axis=1)
    return (again & kept[:, 1:]).sum(axis=1) / size, size


def _rank(*of: np.ndarray) -> np.ndarray:
    """Place among the equal ones, of rows in order."""
    first = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in of], axis=0)])
    return np.arange(len(first)) - np.flatnonzero(first)[np.cumsum(first) - 1]


def _likely(group: pa.RecordBatch, threshold: int, k: int, most: int) -> tuple[np.ndarray, ...] | None:
    """Of each member, the best pairs with members of other groups that the union's
    sketch does not rule out and that share no smaller key."""
    key = group.column(0)[0].as_py()
    twice = group.column(1)[0].as_py() != group.column(2)[0].as_py()
    own, reps, sizes, comps = (group.column(c).to_numpy() for c in (3, 4, 5, 6))
    ends = group.column(7).offsets.to_numpy()
    counts = np.diff(ends)
    wide = np.full((len(reps), max(k, int(counts.max()))), _PAD, dtype=np.int64)
    wide[np.repeat(np.arange(len(reps)), counts), np.arange(counts.sum()) - np.repeat(ends[:-1] - ends[0], counts)] = group.column(7).flatten().to_numpy()
    rows, counts = wide[:, :k], np.minimum(counts, k)
    keys = (rows[:, :-1] << 32) | (rows[:, 1:] & 0xFFFFFFFF)
    keys = np.where((rows[:, 1:] != _PAD) & (keys < key), keys, key)
    x = np.flatnonzero(own == own.min())
    y = np.flatnonzero(own == own.max()) if twice else x
    if twice and own.min() == own.max():
        return None
    low, high = np.minimum.outer(sizes[x], sizes[y]), np.maximum.outer(sizes[x], sizes[y])
    likely = (comps[x][:, None] != comps[y][None, :]) & (100 * low >= threshold * high)
    if not twice:
        likely = np.triu(likely, 1)
    if not likely.any():
        return None
    # values in both sketches are at least as many as count for the estimate
    likely &= _common(rows, x, y, _PAD) >= _floor(threshold, k) * np.maximum.outer(counts[x], counts[y])
    if not likely.any():
        return None
    likely &= _common(keys, x, y, key) == 0
    p, q = np.nonzero(likely)
    p, q = x[p], y[q]
    estimate = np.zeros(len(p))
    for sketch, size in ((rows, k), (wide, WIDE)):
        for i in range(0, len(p), STEP):
            share, n = _estimates(sketch[p[i : i + STEP]], sketch[q[i : i + STEP]], size)
            # a union that its sketch holds whole is known, but for equal halves of hashes
            estimate[i : i + STEP] = np.where(share >= np.where(n < size, threshold / 100 - 0.005, _floor(threshold, size)), share, -1)
        fine = estimate >= 0
        p, q, estimate = p[fine], q[fine], estimate[fine]
    if not len(p):
        return None
    # both ways, so that each member gives its best
    p, q, estimate = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([estimate] * 2)
    order = np.lexsort((reps[q], -estimate, comps[q], p))
    p, q, estimate = p[order], q[order], estimate[order]
    order = np.lexsort((-estimate, _rank(p, comps[q]), p))
    p, q, estimate = p[order], q[order], estimate[order]
    given = _rank(p) < most
    more = np.bincount(p, minlength=len(reps))[p] > most
    a, b = reps[p], reps[q]
    return tuple(c[given] for c in (np.minimum(a, b), np.maximum(a, b), estimate, more))


def estimated(pairs: DataFrame, reps: DataFrame, threshold: int = THRESHOLD, k: int = K) -> DataFrame:
    """Pairs that the union's sketch does not rule out, with the estimate."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    union = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    share = union.select("a", "b", (F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u")).alias("estimate"))
    return share.filter(F.col("estimate") >= _floor(threshold, k))


def _wanted(ids: DataFrame) -> np.ndarray:
    """Bits of the ids; FILTER_BITS bound what comes to the driver."""
    h = F.xxhash64("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 AS INT))")
    rows = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    found = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return found


def _sets(ids: DataFrame, docs: DataFrame, words: int, k: int | None) -> DataFrame:
    """Of the documents (``rep``, ``text``) with an id, and a few others: ``rep``, ``n`` and,
    written, the sketch of ``k`` values (``sketch``) or else the whole set (``s``)."""
    sent = docs.sparkSession.sparkContext.broadcast(_wanted(ids))
    texts = docs.select("rep", F.xxhash64("rep").alias("h"), "text")
    kind = pa.list_(pa.int32()) if k else pa.binary()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bits = sent.value
        for part in pieces(parts, 2):
            h = part.column(1).to_numpy() & ((1 << FILTER_BITS) - 1)
            part = part.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            out, sizes, held = [], [], 0
            for row, x in enumerate(part.column(2)):
                found = shingle_set(x.as_py() or "", known, words)
                sizes.append(len(found))
                out.append(np.unique((found >> 32).astype(np.int32))[:k].copy() if k else found.tobytes())
                held += out[-1].nbytes if k else len(out[-1])
                if held > _BYTES:
                    yield pa.RecordBatch.from_arrays([part.column(0)[row + 1 - len(out) : row + 1], pa.array(sizes, pa.int64()), pa.array(out, kind)], names)
                    out, sizes, held = [], [], 0
            yield pa.RecordBatch.from_arrays([part.column(0)[part.num_rows - len(out) :], pa.array(sizes, pa.int64()), pa.array(out, kind)], names)

    names = ["rep", "n", "sketch" if k else "s"]
    return written(texts.mapInArrow(thrifty(run), f"rep long, n long, {'sketch array<int>' if k else 's binary'}"))


def _verified(pairs: DataFrame, docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """Pairs whose full sets have the similarity, written."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fine = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    full = _sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, words, None)
    one = pairs.select("a", "b").join(full.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a")
    two = one.join(full.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    sure = written(two.mapInArrow(thrifty(compare), "a long, b long"))
    release(full)
    return sure


def _joined(pairs: DataFrame, texts: DataFrame, threshold: int, words: int, groups: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """``groups`` (node, component, written) after all ``pairs`` that hold and would still
    join two groups. Pairs ``tried`` are left out, and those tried now are added."""
    at = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    apart = pairs.select("a", "b")
    for some in tried:
        apart = apart.join(some, ["a", "b"], "left_anti")
    apart = apart.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
    now = written(apart.select("a", "b"))
    tried.append(now)
    if now.isEmpty():
        return groups
    sure = _verified(now, texts, threshold, words)
    out = components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(sure))
    release(groups, sure)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = WORDS, k: int = K) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = written(rows.mapInArrow(thrifty(_signatures(k, words)), "doc_id long, n_shingles long, digest binary, sketch array<int>"))
    classes = base.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    copies = written(classes.filter("size > 1").select("digest", "rep"))
    classed = base.filter("digest IS NOT NULL AND doc_id IS NOT NULL").join(copies, "digest", "left")
    reps = classed.filter("rep IS NULL OR doc_id = rep")
    reps = written(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "digest", "sketch").dropDuplicates(["rep", "digest"]).drop("digest"))
    # an id with texts of several classes joins them
    own = classed.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = written(own.filter("a < b").select("doc_id"))
    same = classed.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.coalesce("rep", "doc_id").alias("b"))
    groups = docs.sparkSession.createDataFrame([], "node long, component long") if several.isEmpty() else components(same)
    texts = rows.withColumnRenamed("doc_id", "rep").filter("rep IS NOT NULL")
    tried: list[DataFrame] = []
    stars, held = candidates(reps)
    for pairs in (lambda: stars, lambda: close(held, groups)):
        likely = written(estimated(pairs(), reps, threshold, k))
        groups = _joined(likely, texts, threshold, words, groups, tried)
        release(likely)
    release(reps, several)
    lists = held.filter(F.col("length") > SHORT).select("key", "length", "rep")
    if not lists.isEmpty():
        most, wide = FIRST, _sets(lists.select(F.col("rep").alias("id")), texts, words, WIDE)
        while True:
            found = written(completed(lists, groups, wide, threshold, k, most))
            more = not found.filter("more").isEmpty()
            groups = _joined(found, texts, threshold, words, groups, tried)
            release(found)
            if not more:
                break
            most *= MORE
        release(wide)
    release(held, *tried)
    rep = F.coalesce("rep", "doc_id")
    classed = base.select("doc_id", "n_shingles", "digest").join(copies, "digest", "left").withColumn("rep", rep)
    found = classed.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, or null, with all their columns."""
    gone = few(written(near_duplicates(docs, id_col, text_col).filter("NOT kept").select("doc_id").distinct()))
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d
), each AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.node = l.a
)
SELECT s.doc_id, len(sh) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
