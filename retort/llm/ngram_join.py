"""Near-duplicate documents: a size-aware heavy-light join on word-shingle sets.

Two sets link when 100 * intersection >= percent * union. Of two linked sets of which the larger
has n shingles, at least ``percent * n / 100`` are shared, so in any one order of all shingles the
first ``n - that + c`` of both share c of them. The order takes shingles in rarely filled cells of
a count sketch first; it need not be exact, only the same everywhere.

* light (small) sets: all pairs of the shingles in the prefix for c = 2 are enumerated; two light
  sets that link have such a pair in common;
* heavy (large) sets: inverted lists of the prefix for c = 1 are scanned; light sets large enough to
  link with a heavy one are in the lists too;
* the boundary is the size at which the cost of both, enumerated pairs and scanned entries over
  all documents, is least.

Equal sets are one class first. A list may be long (copies, common passages), so not all its pairs
are made: in each of two rounds, classes are compared with the leads of their lists, one per list,
and after that pairs of classes that are in different components by then are counted, exactly. In
each list the classes outside its most frequent component are joined with all classes, so no pairs
are made within that component. The first leads are the classes with the fewest rarer shingles: of
near copies of one text the nearest to it, with which most of the others link. The join drops pairs
whose parities of parts of the shingles differ in more places than linked sets differ in shingles;
that is exact. Every candidate is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.text import CHUNK_BYTES, Words, mix, pieces, release, saved, signed, small_batches

NGRAM = 5
PERCENT = 80

#: Cells of the count sketch: fixed, as only the order of shingles and costs come from it.
CELLS = 1 << 20
#: Cells of the sketch that are added up as one row.
RUN_OF_CELLS = 1 << 12
#: Longs of a set's marks: parities by which most sets that don't link are told apart unseen.
MARKS = 8
WANTED_CELLS = 1 << 20
MARK_NAMES = [f"marks_{k}" for k in range(MARKS)]
#: Rounds of leads before all pairs, the same at every size.
LEAD_ROUNDS = 2


def need(n, percent: int):
    """Shingles that a set of ``n`` shares at least with any set that it links with."""
    return -(-percent * n // 100)


class _Sets:
    """The shingle sets of a run of texts."""

    def __init__(self, texts: pa.Array, ngram: int):
        words = Words(texts, lower=True)
        grams = words.windows(ngram)
        self.sets = []
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if b - a >= ngram:
                own = np.sort(grams[a : b - ngram + 1])
                self.sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                self.sets.append(words.spans(np.array([a]), np.array([b])))
            else:
                self.sets.append(grams[:0])
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        sums = np.array([mix(s, 0x3F84D5B5B5470917).sum(dtype=np.uint64) for s in self.sets], np.uint64)
        self.ids = mix(sums + self.sizes.astype(np.uint64)).view(np.int64)

    def new(self, seen: set) -> list[int]:
        """Indexes of the sets that the task has not met before."""
        found = []
        for i, key in enumerate(zip(self.ids.tolist(), self.sizes.tolist(), strict=True)):
            if key[1] and key not in seen:
                seen.add(key)
                found.append(i)
        return found


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _sketch(docs: DataFrame, ngram: int) -> np.ndarray:
    """Entries per cell, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = np.zeros(CELLS, np.int64), set(), [], 0
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                sets = _Sets(piece.column("text"), ngram)
                for i in sets.new(seen):
                    held.append(_cells(sets.sets[i]))
                    size += len(held[-1])
                if size >= CELLS // 2:
                    counts += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        own = counts.reshape(-1, RUN_OF_CELLS)
        filled = np.flatnonzero(own.any(axis=1))
        yield _runs_of(filled, own[filled])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(data, np.int64)
        yield _runs_of(np.array(list(sums)), list(sums.values()))

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("text").mapInArrow(run, "at int, n binary").repartition(width, "at").mapInArrow(add_up, "at int, n binary")
    counts = np.zeros((CELLS // RUN_OF_CELLS, RUN_OF_CELLS), np.int64)
    for at, data in runs.collect():  # CELLS counts at most
        counts[at] = np.frombuffer(data, np.int64)
    return counts.reshape(-1)


def _runs_of(at: np.ndarray, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in counts], pa.binary())], ["at", "n"])


class _Order:
    """Rarity classes of the cells and the lengths of lists expected of them."""

    def __init__(self, counts: np.ndarray):
        # chance alone fills a cell to its mean and some roots of that
        mean = max(1.0, float(np.median(counts)))
        excess = (counts - mean) / (4 * np.sqrt(mean))
        self.level = np.floor(np.log2(np.maximum(2 * excess, 1.0))).astype(np.uint8)
        self.length = np.where(self.level > 0, counts - mean, 1.0).astype(np.float32)

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """The first shingles of a set that is sorted by hash."""
        return shingles[np.argsort(self.level[_cells(shingles)], kind="stable")[:size]]


def _rows(docs: DataFrame, order: _Order, ngram: int, percent: int) -> DataFrame:
    """(doc_id, n, sid, scan, marks): size and class of each row, the entries of its prefix's lists, its marks."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                sets = _Sets(piece.column("text"), ngram)
                scans = []
                for s in sets.sets:
                    size = len(s) - need(len(s), percent) + 1 if len(s) else 0
                    scans.append(size + float(own.length[_cells(own.prefix(s, size))].sum()))
                columns = [piece.column("doc_id"), pa.array(sets.sizes), pa.array(sets.ids), pa.array(scans, pa.float64())]
                columns += [pa.array(m) for m in np.ascontiguousarray(_marks(sets.sets).T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sid", "scan", *MARK_NAMES])

    return docs.mapInArrow(run, f"doc_id {id_type}, n long, sid long, scan double, {', '.join(f'{m} long' for m in MARK_NAMES)}")


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and each of 64 * MARKS parts of all shingles, whether it has an odd number of the part.

    Two sets differ in one shingle at least for each part in which their parities differ.
    """
    parts = 64 * MARKS
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles = np.concatenate([*sets, np.zeros(0, np.uint64)])
    counts = np.bincount(which * parts + (shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts * len(sets))
    return np.packbits((counts & 1).astype(bool).reshape(len(sets), parts), axis=1).view(np.int64)


def _marks_may_link(percent: int):
    """Whether the marks leave it open that two sets link: those that do differ in few shingles.

    100 * shared >= percent * union, with d shingles in one of the two only, is
    (100 + percent) * d <= (100 - percent) * (n + n_b).
    """
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_b"))) for m in MARK_NAMES), F.lit(0))
    return differ * (100 + percent) <= (F.col("n") + F.col("n_b")).cast("long") * (100 - percent)


def boundary(rows: DataFrame, percent: int) -> int:
    """Largest size of a light set, by least cost over all rows; sizes go in eighths of octaves."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 2
    costs = (
        rows.filter("n > 0")
        .groupBy(F.floor(8 * F.log2("n")).alias("octave"))
        .agg(F.max("n").alias("n"), F.sum(prefix * (prefix - 1) / 2).alias("light"), F.sum("scan").alias("heavy"))
        .orderBy("octave")
        .collect()  # one row per eighth of an octave of set sizes
    )
    best, at, total = 0.0, 0, 0.0
    for row in costs:
        total += row["light"] - row["heavy"]
        if total < best:
            best, at = total, row["n"]
    return at


def _entries(docs: DataFrame, order: _Order, light: int, ngram: int, percent: int) -> DataFrame:
    """(key, sid, n, place): keys of light pairs and heavy lists.

    ``place``: that of the shingle in the order, for pairs that of the later one, less one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    least = 100 // (100 - percent) if percent < 100 else 1 << 60
    joins_heavy = need(light + 1, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, set()
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                sets = _Sets(piece.column("text"), ngram)
                keys, owners, places = [], [], []
                for i in sets.new(seen):
                    s, n = sets.sets[i], int(sets.sizes[i])
                    if n < least - 1:  # different sets share 4 shingles (at 80 %) at least
                        continue
                    size = n - need(n, percent) + 1
                    first = own.prefix(s, size + 1)
                    if n <= light:
                        a, b = np.triu_indices(len(first), 1)
                        keys.append(mix(mix(first[a], 0x9216D5D98979FB1B) + first[b]))
                        owners.append(np.full(len(a), i))
                        places.append(b - 1)
                    if n > light or n >= joins_heavy:
                        keys.append(mix(first[:size], 0xD1310BA698DFB5AC))
                        owners.append(np.full(size, i))
                        places.append(np.arange(size))
                if keys:
                    owner, place = np.concatenate(owners), np.concatenate(places).astype(np.int32)
                    columns = [signed(np.concatenate(keys)), pa.array(sets.ids[owner]), pa.array(sets.sizes[owner].astype(np.int32)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "sid", "n", "place"])

    return docs.select("text").mapInArrow(run, "key long, sid long, n int, place int")


def _with_sets(docs: DataFrame, ids: DataFrame, ngram: int) -> DataFrame:
    """(sid, shingles): the sets of the classes in ``ids``, as sorted 64-bit hashes.

    A bitmap of fixed size keeps most other texts out of the shuffle; the join decides.
    """
    cells = ids.select(F.pmod("sid", F.lit(WANTED_CELLS)).alias("cell")).distinct().toPandas()["cell"]  # WANTED_CELLS rows at most
    wanted = np.zeros(WANTED_CELLS, bool)
    wanted[cells.to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                sets = _Sets(piece.column("text"), ngram)
                new = [i for i in sets.new(seen) if shared.value[sets.ids[i] % WANTED_CELLS]]
                yield pa.RecordBatch.from_arrays([pa.array(sets.ids[new]), piece.column("text").take(pa.array(new, pa.int64()))], ["sid", "text"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", CHUNK_BYTES):
                sets = _Sets(piece.column("text"), ngram)
                yield pa.RecordBatch.from_arrays([pa.array(sets.ids), pa.array([s.tobytes() for s in sets.sets], pa.binary())], ["sid", "shingles"])

    texts = docs.select("text").mapInArrow(classes, "sid long, text string").join(ids, "sid", "left_semi")
    return texts.mapInArrow(shingles, "sid long, shingles binary").dropDuplicates(["sid"])


def _links(pairs: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = saved(_with_sets(docs, ids, ngram), "join-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    found = saved(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(run, "a long, b long"), "join-links")
    release(sets)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternating large and small stars; each round is a pair of aggregations and joins, and is
    written, so a node with very many edges is spread like any other key.
    """
    edges = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, saved(small.filter("u != v").distinct(), "edges")
        release(before)
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = saved(nodes.union(edges.select("v", "v").distinct()), "join-roots")
    release(edges)
    return nodes


def _overlap(percent: int):
    """Shingles that linked sets of sizes n and n_b share at least."""
    return F.ceil((F.col("n") + F.col("n_b")) * percent / F.lit(100 + percent))


def _more(light: int, percent: int):
    """Keys beyond the first that two sets must share where that many more places are looked at.

    Each further place costs entries to join, and each further key spares sets to compare; a
    32nd of the set is taken, as far as the lists go. Light pairs of shingles are looked at once.
    """
    spare = [_overlap(percent) - F.ceil(F.col(n) * percent / F.lit(100)) for n in ("n", "n_b")]
    more = F.least(*spare, F.floor(F.least("n", "n_b") / 32))
    return F.when((F.col("n") <= light) & (F.col("n_b") <= light), F.lit(0).cast("long")).otherwise(F.greatest(more, F.lit(0).cast("long")))


def _may_link(light: int, percent: int):
    """Whether a key that two entries share is among those by which their sets must meet.

    Sets that link share at least k + 1 of the first places of both that leave ``_overlap`` less k.
    """
    least = _overlap(percent) - _more(light, percent)
    return (F.col("n") - F.col("place") >= least) & (F.col("n_b") - F.col("place_b") >= least)


def _pairs_apart(live: DataFrame, light: int, percent: int) -> DataFrame:
    """(a, b, c, n, n_b), a < b: pairs of classes of different roots and the keys by which they may link.

    ``most`` is the most frequent root of the key's list; of two different roots one isn't that.
    Where ``live`` has marks, pairs that can't link by them are left out.
    """
    marks = [m for m in MARK_NAMES if m in live.columns]
    rest = live.filter("root != most").select("key", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "place", "root", *marks)])
    # a pair of two classes of the rest comes twice
    once = (F.col("root") == F.col("most")) | (F.col("sid") < F.col("sid_b"))
    may = _may_link(light, percent) & _marks_may_link(percent) if marks else _may_link(light, percent)
    pairs = live.join(rest, "key").filter((F.col("root") != F.col("root_b")) & once & may)
    ordered = F.col("sid") < F.col("sid_b")
    own, other = F.struct("sid", "n"), F.struct(F.col("sid_b").alias("sid"), F.col("n_b").alias("n"))
    pairs = pairs.select(F.when(ordered, own).otherwise(other).alias("x"), F.when(ordered, other).otherwise(own).alias("y"))
    return pairs.groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("x.n").alias("n"), F.max("y.n").alias("n_b"))


def set_components(docs: DataFrame, rows: DataFrame, order: _Order, light: int, ngram: int, percent: int) -> DataFrame:
    """(sid, root) of the classes of sets that link with another class; ``rows`` has their marks."""
    spark: SparkSession = docs.sparkSession
    entries = saved(_entries(docs, order, light, ngram, percent), "join-entries")
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    # aggregates are written before they are joined, so that the join can be split at a hot key
    lists = saved(lists, "join-lists")
    live = entries.join(lists, "key", "left_semi").distinct().withColumn("root", F.col("sid"))
    live = saved(live, "join-live")
    release(entries, lists)
    links, written = spark.createDataFrame([], "a long, b long"), []

    for turn in range(LEAD_ROUNDS + 1):
        per_root = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
        most = F.max_by("root", F.struct("m", "root")).alias("most")
        per_key = per_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), most).filter("roots > 1").select("key", "most")
        before, lists = live, saved(per_key, "join-lists")
        live = saved(before.join(lists, "key"), "join-live")
        release(before, lists)
        last = turn == LEAD_ROUNDS
        if last:
            marks = saved(rows.filter("n > 0").select("sid", *MARK_NAMES).dropDuplicates(["sid"]), "join-marks")
            before, live = live, saved(live.join(marks, "sid"), "join-live")
            release(before, marks)
            pairs = _pairs_apart(live, light, percent)
            pairs = pairs.filter(F.col("c") > _more(light, percent)).select("a", "b")
        else:
            # the lead of a list: first the class with the fewest rarer shingles, as that is the one
            # with the fewest of its own; then one by hash
            rarer = F.col("place") if turn == 0 else F.lit(0)
            lead = F.min(F.struct(rarer.alias("rarer"), F.xxhash64("sid", F.lit(turn)).alias("h"), F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("root").alias("root_b")))
            other = live.groupBy("key").agg(lead.alias("lead")).select("key", "lead.b", "lead.n_b", "lead.place_b", "lead.root_b")
            leads = other = saved(other, "join-leads")
            pairs = live.join(other, "key").filter((F.col("root") != F.col("root_b")) & _may_link(light, percent))
            pairs = pairs.groupBy(F.col("sid").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        pairs = saved(pairs, "join-pairs")
        if last:
            release(live)
        else:
            release(leads)
        found = _links(pairs, docs, ngram, percent)
        release(pairs)
        written.append(found)
        links = links.union(found)
        if last:
            break
        roots = components(links)
        kept = live.drop("root", "most").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        before, live = live, saved(kept.withColumn("root", F.coalesce("root", "sid")), "join-live")
        release(before, roots)
    found = components(links)
    release(*written)
    return found.withColumnRenamed("node", "sid")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_id, component_id.

    Texts are lower-cased (A-Z) and cut into words; a set has the distinct ``ngram``-word shingles,
    or all words as one where there are fewer. Null and wordless texts have empty sets and link with
    nothing. component_id is the smallest identifier that links reach; null identifiers are reached
    and passed through, but are never the smallest unless a component has no other. Repeated rows
    link. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        order = _Order(_sketch(docs, ngram))
        rows = saved(_rows(docs, order, ngram, percent), "join-rows")
        light = boundary(rows, percent)
        roots = set_components(docs, rows, order, light, ngram, percent)
    rows = rows.drop(*MARK_NAMES).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    least = saved(least, "join-least")  # before the join, which can then be split at a large component
    return rows.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("sid").alias("set_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )
