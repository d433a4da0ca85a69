"""Near-duplicates by min-max hashing.

Under each permutation of the shingles both the smallest and the largest value are kept, so a signature of 2k
values takes k hash evaluations a shingle. Bands of the signature propose links; links are confirmed on
the full shingle sets; linked documents form components.

Documents of equal sets are one class from the start. Classes that share a bucket, directly or through others,
are a family; only stars to a bucket's smallest id are needed to find families, no pairs. A family is split into blocks of a
bounded size, and full sets are compared within each block. What is left are links between blocks of one family:

1. Some rounds compare one member of each component so far, dealt anew into blocks, which joins the blocks of a family of
   near copies of one text.
2. A bucket whose members are still of several components may hold links that were not seen. Its members outside its largest
   component are compared with all of its members, block by block; buckets of one component are not looked at again.

A comparison puts out a spanning forest of its links. So no proposed link is lost, no task follows the size of a family or bucket, and
rows follow the members outside their bucket's largest component, not the pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, ByteHash, blocks, checkpointed, forget, mix, slim, word_spans

#: 30 bands of 5 values: a pair of similarity 0.8 is in no common bucket with a probability of 7e-6, of 0.85 with 1e-8.
BANDS, ROWS = 30, 5
#: Documents in a block of a family; two blocks are compared at once.
BLOCK = 2048
#: Rounds that compare one member of each component.
ROUNDS = 3
PERMUTATIONS = BANDS * ROWS // 2
_A = np.random.default_rng(3).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U64(2) + U64(1)
_B = np.random.default_rng(4).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
SCHEMA = "doc_id bigint, n_shingles bigint, class binary, bands array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their bounds (n + 1)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = ByteHash(low).ranges(starts, ends)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.concatenate([[0], np.cumsum(n)])
    begin = first[doc] + np.arange(len(doc)) - at[doc]
    length = np.minimum(size, count[doc])
    value = np.zeros(len(doc), np.uint64)
    for k in range(size):
        inside = length > k
        here = np.minimum(begin + k, max(len(words) - 1, 0))
        value = np.where(inside, mix(value * U64(3) + (words[here] if len(words) else U64(0)) + U64(k + 1)), value)
    # sort by document and value: one sort of values, then a stable one of small numbers
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit class and band hashes of each non-empty set; bounds of non-empty ranges."""
    heads = bounds[:-1]
    classes = [np.add.reduceat(mix(sets * _A[k] + _B[k]), heads) for k in (0, 1)]
    lows, highs = [], []
    for a, b in zip(_A, _B, strict=True):
        x = sets * a + b
        x ^= x >> U64(32)
        lows.append(np.minimum.reduceat(x, heads))
        highs.append(np.maximum.reduceat(x, heads))
    values = np.stack(lows + highs, 1)
    bands = np.zeros((len(heads), BANDS), np.uint64)
    spread = np.arange(BANDS * ROWS).reshape(ROWS, BANDS)  # a band takes values of different permutations
    for r in range(ROWS):
        bands = mix(bands * U64(5) + values[:, spread[r]] + np.arange(BANDS, dtype=np.uint64))
    return np.stack(classes, 1), bands


def sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, bands = [], [], []
            for _, _, data, offsets in blocks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, size)
                n = np.diff(bounds)
                counts.append(n)
                full = np.flatnonzero(n)
                c, b = signatures(sets, np.append(bounds[full], len(sets))) if len(full) else ([], [])
                of = {int(d): i for i, d in enumerate(full)}
                for d in range(len(n)):
                    i = of.get(d)
                    classes.append(None if i is None else c[i].tobytes() + int(n[d]).to_bytes(4, "little"))
                    bands.append(None if i is None else b[i].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "bands"])

    return docs.mapInArrow(run, SCHEMA)


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): the smallest node that each node of an edge reaches, by spreading minima and jumping to the label's label."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("rep"), F.least("a", "b").alias("comp")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["rep"]).groupBy("a").agg(F.min("comp").alias("heard"))
        spread = labels.join(heard, labels["rep"] == heard["a"]).select("rep", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("rep").alias("at"), F.col("comp").alias("further"))
        new = checkpointed(spread.join(jump, spread["comp"] == jump["at"], "left").select("rep", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        changed = new.where("old <> comp").limit(1).count()
        forget(labels)
        labels = new.select("rep", "comp")
        if not changed:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id that it reaches), kept (it is that one).

    Words are lower-cased in A-Z and split at ASCII white space; the set holds the distinct ``size``-word shingles, or the
    whole sequence where there are fewer words. Sets are linked if 100 * intersection >= ``percent`` * union. Null and blank
    texts have an empty set, are linked with nothing and kept. Rows of equal id are one document in links. Rows with a null id are
    linked with nothing and have component null and kept true. An empty table gives no rows; other columns are ignored.
    Texts of any length are read whole. The smallest id decides all ties. The sketch and the classes stay in the shared folder, as the
    result reads them; all other tables made on the way are deleted.
    """
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text")
    known = checkpointed(sketch(rows, size), "sketch")
    usable = known.where("n_shingles > 0 and doc_id is not null")
    heads = checkpointed(usable.groupBy("class").agg(F.min(F.struct("doc_id", "bands")).alias("h")).select("class", F.col("h.doc_id").alias("rep"), F.col("h.bands").alias("bands")), "classes")
    buckets = heads.select("rep", F.explode("bands").alias("band"))
    lows = buckets.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low")
    # one edge from each document to the least of its buckets' smallest ids (as many as bands at most), and from that to the others, once
    found = checkpointed(buckets.join(lows, "band").groupBy("rep").agg(F.collect_set("low").alias("lows")).select("rep", "lows", F.array_min("lows").alias("a")), "stars")
    stars = found.select("a", F.col("rep").alias("b")).union(found.select("a", F.explode("lows").alias("b"))).where("a <> b").distinct()
    family = components(stars).select("rep", F.col("comp").alias("family"))
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = checkpointed(with_sets(rows, placed, size), "members")
    within = members.select("family", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "rep", "shingles")
    links = checkpointed(link(within, percent), "links")
    comps = components(links)
    forget(links)
    forget(found)
    wide = members.where("blocks > 1").select("rep", "family").join(comps, "rep", "left").select("rep", "family", F.coalesce("comp", "rep").alias("comp"))
    wide = checkpointed(wide, "labels")
    if open_families(wide).limit(1).count():
        sets = members.where("blocks > 1").select("rep", "shingles")
        wide = joined_blocks(wide, sets, percent)
        edges = checkpointed(link(across(wide, sets, buckets), percent).where("a <> b"), "links")
        wide = relabelled(wide, edges)
        forget(edges)
    forget(members)
    comps = comps.join(wide.select("rep", F.lit(True).alias("w")), "rep", "left").where("w is null").select("rep", "comp").unionByName(wide.select("rep", "comp"))
    classes = heads.select(F.col("class").alias("k"), "rep").join(comps.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left").select("k", F.coalesce("comp", "rep").alias("comp"))
    out = known.join(classes, (known["class"] == classes["k"]) & known["doc_id"].isNotNull(), "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def open_families(labels: DataFrame) -> DataFrame:
    """(family) of those (rep, family, comp) rows whose family holds several components."""
    return labels.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("family")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, family, comp) after the (a, b) links between components."""
    if not edges.limit(1).count():
        return labels
    new = components(edges).toDF("old", "new")
    out = checkpointed(labels.join(new, labels["comp"] == new["old"], "left").select("rep", "family", F.coalesce("new", "comp").alias("comp")), "labels")
    forget(labels)
    return out


def joined_blocks(labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, family, comp) after some rounds in which one member of each component, another each time, is compared."""
    for turn in range(ROUNDS):
        drawn = F.xxhash64("rep", F.lit(turn))
        lead = labels.join(open_families(labels), "family", "left_semi").groupBy("family", "comp").agg(F.min(F.struct(drawn.alias("h"), "rep")).alias("m")).select("family", "comp", "m.rep")
        sizes = lead.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
        dealt = lead.join(sizes, "family").select("family", F.pmod(drawn, F.col("n")).cast("int").alias("i"), "comp", "rep")
        rows = dealt.join(sets.hint("merge"), "rep").select("family", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("comp").alias("rep"), "shingles")
        edges = checkpointed(link(rows, percent), "links")
        known = labels
        labels = relabelled(labels, edges)
        forget(edges)
        if labels is known:
            break
    return labels


def across(labels: DataFrame, sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """(family: the bucket, i, j, side, rep: the component, shingles) rows that compare a bucket's members outside its largest component with all.

    Only buckets with members of several components; side 0 are all members, in blocks j, side 1 the ones outside, in blocks i.
    """
    mine = labels.join(open_families(labels), "family", "left_semi").select("rep", "comp")
    held = buckets.join(mine.hint("merge"), "rep").select("band", "rep", "comp")
    sizes = held.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    sizes = sizes.where("comps > 1").select("band", F.col("main.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("other_blocks"))
    rows = held.join(sizes, "band")

    def block(count: str):
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    every = rows.select("band", each("other_blocks").alias("i"), block("all_blocks").alias("j"), F.lit(0).alias("side"), "rep", "comp")
    others = rows.where("comp <> main").select("band", block("other_blocks").alias("i"), each("all_blocks").alias("j"), F.lit(1).alias("side"), "rep", "comp")
    return every.unionByName(others).join(sets.hint("merge"), "rep").select(F.col("band").alias("family"), "i", "j", "side", F.col("comp").alias("rep"), "shingles")


def with_sets(rows: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """The placed documents with their full sets, packed."""
    # nothing bounds the number of placed documents, so they are never broadcast
    wanted = rows.where("doc_id is not null").join(placed.hint("merge"), rows["doc_id"] == placed["rep"]).select("rep", "text", "family", "blocks", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, _, data, offsets in blocks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, size)
                packed += [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(packed, pa.binary())], names=["rep", "family", "blocks", "block", "shingles"])

    return wanted.mapInArrow(run, "rep bigint, family bigint, blocks int, block int, shingles binary")


def intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, from indicator matrices, some shingles at a time."""
    out = np.zeros((len(x), len(y)), np.float32)

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (vx, rx), (vy, ry) = flat(x), flat(y)
    if x is y:  # only shingles of two sets or more count
        values, n = np.unique(vx, return_counts=True)
        both = values[n > 1]
    else:
        both = np.intersect1d(vx, vy)

    def placed(values, rows):
        """Row and column of each value that counts, by column, and where each run of columns begins."""
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = np.flatnonzero(both[at] == values) if len(both) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return rows[hit], at[hit], np.searchsorted(at[hit], np.arange(0, len(both) + columns, columns))

    px = placed(vx, rx)
    py = px if x is y else placed(vy, ry)

    def indicator(p, sets, k, width):
        rows, at, cuts = p
        part = slice(cuts[k], cuts[k + 1])
        m = np.zeros((len(sets), width), np.float32)
        m[rows[part], at[part] - k * columns] = 1
        return m

    for k in range(-(-len(both) // columns)):
        width = min(columns, len(both) - k * columns)
        mx = indicator(px, x, k, width)
        out += mx @ (mx if x is y else indicator(py, y, k, width)).T
    if x is y:
        np.fill_diagonal(out, 0)
    return out


def link(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each block, or between the two blocks, of (family, i, j, side, rep, shingles)."""
    def run(group: pa.Table) -> pa.Table:
        reps, sides = group.column("rep").to_numpy(), group.column("side").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        left = np.flatnonzero(sides == 0)
        right = np.flatnonzero(sides == 1) if sides.any() else left
        edges = []
        if len(left) and len(right):
            xs = [sets[k] for k in left]
            inter = intersections(xs, xs if right is left else [sets[k] for k in right]).astype(np.int64)
            linked = 100 * inter >= percent * (n[left][:, None] + n[right][None, :] - inter)
            if right is left:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            a, b = left[a], right[b]
            # breadth first over both directions
            order = np.argsort(np.concatenate([a, b]), kind="stable")
            source, target = np.concatenate([a, b])[order], np.concatenate([b, a])[order]
            cuts = np.searchsorted(source, np.arange(len(reps) + 1))
            seen = np.zeros(len(reps), bool)
            for root in range(len(reps)):
                if seen[root]:
                    continue
                seen[root] = True
                todo = [root]
                while todo:
                    at = todo.pop()
                    fresh = np.unique(target[cuts[at] : cuts[at + 1]])
                    fresh = fresh[~seen[fresh]]
                    seen[fresh] = True
                    todo += fresh.tolist()
                    edges += [(reps[at], reps[k]) for k in fresh]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return groups.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """All columns of the kept documents; of rows with one id and equal text, all stay."""
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    # the number of copies is not bounded either
    return docs.join(gone.hint("merge"), docs[id_col] == gone["__gone"], "left_anti")
