"""Near-duplicate documents by min-max hashing: each permutation gives its minimum and its maximum.

Documents of equal shingle sets form a class, represented by its smallest id; only representatives are compared. A
signature holds both ends of PERMUTATIONS permutations, so 64 evaluations of a hash fill 128 places, and 32 bands of 4
places make two sets of similarity 0.8 miss each other with probability 5e-8. In each bucket of a band the smallest id
is compared with all others on full sets. Pairs within a component need no comparison and are never made.

What components share a bucket after that could still hold links, and their pairs are not made either unless exact
bounds leave them open. A pair shares a rare shingle, which RARE or fewer of these documents hold, or it does not. The
former are listed from the rare shingles, less than RARE for each. The latter have all they share in their cores, the
shingles that are not rare, so a core bounds how large a partner can be: documents whose bound rules out every other
component of a bucket leave it, and the rest meet only where both bounds allow and where tallies of the shingles by hash
class leave enough to share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import kernels, shared
from signalloom.llm.components import components, extended

PERMUTATIONS, ROWS = 64, 4
PLACES = 2 * PERMUTATIONS
BANDS = PLACES // ROWS
PERCENT = 80
#: A shingle that so many of the documents compared hold, or fewer, is rare.
RARE = 8
#: Hash classes by which the shingles of a set are tallied.
CLASSES = 128
#: Members of a bucket that one task compares with others at a time; larger buckets are split.
PART = 2000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(text: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of every row; a row of fewer words has its whole sequence as one."""
    for lo, hi, data, off in kernels.blocks(text):
        data = kernels.LOWER[data]
        starts, ends, doc = kernels.word_spans(data, off, kernels.SPACES)
        words = kernels.span_hashes(data, starts, ends)
        counts = np.bincount(doc, minlength=hi - lo)
        begin = np.concatenate(([0], np.cumsum(counts)))
        whole = kernels.rolling(words, size)
        short = {k: kernels.rolling(words, k) + np.uint64(k) for k in range(1, size) if (counts == k).any()}
        for i in range(hi - lo):
            n, at = int(counts[i]), int(begin[i])
            if not n:
                found = whole[:0]
            elif n < size:
                found = short[n][at : at + 1]
            else:
                found = np.sort(whole[at : at + n - size + 1])
                found = found[np.append(True, found[1:] != found[:-1])]
            yield lo + i, found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PLACES minima and maxima of each set, none of them empty, as rows of 32-bit words."""
    out = np.empty((len(sets), PLACES), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    for k in range(PERMUTATIONS):
        v = h * _A[k]
        v += _B[k]
        out[:, 2 * k] = np.minimum.reduceat(v, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature; the last two null where there is no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            counts, digests, signs = [0] * n, [None] * n, [None] * n
            pending: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush():
                rows = signatures([s for _, s in pending])
                for (i, _), row in zip(pending, rows, strict=True):
                    signs[i] = row.tobytes()
                pending.clear()

            for i, found in shingle_sets(batch.column("text"), size):
                counts[i] = len(found)
                if len(found):
                    digests[i] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    pending.append((i, found))
                    held += len(found)
                    if held > 200_000:
                        flush()
                        held = 0
            if pending:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sign"],
            )

    return shared.slim(docs, "doc_id", "text").mapInArrow(shared.tidy(run), "doc_id bigint, n_shingles bigint, digest binary, sign binary")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the whole set as an array of 64-bit hashes, and the number of them in each class by their upper bits."""
    shift = np.uint64(64 - (CLASSES - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sets = [s.view(np.int64) for _, s in shingle_sets(part.column("text"), size)]
                off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets))
                tally = [np.bincount((s.view(np.uint64) >> shift).astype(np.int64), minlength=CLASSES) for s in sets]
                tallies = pa.ListArray.from_arrays(pa.array(np.arange(0, CLASSES * len(sets) + 1, CLASSES, dtype=np.int32)), pa.array(np.concatenate(tally).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), values), tallies], names=["doc_id", "shingles", "tally"])

    return docs.select("doc_id", "text").mapInArrow(shared.tidy(run), "doc_id bigint, shingles array<bigint>, tally array<int>")


def band_keys(sign: Column) -> Column:
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.lit(j), F.substring(sign, j * width + 1, width)) for j in range(BANDS)])


def linked(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose full sets are alike enough. Merge joins: the plan is one at every size."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.hint("merge").join(left, "b").hint("merge").join(right, "a")
    shared_part = F.size(F.array_intersect("sa", "sb"))
    judged = both.select("a", "b", shared_part.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return judged.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def of_like_size(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of so many shingles are near enough in size to be alike."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def open_pairs(sets: DataFrame, classes: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives of different labels in ``left`` (key, id, label) that exact bounds do not rule out.

    Of s shingles, c of them in the core, at most c are shared with a partner of t shingles, and a link needs at least
    percent * (s + t) / (100 + percent); so t is c * (100 + percent) / percent - s at most. Two sets share, of the shingles
    of each hash class, no more than the smaller tally of the two, so the sum of these bounds what they share at all.
    """
    labels = left.select("id", "label").distinct()
    own = sets.withColumnRenamed("doc_id", "id").join(labels.hint("merge"), "id")
    held = shared.cut(own.select("id", "label", F.size("shingles").alias("size"), F.explode("shingles").alias("s")))
    few_hold = held.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    rare = shared.cut(held.join(few_hold, "s"))
    shared.drop(held)
    groups = rare.where("n > 1").groupBy("s").agg(F.collect_list(F.struct("id", "label", "size")).alias("m"))
    other = lambda x: F.filter("m", lambda y: (x["id"] < y["id"]) & (x["label"] != y["label"]) & of_like_size(x["size"], y["size"], percent))
    both = F.flatten(F.transform("m", lambda x: F.transform(other(x), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    by_rare = shared.cut(groups.select(F.explode(both).alias("p")).select("p.a", "p.b").distinct())

    counts = rare.groupBy("id").agg(F.count("*").alias("r"))
    bounds = classes.join(labels, "id").join(counts, "id", "left").select("id", "sign", F.col("n").alias("size"), (F.col("n") - F.coalesce("r", F.lit(0))).alias("core"))
    bounds = shared.cut(bounds.withColumn("most", F.floor(F.col("core") * F.lit(100 + percent) / F.lit(percent) + F.lit(1e-9)) - F.col("size")))
    shared.drop(rare)
    rows = shared.cut(left.join(bounds.drop("core", "sign"), "id"))
    per_label = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("size").alias("lo"), F.max("most").alias("hi"))
    bucket = per_label.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("n"))
    bucket = shared.cut(bucket)
    able = shared.cut(shared.join_keyed(rows, bucket, ["key"], "n", rows.count()).where("most >= lo and size <= hi").drop("lo", "hi"))
    shared.drop(rows, bucket)
    few = able.where("label <> main")
    extent = few.groupBy("key").agg(F.min("size").alias("lo"), F.max("most").alias("hi"))
    counted = able.groupBy("key").agg(F.count("*").alias("n")).join(extent, "key").withColumn("parts", F.ceil(F.col("n") / F.lit(PART)).cast("int"))
    counted = shared.cut(counted)
    many = shared.join_keyed(able, counted, ["key"], "n", able.count()).where("most >= lo and size <= hi")
    few = many.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tallies = sets.select(F.col("doc_id").alias("id"), "tally").hint("merge")
    keys = bounds.select("id", band_keys(F.col("sign")).alias("keys")).join(tallies, "id")
    x = few.join(keys, "id").select("key", "part", F.col("id").alias("a"), F.col("label").alias("la"), F.col("size").alias("na"), F.col("most").alias("ma"), F.col("keys").alias("ka"), F.col("tally").alias("ta"))
    y = many.join(keys, "id").select(
        "key", "part", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("size").alias("nb"), F.col("most").alias("mb"), F.col("keys").alias("kb"), F.col("tally").alias("tb"), (F.col("label") == F.col("main")).alias("first")
    )
    once = F.array_intersect("ka", "kb")[0] == F.col("key")  # a pair counts in the first bucket it shares
    meet = (F.col("la") != F.col("lb")) & (F.col("first") | (F.col("a") < F.col("b"))) & (F.col("na") <= F.col("mb")) & (F.col("nb") <= F.col("ma"))
    most_shared = F.aggregate(F.zip_with("ta", "tb", lambda m, n: F.least(m, n)), F.lit(0), lambda n, c: n + c)
    near = (100 + percent) * most_shared >= percent * (F.col("na") + F.col("nb"))
    x = x.withColumnRenamed("key", "kx").withColumnRenamed("part", "px")
    by_size = x.join(y, (F.col("kx") == F.col("key")) & (F.col("px") == F.col("part")) & meet & once & near)
    found = shared.cut(by_rare.union(by_size.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    shared.drop(by_rare, bounds, able, counted)
    return found


def near_groups(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. class_id is the smallest id with the same set, component_id
    the smallest id reached over links of at least ``percent`` percent similarity; kept marks the one document of each
    component that stays. Null and wordless texts link with nothing and are their own component. Rows without an id
    link with nothing, have null class and component, and are kept. Rows of one id must be equal; they repeat. No
    document is dropped here. Texts of any length are read whole; equal sets tie to the smallest id. Columns besides
    doc_id and text are left out, so names may clash.
    """
    rows = shared.slim(docs, "doc_id", "text")
    whole = shared.cut(signed(rows, size))
    known = shared.cut(whole.drop("sign"))
    classes = whole.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n"))
    classes = shared.cut(classes)
    shared.drop(whole)
    banded = classes.select("id", F.col("n").alias("size"), F.explode(band_keys(F.col("sign"))).alias("key"))
    full = banded.groupBy("key").agg(F.min("id").alias("hub"), F.min_by("size", "id").alias("hub_size"), F.count("*").alias("n")).where("n > 1")
    full = shared.cut(full)
    members = shared.cut(shared.join_keyed(banded, full, ["key"], "n", BANDS * classes.count()))
    shared.drop(full)
    compared = members.select(F.col("id").alias("doc_id")).distinct()
    # one row for each id: open_pairs counts the holders of a shingle
    sets = shared.cut(full_sets(rows.join(compared.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), size))
    alike = of_like_size(F.col("size"), F.col("hub_size"), percent)
    stars = shared.cut(members.where("id <> hub").where(alike).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = shared.cut(linked(sets, stars, percent))
    shared.drop(stars)
    labels = components(links)
    # components that share a bucket: only these members can hold links not seen so far
    placed = shared.cut(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    shared.drop(members, links)
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    mixed = shared.cut(mixed)
    left = shared.cut(shared.join_keyed(placed, mixed, ["key"], "n", placed.count()))
    shared.drop(placed, mixed)
    if not left.isEmpty():
        rest = open_pairs(sets, classes, left, percent)
        more = shared.cut(linked(sets, rest, percent))
        if not more.isEmpty():
            labels = extended(labels, more)
    shared.drop(left, sets)
    grouped = classes.select("digest", F.col("id").alias("class_id")).join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    grouped = grouped.select("digest", "class_id", F.coalesce("label", "class_id").alias("component"))
    out = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(grouped, "digest", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies, by sets of four-word shingles."""
    found = near_groups(shared.table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def brute(documents: list[tuple], size: int = 4, percent: int = PERCENT) -> list[tuple]:
    """The contract of op8 over all pairs that share a shingle, for tests."""
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets: dict[int, frozenset] = {}
    for d, t in documents:
        w = (t or "").encode().translate(fold).split()
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    tried = set()
    for ds in holders.values():
        for a in ds:
            for b in ds:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    i = len(sets[a] & sets[b])
                    if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                        ra, rb = sorted((root(a), root(b)))
                        parent[rb] = ra
    return [(d, len(sets[d]), root(d), root(d) == d) for d, _ in documents]
