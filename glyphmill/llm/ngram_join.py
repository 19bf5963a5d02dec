"""N-gram Jaccard join: a grouped prefix join over five-word shingles.

Every text becomes the set of its distinct shingles. A global order puts the shingles that
are common anywhere last, so that the first quarter of a set (its prefix) is made of rare
ones: two sets with a Jaccard index of `threshold` or more share one shingle of their
prefixes at least. Texts with the same prefix and the same size collapse into one group;
groups, not texts, are joined on prefix shingles; pairs of groups are filtered by size, by the
place of a shared shingle and by how many shingles of the prefixes are shared at all. What is
left is expanded to members, filtered by bitmaps of the sets (a bit that only one of them has
is a shingle that the other lacks, so the bound is exact), and verified on whole sets.

Joining goes in two steps, so that a family of near copies costs no square: first every
group meets only the most central group of each shingle (one row a posting), and verified
links are closed into components; then only pairs from different components that still
share a prefix shingle are verified. A pair inside a component cannot change the result.

Defined results: null, empty or wordless texts have no shingle and link with nothing; fewer
than five words are one shingle; rows that repeat an id or a text are rows of their own that
share a component; a null id never names a component. Other columns of `docs` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bloom, components, cut, drop, hit, mix, shingle_sets, slices

#: Shingles that are moved to the end of the global order: so many at most.
HEAVY = 200_000
#: Postings that one task of the inverted index aims at.
POSTINGS = 250_000
#: Shingles of more groups are met by classes of size.
CROWD = 64

_SIGNED = np.int64


def _tokens(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches):
        yield batch, list(shingle_sets(batch.column(batch.schema.get_field_index("text")), k))


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([(mix(s) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _bitmap(s: np.ndarray) -> bytes:
    """Bits of a set by the low bits of its shingles, four to eight a shingle; a longer bitmap folds into a shorter one."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _most_shared(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """No two sets of these bitmaps and sizes share more."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))


def heavy_shingles(texts: DataFrame, k: int = 5, most: int = HEAVY) -> tuple[np.ndarray, int]:
    """The shingles that repeat most across texts (at most `most`), rarest first, and how many shingles there are.

    The choice only orders shingles, so it may miss any without changing a result: tasks report
    what repeats in a batch of theirs, and Spark sums.
    """

    def local(batches):
        for _, sets in _tokens(batches, k):
            full = [s for s in sets if len(s)]
            if not full:
                continue
            tok, n = np.unique(np.concatenate(full), return_counts=True)
            often = n >= 8
            yield pa.RecordBatch.from_pydict({"tok": pa.array(np.append(tok[often].view(_SIGNED), 0)), "n": pa.array(np.append(n[often], n.sum())), "all": pa.array([False] * int(often.sum()) + [True])})

    seen = texts.select("text").mapInArrow(local, "tok long, n long, all boolean").groupBy("tok", "all").agg(F.sum("n").alias("n"))
    rows = cut(seen)
    total = rows.filter("all").agg(F.sum("n")).first()[0] or 0
    top = rows.filter("not all and n >= 32").orderBy(F.desc("n"), "tok").limit(most).collect()
    return np.array([r.tok for r in reversed(top)], _SIGNED).view(np.uint64), int(total)


def _bounds(threshold: float) -> tuple[int, int]:
    num = round(threshold * 1000)
    return num, 1000


def jaccard_links(docs: DataFrame, k: int = 5, threshold: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, set_key, component_id.

    component_id is the smallest id that can be reached by links, the row's own included.
    """
    num, den = _bounds(threshold)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    heavy, total = heavy_shingles(texts, k)
    order = np.argsort(heavy)
    heavy_sorted, heavy_rank = heavy[order], order.astype(np.uint64)
    n_buckets = max(24, total // 4 // POSTINGS + 1)

    def prefix(s: np.ndarray) -> tuple[np.ndarray, int]:
        """The first shingles of s in the global order; how many of them are not heavy."""
        n = len(s)
        m = n - -(-num * n // den) + 1
        if len(heavy_sorted):
            at = np.minimum(np.searchsorted(heavy_sorted, s), len(heavy_sorted) - 1)
            is_heavy = heavy_sorted[at] == s
            if is_heavy.any():
                light = s[~is_heavy]
                if len(light) >= m:
                    return light[:m], m
                late = s[is_heavy][np.argsort(heavy_rank[at[is_heavy]])]
                return np.concatenate([light, late[: m - len(light)]]), len(light)
        return s[:m], m

    def group_key(p: np.ndarray, n: int) -> int:
        with np.errstate(over="ignore"):
            return int(mix(np.array([(mix(p) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) ^ np.uint64(n)]))[0].astype(np.int64))

    def member_rows(batches):
        for batch, sets in _tokens(batches, k):
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n": pa.array(n, pa.int64()),
                "gid": pa.array([group_key(prefix(s)[0], len(s)) if len(s) else None for s in sets], pa.int64()),
                "sid": pa.array([_set_key(s) if len(s) else None for s in sets], pa.int64()),
                "bits": pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
            })

    members = cut(texts.mapInArrow(member_rows, "doc_id long, n long, gid long, sid long, bits binary"))

    # -- the inverted index, packed: a row is what one task has for one bucket of shingles. A light shingle is told apart by 32 more
    # bits within its bucket (two that agree by chance only add a candidate), a heavy one, in any bucket, by its rank
    def packed(batches):
        held: dict[int, tuple] = {}
        count = 0

        def flush():
            lens = np.array([len(v[0]) for v in held.values()])
            gid = np.repeat(np.fromiter(held, np.int64, len(held)), lens)
            tok = np.concatenate([v[0] for v in held.values()])
            pos = np.arange(len(tok), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
            late = np.flatnonzero(pos >= np.repeat([v[1] for v in held.values()], lens))
            bucket = ((tok >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            bucket[late] = n_buckets + ((gid[late].view(np.uint64) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            told = (mix(tok) >> np.uint64(32)).astype(np.uint32)
            if len(late):
                told[late] = heavy_rank[np.searchsorted(heavy_sorted, tok[late])]
            by = np.lexsort((told, bucket))
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
            rows = {"bucket": [], "tok": [], "gid": [], "pos": []}
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                one = by[lo:hi]
                rows["bucket"].append(int(bucket[one[0]]))
                rows["tok"].append(told[one].tobytes())
                rows["gid"].append(gid[one].tobytes())
                rows["pos"].append(pos[one].astype(np.uint16 if pos[one].max() < 1 << 16 else np.uint32).tobytes())
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in ("tok", "gid", "pos")}})

        for _, sets in _tokens(batches, k):
            for s in sets:
                if len(s):
                    p, light = prefix(s)
                    key = group_key(p, len(s))
                    if key not in held:
                        held[key] = (p, light)
                        count += len(p)
                        if count > 700_000:
                            yield flush()
                            count = 0
        if held:
            yield flush()

    def repeated(key, table):
        parts = []
        for tok, gid, pos in zip(*(table.column(c).to_pylist() for c in ("tok", "gid", "pos"))):
            tok = np.frombuffer(tok, np.uint32)
            parts.append((tok, np.frombuffer(gid, np.int64), np.frombuffer(pos, np.uint16 if len(pos) == 2 * len(tok) else np.uint32).astype(np.int64)))
        tok, gid, pos = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((gid, tok))
        tok, gid, pos = tok[by].astype(np.int64), gid[by], pos[by]
        fresh = np.append(True, (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1]))
        tok, gid, pos = tok[fresh], gid[fresh], pos[fresh]
        bucket = key[0].as_py()
        if bucket < n_buckets:
            same = tok[1:] == tok[:-1]
            keep = np.append(False, same) | np.append(same, False)
            tok, gid, pos = tok[keep] | bucket << 32, gid[keep], pos[keep]
        else:
            tok = -1 - tok
        return pa.table({"tok": tok, "gid": gid, "pos": pos})

    index = texts.mapInArrow(packed, "bucket long, tok binary, gid binary, pos binary")
    postings = cut(index.groupBy("bucket").applyInArrow(repeated, "tok long, gid long, pos long"))
    sets = members.filter("sid is not null").select("gid", "sid", "n").distinct()
    central = postings.groupBy("gid").count().join(sets.select("gid", "n").distinct(), "gid").select("gid", "n", (F.col("count") / F.col("n")).alias("c"))
    found, postings = postings, cut(postings.join(central, "gid"))
    drop(found)

    need = lambda x, y: F.ceil(F.lit(num) * (x + y) / F.lit(float(den + num)))  # noqa: E731  shared shingles that the threshold asks for
    near = lambda a, b: (
        (F.least(a["n"], b["n"]) * den >= F.greatest(a["n"], b["n"]) * num)
        & (F.least(a["pos"], b["pos"]) + 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1 >= need(a["n"], b["n"]))
    )

    # shared shingles past the prefixes: of the set whose prefix ends first none is beyond its rest
    rest_of = lambda n: F.ceil(n * F.lit(num) / F.lit(float(den))) - 1
    enough = F.col("c") + F.greatest(rest_of(F.col("n1")), rest_of(F.col("n2"))) >= need(F.col("n1"), F.col("n2"))

    # -- step 1: each group meets the most central group of each of its shingles
    hubs = (
        postings.groupBy("tok").agg(F.max(F.struct("c", "gid", "n", "pos")).alias("h"))
        .select("tok", F.col("h.gid").alias("hub"), F.struct("h.n", "h.pos").alias("h"))
    )
    star = (
        postings.join(hubs, "tok").filter("gid <> hub")
        .filter(near({"n": F.col("n"), "pos": F.col("pos")}, {"n": F.col("h.n"), "pos": F.col("h.pos")}))
        .groupBy("gid", "hub").agg(F.count("*").alias("c"), F.min("n").alias("n1"), F.min("h.n").alias("n2"))
        .filter(enough).select("gid", "hub")
    )
    lead = sets.groupBy("gid").agg(F.min("sid").alias("lead"))
    first = (
        sets.join(star, "gid").join(lead.withColumnRenamed("gid", "hub"), "hub").select(F.col("sid").alias("a"), F.col("lead").alias("b"))
        .union(sets.join(lead, "gid").filter("sid <> lead").select(F.col("sid").alias("a"), F.col("lead").alias("b")))
    )
    links = cut(verified(texts, members, first, k, num, den))
    label = components(links)

    # -- step 2: pairs of sets that share a prefix shingle and are still apart
    placed = cut(sets.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    spread = cut(placed.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    where = cut(postings.drop("c").join(spread, "gid"))
    torn = cut(where.groupBy("tok").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("groups")).filter("l <> h").select("tok", "groups"))
    # sizes that may link are in one class or in two next to each other, so a shingle of many groups is met class by class
    of_size = F.when(F.col("groups") > CROWD, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int"))
    open_ = where.join(torn, "tok").select("tok", "gid", "n", "pos", "lo", "hi", F.coalesce(of_size, F.lit(-2)).alias("own"))
    x = open_.withColumn("class", F.explode(F.when(F.col("own") < -1, F.array("own")).otherwise(F.array("own", F.col("own") + 1)))).alias("x")
    y = open_.withColumn("class", F.col("own")).alias("y")
    once = (F.col("x.own") < F.col("y.own")) | (F.col("x.gid") < F.col("y.gid"))
    apart = (
        x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.class") == F.col("y.class")) & once & ((F.col("x.lo") != F.col("y.lo")) | (F.col("x.hi") != F.col("y.hi")) | (F.col("x.lo") != F.col("x.hi")))
               & near({"n": F.col("x.n"), "pos": F.col("x.pos")}, {"n": F.col("y.n"), "pos": F.col("y.pos")}))
        .groupBy(F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2")).agg(F.count("*").alias("c"), F.min("x.n").alias("n1"), F.min("y.n").alias("n2"))
        .filter(enough).select("g1", "g2")
    )
    one = placed.select(F.col("gid").alias("g1"), F.col("sid").alias("a"), F.col("label").alias("la"))
    two = placed.select(F.col("gid").alias("g2"), F.col("sid").alias("b"), F.col("label").alias("lb"))
    inner = spread.filter("lo <> hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    rest = apart.union(inner).join(one, "g1").join(two, "g2").filter("la <> lb and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(verified(texts, members, rest, k, num, den))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    named = members.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("node", "sid"), "sid", "left")
    named = cut(named.withColumn("label", F.coalesce("label", "sid")))
    smallest = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of_set = cut(named.join(smallest, "label").select("sid", "component_id"))
    return members.select("doc_id", "n", "sid").join(of_set, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_key"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def verified(texts: DataFrame, members: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b: set keys) whose whole sets reach num / den; members has the size and bitmap of each set."""
    pairs = cut(pairs.filter("a <> b").distinct())

    def possible(batches):
        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            ok = [_most_shared(x, y, nx, ny) * (den + num) >= num * (nx + ny) for x, y, nx, ny in zip(*columns)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def sided(pairs: DataFrame, whole: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(whole.select(F.col("sid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])

    def filtered(ids: DataFrame):
        """A Bloom filter of the keys on every executor, and its bits."""
        bits = 1 << min(27, max(16, (ids.count() * 12).bit_length()))
        return texts.sparkSession.sparkContext.broadcast(bloom(ids.withColumnRenamed("sid", "h"), bits)), bits

    ids = cut(_ids(pairs))
    first, first_bits = filtered(ids)

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(first.value, np.asarray(batch.column(0)), first_bits)))

    known = members.filter("sid is not null").select("sid", "n", "bits").mapInArrow(wanted, "sid long, n long, bits binary")
    known = known.join(ids, "sid", "left_semi").dropDuplicates(["sid"])
    pairs = cut(sided(pairs, known, "bits", "n").mapInArrow(possible, "a long, b long"))
    ids = cut(_ids(pairs))
    second, bits = filtered(ids)

    def keyed(batches):
        table = second.value
        for _, sets in _tokens(batches, k):
            sets = [s for s in sets if len(s)]
            keys = np.array([_set_key(s) for s in sets], np.int64)
            done = {int(keys[i]): sets[i].tobytes() for i in (np.flatnonzero(hit(table, keys, bits)) if len(keys) else ())}
            yield pa.RecordBatch.from_pydict({"sid": pa.array(list(done), pa.int64()), "s": pa.array(list(done.values()), pa.binary())})

    whole = texts.select("text").mapInArrow(keyed, "sid long, s binary")
    whole = whole.join(ids, "sid", "left_semi").dropDuplicates(["sid"])

    def check(batches):
        for batch in slices(batches):
            sa, sb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(sa), bool)
            for i, (x, y) in enumerate(zip(sa, sb)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                    z = np.sort(np.concatenate([x, y]))
                    common = int((z[1:] == z[:-1]).sum())
                    ok[i] = common * den >= num * (len(x) + len(y) - common)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return sided(pairs, whole, "s").mapInArrow(check, "a long, b long")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()


def one_of_each(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays; all columns are kept.

    Rows whose text has no word stay; of rows that repeat an id and a text one stays. Where an id
    repeats with different texts, each text is judged by itself.
    """
    found = cut(jaccard_links(docs, threshold=threshold).filter("n_shingles > 0").select("doc_id", "set_key", "component_id"))
    gone = found.filter("doc_id <> component_id").select("doc_id", "set_key").distinct()
    twice = cut(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return docs.join(gone.select("doc_id"), "doc_id", "left_anti")

    def keyed(batches):
        for batch, sets in _tokens(batches, 5):
            keys = pa.array([_set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "set_key"])

    many = docs.join(twice, "doc_id", "left_semi")
    many = many.mapInArrow(keyed, StructType([*many.schema.fields, StructField("set_key", LongType())]))
    many = many.join(gone, ["doc_id", "set_key"], "left_anti").select(*docs.columns, "set_key")
    # of near duplicates that share the smallest id too, one text stays
    first = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("set_key").alias("kept_key")).withColumnRenamed("doc_id", "kept_id")
    many = many.join(first, F.col("doc_id") == F.col("kept_id"), "left")
    own = found.filter("doc_id = component_id").select("doc_id", "set_key").distinct().withColumn("own", F.lit(True))
    many = many.join(own, ["doc_id", "set_key"], "left").filter("own is null or set_key = kept_key").select(*docs.columns)
    left = docs.join(twice, "doc_id", "left_anti").join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    return left.unionByName(many.dropDuplicates(["doc_id", "text"]))
