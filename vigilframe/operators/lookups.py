"""Lookup joins: networks, domain suffixes, nearest in time, vectors, and set similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def ip_to_long(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null where it is not one."""
    p = F.split(ip, r"\.")
    ok = ip.rlike(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")
    n = sum((p[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(ok & F.forall(p, lambda x: x.cast("int") <= 255), n)


def block_size(prefix: Column) -> Column:
    """Addresses of a network with that prefix length."""
    return F.pow(F.lit(2.0), F.lit(32) - prefix).cast("long")


def cidr_bounds(df: DataFrame, cidr: str) -> DataFrame:
    """prefix, lo and hi of `a.b.c.d/n`; a bare address is /32."""
    parts = F.split(F.col(cidr), "/")
    prefix = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(32))
    size = block_size(prefix)
    base = ip_to_long(parts[0])
    return df.withColumn("prefix", prefix).withColumn("lo", base - base % size).withColumn("hi", F.col("lo") + size - 1)


def cidr_join(df: DataFrame, num: str, nets: DataFrame, how: str = "left") -> DataFrame:
    """The most specific network that holds each address, by equi joins instead of a range join.

    nets has prefix and lo, one row per network. Each address makes one key per prefix length that occurs (33 at most),
    so the join hashes on (prefix, lo) and the deepest hit is kept by one aggregation on the row's own columns.
    """
    lengths = F.array(*[F.lit(i) for i in range(32, -1, -1)])
    key = F.explode(F.transform(lengths, lambda n: F.struct(n.alias("prefix"), (F.col(num) - F.col(num) % block_size(n)).alias("lo"))))
    occurring = nets.select("prefix").distinct()
    probe = df.select(F.col(num)).distinct().withColumn("__k", key).select(num, F.col("__k.prefix").alias("prefix"), F.col("__k.lo").alias("lo"))
    hits = probe.join(F.broadcast(occurring), "prefix", "left_semi").join(nets, ["prefix", "lo"])  # prefix lengths: 33 rows at most
    extra = [c for c in nets.columns if c not in ("prefix", "lo", "hi")]
    best = hits.groupBy(num).agg(F.max_by(F.struct("prefix", *extra), "prefix").alias("__n"))
    return df.join(best, num, how).select(*df.columns, *[F.col(f"__n.{c}").alias(c) for c in ("prefix", *extra)])


def suffixes(host: Column) -> Column:
    """A host and its parents that still have a dot, most specific first."""
    p = F.split(F.lower(host), r"\.")
    n = F.size(p)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, i, n), "."))


def suffix_join(df: DataFrame, host: str, table: DataFrame, domain: str, key: str) -> DataFrame:
    """The longest listed suffix of each host: an equi join on exploded suffixes, then one aggregation."""
    probe = df.select(key, F.explode(suffixes(F.col(host))).alias(domain))
    hit = probe.join(table, domain).groupBy(key).agg(F.max_by(domain, F.length(domain)).alias("matched"))
    return df.join(hit, key, "left")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, within_us: int) -> DataFrame:
    """Each left row with the right row of the same keys that is nearest in time, at most within_us away, and their distance.

    Both sides have `us`. Time is cut into slices as long as the tolerance; a right row goes to its own slice and both
    neighbours, a left row to its own. One pass in each direction of time then carries the last right row seen along, so
    the work is linear in the rows of a slice, no pairs arise, and a hot key is split by time. Of equally near rows the
    earlier stays, then the smaller right_id. Rows with a null key or time find nothing.
    """
    cut = lambda c: F.floor(c / within_us)
    r = right.dropna(subset=[*keys, "us"]).select(*keys, "us", F.struct(F.col("us").alias("us"), F.col(right_id).alias("id")).alias("__r"), F.explode(F.array(*[cut(F.col("us")) + i for i in (-1, 0, 1)])).alias("__slot"))
    both = left.withColumns({"__left": F.lit(True), "__slot": cut(F.col("us"))}).unionByName(r, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "__slot").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda order: F.last("__r", ignorenulls=True).over(part.orderBy(order, F.asc_nulls_first("__left"), F.desc("__r.id")))
    near = both.withColumns({"__before": seen(F.asc("us")), "__after": seen(F.desc("us"))}).filter("__left")
    dist = lambda c: F.abs(F.col("us") - F.col(f"{c}.us"))
    found = F.array_min(F.array_compact(F.array(*[F.when(dist(c) <= within_us, F.struct(dist(c).alias("dist"), F.col(f"{c}.us").alias("us"), F.col(f"{c}.id").alias("id"))) for c in ("__before", "__after")])))
    return near.withColumn("__b", found).select(*left.columns, F.col("__b.id").alias(right_id), F.col("__b.dist").alias("dist"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; those that are null or hold a null are left out."""
    at: dict[int, list[int]] = {}
    lengths = pc.list_value_length(vectors)
    if len(vectors) and not vectors.null_count and not vectors.flatten().null_count and pc.count_distinct(lengths).as_py() == 1:
        n = lengths[0].as_py()
        return {n: (np.arange(len(vectors)), vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), n))}
    rows = vectors.to_pylist()
    for i, v in enumerate(rows):
        if v is not None and None not in v:
            at.setdefault(len(v), []).append(i)
    return {n: (np.array(some), np.array([rows[i] for i in some], dtype=float).reshape(len(some), n)) for n, some in at.items()}


def _norms(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for c in m.T:
        out += c * c
    return np.sqrt(out)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cosine() of all rows of a with all rows of b. Sums run from the first number to the last, as dot() does, so equal vectors have equal scores wherever they stand."""
    columns, out = np.ascontiguousarray(b.T), np.zeros((len(a), len(b)))
    each = np.empty_like(out)
    for i in range(a.shape[1]):
        np.multiply(a[:, i, None], columns[i], out=each)
        out += each
    np.multiply(_norms(a)[:, None], _norms(b), out=each)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((each > 0) | np.isnan(each), out / each, 0.0)


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vector: str, carry: tuple[str, ...] = (), own: bool = False, block: int = 4096, chunk: int = 4096) -> DataFrame:
    """The k right rows of greatest cosine similarity for each left row, exactly: left_id, right_id, score, rank and the right rows' `carry`.

    Both sides lie in a grid of cells. Right rows are dealt by a hash into blocks of about `block`, left rows by another
    into chunks of about `chunk`; every left row goes once to each block, every right row once to each chunk. A cell
    scores all its pairs in tiles of at most 131,072 numbers or one left row, and only the k best of a left row in it move
    on. The driver sees two counts. Rows of the same id are not compared unless `own` is set. Equal scores go to the
    smaller right_id. A null vector or one that holds a null scores 0, vectors of two lengths null, which comes last.
    """
    blocks, chunks = max(1, -(-right.count() // block)), max(1, -(-left.count() // chunk))
    number = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not own:
        left, right = left.filter(F.col(left_id).isNotNull()), right.filter(F.col(right_id).isNotNull())
    rows = left.select(F.col(left_id).alias("id"), F.col(vector).alias("v"), number(left_id, chunks, 2).alias("__chunk"), every(blocks).alias("__block"))
    held = right.select(F.col(right_id).alias("id"), F.col(vector).alias("v"), *[F.col(c).alias(f"c_{c}") for c in carry], number(right_id, blocks, 1).alias("__block"), every(chunks).alias("__chunk"))
    names = [left_id, right_id, "score", *carry]
    kinds = [left.schema[left_id].dataType, right.schema[right_id].dataType, DoubleType(), *[right.schema[c].dataType for c in carry]]
    schema = StructType([StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[("id", "ascending")], null_placement="at_end"))  # of equal scores the first wins
        sides = [t["v"].combine_chunks() if len(t) else pa.array([], pa.list_(pa.float64())) for t in (a, b)]
        ours, theirs = _by_length(sides[0]), _by_length(sides[1])
        placed = {n: dict(zip(at.tolist(), range(len(at)), strict=True)) for n, (at, _) in ours.items()}
        of = {i: n for n, some in placed.items() for i in some}
        mixed = len(ours.keys() | theirs.keys()) > 1
        sizes = [np.zeros(len(t)) for t in (a, b)]
        for size, side in zip(sizes, (ours, theirs), strict=True):
            for at, m in side.values():
                size[at] = _norms(m)
        found, step = [], max(1, 131_072 // max(1, len(b)))
        for start in range(0, len(a) if len(b) else 0, step):
            here = range(start, min(start + step, len(a)))
            score = np.zeros((len(here), len(b)))
            none = ~(sizes[0][start : here.stop, None] * sizes[1] <= 0) if mixed else np.zeros((1, len(b)), bool)
            for n in {of[i] for i in here if i in of} & set(theirs):
                mine = [i for i in here if of.get(i) == n]
                place = np.ix_([i - start for i in mine], theirs[n][0])
                score[place] = _cosines(ours[n][1][[placed[n][i] for i in mine]], theirs[n][1])
                if mixed:
                    none[place] = False
            none = np.broadcast_to(none, score.shape)
            order = np.where(none, -1e300, np.where(np.isnan(score), np.inf, score))
            if not own:
                order[a["id"].slice(start, len(here)).to_numpy()[:, None] == b["id"].to_numpy()] = -np.inf
            least = np.partition(order, len(b) - k, axis=1)[:, len(b) - k, None] if len(b) > k else -np.inf
            r, c = np.nonzero((order >= least) & (order > -np.inf))
            best = np.lexsort((c, -order[r, c], r))
            r, c = r[best], c[best]
            first = np.searchsorted(r, r, side="left")
            kept = np.arange(len(r)) - first < k
            r, c = r[kept], c[kept]
            found.append((r + start, c, score[r, c], none[r, c]))
        r, c, score, none = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        return pa.table([a["id"].take(pa.array(r, pa.int64())), b["id"].take(pa.array(c, pa.int64())), pa.array(score, pa.float64(), mask=none), *[b[f"c_{x}"].take(pa.array(c, pa.int64())) for x in carry]], names=names)

    found = rows.groupBy("__block", "__chunk").cogroup(held.groupBy("__block", "__chunk")).applyInArrow(cell, schema)
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), F.asc_nulls_last(right_id))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, id_col: str, vector: str, block: int = 4096) -> DataFrame:
    """The k corpus rows of greatest cosine similarity for each query, exactly; no query vector goes to the driver."""
    return nearest(queries, corpus, k, query_id, id_col, vector, block=block)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def version_parts(v: Column) -> Column:
    """major.minor.patch[pN] as a struct that orders like the version."""
    g = lambda i: F.coalesce(F.regexp_extract(v, r"^(\d+)\.?(\d*)\.?(\d*)p?(\d*)", i).try_cast("int"), F.lit(0))
    return F.struct(g(1).alias("major"), g(2).alias("minor"), g(3).alias("patch"), g(4).alias("p"))
