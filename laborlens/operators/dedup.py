"""Finding duplicate postings and grouping them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..functions import text as X
from ..session import cut_lineage
from .serving import LIVE
from .skew import salted_join

# --- fixed values: hosts of job platforms, which say nothing about the employer -------------
PLATFORM_HOST = (
    r"(^|\.)(adzuna\.[a-z.]+|greenhouse\.io|lever\.co|recruitee\.com|personio\.(de|com)|workable\.com"
    r"|smartrecruiters\.com|indeed\.[a-z.]+|linkedin\.com)$"
)
NEAR_THRESHOLD = 0.9
# --- end of fixed values --------------------------------------------------------------------

PIVOTS = 32  # pivot vectors held by every task
SAMPLE = 512  # vectors that the pivots and the directions of heads are taken from
TILE = 2048  # rows per side of one comparison task
STRIP = 128  # rows of a tile whose products with the other tile are held at a time
PAIR_RUN = 1 << 15  # open pairs whose vectors are gathered at a time
BOUND_SLACK = 1e-9  # rounding of sums of products of unit vectors


def employer_domain(company_domain: Column, apply_url: Column) -> Column:
    host = X.url_domain(F.coalesce(company_domain, apply_url))
    return F.when(~host.rlike(PLATFORM_HOST), host)


def _normalised(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """The distinct names with their normalised form ``_norm``, and further aggregates.

    The form is made of an aggregate: a condition on a grouping column would be moved below the grouping, to every row.
    """
    one = rows.groupBy(name).agg(F.max(name).alias("_same"), *more)
    return one.withColumn("_norm", X.normalize_company(F.col("_same"))).drop("_same")


def resolve_companies(postings: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with ``company_key``, companies to add, domains to fill in).

    An employer domain decides first, then the normalised name. Of the rest, names and domains make a
    graph: a name goes with the domain it stands with most often (of equal ones the least), so postings
    of one firm with and without a domain, or with two, are one new company. A domain without a
    name is its own key. Postings without name and domain have no company. All this is found for the distinct
    pairs of name and domain, so names are normalised once each and postings meet their pair in one join.
    """
    domain = employer_domain(F.lit(None).cast("string"), F.col("apply_url"))
    p = postings.drop("company_key").withColumn("_domain", domain)
    pairs = p.groupBy("company_name", "_domain").agg(F.count("*").alias("_rows"))
    names = _normalised(pairs, "company_name")
    by_domain = companies.filter(F.col("domain").isNotNull()).groupBy(F.col("domain").alias("_domain")).agg(F.min("company_id").alias("_d"))
    by_name = _normalised(companies, "name", F.min("company_id").alias("_n")).groupBy("_norm").agg(F.min("_n").alias("_n"))
    pairs = pairs.join(names.join(by_name, "_norm", "left"), "company_name", "left").join(by_domain, "_domain", "left")
    known = F.coalesce("_d", "_n").cast("string")
    links = pairs.filter(known.isNull() & F.col("_domain").isNotNull() & F.col("_norm").isNotNull()).groupBy("_norm", "_domain").agg(F.sum("_rows").alias("_c"))
    main = links.groupBy("_norm").agg(F.min_by("_domain", F.struct(-F.col("_c"), F.col("_domain"))).alias("_main"))
    fresh = F.concat(F.lit("new:"), F.when(F.col("_norm").isNotNull(), F.coalesce("_main", "_norm")).otherwise(F.col("_domain")))
    pairs = pairs.join(main, "_norm", "left").withColumn("company_key", F.coalesce(known, fresh))
    new = pairs.filter(F.col("company_key").startswith("new:")).groupBy("company_key").agg(
        F.min(F.coalesce("company_name", "_domain")).alias("name"), F.min(F.coalesce("_main", "_domain")).alias("domain")
    )
    fills = pairs.filter(F.col("_d").isNull() & F.col("_n").isNotNull() & F.col("_domain").isNotNull()).groupBy(
        F.col("_n").alias("company_id")
    ).agg(F.min("_domain").alias("fill"))
    fills = fills.join(companies.filter(F.col("domain").isNull()).select("company_id"), "company_id", "left_semi")
    keys = pairs.filter(F.col("company_key").isNotNull()).select(F.col("company_name").alias("_name"), F.col("_domain").alias("_host"), "company_key")
    posts = p.join(keys, F.col("company_name").eqNullSafe(F.col("_name")) & F.col("_domain").eqNullSafe(F.col("_host")), "left")
    return posts.drop("_domain", "_name", "_host"), new, fills


def same_key_edges(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """(src, dst): every row of a shared key tied to the smallest id of the key.

    A star needs one edge per row where all pairs would need a square; a hot key is combined
    before the shuffle and spread over tasks for the join back.
    """
    live = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(row_id).alias("src"))
    least = live.groupBy("_k").agg(F.min("src").alias("dst"))
    return salted_join(live, least, "_k", "src").filter("src <> dst").select("src", "dst")


def live_rows(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("status").isin(*LIVE))


# --- near duplicates by vectors ---------------------------------------------------------------


def main_directions(sample: np.ndarray) -> np.ndarray:
    """Orthonormal directions, as columns, by falling weight in a sample of unit vectors: a quarter of all.

    The bounds hold for any orthonormal directions; these only gather more of a product.
    """
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, : max(1, sample.shape[1] // 4)]


def heads(m: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of each row, as a unit vector: its part along the directions, then the norm of what is left."""
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    part = u @ basis
    rest = np.sqrt(np.maximum(0.0, (u * u).sum(axis=1) - (part * part).sum(axis=1)))
    return np.c_[part, rest]


def pairs_above(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, cosine) of all pairs of rows above the threshold, and the multiplications spent.

    The products of the heads, the norms of the rests included, bound every cosine from above (Cauchy and
    Schwarz on the rests); only pairs whose bound passes are computed whole. Blocks of heads whose balls
    lie too far apart are dropped at once. A row of zeros has no partner.
    """
    none, h = np.zeros(0, np.int64), hx.shape[1]
    work = 0
    if len(x) * len(y) > 8 * (len(x) + len(y)):
        work = 2 * h * (len(x) + len(y))
        cx, cy = hx[:, :-1].mean(axis=0), hy[:, :-1].mean(axis=0)
        reach = [np.linalg.norm(m[:, :-1] - c, axis=1).max() for m, c in ((hx, cx), (hy, cy))]
        if np.linalg.norm(cx - cy) - sum(reach) > math.sqrt(max(0.0, 2 - 2 * threshold)) + BOUND_SLACK:
            return none, none, np.zeros(0), work
    found = [_pairs_of_strip(x[at : at + STRIP], y, hx[at : at + STRIP], hy, threshold, at) for at in range(0, len(x), STRIP)]
    if not found:
        return none, none, np.zeros(0), work
    i, j, c = (np.concatenate([f[k] for f in found]) for k in range(3))
    return i, j, c, work + sum(f[3] for f in found)


def _pairs_of_strip(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, threshold: float, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``pairs_above`` of a few rows of one side, of which ``first`` is the place of the first; all of its products are held at once."""
    d, h = x.shape[1], hx.shape[1]
    bound = hx @ hy.T
    work = h * bound.size
    i, j = np.nonzero(bound > threshold - BOUND_SLACK)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    if len(i) * 4 > bound.size:  # most are open: one product is cheaper than gathered rows
        dots = (x @ y.T)[i, j]
        work += d * bound.size
    else:
        runs = [slice(at, at + PAIR_RUN) for at in range(0, len(i), PAIR_RUN)]
        dots = np.concatenate([np.einsum("ij,ij->i", x[i[r]], y[j[r]]) for r in runs]) if runs else np.zeros(0)
        work += d * len(i)
    norm = nx[i] * ny[j]
    s = np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)
    near = (s > threshold - BOUND_SLACK) & (norm > 0)
    i, j = i[near], j[near]
    work += d * len(i)
    s = np.concatenate([cosines(x[i[at : at + PAIR_RUN]], y[j[at : at + PAIR_RUN]]) for at in range(0, max(1, len(i)), PAIR_RUN)])
    over = s > threshold
    return first + i[over], j[over], s[over], work


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with that of ``y``, summed in the order of the numbers.

    A matrix product sums in an order that depends on where a row lies, so equal vectors get cosines that
    differ in the last bit, and ties among them are not seen.
    """
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(x.shape[1]):
        dot += x[:, k] * y[:, k]
        xx += x[:, k] * x[:, k]
        yy += y[:, k] * y[:, k]
    return dot / np.sqrt(xx * yy)


def _tiled_pairs(home: DataFrame, probe: DataFrame, threshold: float, work: tuple | None) -> DataFrame:
    """(a, b, similarity), a < b, of the pairs of (id, blk, v, head, cell, same) rows of one cell above the threshold.

    A ``same`` row of ``probe`` is a row of that cell itself, where each pair is met from both ends.

    Cells above ``TILE`` rows are cut by a hash of the id on both sides, so a task holds two tiles at most.
    """

    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("blk", "cell").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias(name))

    size = tiles(home, "nh").join(tiles(probe, "np"), ["blk", "cell"])
    spread = F.pmod(F.xxhash64("id"), F.col("n_own")).cast("int")

    def side(df: DataFrame, own: str, other: str, role: int) -> DataFrame:
        s = size.select("blk", "cell", F.col(own).alias("n_own"), F.col(other).alias("n_other"))
        out = df.join(s, ["blk", "cell"]).withColumn("mine", spread)
        out = out.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        first, second = ("mine", "theirs") if role == 0 else ("theirs", "mine")
        return out.select("blk", "cell", F.col(first).alias("th"), F.col(second).alias("tp"), "id", "v", "head", "same", F.lit(role).alias("role"))

    both = side(home, "nh", "np", 0).unionByName(side(probe, "np", "nh", 1))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        h, p = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if h.empty or p.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (h, p))
        hx, hy = (np.stack(d["head"].to_numpy()) for d in (h, p))
        i, j, s, spent = pairs_above(x, y, hx, hy, threshold)
        if work is not None:
            work[0].add(spent)
            work[1].add(len(x) * len(y) * x.shape[1])
        ids_h, ids_p, same = h["id"].to_numpy()[i], p["id"].to_numpy()[j], p["same"].to_numpy(dtype=bool)[j]
        once = (ids_h < ids_p) | (~same & (ids_h > ids_p))
        a, b = np.minimum(ids_h, ids_p)[once], np.maximum(ids_h, ids_p)[once]
        return pd.DataFrame({"a": a, "b": b, "similarity": s[once]})

    return both.groupBy("blk", "cell", "th", "tp").applyInPandas(compare, "a long, b long, similarity double")


def _vectors(rows: DataFrame, row_id: str, vector: str, block: str | None) -> tuple[DataFrame, np.ndarray]:
    """(id, blk, v) rows with a vector, and a sample of at most ``SAMPLE`` unit vectors."""
    base = rows.select(
        F.col(row_id).alias("id"), (F.col(block).cast("string") if block else F.lit("")).alias("blk"), F.col(vector).alias("v")
    ).filter(F.col("v").isNotNull())
    sample = base.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    known = np.array([r["v"] for r in sample], dtype=np.float64)
    if len(known):
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
    return base, known


def _with_heads(base: DataFrame, sample: np.ndarray, work: tuple | None) -> DataFrame:
    """The rows with ``head``, made once for each row."""
    basis = main_directions(sample)

    @pandas_udf(ArrayType(DoubleType()))
    def head(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        if work is not None:
            work[0].add(len(v) * basis.size)
        return pd.Series(list(heads(np.stack(v.to_numpy()).astype(np.float64), basis)))

    return base.withColumn("head", head("v"))


def _no_pairs(base: DataFrame) -> DataFrame:
    return base.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)


def similar_pairs(
    rows: DataFrame, row_id: str, vector: str, threshold: float = NEAR_THRESHOLD, block: str | None = None, work: tuple | None = None
) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs whose cosine is above the threshold, exactly.

    Vectors are parted by their nearest of a few pivots and by rings of the angle to it. Angles
    obey the triangle inequality, so a partner within angle t of x lies in a ring within t of
    x's own angle to that pivot, and only in cells of pivots not farther from x than its
    nearest one plus 2t. A row is stored in one cell and probes those of the others that have a higher
    number, as a partner in a lower one probes its cell. Large cells
    are cut into tiles by hash, so no task holds more than a tile of each side; a task
    multiplies the heads of two tiles, and vectors only
    where the heads leave a pair open (``pairs_above``), and returns only the pairs above the threshold.
    ``work`` may be two accumulators: multiplications spent, and those that whole products of the tiles
    would take. Null vectors have no partner, a vector of zeros neither; an empty table gives no pair.
    """
    base, sample = _vectors(rows, row_id, vector, block)
    if not len(sample):
        return _no_pairs(base)
    pivots = sample[:PIVOTS]
    angle = math.acos(threshold)
    width, slack = angle, 1e-5

    @pandas_udf(ArrayType(IntegerType()))
    def cells(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        a = np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))
        home = a.argmin(axis=1)
        near = a[np.arange(len(a)), home]
        rings = int(math.pi / width) + 2
        out = []
        for i in range(len(a)):
            own = int(home[i]) * rings + int(near[i] / width)
            probe = [own]
            for p in np.flatnonzero(a[i] <= near[i] + 2 * angle + slack):
                lo, hi = int(max(0.0, a[i, p] - angle - slack) / width), int((a[i, p] + angle + slack) / width)
                probe.extend(int(p) * rings + r for r in range(lo, hi + 1))
            out.append([own] + sorted(c for c in set(probe) if c >= own))
        return pd.Series(out)

    placed = _with_heads(base, sample, work).withColumn("cells", cells("v"))
    home = placed.select("id", "blk", "v", "head", F.get("cells", F.lit(0)).alias("cell"), F.lit(True).alias("same"))
    probe = placed.select("id", "blk", "v", "head", F.get("cells", F.lit(0)).alias("own"), F.explode(F.slice("cells", 2, 1 << 30)).alias("cell"))
    probe = probe.withColumn("same", F.col("own") == F.col("cell")).drop("own")
    return _tiled_pairs(home, probe, threshold, work)


def hyperplane_pairs(
    rows: DataFrame, row_id: str, vector: str, threshold: float = NEAR_THRESHOLD, block: str | None = None,
    planes: int = 10, tables: int = 24, work: tuple | None = None,
) -> DataFrame:
    """(a, b, similarity) with a < b: most pairs above the threshold, none below it.

    The option for data that pivots do not part. Signs against ``planes`` random hyperplanes are the cell
    of a vector in each of ``tables`` tables; a pair at angle t shares a cell of one table with probability
    (1 - t / pi) ** planes, so with the given numbers a pair at a cosine of 0.9 is missed with probability
    0.004. A row is copied once for each table. Cells of any size are compared whole, in tiles.
    """
    base, sample = _vectors(rows, row_id, vector, block)
    if not len(sample):
        return _no_pairs(base)
    normals = np.random.default_rng(7).normal(size=(sample.shape[1], tables * planes))
    weights = 1 << np.arange(planes)

    @pandas_udf(ArrayType(IntegerType()))
    def cells(v: pd.Series) -> pd.Series:
        sign = np.stack(v.to_numpy()).astype(np.float64) @ normals > 0
        key = sign.reshape(len(v), tables, planes) @ weights
        return pd.Series(list((key + (np.arange(tables) << planes)).astype(np.int32)))

    placed = _with_heads(base, sample, work).withColumn("cell", F.explode(cells("v"))).withColumn("same", F.lit(True))
    return _tiled_pairs(placed, placed, threshold, work).dropDuplicates(["a", "b"])


def nearest(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` most similar partners of every row (a top-k report)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity")
    )
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- groups -----------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): connected groups, named by their smallest id.

    Alternating large-star and small-star steps; the rounds grow with the logarithm of the
    longest chain. Each round is checkpointed, so the lineage stays short.
    """
    e = cut_lineage(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    )

    def shape(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        return r["n"], r["x"]

    before = shape(e)
    for _ in range(max_rounds):
        # large star: larger neighbours of a node move to its smallest neighbour (or itself)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = salted_join(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut_lineage(small)
        now = shape(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("grouping did not settle")
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def duplicate_edges(postings: DataFrame, vectors: DataFrame | Column | None = None, row_id: str = "doc_id") -> DataFrame:
    """Edges of the layers: canonical URL, then normalised key, then near vectors in a company.

    Later layers see only the rows the earlier ones left alone, except for the smallest row of
    each group, which stays so that a later layer can still join two groups. ``vectors`` is a table
    of (row id, embedding), or a column that makes the vector of a row, for those rows only.
    """
    p = live_rows(postings).withColumns(
        {
            "_url": X.url_canonical(F.col("apply_url")),
            "_key": X.dedup_key(F.col("title"), F.col("company_name"), F.col("city")),
        }
    )
    by_url = same_key_edges(p, "_url", row_id)
    rest = p.join(by_url.select(F.col("src").alias(row_id)), row_id, "left_anti")
    by_key = same_key_edges(rest, "_key", row_id)
    out = by_url.withColumn("layer", F.lit(1)).unionByName(by_key.withColumn("layer", F.lit(3)))
    if vectors is not None:
        rest = rest.join(by_key.select(F.col("src").alias(row_id)), row_id, "left_anti")
        rest = rest.filter(F.col("company_id").isNotNull())
        made = rest.withColumn("embedding", vectors) if isinstance(vectors, Column) else rest.join(vectors, row_id)
        near = similar_pairs(cut_lineage(made.select(row_id, "company_id", "embedding")), row_id, "embedding", block="company_id")
        out = out.unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(4).alias("layer")))
    return out
