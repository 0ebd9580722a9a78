"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of (source, language, topic).  The token totals of the cells are raked until their sums over
each margin meet its targets, in every sweep held to what a cell has; a document's probability is the share of its
cell's tokens that the fit keeps, and a hash of doc_id decides, so a rerun picks the same documents.

Every value of a margin has a target of its own, however many there are; null is a class by itself.  With given targets
those that they do not name (and null) share the class "other".  A table of at most ``CELLS`` cells and ``BYTES`` of
names is raked in the driver and broadcast, a larger one by groupBy and join for each margin; both give the same fit.
Without given targets a margin's are its token shares to the power ``SMOOTH``, which lifts small sources.  A topic is
the nearest of some centroids of term weights, learned from all rows (``topics``).  Texts are read once: what they are
measured by is written to the shared folder.

Edge cases: a null text has no tokens and the topic "none"; a class without tokens is kept whole; targets beyond what a class
has are met by all it has, the rest goes to the other classes; repeated rows are picked together; rows of null doc_id
share one decision; an empty table stays empty.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common, topics

SMOOTH, KEEP, SEED = 0.7, 0.8, 20240101
#: Up to here the driver rakes; nothing is left out beyond.
CELLS, BYTES = 50_000, 8_000_000
OTHER = "other"
MARGINS = ("source", "lang", "topic")
SWEEPS, TOLERANCE = 200, 1e-9


def filled(available: np.ndarray, shares: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt out by ``shares``, no class above what it has; what that leaves goes to the others."""
    out, free = np.zeros(len(available)), (available > 0) & (shares > 0)
    for _ in range(len(available) + 1):
        rest = total - out.sum()
        if rest <= 1e-9 * max(total, 1) or not free.any():
            break
        more = np.where(free, rest * shares / shares[free].sum(), 0)
        out = np.minimum(available, out + more)
        free &= out < available * (1 - 1e-12)
    return out


def raked(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Cell totals that meet the targets of every margin as nearly as their bounds (``cells``) allow.

    ``codes`` has the class of each cell, by margin.
    """
    fit = cells.astype(float).copy()
    for _ in range(sweeps):
        before = fit.copy()
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, fit, len(target)).astype(float)  # of no rows they are int
            factor = np.divide(target, sums, out=np.ones_like(sums), where=sums > 0)
            fit = np.minimum(fit * factor[code], cells)
        if np.abs(fit - before).max(initial=0) <= TOLERANCE * max(cells.max(initial=0), 1):
            return fit
    warnings.warn(f"raking still moved after {sweeps} sweeps", stacklevel=2)
    return fit


def rake(cells: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """``raked`` for cells that fill a box."""
    codes = list(np.indices(cells.shape).reshape(cells.ndim, -1))
    return raked(cells.reshape(-1), codes, targets, sweeps).reshape(cells.shape)


def _by_driver(cells: DataFrame, targets: dict, keep: float, sweeps: int) -> DataFrame:
    """The cells with their share kept, by one process."""
    rows = sorted(cells.collect(), key=lambda r: [(r[m] is not None, r[m] or "") for m in MARGINS])
    codes, sizes, named = [], [], []
    for m in MARGINS:
        given = targets.get(m)
        own = [r[m] if not given or (r[m] in given and r[m] != OTHER) else None for r in rows]
        place = {c: i for i, c in enumerate(dict.fromkeys(own))}
        codes.append(np.array([place[c] for c in own], dtype=int))
        named.append(list(place))
        sizes.append(len(place))
    both, at = np.unique(np.array(codes).reshape(len(MARGINS), -1), axis=1, return_inverse=True)
    at = at.reshape(-1)
    total = np.bincount(at, np.array([r["t"] for r in rows], dtype=float), both.shape[1]).astype(float)
    wanted = []
    for m, code, n, own in zip(MARGINS, both, sizes, named, strict=True):
        sums = np.bincount(code, total, n).astype(float)
        given = targets.get(m)
        shares = np.array([given.get(OTHER if c is None else c, 0.0) for c in own]) if given else np.power(sums, SMOOTH)
        wanted.append(filled(sums, shares, keep * total.sum()))
    fit = raked(total, list(both), wanted, sweeps)
    p = np.divide(fit, total, out=np.ones_like(fit), where=total > 0)[at]
    out = [(*[r[m] for m in MARGINS], float(x)) for r, x in zip(rows, p, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, p double")


def _filled(sums: DataFrame, total: float) -> DataFrame:
    """``filled`` over the rows (has, share) of a margin: each gets ``level`` times its share, or all it has."""
    level, at = 0.0, -1
    while True:  # each round fills at least one more class; what is full stays so
        full = (F.col("has") <= level * F.col("share")) | (F.col("share") <= 0) | (F.col("has") <= 0)
        r = sums.agg(
            F.sum(F.when(full & (F.col("share") > 0), F.col("has")).otherwise(0.0)).alias("full"),
            F.sum(F.when(~full, F.col("share")).otherwise(0.0)).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if not r["free"]:
            level = float("inf")
        if r["n"] == at or not r["free"]:
            break
        level, at = max(level, (total - r["full"]) / r["free"]), r["n"]
    # with no class left to take more, all that have a share give all they have
    target = F.when(F.col("share") <= 0, 0.0).otherwise(F.col("has") if level == float("inf") else F.least("has", F.col("share") * level))
    return sums.withColumn("target", target)


def _by_joins(cells: DataFrame, targets: dict, keep: float, sweeps: int) -> DataFrame:
    """The cells with their share kept, a class being a code that is never null: "" for null and what has no name."""
    spark = cells.sparkSession
    d = cells
    for m in MARGINS:
        given = targets.get(m)
        if given:
            named = spark.createDataFrame([(k,) for k in given if k != OTHER], "__k string")
            d = d.join(named, d[m] == named["__k"], "left").withColumnRenamed("__k", f"__n_{m}")
        code = F.col(f"__n_{m}" if given else m)
        d = d.withColumn(f"__{m}", F.coalesce(F.concat(F.lit("="), code), F.lit(""))).drop(f"__n_{m}")
    keys = [f"__{m}" for m in MARGINS]
    d = common.written(d, "coded")
    fit = common.written(d.groupBy(*keys).agg(F.sum("t").cast("double").alias("t")).withColumn("fit", F.col("t")), "fit")
    whole = fit.agg(F.sum("t"), F.max("t")).first()
    total, largest = whole[0] or 0.0, whole[1] or 0.0
    wanted = []
    for m, k in zip(MARGINS, keys, strict=True):
        sums, given = fit.groupBy(k).agg(F.sum("t").alias("has")), targets.get(m)
        if given:
            shares = [("" if c == OTHER else f"={c}", float(x)) for c, x in given.items()]
            sums = sums.join(spark.createDataFrame(shares, f"{k} string, share double"), k, "left").na.fill(0.0, ["share"])
        else:
            sums = sums.withColumn("share", F.pow("has", F.lit(SMOOTH)))
        sums = common.written(sums, "margin")
        wanted.append(common.written(_filled(sums, keep * total).select(k, "target"), "target"))
    for _ in range(sweeps):
        now = fit.withColumn("before", F.col("fit"))
        for k, target in zip(keys, wanted, strict=True):
            factor = now.groupBy(k).agg(F.sum("fit").alias("s")).join(target, k)
            factor = factor.select(k, F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(1.0).alias("factor"))
            now = now.join(factor, k).withColumn("fit", F.least(F.col("fit") * F.col("factor"), "t")).drop("factor")
            now = common.written(now, "fit")
        moved = now.agg(F.max(F.abs(F.col("fit") - F.col("before")))).first()[0] or 0.0
        fit = now.drop("before")
        if moved <= TOLERANCE * max(largest, 1):
            break
    else:
        warnings.warn(f"raking still moved after {sweeps} sweeps", stacklevel=2)
    p = fit.select(*keys, F.when(F.col("t") > 0, F.col("fit") / F.col("t")).otherwise(1.0).alias("p"))
    return common.written(d.join(p, keys).select(*MARGINS, "p"), "kept")


def fitted(
    measured: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, sweeps: int | None = None
) -> tuple[DataFrame, bool]:
    """Each (source, lang, topic), as strings, with the share ``p`` of its tokens that the fit keeps; whether it is small.

    ``measured``: rows of source, lang, topic and n_tokens.
    """
    cells = measured.groupBy(*[F.col(m).cast("string").alias(m) for m in MARGINS]).agg(F.sum("n_tokens").alias("t"))
    cells = common.written(cells, "cells")
    n = cells.agg(F.count("*"), F.sum(sum(F.coalesce(F.octet_length(m), F.lit(0)).cast("long") for m in MARGINS))).first()
    small = n[0] <= CELLS and (n[1] or 0) <= BYTES
    return (_by_driver if small else _by_joins)(cells, targets or {}, keep, sweeps or SWEEPS), small


def measured(documents: DataFrame, keep_text: bool = True) -> DataFrame:
    """``documents`` with n_tokens and topic, from a table in the shared folder."""
    added = {"n_tokens", "topic", "weight", "probability", "selected", "__v"}
    d = topics.measured(documents.select(*[c for c in documents.columns if c.lower() not in added]), keep_text)
    d = common.written(d, "measured")
    return topics.with_topic(d, topics.fitted(d))


def mixed(
    documents: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = KEEP,
    seed: int = SEED,
    keep_text: bool = True,
) -> DataFrame:
    """``documents`` with n_tokens, topic, weight (over the plain share kept), probability and selected."""
    d = measured(documents, keep_text)
    cells, small = fitted(d, targets, keep)
    lookup = cells.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], (F.col("p") / keep).alias("weight"), F.least("p", F.lit(1.0)).alias("probability"))
    same = [F.col(m).cast("string").eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    d = d.join(F.broadcast(lookup) if small else lookup, same, "left").drop(*[f"__{m}" for m in MARGINS])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return d.withColumn("selected", draw < F.col("probability"))


def sampled(documents: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents that the mix picks, their columns as they were."""
    return mixed(documents, targets, keep).where("selected").select(*documents.columns)
