"""Ordinary least squares per key by a tall-skinny QR (M3, M9-M11), and models as tables of cubic pieces.

* Facts are reduced in groups of one key and one part (a year): each group leaves one triangular factor of its design with the
  response, packed in an array.  A key's factors are merged pairwise, so the work of a key grows with its parts and
  the order of the rows costs nothing.  Residual sums come from the factor's last entry, not from differences of sums.
* Models without splines have the same design for all keys: their rows go through a task sorted, batch by batch, and the keys of a
  batch of factors are solved at once, so many small keys cost no Python call each.
* A fitted spline is handed out as its cubic pieces, one per interval between knots.  Facts find their piece by the number of the cell
  (of ``CELLS`` of equal width) that their value lies in, and evaluate it by Horner's rule as Column expressions: no coefficients
  travel with the facts and no Python sees them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.operators import regression as rg
from climo.operators.regression import SPLINE_KINDS, Term
from climo.session import ship_package, stored

#: Parts that rows are dealt to by a hash of their values where the caller names none.
DEALT_PARTS = 32
CELLS = 64
_PIECE = ["term", "level", "lo", "hi", "at", "c0", "c1", "c2", "c3"]


def key_knots(rows: DataFrame, terms: Sequence[Term], keys: Sequence[str], part: str) -> DataFrame:
    """(keys, parts, _kn<j>): each key's parts and the knots of every spline term from that key's own distinct values.

    Knots are the bounds and exact quantiles of the distinct values inside them; equal ones fall together, so a key
    with few values has fewer knots and a narrower basis.  Terms, and the parts, are read in one pass.
    """
    keys = list(keys)
    splines = [(j, t) for j, t in enumerate(terms) if t.kind in SPLINE_KINDS]
    probs = {j: rg._inner_probs(t) for j, t in splines}
    wanted = sorted({p for ps in probs.values() for p in ps})
    entries = [F.struct(F.lit(-1).alias("_j"), F.col(part).cast("double").alias("_x"))]
    entries += [F.struct(F.lit(j).alias("_j"), F.col(t.col).cast("double").alias("_x")) for j, t in splines]
    values = rows.select(*keys, F.explode(F.array(*entries)).alias("_p")).select(*keys, "_p._j", "_p._x").distinct()
    low, high = F.min("_x"), F.max("_x")
    for j, t in splines:
        low = F.when(F.col("_j") == j, F.lit(float(t.lower))).otherwise(low) if t.lower is not None else low
        high = F.when(F.col("_j") == j, F.lit(float(t.upper))).otherwise(high) if t.upper is not None else high
    bounds = values.groupBy(*keys, "_j").agg(low.alias("_lo"), high.alias("_hi"), F.collect_set(F.when(F.col("_j") == -1, F.col("_x"))).alias("_parts"))
    inside = values.join(bounds.drop("_parts"), [*keys, "_j"]).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    found = rg.distinct_quantiles(inside.select(*keys, "_j", "_x"), keys, wanted or [0.5])
    found = bounds.join(found, [*keys, "_j"], "left")
    cols = [F.max(F.when(F.col("_j") == -1, F.col("_parts"))).alias("parts")]
    for j, _ in splines:
        inner = [F.col("_q")[wanted.index(p)] for p in probs[j]]
        knots = F.array_sort(F.array_distinct(F.filter(F.array("_lo", "_hi", *inner), lambda x: x.isNotNull())))
        cols.append(F.max(F.when(F.col("_j") == j, knots)).alias(f"_kn{j}"))
    return found.groupBy(*keys).agg(*cols)


def _own_terms(terms: Sequence[Term], row) -> list[Term]:
    """The terms with one key's knots; a spline of a single knot has no columns left and is dropped to none."""
    out = []
    for j, t in enumerate(terms):
        if t.kind in SPLINE_KINDS:
            knots = np.asarray(row[f"_kn{j}"], dtype=float)
            t = rg.replace_knots(t, knots) if knots.size > 1 else Term("dummies", t.col, levels=["-"])
        out.append(t)
    return out


def _pack(r: np.ndarray, width: int, upper: tuple | None = None) -> np.ndarray:
    full = np.zeros((width, width))
    full[:r.shape[0]] = r
    return full[upper or np.triu_indices(width)]


def _unpack(packed) -> np.ndarray:
    packed = np.asarray(packed, dtype=float)
    width = int((np.sqrt(8 * packed.size + 1) - 1) / 2 + 0.5)
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = packed
    return full


def merged(factors: list[np.ndarray]) -> np.ndarray:
    """One triangular factor of all stacked rows, by pairwise merging."""
    while len(factors) > 1:
        pairs = [np.linalg.qr(np.vstack(factors[i:i + 2]), mode="r") for i in range(0, len(factors) - 1, 2)]
        factors = pairs + factors[2 * len(pairs):]
    return factors[0]


def solved_all(r: np.ndarray, n: np.ndarray, to_centred: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients with their inference, a row per factor of the stack ``r`` of [design, response]; absent ones are null (NaN)."""
    width = to_centred.shape[-1]
    small = np.linalg.qr(np.concatenate([r[..., :-1] @ to_centred, r[..., -1:]], axis=-1), mode="r")
    scale = np.linalg.norm(small[..., :width], axis=1)
    absent = scale == 0
    unit = np.where(absent, 1.0, scale)
    u, s, vt = np.linalg.svd(small[:, :width, :width] / unit[:, None, :])
    kept = s > s[:, :1] * np.maximum(n, width)[:, None] * np.finfo(float).eps
    projected = np.einsum("bji,bj->bi", u, small[:, :width, width])
    inverse = np.where(kept, 1 / np.where(kept, s, 1.0), 0.0)
    beta = np.einsum("bji,bj->bi", vt, projected * inverse) / unit
    sse = small[:, width, width] ** 2 + np.sum(np.where(kept, 0.0, projected) ** 2, axis=1)
    rank = kept.sum(axis=1)
    dof = n - rank
    sigma2 = np.where(dof >= 1, sse / np.where(dof >= 1, dof, 1.0), np.nan)
    err = np.sqrt(sigma2[:, None] * np.sum((vt * inverse[:, :, None]) ** 2, axis=1)) / unit
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(err > 0, beta / err, np.nan)
    p = rg.t_two_sided_p(np.nan_to_num(t).ravel(), np.repeat(np.maximum(dof, 1.0), width)).reshape(t.shape)
    beta_raw = np.einsum("...ij,bj->bi", to_centred, np.where(absent, 0.0, beta))
    return {"n": n, "rank": rank, "sigma2": sigma2, "coef": np.where(absent, np.nan, beta), "std_err": np.where(absent, np.nan, err),
            "p_value": np.where(absent | np.isnan(t), np.nan, p), "beta_raw": beta_raw}


def solved(r: np.ndarray, n: float, terms: Sequence[Term]) -> dict:
    """Centred coefficients with their inference from the factor ``r`` of [design, response]."""
    k = r.shape[1] - 1
    means = r[0, 0] * r[0, :k] / n if terms[0].kind == "intercept" else np.zeros(k)
    row = {c: v[0] for c, v in solved_all(r[None], np.array([n]), rg.centering_transform(terms, means)).items()}

    def plain(x: np.ndarray) -> list:
        return [None if np.isnan(v) else float(v) for v in x]

    return {"n": n, "rank": int(row["rank"]), "sigma2": None if np.isnan(row["sigma2"]) else float(row["sigma2"]),
            **{c: plain(row[c]) for c in ("coef", "std_err", "p_value")}, "beta_raw": [float(x) for x in row["beta_raw"]]}


def cubic_pieces(knots: np.ndarray, values: np.ndarray, cyclic: bool) -> list[tuple]:
    """(from, to, at, c0..c3) of the spline through ``values`` at the knots: c0 + c1 u + c2 u^2 + c3 u^3 with u = x - at.

    The outer pieces have no outer bound; natural splines go on as straight lines outside the knots.
    """
    bend = rg._curvatures(knots, cyclic) @ values
    size = values.size
    out = []
    for i, h in enumerate(np.diff(knots)):
        f0, f1, m0, m1 = values[i], values[(i + 1) % size], bend[i], bend[(i + 1) % size]
        out.append([knots[i], knots[i + 1], knots[i], f0, (f1 - f0) / h - h * (2 * m0 + m1) / 6, m0 / 2, (m1 - m0) / (6 * h)])
    if not cyclic:
        _, _, at, _, slope, _, _ = out[0]
        a, b, origin, c0, c1, c2, c3 = out[-1]
        h = b - origin
        out.insert(0, [-np.inf, at, at, out[0][3], slope, 0.0, 0.0])
        out.append([b, np.inf, b, c0 + h * (c1 + h * (c2 + h * c3)), c1 + h * (2 * c2 + 3 * h * c3), 0.0, 0.0])
    out[0][0], out[-1][1] = -np.inf, np.inf
    return [tuple(float(x) for x in p) for p in out]


def _model_row(r: np.ndarray, n: float, terms: Sequence[Term]) -> dict:
    """``solved`` with the model's parts: constants of plain terms, and pieces of splines and levels."""
    row = solved(r, n, terms)
    beta = np.asarray(row["beta_raw"])
    constants, pieces = [], []
    for j, (t, sl) in enumerate(zip(terms, rg.term_slices(terms), strict=True)):
        b = beta[sl]
        constants.append(float(b[0]) if t.kind in ("intercept", "linear") else None)
        if t.kind == "dummies":
            pieces += [(j, str(level), None, None, None, float(x), 0.0, 0.0, 0.0) for level, x in zip(t.levels[1:], b, strict=True)]
        elif t.kind == "by_level":
            each = b.size // len(t.levels)
            for i, level in enumerate(t.levels):
                pieces += [(j, str(level), *p) for p in cubic_pieces(t.knots, b[i * each:(i + 1) * each], True)]
        elif t.kind in SPLINE_KINDS:
            pieces += [(j, None, *p) for p in cubic_pieces(t.knots, b, t.kind == "cc")]
    row["constants"] = constants
    row["pieces"] = [dict(zip(_PIECE, p, strict=True)) for p in pieces]
    return row


def _key_starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """The rows of a sorted batch that begin another key (its first columns)."""
    begun = np.zeros(batch.num_rows, bool)
    begun[:1] = True
    for column in batch.columns[:n_keys]:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begun[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(begun)


def _listed(values: np.ndarray) -> pa.ListArray:
    """One list per row; NaN is null."""
    offsets = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.float64(), mask=np.isnan(values).ravel()))


def _plain_parts(beta: np.ndarray, terms: Sequence[Term]) -> tuple[pa.Array, pa.Array]:
    """``constants`` and ``pieces`` of ``_model_row`` for many keys at once; ``terms`` without splines."""
    constants, levels = np.full((len(beta), len(terms)), np.nan), []
    for j, (t, sl) in enumerate(zip(terms, rg.term_slices(terms), strict=True)):
        if t.kind == "dummies":
            levels += [(j, str(level), at) for level, at in zip(t.levels[1:], range(sl.start, sl.stop), strict=True)]
        else:
            constants[:, j] = beta[:, sl.start]
    size = len(beta) * len(levels)
    nothing, zeros = pa.nulls(size, pa.float64()), pa.array(np.zeros(size))
    value = _listed(beta[:, [at for _, _, at in levels]]).flatten()
    pieces = pa.StructArray.from_arrays(
        [pa.array([j for j, _, _ in levels] * len(beta), pa.int32()), pa.array([level for _, level, _ in levels] * len(beta), pa.string()),
         nothing, nothing, nothing, value, zeros, zeros, zeros], names=_PIECE)
    return _listed(constants), pa.ListArray.from_arrays(pa.array(np.arange(len(beta) + 1, dtype=np.int32) * len(levels)), pieces)


def _plain_fit(rows: DataFrame, terms: Sequence[Term], keys: Sequence[str], out: str) -> DataFrame:
    """``ols_fit`` where no term has knots of its own: the design needs no look at a key, so a task takes its rows sorted, batch by
    batch, with one factor per key and batch, and solves the keys of a batch of factors at once."""
    k, width = len(keys), sum(t.n_raw() for t in terms) + 1
    upper = np.triu_indices(width)
    identity = np.identity(width - 1)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _key_starts(batch, k)
            pdf = batch.to_pandas()
            whole = np.column_stack([rg.design(pdf, terms), pdf["_y"].to_numpy(dtype=float)])
            packed = np.stack([_pack(np.linalg.qr(part, mode="r"), width, upper) for part in np.split(whole, starts[1:])])
            sizes = np.diff(np.r_[starts, batch.num_rows]).astype(float)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * packed.shape[1])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(starts)) for c in batch.columns[:k]), pa.array(sizes),
                                              pa.ListArray.from_arrays(offsets, pa.array(packed.ravel()))], names=[*keys, "_n", "_r"])

    def rows_of(names: list[pa.Array], factors: list[np.ndarray], sizes: list[float]) -> pa.RecordBatch:
        row = solved_all(np.stack(factors), np.array(sizes), identity)
        constants, pieces = _plain_parts(row["beta_raw"], terms)
        lists = [_listed(row[c]) for c in ("coef", "std_err", "p_value", "beta_raw")]
        sigma2 = pa.array(row["sigma2"], pa.float64(), mask=np.isnan(row["sigma2"]))
        return pa.RecordBatch.from_arrays([*names, pa.array(row["n"]), pa.array(row["rank"], pa.int32()), sigma2, *lists, constants, pieces],
                                          names=[*keys, "n", "rank", "sigma2", "coef", "std_err", "p_value", "beta_raw", "constants", "pieces"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                             # the last key of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _key_starts(batch, k)
            packed = batch.column(k + 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            square = np.zeros((batch.num_rows, width, width))
            square[:, upper[0], upper[1]] = packed
            factors = [part[0] if len(part) == 1 else merged(list(part)) for part in np.split(square, starts[1:])]
            sizes = np.add.reduceat(batch.column(k).to_numpy(), starts).tolist()
            names = [c.take(pa.array(starts)) for c in batch.columns[:k]]
            if held is not None:
                if all(a[0].as_py() == b[0].as_py() for a, b in zip(held[0], names, strict=True)):
                    factors[0], sizes[0] = merged([held[1], factors[0]]), held[2] + sizes[0]
                else:
                    yield rows_of(held[0], [held[1]], [held[2]])
            if len(starts) > 1:
                yield rows_of([c[:-1] for c in names], factors[:-1], sizes[:-1])
            held = [c[-1:] for c in names], factors[-1], sizes[-1]
        if held is not None:
            yield rows_of(held[0], [held[1]], [held[2]])

    used = rows.select(*keys, "_part", *[c for c in rows.columns if c not in (*keys, "_part")])
    factors = rg._by_key(used, [*keys, "_part"]).sortWithinPartitions(*keys).mapInArrow(factor, f"{fields}, _n double, _r array<double>")
    return rg._by_key(factors, keys).sortWithinPartitions(*keys).mapInArrow(solve, f"{fields}, {out}")


def ols_fit(df: DataFrame, y: str, terms: Sequence[Term], keys: Sequence[str] = ("station",), part: Column | None = None) -> DataFrame:
    """OLS per key over all rows: one row per key with coefficients, standard errors, p-values and the model's pieces.

    ``part`` (a number, such as the year) bounds what one task holds: the rows of one key and part.  Without it rows are dealt to
    ``DEALT_PARTS`` parts by a hash of their values.  Rows with a null in a term or the response are left out.  A column
    that no row of a key reaches (a level that doesn't occur) has null coefficients, and dependent columns share the
    solution of smallest norm (``rank`` counts the independent ones).  Lazy: nothing runs before the result is used.
    """
    ship_package(df.sparkSession)
    keys, terms = list(keys), list(terms)
    cols = sorted({c for t in terms for c in (t.col, t.by) if c})
    values = [F.col(c) for c in cols]
    dealt = F.pmod(F.xxhash64(*values, F.col(y)), F.lit(DEALT_PARTS)) if part is None else part
    rows = df.select(*keys, *values, F.col(y).cast("double").alias("_y"), dealt.cast("double").alias("_part"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*cols, "_y", "_part"]]))
    piece = "struct<term:int,level:string,lo:double,hi:double,at:double,c0:double,c1:double,c2:double,c3:double>"
    out = ("n double, rank int, sigma2 double, coef array<double>, std_err array<double>, p_value array<double>, "
           f"beta_raw array<double>, constants array<double>, pieces array<{piece}>")
    knot_cols = [f"_kn{j}" for j, t in enumerate(terms) if t.kind in SPLINE_KINDS]
    if not knot_cols:
        return _plain_fit(rows, terms, keys, out)
    shared = key_knots(rows, terms, keys, "_part")
    names = [*[f"_k{i}" for i in range(len(keys))], "_p"]
    per_part = shared.select(*keys, F.explode("parts").alias("_part"), *knot_cols).toDF(*names, *knot_cols)
    key_fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def factor(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        design = rg.design(left, _own_terms(terms, right.iloc[0]))
        r = np.linalg.qr(np.column_stack([design, left["_y"].to_numpy(dtype=float)]), mode="r")
        found = right.head(1).rename(columns=dict(zip(names, [*keys, "_part"], strict=True)))
        found["_n"], found["_r"] = float(len(left)), [_pack(r, design.shape[1] + 1)]
        return found[[*keys, "_part", "_n", "_r", *knot_cols]]

    knot_fields = "".join(f", {c} array<double>" for c in knot_cols)
    factors = rows.groupBy(*keys, "_part").cogroup(per_part.groupBy(*names)).applyInPandas(
        factor, f"{key_fields}, _part double, _n double, _r array<double>{knot_fields}")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        first = pdf.iloc[0]
        row = _model_row(merged([_unpack(x) for x in pdf["_r"]]), float(pdf["_n"].sum()), _own_terms(terms, first))
        found = pd.DataFrame({c: [first[c]] for c in [*keys, *knot_cols]})
        for c, v in row.items():
            found[c] = pd.Series([v], dtype=object) if isinstance(v, list) else v
        return found[[*keys, "n", "rank", "sigma2", "coef", "std_err", "p_value", "beta_raw", "constants", "pieces", *knot_cols]]

    return factors.groupBy(*keys).applyInPandas(solve, f"{key_fields}, {out}{knot_fields}")


def _cell(x: Column, lo: Column, hi: Column) -> Column:
    share = (x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)
    return F.greatest(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")


def predict(df: DataFrame, model: DataFrame, terms: Sequence[Term], keys: Sequence[str] = ("station",), components: bool = False,
            out_col: str = "fitted") -> DataFrame:
    """``df`` with the fitted value, and the part of each term (``comp_<term>``) with ``components``.

    The model (one row per key) is written once below the checkpoint folder, so its pieces are joined by a broadcast only if
    their file is small.  Rows whose key has no model, or with a null in a term, have null results; a level that the model
    doesn't know adds 0.
    """
    keys, terms = list(keys), list(terms)
    model = stored(model)
    splines = [j for j, t in enumerate(terms) if t.kind in SPLINE_KINDS]
    bounds = [F.col(f"_kn{j}")[0].alias(f"_lo{j}") for j in splines] + [F.element_at(f"_kn{j}", -1).alias(f"_hi{j}") for j in splines]
    consts = [F.col("constants")[j].alias(f"_const{j}") for j, t in enumerate(terms) if t.kind in ("intercept", "linear")]
    scalars = model.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *consts, *bounds, F.lit(True).alias("_known"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = df.join(scalars, reduce(lambda a, b: a & b, same), "left").drop(*[f"_k_{k}" for k in keys])
    flat = model.select(*keys, *[F.col(f"_kn{j}")[0].alias(f"_lo{j}") for j in splines],
                        *[F.element_at(f"_kn{j}", -1).alias(f"_hi{j}") for j in splines], F.explode("pieces").alias("p"))
    parts = []
    for j, t in enumerate(terms):
        name = f"_part{j}"
        parts.append(name)
        if t.kind == "intercept":
            out = out.withColumn(name, F.col(f"_const{j}"))
            continue
        if t.kind == "linear":
            out = out.withColumn(name, F.col(f"_const{j}") * F.col(t.col).cast("double"))
            continue
        table = flat.where(F.col("p.term") == j)
        level = t.col if t.kind == "dummies" else t.by if t.kind == "by_level" else None
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        on += [F.col(level).cast("string") == F.col("_level")] if level else []
        named = [F.col(k).alias(f"_k_{k}") for k in keys] + [F.col("p.level").alias("_level")]
        known = F.col("_known") & (F.col(level).isNotNull() if level else F.lit(True))
        if t.kind == "dummies":
            found = table.select(*named, F.col("p.c0").alias("_v"))
            value = F.col("_v")
        else:
            lo, hi, x = F.col(f"_lo{j}"), F.col(f"_hi{j}"), F.col(t.col).cast("double")
            if t.kind != "cr":
                x = F.when((x < lo) | (x > hi), lo + F.pmod(x - lo, F.when(hi > lo, hi - lo))).otherwise(x)
            out = out.withColumns({"_x": x, "_cell": _cell(x, lo, hi)})
            first = F.when(F.col("p.lo") == float("-inf"), F.lit(0)).otherwise(_cell(F.col("p.lo"), lo, hi))
            last = F.when(F.col("p.hi") == float("inf"), F.lit(CELLS - 1)).otherwise(_cell(F.col("p.hi"), lo, hi))
            found = table.select(*named, *[F.col(f"p.{c}").alias(f"_{c}") for c in _PIECE[2:]],
                                 F.explode(F.sequence(first, F.greatest(first, last))).alias("_in"))
            on += [F.col("_cell") == F.col("_in"), F.col("_x") >= F.col("_lo"), F.col("_x") < F.col("_hi")]
            u = F.col("_x") - F.col("_at")
            value = F.col("_c0") + u * (F.col("_c1") + u * (F.col("_c2") + u * F.col("_c3")))
            known = known & F.col("_x").isNotNull()
        extra = [c for c in found.columns] + ["_x", "_cell"]
        joined = out.join(found, reduce(lambda a, b: a & b, on), "left")
        # A spline of one knot has no pieces: its constant part is in the intercept.
        out = joined.withColumn(name, F.when(known, F.coalesce(value, F.lit(0.0)))).drop(*extra)
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    shown = [F.col(p).alias(f"comp_{t.name}") for p, t in zip(parts, terms, strict=True)] if components else []
    return out.select(*df.columns, total.alias(out_col), *shown)
