"""Mixed-model equations with several large random terms, solved on the cluster.

No random level reaches the driver. Every level is one row that holds its products with the fixed columns and with itself;
products of levels of different terms are the links between rows. The equations of all levels, for all fixed
columns, the response and a few random vectors at once, are solved by conjugate gradients, preconditioned by the
exact inverse of each level's own block: a step is one join of the links with the direction, one sum per level and a few
sums per task for the driver. Each step is a written table, so a lost executor costs one step.

The variances need the traces of the terms' blocks of the inverse. What a level's own block contributes is summed exactly, the
fixed columns' part is exact too, and the rest is estimated by the random vectors as the difference from the
blocks' own estimate, so its error is that of the links alone. The log determinant comes from the coefficients of the
conjugate gradients (Lanczos quadrature), with the standard error over the random vectors. The vectors are the same
in every round, and every round starts from the solution before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written
from .linear import DesignColumn
from .mixed import RandomTerm, Round, _part, _prefixes

#: Relative size of the residual at which a solution is good enough.
TOLERANCE = 1e-8
MAX_STEPS = 500
_STATE = "node long, term int, a array<double>, x array<double>, r array<double>, d array<double>, q array<double>, dots array<double>"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]
_LIST = pa.list_(pa.float64())


def _term(name: Column, random: Sequence[RandomTerm]) -> Column:
    return F.coalesce(*[F.when(_part(name, t).isNotNull(), F.lit(k)) for k, t in enumerate(random)], F.lit(None).cast("int"))


def _level(name: Column, random: Sequence[RandomTerm]) -> Column:
    return F.coalesce(*[F.when(name.startswith(p), name.substr(F.lit(len(p) + 1), F.length(name))) for t in random for p in _prefixes(t)])


def signs(node: np.ndarray, parts: int, vectors: int) -> np.ndarray:
    """(levels, parts, vectors) of +1 and -1, from a scrambling of the level's number."""
    x = node.astype(np.uint64)[:, None, None] + (np.arange(parts, dtype=np.uint64)[:, None] * np.uint64(1_000_003)
                                                + np.arange(1, vectors + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


class CrossedSystem:
    def __init__(self, prods: DataFrame, fixed: Sequence[DesignColumn], random: Sequence[RandomTerm], probes: int = 16):
        self.spark, self.random, self.p, self.k = prods.sparkSession, list(random), len(fixed), probes
        self.dims = [1 + len(t.slopes) for t in random]
        self.d, self.width = max(self.dims), self.p + 1 + max(self.dims)
        p, i, j = self.p, F.col("i"), F.col("j")
        both = prods.select("i", "j", "v").union(prods.where("i <> j").select(j.alias("i"), i.alias("j"), "v"))
        order = {**{f"fixed {c.name}": k for k, c in enumerate(fixed)}, "response": p}
        own = both.where(i.isin(list(order)) & j.isin(list(order))).collect()  # (fixed columns + 1)^2 numbers
        full = np.zeros((p + 1, p + 1))
        for x in own:
            full[order[x["i"]], order[x["j"]]] = x["v"]
        self.c_ww, self.r_w, self.yy = full[:p, :p], full[:p, p], float(full[p, p])
        self.n = int(round(full[0, 0]))

        known = F.create_map(*[F.lit(x) for name, c in order.items() for x in (name, c)])
        part = lambda c: F.coalesce(*[_part(c, t) for t in random])
        named = both.select(
            _term(i, random).alias("term"), _level(i, random).alias("level"), part(i).alias("k"), _term(j, random).alias("term2"),
            _level(j, random).alias("level2"), part(j).alias("k2"), F.try_element_at(known, j).alias("c"), "v").where("term IS NOT NULL")
        node, other = F.xxhash64("term", "level"), F.xxhash64("term2", "level2")
        same = (F.col("term") == F.col("term2")) & (F.col("level") == F.col("level2"))
        rows = (named.where(F.col("c").isNotNull() | same)
                .select(node.alias("node"), "term", "level", F.struct("k", F.coalesce("c", F.lit(p + 1) + F.col("k2")).alias("c"), "v").alias("e"))
                .groupBy("node", "term", "level").agg(F.collect_list("e").alias("e")))  # at most parts x (columns + parts) entries
        self.nodes = written(rows.mapInArrow(self._dense(), "node long, term int, level string, a array<double>"), "levels")
        self.links = written(named.where(F.col("term2").isNotNull() & ~same).select(
            node.alias("node"), "k", other.alias("other"), "k2", "v"), "links")
        counts = {r["term"]: r["n"] for r in self.nodes.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("node").alias("u")).collect()}
        if self.nodes.select("node").distinct().count() != sum(counts.values()):
            raise RuntimeError("two levels share a number")
        self.counts = [counts.get(k, 0) for k in range(len(random))]
        self.state: DataFrame | None = None
        self.precision = TOLERANCE  # the fit asks for less in its first rounds
        self.steps = 0

    # ---- kernels ----------------------------------------------------------------------------

    def _dense(self):
        d, width = self.d, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(3)
                k, c, v = lists.flatten().flatten()
                a = np.zeros((b.num_rows, d, width))
                sizes = np.diff(lists.offsets.to_numpy())
                a[np.repeat(np.arange(b.num_rows), sizes), k.to_numpy(), c.to_numpy()] = v.to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(a)], ["node", "term", "level", "a"])
        return run

    def _padded(self, s2: float, mats: Sequence[np.ndarray]) -> np.ndarray:
        """Per term what is added to a level's own block; parts that a term lacks get 1 on the diagonal."""
        out = np.array([np.eye(self.d) for _ in mats])
        for k, (g, d) in enumerate(zip(mats, self.dims)):
            out[k, :d, :d] = s2 * np.linalg.inv(g)
        return out

    def _run(self, df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], tuple[dict[str, np.ndarray], np.ndarray | None]], name: str) -> tuple[DataFrame, np.ndarray]:
        """Write the states that a kernel makes of states; sums it returns are added up over all tasks."""
        d, r = self.d, self.r

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                given = _arrays(b, d, r)
                made, sums = kernel(given)
                if sums is not None:
                    total = sums if total is None else total + sums
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *[_lists(made[c]) if c in made else pa.nulls(n, _LIST) for c in _NAMES[2:]]], _NAMES)
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *[pa.nulls(1, _LIST)] * 5, pa.array([total.ravel().tolist()], _LIST)], _NAMES)

        table = written(df.mapInArrow(run, _STATE), name)
        sums = [np.array(x["dots"]) for x in table.where("node IS NULL").select("dots").collect()]  # one row per task
        return table.where("node IS NOT NULL"), np.sum(sums, axis=0)

    def _across(self, state: DataFrame, column: str) -> DataFrame:
        """States with ``q``: what the links make of a column, summed per level."""
        d, r = self.d, self.r
        met = self.links.join(state.select(F.col("node").alias("other"), F.col(column).alias("_d")), "other")
        sums = [F.sum(F.when(F.col("k") == k, F.col("v") * F.get("_d", F.col("k2") * r + c)) if d > 1 else F.col("v") * F.get("_d", F.lit(c)))
                for k in range(d) for c in range(r)]
        got = met.groupBy("node").agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias("q"))
        return (state.drop("q", "dots").join(got, "node", "left")
                .select("node", "term", "a", "x", "r", "d", "q", F.lit(None).cast("array<double>").alias("dots")))

    def _blocks(self, pen: np.ndarray) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        first = self.p + 1
        return lambda s: s["a"][:, :, first:] + pen[s["term"]]

    def _right(self, probe: Callable[[dict[str, np.ndarray]], np.ndarray]) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        first = self.p + 1
        return lambda s: np.concatenate([s["a"][:, :, :first], probe(s)], axis=2)

    def _probes(self) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        """The random vectors: 0 at parts that a term lacks. (Kernels travel to the tasks, so they hold numbers only.)"""
        dims, d, k = np.array(self.dims), self.d, self.k

        def probes(s):
            return signs(s["node"], d, k) * (np.arange(d)[None, :] < dims[s["term"]][:, None])[:, :, None]
        return probes

    # ---- conjugate gradients ------------------------------------------------------------------

    def _solve(self, pen: np.ndarray, right: Callable[[dict[str, np.ndarray]], np.ndarray], start: DataFrame | None) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
        """Solve for all right-hand sides; also the step coefficients of every step."""
        blocks, r, fresh = self._blocks(pen), self.r, start is None

        def begin(s):
            own, b = blocks(s), right(s)
            if fresh:
                x, rest = np.zeros_like(b), b
            else:
                x = s["x"]
                rest = b - own @ x - s["q"]
            z, zb = np.linalg.solve(own, rest), np.linalg.solve(own, b)
            return {"a": s["a"], "x": x, "r": rest, "d": z}, np.array([(rest * z).sum((0, 1)), (b * zb).sum((0, 1))])

        def step(s):
            own = blocks(s)
            q = own @ s["d"] + s["q"]
            mq = np.linalg.solve(own, q)
            return {**{c: s[c] for c in ("a", "x", "r", "d")}, "q": q}, np.array(
                [(s["d"] * q).sum((0, 1)), (s["r"] * mq).sum((0, 1)), (q * mq).sum((0, 1)),
                 (s["r"] * np.linalg.solve(own, s["r"])).sum((0, 1))])

        empty = F.lit(None).cast("array<double>")
        first = (self.nodes.select("node", "term", "a", *[empty.alias(c) for c in _NAMES[3:]]) if start is None
                 else self._across(start, "x"))
        state, sums = self._run(first, begin, "cg-start")
        rz, scale = sums.reshape(2, r)
        coefficients = []
        for _ in range(MAX_STEPS):
            live = rz > self.precision ** 2 * scale
            if not live.any():
                return state, coefficients
            table, sums = self._run(self._across(state, "d"), step, "cg-step")
            self.steps += 1
            dq, rq, qq, rz = sums.reshape(4, r)  # rz anew, so that rounding does not add up over the steps
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(live, rz / dq, 0.0)
                new = np.where(live, np.maximum(rz - 2 * alpha * rq + alpha ** 2 * qq, 0.0), rz)
                beta = np.where(live, new / rz, 0.0)
            coefficients.append((alpha, beta))
            rz = new
            state = self._moved(table, blocks, alpha, beta)
        raise RuntimeError(f"conjugate gradients did not settle in {MAX_STEPS} steps")

    def _moved(self, table: DataFrame, blocks: Callable[[dict[str, np.ndarray]], np.ndarray], alpha: np.ndarray, beta: np.ndarray) -> DataFrame:
        d, r = self.d, self.r

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = _arrays(b, d, r)
                rest = s["r"] - alpha * s["q"]
                made = {"a": s["a"], "x": s["x"] + alpha * s["d"], "r": rest, "d": np.linalg.solve(blocks(s), rest) + beta * s["d"]}
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *[_lists(made[c]) if c in made else pa.nulls(b.num_rows, _LIST) for c in _NAMES[2:]]], _NAMES)
        return table.mapInArrow(run, _STATE)

    @property
    def r(self) -> int:
        """Right-hand sides: fixed columns, response, random vectors."""
        return self.p + 1 + self.k

    # ---- rounds -------------------------------------------------------------------------------

    def round(self, s2: float, mats: list[np.ndarray], last: bool = False) -> Round:
        p, d, k, terms = self.p, self.d, self.k, len(self.random)
        pen = self._padded(s2, mats)
        blocks, probes, dims = self._blocks(pen), self._probes(), np.array(self.dims)
        state, _ = self._solve(pen, self._right(self._probes()), self.state)
        shapes = [(p + 1, self.r), (terms, d, d, p + 1, p + 1), (terms, k, d, d), (terms, d, d)]

        def moments(s):
            own, z = blocks(s), probes(s)
            x, f, m = s["x"], s["a"][:, :, :p + 1], np.linalg.inv(own)
            used = np.arange(d)[None, :] < dims[s["term"]][:, None]
            m = m * used[:, :, None] * used[:, None, :]
            out = [np.einsum("nif,nir->fr", f, x), np.zeros(shapes[1]), np.zeros(shapes[2]), np.zeros(shapes[3])]
            for t in range(terms):
                at = s["term"] == t
                out[1][t] = np.einsum("nia,njb->ijab", x[at][:, :, :p + 1], x[at][:, :, :p + 1])
                out[2][t] = np.einsum("nik,njk->kij", z[at], x[at][:, :, p + 1:] - m[at] @ z[at])
                out[3][t] = m[at].sum(axis=0)
            return {"a": s["a"], "x": x}, np.concatenate([o.ravel() for o in out])

        self.state, sums = self._run(state, moments, "cg-solution")
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        wx, gram, probed, exact = (v.reshape(s) for v, s in zip(np.split(sums, cuts), shapes))
        schur = self.c_ww - wx[:p, :p]
        inverse = np.linalg.inv((schur + schur.T) / 2)
        beta = inverse @ (self.r_w - wx[:p, p])
        coef = np.append(-beta, 1.0)
        second = []
        for t, dim in enumerate(self.dims):
            uu = np.einsum("a,ijab,b->ij", coef, gram[t], coef)
            around = exact[t] + probed[t].mean(axis=0) + np.einsum("ab,ijab->ij", inverse, gram[t][:, :, :p, :p])
            out = (uu + s2 * (around + around.T) / 2)[:dim, :dim] / self.counts[t]
            second.append(out)
        explained = float(beta @ self.r_w + wx[p, p] - wx[p, :p] @ beta)
        logdet, error = 0.0, 0.0
        if last:
            self.beta = beta
            inner, error = self.logdet(pen)
            logdet = inner + float(np.linalg.slogdet(schur)[1])
        return Round(beta, inverse, second, explained, logdet, error)

    def logdet(self, pen: np.ndarray) -> tuple[float, float]:
        """Log determinant of the levels' equations and its standard error."""
        blocks, probes, first = self._blocks(pen), self._probes(), self.p + 1

        def scaled(s):
            z = probes(s)
            return np.concatenate([np.zeros((*z.shape[:2], first)), np.linalg.cholesky(blocks(s)) @ z], axis=2)

        def sizes(s):
            return {}, np.array([np.linalg.slogdet(blocks(s))[1].sum()])

        empty = F.lit(None).cast("array<double>")
        _, own = self._run(self.nodes.select("node", "term", "a", *[empty.alias(c) for c in _NAMES[3:]]), sizes, "cg-sizes")
        _, steps = self._solve(pen, scaled, None)
        n = sum(c * d for c, d in zip(self.counts, self.dims))
        found = []
        for c in range(first, self.r):
            alpha = [a[c] for a, _ in steps if a[c] > 0]
            beta = [b[c] for a, b in steps if a[c] > 0]
            t = np.diag([1 / a + (beta[i - 1] / alpha[i - 1] if i else 0.0) for i, a in enumerate(alpha)])
            for i in range(len(alpha) - 1):
                t[i, i + 1] = t[i + 1, i] = np.sqrt(beta[i]) / alpha[i]
            w, v = np.linalg.eigh(t)
            found.append(n * float((v[0] ** 2 * np.log(np.maximum(w, 1e-300))).sum()))
        return float(own[0]) + float(np.mean(found)), float(np.std(found, ddof=1) / np.sqrt(len(found)))

    def n_effects(self) -> list[int]:
        return self.counts

    def levels(self, spark: SparkSession) -> dict[str, DataFrame]:
        coef, first, r, d = np.append(-self.beta, 1.0), self.p + 1, self.r, self.d
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _values(b.column(2)).reshape(b.num_rows, d, r)[:, :, :first] @ coef
                term = b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([u[:dims[t]].tolist() for u, t in zip(x, term)], _LIST)], ["node", "term", "u"])

        effects = self.state.select("node", "term", "x").mapInArrow(run, "node long, term int, u array<double>")
        table = written(effects.join(self.nodes.select("node", "level"), "node"), "effects")
        none = F.lit(None).cast("array<double>")
        return {t.group: table.where(F.col("term") == k).select("level", "u", none.alias("pev"), none.alias("cov"))
                for k, t in enumerate(self.random)}


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _arrays(b: pa.RecordBatch, d: int, r: int) -> dict[str, np.ndarray]:
    """Columns of a batch of states as arrays (levels, parts, columns); missing columns are left out, a missing q is 0."""
    n = b.num_rows
    out = {"node": b.column(0).to_numpy(), "term": b.column(1).to_numpy(), "a": _values(b.column(2)).reshape(n, d, -1)}
    for name, column in zip(("x", "r", "d"), b.columns[3:6]):
        if column.null_count < n:
            out[name] = _values(column).reshape(n, d, r)
    out["q"] = np.zeros((n, d, r))
    held = b.column(6).is_valid().to_numpy(zero_copy_only=False)
    out["q"][held] = _values(b.column(6)).reshape(-1, d, r)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    n = len(x)
    flat = np.ascontiguousarray(x.reshape(n, -1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
