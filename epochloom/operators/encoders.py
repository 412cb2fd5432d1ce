"""Encoders from epoch features to text-embedding space.

Executors reduce the data to feature-by-feature sums; the driver only ever holds
matrices of the feature width, never rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from epochloom.functions import arrays
from epochloom.functions.hashed import gaussian_vector
from epochloom.functions.scale import array_sum

#: Up to here ``X'X`` is summed whole and solved on the driver.
MAX_FEATURES = 4096
#: Lines of a wide ``X'X`` that one task holds.
LINES = 512
#: Bytes of the models of the folds that are fitted together.
FOLD_BYTES = 64 << 20
CHUNK_ROWS = 20_000


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 0))


def feature_stats(df: DataFrame, column: str = "x") -> DataFrame:
    """Mean and floored population deviation per feature position."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = array_to_vector(F.transform(F.col(column), lambda v: v.cast("double")))
    row = df.select(vec.alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    ).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"),
        F.col("s.count").alias("n"),
    )
    # the summary holds one number per feature
    return row.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("idx", "m")).select(
        "idx", F.col("m.mean").alias("mean"),
        F.greatest(
            F.sqrt(F.greatest(F.col("m.var"), F.lit(0.0)) * F.when(F.col("n") > 1, (F.col("n") - 1) / F.col("n")).otherwise(0.0)),
            F.lit(1e-6),
        ).alias("scale"),
    )


def _gram_rows(width: int, dim: int, keyed: bool):
    """Partial ``[X'X | X'Y]`` per partition (and group), one output row per matrix line."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[object, np.ndarray] = {}
        budget = max(1, (256 << 20) // (8 * width * (width + dim)))

        def flush() -> Iterator[pd.DataFrame]:
            for g, m in acc.items():
                yield pd.DataFrame({"grp": [g] * width, "row": range(width), "vec": list(m)})
            acc.clear()

        for batch in batches:
            if not len(batch):
                continue
            x, y = matrix(batch["x"]), matrix(batch["y"])
            xy = np.hstack([x, y])
            if not keyed:
                acc[None] = acc.get(None, 0.0) + x.T @ xy
                continue
            codes, names = pd.factorize(batch["grp"])
            for code, name in enumerate(names):
                pick = codes == code
                acc[name] = acc.get(name, 0.0) + x[pick].T @ xy[pick]
                if len(acc) > budget:
                    yield from flush()
        yield from flush()

    return partial


def _gram_lines(size: int):
    """As ``_gram_rows`` for one block of lines at a time; rows come in order of block and group."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, acc = None, None
        out = lambda: pd.DataFrame({"grp": [key[1]] * len(acc), "row": range(key[0] * size, key[0] * size + len(acc)), "vec": list(acc)})
        for batch in batches:
            grp = batch["grp"]
            for (blk, none, name), some in batch.groupby([batch["blk"], grp.isna(), grp.fillna("")], sort=False):
                now = (blk, None if none else name)
                x, y = matrix(some["x"]), matrix(some["y"])
                made = x[:, blk * size : (blk + 1) * size].T @ np.hstack([x, y])
                if now == key:
                    acc += made
                    continue
                if acc is not None:
                    yield out()
                key, acc = now, made
        if acc is not None:
            yield out()

    return partial


def _normal_product(shared):
    """Partial ``X'(X P)`` of a partition, and ``X'Y`` with it where ``P`` is None."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        direction, total = shared.value, None
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                made = x.T @ (matrix(batch["y"]) if direction is None else x @ direction)
                total = made if total is None else total + made
        if total is not None:
            yield pd.DataFrame({"row": range(len(total)), "vec": list(total)})

    return partial


def conjugate_ridge(df: DataFrame, width: int, dim: int, ridge: float, tolerance: float = 1e-12, most: int | None = None) -> np.ndarray:
    """``(X'X + ridge I) W = X'Y`` by conjugate gradients, all columns of ``W`` at once.

    ``X'X`` is never formed: a step is one pass that sums ``X'(X P)`` line by line. The driver holds four matrices of the
    size of ``W``. In exact arithmetic it ends within as many steps as ``X`` has independent rows or columns.
    """
    if ridge <= 0:
        raise ValueError("conjugate gradients need a positive ridge")
    rows = df.select("x", "y").persist()
    sc = df.sparkSession.sparkContext

    def product(direction: np.ndarray | None) -> np.ndarray:
        shared = sc.broadcast(direction)
        lines = array_sum(rows.mapInPandas(_normal_product(shared), "row int, vec array<double>"), ["row"], "vec", "vec")
        out = np.zeros((width, dim))
        for r in lines.collect():
            out[r["row"]] = r["vec"]
        shared.unpersist()
        return out

    try:
        residual = product(None)
        w, direction = np.zeros((width, dim)), residual.copy()
        size = (residual**2).sum(0)
        goal = tolerance**2 * np.maximum(size, 1e-300)
        for _ in range(most or 2 * width):
            open_ = size > goal
            if not open_.any():
                break
            applied = product(direction) + ridge * direction
            step = np.where(open_, size / np.maximum((direction * applied).sum(0), 1e-300), 0.0)
            w, residual = w + step * direction, residual - step * applied
            new = (residual**2).sum(0)
            direction = residual + np.where(open_, new / np.maximum(size, 1e-300), 0.0) * direction
            size = new
        return w
    finally:
        rows.unpersist()


def gram(df: DataFrame, width: int, dim: int, group: str | None = None) -> DataFrame:
    """Rows of ``[X'X | X'Y]``, overall or per group, summed by matrix line.

    ``df`` has ``x`` and ``y`` arrays. Lines are reduced apart from each other, so no
    task ever sums whole matrices. Beyond ``MAX_FEATURES`` a task holds ``LINES`` lines only: rows are copied
    for each such block of lines and dealt by it.
    """
    rows = df.select((F.col(group) if group else F.lit(None)).cast("string").alias("grp"), "x", "y")
    if width > MAX_FEATURES:
        blocks = -(-width // LINES)
        parts = max(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        copies = rows.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
            "part", F.pmod(F.xxhash64("x"), F.lit(max(1, parts // blocks)))
        )
        dealt = copies.repartition(parts, "blk", "part").sortWithinPartitions("blk", "grp")
        partial = dealt.select("grp", "x", "y", "blk").mapInPandas(_gram_lines(LINES), "grp string, row int, vec array<double>")
        return array_sum(partial, ["grp", "row"], "vec", "vec")
    partial = rows.mapInPandas(_gram_rows(width, dim, group is not None), "grp string, row int, vec array<double>")
    return array_sum(partial, ["grp", "row"], "vec", "vec")


def collect_gram(lines: DataFrame, width: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The one overall Gram matrix on the driver: ``width`` lines of ``width + dim`` numbers."""
    full = np.zeros((width, width + dim))
    for r in lines.collect():
        full[r["row"]] = r["vec"]
    return full[:, :width], full[:, width:]


def solve_ridge(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(xx + ridge * np.eye(xx.shape[0]), xy)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


@dataclass
class RidgeModel:
    """Linear map ``W``; encodes by projection and unit length."""

    weights: np.ndarray

    def transform(self, df: DataFrame, x: str = "x", out: str = "emb") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.weights)

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            w = shared.value
            for batch in batches:
                yield pd.Series(list(unit_rows(matrix(batch) @ w))) if len(batch) else pd.Series([], dtype=object)

        return df.withColumn(out, encode(F.col(x)))

    def to_rows(self, spark: SparkSession, model_id: str) -> DataFrame:
        rows = [(model_id, "w", i, [float(v) for v in line]) for i, line in enumerate(self.weights)]
        return spark.createDataFrame(rows, "model_id string, part string, row int, vec array<double>")

    @classmethod
    def from_rows(cls, rows: DataFrame) -> "RidgeModel":
        lines = {r["row"]: r["vec"] for r in rows.where("part = 'w'").toLocalIterator()}
        return cls(_stacked("w", lines))


def _stacked(part: str, lines: dict[int, list[float]]) -> np.ndarray:
    """The lines of a stored matrix in order; a line that is missing or of another width is an error."""
    if sorted(lines) != list(range(len(lines))) or len({len(v) for v in lines.values()}) > 1:
        raise ValueError(f"stored matrix {part} is incomplete")
    return np.array([lines[i] for i in range(len(lines))])


@dataclass
class RidgeEncoder:
    """``W = (X'X + ridge I)^-1 X'Y``, from one pass over the data; by conjugate gradients beyond ``MAX_FEATURES``."""

    width: int
    dim: int = 64
    ridge: float = 1.0

    def fit(self, df: DataFrame) -> RidgeModel:
        if self.ridge < 0:
            raise ValueError("ridge must be non-negative")
        if self.width > MAX_FEATURES:
            return RidgeModel(conjugate_ridge(df, self.width, self.dim, self.ridge))
        xx, xy = collect_gram(gram(df, self.width, self.dim), self.width, self.dim)
        return RidgeModel(solve_ridge(xx, xy, self.ridge))


def random_projection(spark: SparkSession, width: int, dim: int, seed: str = "0", scale: float = 0.02) -> RidgeModel:
    """Untrained chance-level encoder; its weights are drawn from hashed keys."""
    rows = spark.range(width).select(
        F.col("id").alias("row"), gaussian_vector(F.col("id"), dim, seed).alias("vec")
    ).orderBy("row").collect()
    return RidgeModel(np.array([r["vec"] for r in rows]) * scale)


def _held_out_small(xx: np.ndarray, xy: np.ndarray, ridge: float, shared):
    """Held-out predictions of one small group from the full fit and its own rows."""

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        inverse, weights = shared.value
        x, y = matrix(pdf["x"]), matrix(pdf["y"])
        h = x @ inverse @ x.T
        fitted = x @ weights
        held = np.linalg.solve(np.eye(len(x)) - h, fitted - h @ y)
        out = pdf[["epoch_id", "grp"]].copy()
        out["emb"] = list(unit_rows(held))
        return out

    return predict


def _held_out_large(width: int, ridge: float, shared):
    """Weights of one large group's fold: the overall sums less the group's own."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        xx, xy = shared.value
        own = matrix(pdf.sort_values("row")["vec"])
        w = solve_ridge(xx - own[:, :width], xy - own[:, width:], ridge)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "w": [list(w.ravel())]})

    return solve


def _apply_weights(width: int, dim: int):
    def apply(rows: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        out = rows[["epoch_id", "grp"]].copy()
        if len(rows):
            w = np.asarray(weights["w"].iloc[0]).reshape(width, dim)
            out["emb"] = list(unit_rows(matrix(rows["x"]) @ w))
        else:
            out["emb"] = []
        return out

    return apply


def held_out_embeddings(
    df: DataFrame, group: str, width: int, dim: int, ridge: float, epoch_id: str = "epoch_id"
) -> DataFrame:
    """Every epoch encoded by the model of the fold that leaves its group out.

    One Gram pass serves all folds. Groups of at most ``width`` rows use the
    leave-group-out identity on their own rows; larger ones take their own sums away
    from the overall ones, and their rows are encoded in chunks of bounded size.
    """
    if ridge <= 0:
        raise ValueError("all-fold evaluation needs a positive ridge")
    rows = df.select(F.col(epoch_id).alias("epoch_id"), F.col(group).cast("string").alias("grp"), "x", "y")
    xx, xy = collect_gram(gram(rows, width, dim), width, dim)
    inverse = np.linalg.inv(xx + ridge * np.eye(width))
    sc = df.sparkSession.sparkContext
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(sizes.where(F.col("n") <= width).select("grp"), "grp", "left_semi")
    kind = df.schema[epoch_id].dataType.simpleString()
    schema = f"epoch_id {kind}, grp string, emb array<double>"
    near = small.groupBy("grp").applyInPandas(
        _held_out_small(xx, xy, ridge, sc.broadcast((inverse, inverse @ xy))), schema
    )
    big_groups = sizes.where(F.col("n") > width)
    if big_groups.isEmpty():
        return near
    large = rows.join(big_groups, "grp", "inner")
    lines = gram(large, width, dim, "grp")
    weights = lines.groupBy("grp").applyInPandas(
        _held_out_large(width, ridge, sc.broadcast((xx, xy))), "grp string, w array<double>"
    )
    return near.unionByName(encode_by_group(large.drop("n"), weights, width, dim))


def encode_by_group(rows: DataFrame, weights: DataFrame, width: int, dim: int) -> DataFrame:
    """Rows encoded by their group's weights, a group being cut into chunks of bounded size."""
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK_ROWS)).cast("int")
    chunked = rows.select("epoch_id", "grp", "x").join(sizes, "grp", "inner").withColumn(
        "chunk", F.pmod(F.xxhash64("epoch_id"), chunks).cast("int")
    ).drop("n")
    spread = weights.join(sizes, "grp", "inner").select(
        "grp", "w", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")
    )
    kind = rows.schema["epoch_id"].dataType.simpleString()
    return chunked.groupBy("grp", "chunk").cogroup(spread.groupBy("grp", "chunk")).applyInPandas(
        _apply_weights(width, dim), f"epoch_id {kind}, grp string, emb array<double>"
    )


@dataclass
class MlpModel:
    """Standardise, one ReLU layer, one linear layer, unit length."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self) -> dict[str, np.ndarray]:
        return {
            "w1": self.w1, "b1": self.b1[None, :], "w2": self.w2, "b2": self.b2[None, :],
            "x_mean": self.mean[None, :], "x_scale": self.scale[None, :],
        }

    def to_rows(self, spark: SparkSession, model_id: str) -> DataFrame:
        rows = [
            (model_id, part, i, [float(v) for v in line])
            for part, m in self.parts().items() for i, line in enumerate(m)
        ]
        return spark.createDataFrame(rows, "model_id string, part string, row int, vec array<double>")

    @classmethod
    def from_rows(cls, rows: DataFrame) -> "MlpModel":
        got: dict[str, dict[int, list[float]]] = {}
        for r in rows.toLocalIterator():
            got.setdefault(r["part"], {})[r["row"]] = r["vec"]
        m = {k: _stacked(k, v) for k, v in got.items()}
        return cls(m["w1"], m["b1"][0], m["w2"], m["b2"][0], m["x_mean"][0], m["x_scale"][0])

    def transform(self, df: DataFrame, x: str = "x", out: str = "emb") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                hidden = np.maximum((matrix(batch) - m.mean) / m.scale @ m.w1 + m.b1, 0.0)
                yield pd.Series(list(unit_rows(hidden @ m.w2 + m.b2)))

        return df.withColumn(out, encode(F.col(x)))


def _gradients(shared):
    def grads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = shared.value
        total = [np.zeros_like(m.w1), np.zeros((1, len(m.b1))), np.zeros_like(m.w2), np.zeros((1, len(m.b2)))]
        seen = False
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            x = (matrix(batch["x"]) - m.mean) / m.scale
            z = x @ m.w1 + m.b1
            hidden = np.maximum(z, 0.0)
            g_out = (2.0 / n) * (hidden @ m.w2 + m.b2 - matrix(batch["y"]))
            g_z = (g_out @ m.w2.T) * (z > 0.0)
            for slot, g in enumerate((x.T @ g_z, g_z.sum(0, keepdims=True), hidden.T @ g_out, g_out.sum(0, keepdims=True))):
                total[slot] += g
        if seen:
            yield pd.concat([
                pd.DataFrame({"part": part, "row": range(len(g)), "vec": list(g)})
                for part, g in zip(("w1", "b1", "w2", "b2"), total)
            ])

    return grads


@dataclass
class MlpEncoder:
    """Full-batch gradient descent: every step is one job of summed partial gradients."""

    width: int
    dim: int = 64
    hidden: int = 64
    ridge: float = 1e-4
    epochs: int = 200
    lr: float = 1e-3
    seed: str = "0"

    def _start(self, spark: SparkSession, mean: np.ndarray, scale: np.ndarray) -> MlpModel:
        w1 = random_projection(spark, self.width, self.hidden, f"{self.seed}:w1", float(np.sqrt(2.0 / self.width))).weights
        w2 = random_projection(spark, self.hidden, self.dim, f"{self.seed}:w2", float(np.sqrt(2.0 / self.hidden))).weights
        return MlpModel(w1, np.zeros(self.hidden), w2, np.zeros(self.dim), mean, scale)

    def fit(self, df: DataFrame) -> MlpModel:
        if self.epochs < 1 or self.lr <= 0 or self.ridge < 0:
            raise ValueError("epochs and lr must be positive and ridge non-negative")
        rows = df.select("x", "y").persist()
        try:
            n = rows.count()
            if n == 0:
                raise ValueError("At least one epoch is required")
            stats = feature_stats(rows).orderBy("idx").collect()
            model = self._start(
                df.sparkSession, np.array([r["mean"] for r in stats]), np.array([r["scale"] for r in stats])
            )
            for _ in range(self.epochs):
                shared = df.sparkSession.sparkContext.broadcast((model, float(n)))
                partial = rows.mapInPandas(_gradients(shared), "part string, row int, vec array<double>")
                g = {"w1": {}, "b1": {}, "w2": {}, "b2": {}}
                # as many lines as the weight matrices have
                for r in array_sum(partial, ["part", "row"], "vec", "vec").collect():
                    g[r["part"]][r["row"]] = r["vec"]
                step = {k: np.array([v[i] for i in range(len(v))]) for k, v in g.items()}
                model = MlpModel(
                    model.w1 - self.lr * (step["w1"] + 2.0 * self.ridge * model.w1),
                    model.b1 - self.lr * step["b1"][0],
                    model.w2 - self.lr * (step["w2"] + 2.0 * self.ridge * model.w2),
                    model.b2 - self.lr * step["b2"][0],
                    model.mean, model.scale,
                )
                shared.unpersist()
            return model
        finally:
            rows.unpersist()


def _fold_gradients(shared):
    """Partial gradients of every fold's model over the rows outside its group."""

    def grads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, sizes = shared.value
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            every, targets, grp = matrix(batch["x"]), matrix(batch["y"]), batch["grp"].to_numpy()
            for name, m in models.items():
                use = grp != name
                if not use.any():
                    continue
                x = (every[use] - m.mean) / m.scale
                z = x @ m.w1 + m.b1
                hidden = np.maximum(z, 0.0)
                g_out = (2.0 / sizes[name]) * (hidden @ m.w2 + m.b2 - targets[use])
                g_z = (g_out @ m.w2.T) * (z > 0.0)
                made = [x.T @ g_z, g_z.sum(0, keepdims=True), hidden.T @ g_out, g_out.sum(0, keepdims=True)]
                total[name] = [a + b for a, b in zip(total[name], made)] if name in total else made
        for name, parts in total.items():
            for part, g in zip(("w1", "b1", "w2", "b2"), parts):
                yield pd.DataFrame({"fold": name, "part": part, "row": range(len(g)), "vec": list(g)})

    return grads


def _encode_own(shared):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for batch in batches:
            for name, some in batch.groupby("grp"):
                m = models[name]
                hidden = np.maximum((matrix(some["x"]) - m.mean) / m.scale @ m.w1 + m.b1, 0.0)
                yield pd.DataFrame({"epoch_id": some["epoch_id"], "grp": name, "emb": list(unit_rows(hidden @ m.w2 + m.b2))})

    return encode


def refit_embeddings(df: DataFrame, folds: DataFrame, group: str, settings: MlpEncoder, epoch_id: str = "epoch_id", fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """Every epoch of ``folds`` encoded by a model fitted on all rows outside its group.

    The models of all folds (of as many as ``fold_bytes`` hold, at very many) take each gradient step together: one pass,
    summed over (fold, part, line). Standardisation leaves each group out of the overall sums, taken around the overall mean.
    """
    if settings.epochs < 1 or settings.lr <= 0 or settings.ridge < 0:
        raise ValueError("epochs and lr must be positive and ridge non-negative")
    spark, width = df.sparkSession, settings.width
    rows = df.select(F.col(epoch_id).alias("epoch_id"), F.col(group).cast("string").alias("grp"), "x", "y").where("grp IS NOT NULL").persist()
    n = rows.count()
    if n == 0:
        raise ValueError("At least one epoch is required")
    around = np.array([r["mean"] for r in feature_stats(rows).orderBy("idx").collect()])
    middle = F.array(*[F.lit(float(v)) for v in around])
    spread = F.zip_with("x", middle, lambda a, b: a - b)
    sums = array_sum(rows.select("grp", spread.alias("d")).select("grp", F.concat("d", F.transform("d", lambda v: v * v), F.array(F.lit(1.0))).alias("s")), ["grp"], "s", "s").persist()
    whole = np.array(array_sum(sums, [], "s", "s").first()["s"])
    weights = (settings.width + 1) * settings.hidden + (settings.hidden + 1) * settings.dim + 2 * width
    cuts = max(1, -(-folds.count() * weights * 8 // fold_bytes))
    start = settings._start(spark, np.zeros(width), np.ones(width))
    kind = df.schema[epoch_id].dataType.simpleString()
    out = None
    for cut in range(cuts):
        some = folds.where(F.pmod(F.xxhash64("fold"), F.lit(cuts)) == cut)
        own = sums.join(some.select(F.col("fold").cast("string").alias("grp")), "grp", "left_semi").collect()  # as many as fold_bytes hold
        models, sizes = {}, {}
        for r in own:
            left = whole - np.array(r["s"])
            if left[-1] < 1:
                raise ValueError("At least one epoch is required")
            mean, square = left[:width] / left[-1], left[width:-1] / left[-1]
            scale = np.maximum(np.sqrt(np.maximum(square - mean**2, 0.0)), 1e-6)
            models[r["grp"]] = MlpModel(start.w1, start.b1, start.w2, start.b2, around + mean, scale)
            sizes[r["grp"]] = left[-1]
        for _ in range(settings.epochs if models else 0):
            shared = spark.sparkContext.broadcast((models, sizes))
            partial = rows.mapInPandas(_fold_gradients(shared), "fold string, part string, row int, vec array<double>")
            g: dict[tuple[str, str], dict[int, list[float]]] = {}
            for r in array_sum(partial, ["fold", "part", "row"], "vec", "vec").collect():
                g.setdefault((r["fold"], r["part"]), {})[r["row"]] = r["vec"]
            line = lambda name, part: np.array([v for _, v in sorted(g[name, part].items())])
            lr, shrink = settings.lr, 2.0 * settings.ridge
            models = {
                name: MlpModel(
                    m.w1 - lr * (line(name, "w1") + shrink * m.w1), m.b1 - lr * line(name, "b1")[0],
                    m.w2 - lr * (line(name, "w2") + shrink * m.w2), m.b2 - lr * line(name, "b2")[0], m.mean, m.scale,
                ) for name, m in models.items()
            }
            shared.unpersist()
        mine = rows.select("epoch_id", "grp", "x").where(F.pmod(F.xxhash64("grp"), F.lit(cuts)) == cut).join(
            some.select(F.col("fold").cast("string").alias("grp")), "grp", "left_semi"
        )
        part = mine.select("epoch_id", "grp", "x").mapInPandas(_encode_own(spark.sparkContext.broadcast(models)), f"epoch_id {kind}, grp string, emb array<double>")
        out = part if out is None else out.unionByName(part)
    return out


ENCODERS = {"ridge": RidgeEncoder, "mlp": MlpEncoder}


def encoder(kind: str, **settings) -> RidgeEncoder | MlpEncoder:
    if kind not in ENCODERS:
        raise ValueError("encoder kind must be ridge or mlp")
    return ENCODERS[kind](**settings)


def with_features(df: DataFrame, width: int, column: str = "eeg", out: str = "x") -> DataFrame:
    return df.withColumn(out, arrays.features(column, width))
