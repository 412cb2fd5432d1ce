"""Splits, encoders and evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.joins import BLOCK_SQL
from bindings.registry import CTES, query
from epochloom.functions import arrays
from epochloom.functions.scale import attach_row
from epochloom.operators import embedders, encoders, retrieval, splits
from epochloom.operators.embedders import FunctionEmbedder
from epochloom.plans import train


def fold_sql(key: str) -> str:
    return f"SELECT {key} AS fold, count(*) AS n_test, (SELECT count(*) FROM v_epochs) - count(*) AS n_train FROM v_epochs GROUP BY 1"


def folds(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    rows = splits.group_folds(v.epochs(spark, sf), strategy)
    return splits.require_folds(rows, strategy).select("fold", "n_test", "n_train")


@query("m01_cross_session_folds", fold_sql("session_id"))
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return folds(spark, sf, "cross_session")


@query("m02_leave_one_subject_out", fold_sql("subject_id") + " UNION ALL SELECT 'only ' || subject_id, count(*), (SELECT count(*) FROM v_epochs) - count(*) FROM v_epochs WHERE subject_id = 'sub-03' GROUP BY 1")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    """All subjects as folds, and one named holdout subject."""
    one = splits.group_folds(v.epochs(spark, sf), "loso", "sub-03").select(F.concat(F.lit("only "), "fold").alias("fold"), "n_test", "n_train")
    return folds(spark, sf, "loso").unionByName(one)


@query("m03_leave_one_stimulus_out", fold_sql("stimulus_id"))
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return folds(spark, sf, "stimulus_identity")


@query("m04_stimulus_block", f"SELECT side, count(*) AS n_epochs, count(DISTINCT label) AS n_labels FROM ({BLOCK_SQL}) JOIN v_epochs USING (epoch_id) GROUP BY 1")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    tr, te = splits.stimulus_block(v.epochs(spark, sf), (7, 8, 9))
    part = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n_epochs"), F.count_distinct("label").alias("n_labels"))
    return part(tr, "train").unionByName(part(te, "test"))


@query("m05_random_split", """
SELECT epoch_id, row_number() OVER (ORDER BY sha256('split:' || epoch_id)) > floor((SELECT count(*) FROM v_epochs) * 8e-1) AS is_test FROM v_epochs""")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_split(v.epochs(spark, sf), "epoch_id", allow=True).select("epoch_id", "is_test")


@query("m06_designated_holdout", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'validation' END AS side FROM labels""")
def m06(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "labels").withColumn("split", F.when(F.col("quality") == 1, "train").otherwise("validation"))
    tr, te = splits.designated_holdout(rows)
    return tr.select("doc_id", F.lit("train").alias("side")).unionByName(te.select("doc_id", F.lit("validation").alias("side")))


def ready(spark: SparkSession, sf: str) -> DataFrame:
    return train.with_targets(v.featured(spark, sf), v.label_vocab(spark, sf))


def weight_cells(rows: DataFrame) -> DataFrame:
    return rows.select("part", "row", F.posexplode("vec").alias("col", "w")).select("part", "row", "col", v.r6("w").alias("w"))


@query("m07_ridge_fit")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    model = encoders.RidgeEncoder(v.WIDTH, 64, 1.0).fit(ready(spark, sf))
    return weight_cells(model.to_rows(spark, "ridge"))


#: Sums of three features and two targets of the given vectors, and the ridge weights from them by cofactors.
CTES["s_small"] = """
SELECT vec_id AS epoch_id, label::VARCHAR AS grp, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3,
  embedding[4]::DOUBLE AS y1, embedding[5]::DOUBLE AS y2 FROM embeddings"""
_SUMS = ", ".join(f"sum({a} * {b}) AS {a}{b}" for a, b in (
    ("x1", "x1"), ("x1", "x2"), ("x1", "x3"), ("x2", "x2"), ("x2", "x3"), ("x3", "x3"), *[(x, y) for x in ("x1", "x2", "x3") for y in ("y1", "y2")],
))
_SOLVED = """
SELECT *, (c11 * x1{y} + c12 * x2{y} + c13 * x3{y}) / det AS w1{y}, (c12 * x1{y} + c22 * x2{y} + c23 * x3{y}) / det AS w2{y},
  (c13 * x1{y} + c23 * x2{y} + c33 * x3{y}) / det AS w3{y} FROM {source}"""


def solved_sql(source: str) -> str:
    """Weights ``w{i}y{k}`` for the ridge 1 from sums of products, by Cramer's rule."""
    sides = f"""SELECT *, a * c11 + b * c12 + c * c13 AS det FROM (SELECT *, d * f - e * e AS c11, c * e - b * f AS c12, b * e - c * d AS c13,
      a * f - c * c AS c22, b * c - a * e AS c23, a * d - b * b AS c33 FROM (
      SELECT *, x1x1 + 1 AS a, x1x2 AS b, x1x3 AS c, x2x2 + 1 AS d, x2x3 AS e, x3x3 + 1 AS f FROM ({source})))"""
    return _SOLVED.format(y="y2", source=f"({_SOLVED.format(y='y1', source=f'({sides})')})")


def small(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *at: F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in at])
    return v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("epoch_id"), F.col("label").cast("string").alias("grp"), pick(0, 1, 2).alias("x"), pick(3, 4).alias("y")
    )


@query("m07_ridge_three_features", " UNION ALL ".join(
    f"SELECT 'w' AS part, {i - 1} AS row, {k - 1} AS i, round(w{i}y{k}, 6) AS w FROM ({solved_sql(f'SELECT {_SUMS} FROM s_small')})" for i in (1, 2, 3) for k in (1, 2)))
def m07_small(spark: SparkSession, sf: str) -> DataFrame:
    """The closed form on three features."""
    rows = encoders.RidgeEncoder(3, 2, 1.0).fit(small(spark, sf)).to_rows(spark, "small")
    return rows.select("part", "row", F.posexplode("vec").alias("i", "x")).select("part", "row", "i", v.r6("x").alias("w"))


@query("m07_conjugate_ridge", " UNION ALL ".join(
    f"SELECT {i - 1} AS row, {k - 1} AS i, round(w{i}y{k}, 6) AS w FROM ({solved_sql(f'SELECT {_SUMS} FROM s_small')})" for i in (1, 2, 3) for k in (1, 2)))
def m07_conjugate(spark: SparkSession, sf: str) -> DataFrame:
    """The way of wide features, which forms no square matrix, on three."""
    w = encoders.conjugate_ridge(small(spark, sf), 3, 2, 1.0)
    cells = [(i, k, float(w[i, k])) for i in range(3) for k in range(2)]
    return spark.createDataFrame(cells, "row int, i int, x double").select("row", "i", v.r6("x").alias("w"))


def _encoded_sql(weights: str, join: str) -> str:
    y = lambda k: f"x1 * w1y{k} + x2 * w2y{k} + x3 * w3y{k}"
    return f"""SELECT epoch_id, grp, round(p / (sqrt(p * p + q * q) + 1e-8), 6) AS e1, round(q / (sqrt(p * p + q * q) + 1e-8), 6) AS e2
FROM (SELECT s.epoch_id, s.grp, {y(1).replace("x", "s.x", 1).replace(" x", " s.x")} AS p, {y(2).replace("x", "s.x", 1).replace(" x", " s.x")} AS q
  FROM s_small s JOIN ({weights}) w ON {join})"""


def unit_cells(rows: DataFrame) -> DataFrame:
    return rows.select("epoch_id", "grp", *[v.r6(F.get("emb", F.lit(i))).alias(f"e{i + 1}") for i in (0, 1)])


@query("m09_encode_three_features", _encoded_sql(solved_sql(f"SELECT {_SUMS} FROM s_small"), "true"))
def m09_small(spark: SparkSession, sf: str) -> DataFrame:
    rows = small(spark, sf)
    return unit_cells(encoders.RidgeEncoder(3, 2, 1.0).fit(rows).transform(rows))


_LEFT = ", ".join(f"t.{c} - g.{c} AS {c}" for c in (
    "x1x1", "x1x2", "x1x3", "x2x2", "x2x3", "x3x3", "x1y1", "x1y2", "x2y1", "x2y2", "x3y1", "x3y2",
))


@query("m08_held_out_three_features", _encoded_sql(
    solved_sql(f"SELECT g.grp AS fold, {_LEFT} FROM (SELECT {_SUMS} FROM s_small) t, (SELECT grp, {_SUMS} FROM s_small GROUP BY 1) g"), "w.fold = s.grp"))
def m08_small(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector by the model that leaves its label out, solved in closed form for each."""
    return unit_cells(encoders.held_out_embeddings(small(spark, sf), "grp", 3, 2, 1.0))


@query("m08_all_fold_evaluation")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out hit rates of every session and every subject fold from one pass each."""
    cfg = train.TrainConfig(width=v.WIDTH, ridge=1.0)
    ep, vocab = v.featured(spark, sf), v.label_vocab(spark, sf)
    return train.grouped_report(ep, "cross_session", vocab, cfg).unionByName(train.grouped_report(ep, "loso", vocab, cfg))


@query("m08_held_out_embeddings")
def m08_emb(spark: SparkSession, sf: str) -> DataFrame:
    rows = encoders.held_out_embeddings(ready(spark, sf), "subject_id", v.WIDTH, 64, 1.0)
    return rows.select("epoch_id", "grp", F.posexplode("emb").alias("i", "x")).select("epoch_id", "grp", "i", v.r6("x").alias("x"))


@query("m09_encode")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    rows = ready(spark, sf)
    out = encoders.RidgeEncoder(v.WIDTH, 64, 1.0).fit(rows).transform(rows)
    return out.select("epoch_id", F.posexplode("emb").alias("i", "x")).select("epoch_id", "i", v.r6("x").alias("x"))


def gauss_sql(key: str, dim: int, seed: str) -> str:
    """SQL twin of the hashed Gaussian vector."""
    u = lambda word: f"((('0x' || substr(h, ({word}) * 8 + 1, 8))::BIGINT + 5e-1) / 4294967296e0)"
    return (
        f"list_transform(range(0, {dim}), lambda i: list_extract(list_transform([sha256('{seed}:' || {key} || ':' || (i // 8))], "
        f"lambda h: sqrt(-2e0 * ln({u('(i % 8) // 2 * 2')})) * CASE WHEN i % 2 = 0 THEN cos(2e0 * pi() * {u('(i % 8) // 2 * 2 + 1')}) ELSE sin(2e0 * pi() * {u('(i % 8) // 2 * 2 + 1')}) END), 1))"
    )


CTES["n_proj"] = f"SELECT r AS row, {gauss_sql('r', 64, '0')} AS w FROM range(0, 64) t(r)"
CTES["n_raw"] = "SELECT epoch_id, i, sum(embedding[r + 1]::DOUBLE * w[i] * 2e-2) AS x FROM v_epochs, (SELECT row AS r, w FROM n_proj), range(1, 65) c(i) GROUP BY 1, 2"


@query("m10_random_projection", "SELECT epoch_id, (i - 1)::INT AS i, round(x / (sqrt(sum(x * x) OVER (PARTITION BY epoch_id)) + 1e-8), 6) AS x FROM n_raw")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    out = encoders.random_projection(spark, v.WIDTH, 64).transform(v.featured(spark, sf))
    return out.select("epoch_id", F.posexplode("emb").alias("i", "x")).select("epoch_id", "i", v.r6("x").alias("x"))


@query("m11_mlp_fit")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    model = encoders.MlpEncoder(v.WIDTH, 64, hidden=16, epochs=8, lr=0.05).fit(ready(spark, sf))
    return weight_cells(model.to_rows(spark, "mlp"))


@query("m12_retrieval_evaluation", """
SELECT subject_id, k, round(avg((gold_rank <= k)::INT), 6) AS topk FROM l_gold, (SELECT CASE WHEN count(*) <= 1 THEN 1 ELSE least(5, count(*) - 1) END AS k FROM l_vocab) GROUP BY 1, 2""")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    vocab = v.label_vocab(spark, sf)
    k = vocab.agg(retrieval.operating_k(F.count(F.lit(1))).alias("k"))
    ranks = attach_row(retrieval.gold_ranks(v.embedded(spark, sf), vocab), k)
    return ranks.groupBy("subject_id", "k").agg(v.r6(F.avg((F.col("gold_rank") <= F.col("k")).cast("int"))).alias("topk"))


@query("m13_shuffled_labels", """
SELECT a.epoch_id, b.label FROM (SELECT epoch_id, row_number() OVER (ORDER BY epoch_id) AS i FROM v_epochs) a
JOIN (SELECT label, row_number() OVER (ORDER BY sha256('1:' || epoch_id)) AS i FROM v_epochs) b USING (i)""")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.shuffled_labels(v.epochs(spark, sf), "epoch_id", "label").select("epoch_id", "label")


CTES["n_gauss"] = f"SELECT epoch_id, {gauss_sql('epoch_id', 64, 'temporal:1')} AS raw FROM v_epochs"


@query("m14_random_unit_vectors", "SELECT epoch_id, (i - 1)::INT AS i, round(raw[i] / (sqrt(list_sum(list_transform(raw, lambda x: x * x))) + 1e-8), 6) AS x FROM n_gauss, range(1, 65) r(i)")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.random_unit(v.epochs(spark, sf).select("epoch_id"), "epoch_id", 64, "temporal:1")
    return rows.select("epoch_id", F.posexplode("emb").alias("i", "x")).select("epoch_id", "i", v.r6("x").alias("x"))


@query("m15_label_prior", "SELECT subject_id, round(least(4e0 / count(DISTINCT label), 1e0), 6) AS prior FROM v_epochs GROUP BY 1")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    return v.epochs(spark, sf).groupBy("subject_id").agg(v.r6(F.least(F.lit(4.0) / F.count_distinct("label"), F.lit(1.0))).alias("prior"))


CTES["k_terms"] = """
SELECT item_id, fold, term, count(*) AS tf FROM (SELECT item_id, fold, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (
  SELECT conv_id * 100 + turn AS item_id, role AS fold, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations)) GROUP BY 1, 2, 3"""
CTES["k_fold"] = """
SELECT f.fold, t.term, sum(t.tf)::BIGINT AS tf_train, count(*) AS df_train, (SELECT count(*) FROM conversations WHERE role <> f.fold) AS n_train
FROM (SELECT DISTINCT role AS fold FROM conversations) f JOIN k_terms t ON t.fold <> f.fold GROUP BY 1, 2"""


@query("m16_fold_local_terms", """
SELECT fold, term, tf_train, df_train, round(ln((n_train + 1) / (df_train + 1)) + 1, 6) AS idf FROM k_fold QUALIFY row_number() OVER (PARTITION BY fold ORDER BY tf_train DESC, term) <= 64""")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    """Roles as folds: the terms each fold's embedder would be fitted on."""
    conv = v.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.col("role").alias("fold"), "text")
    terms = embedders.fold_terms(conv, "item_id", "text", "fold", 64)
    return terms.select("fold", "term", "tf_train", "df_train", v.r6("idf").alias("idf"))


@query("m16_fold_local_report")
def m16_report(spark: SparkSession, sf: str) -> DataFrame:
    return train.fold_local_report(v.featured(spark, sf), train.TrainConfig(width=v.WIDTH, dim=16, ridge=1.0))


@query("m17_headline_choice", """
SELECT strategy, round(top5, 6) AS top5, combined FROM (
  SELECT 'stimulus_block' AS strategy, avg((gold_rank <= 5)::INT) AS top5 FROM l_gold WHERE label IN ('class_7', 'class_8', 'class_9')) ,
  (SELECT avg((gold_rank <= 5)::INT) > 5e-1 AND (SELECT avg((gold_rank <= 5)::INT) > 5e-1 FROM l_gold WHERE label IN ('class_7', 'class_8', 'class_9')) AS combined FROM l_gold)""")
def m17(spark: SparkSession, sf: str) -> DataFrame:
    ranks = retrieval.gold_ranks(v.embedded(spark, sf), v.label_vocab(spark, sf))
    part = lambda rows, name: retrieval.hit_rates(rows, 5).select(
        F.lit(name).alias("strategy"), "top5", (F.col("top5") > 0.5).alias("gate_pass"), F.lit(None).cast("string").alias("skipped"))
    held = ranks.where(F.col("segment").isin(7, 8, 9))
    best = train.headline(part(ranks, "loso").unionByName(part(held, "stimulus_block")))
    return best.select("strategy", v.r6("top5").alias("top5"), F.col("combined_gate").alias("combined"))


@query("u01_pluggable_embedder", "SELECT surface, (i - 1)::INT AS i, round(vec[i], 6) AS x FROM l_vocab, range(1, 65) r(i)")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    """A user function as embedder: here the hash embedding written in NumPy."""
    import hashlib

    import numpy as np

    def user_embed(surface: str, dim: int) -> np.ndarray:
        raw = np.frombuffer(hashlib.sha256(surface.strip().lower().encode()).digest(), dtype=np.uint8)
        vec = (np.resize(raw, dim).astype(float) - 128.0) / 64.0
        return vec / (np.linalg.norm(vec) + 1e-8)

    vocab = retrieval.label_vocab(v.epochs(spark, sf), "label", "epoch_id", FunctionEmbedder(user_embed, 64))
    return vocab.select("surface", F.posexplode("vec").alias("i", "x")).select("surface", "i", v.r6("x").alias("x"))


@query("u02_encoder_choice")
def u02(spark: SparkSession, sf: str) -> DataFrame:
    """Both encoder kinds through the one interface: mean fit of each to its targets."""
    rows = ready(spark, sf).persist()
    part = None
    for kind, extra in (("ridge", {"ridge": 0.1}), ("mlp", {"hidden": 8, "epochs": 3, "lr": 0.05})):
        model = encoders.encoder(kind, width=v.WIDTH, dim=64, **extra).fit(rows)
        fit = model.transform(rows).agg(v.r6(F.avg(arrays.dot("emb", "y"))).alias("mean_cosine")).withColumn("kind", F.lit(kind))
        part = fit if part is None else part.unionByName(fit)
    return part


