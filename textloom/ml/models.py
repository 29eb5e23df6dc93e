"""Models on Spark ML and on bounded samples: word vectors, latent spaces, clusters, classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import workspace
from textloom.functions import vectors as V
from textloom.ml import training


def word_vectors(sentences: DataFrame, words: str, size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 1, seed: int = 1) -> DataFrame:
    """(word, vec) by skip-gram with hierarchical softmax."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, inputCol=words, outputCol="v").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def negative_sampling(pairs: DataFrame, counts: np.ndarray, size: int = 50, epochs: int = 3, rate: float = 0.025, negatives: int = 5, seed: int = 1) -> np.ndarray:
    """Vectors of word ordinals from pairs (word, context) by skip-gram with negative sampling; see ``ml.training``."""
    rows = pairs.select("word", F.array(F.col("context").cast("int")).alias("context"))
    return training.train_words(rows, counts, size, "skip", epochs, rate, negatives, seed=seed).inner


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """Text rows of a word and its numbers, separated by spaces."""
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def word_classes(vectors: DataFrame, key: str, vector: str, classes: int, seed: int = 1) -> DataFrame:
    """(key, class): k-means on the vectors."""
    rows = vectors.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    return KMeans(k=classes, seed=seed, featuresCol="v", predictionCol="class").fit(rows).transform(rows).select(key, "class")


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, pc): the first components; a component's largest loading is positive."""
    rows = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(rows)
    signs = np.sign(model.pc.toArray()[np.abs(model.pc.toArray()).argmax(axis=0), range(k)])
    pc = vector_to_array("pc")
    return model.transform(rows).select(key, F.array(*[F.get(pc, F.lit(i)) * float(s) for i, s in enumerate(signs)]).alias("pc"))


def latent_space(vectors: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Truncated SVD of the rows: (key, latent), singular values, and the k right vectors, signs fixed.

    X'X of a bounded number of columns is summed over tasks; rows are projected where they are.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            yield pd.DataFrame({"i": range(len(g)), "g": list(g)})

    rows = vectors.select(F.col(key), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    # the tasks' matrices are added row by row in Spark; one matrix comes to the driver
    parts = rows.select("v").mapInPandas(gram, "i int, g array<double>")
    summed = parts.groupBy("i").agg(F.aggregate(F.collect_list("g"), F.array().cast("array<double>"), lambda s, v: F.when(F.size(s) == 0, v).otherwise(F.zip_with(s, v, lambda p, q: p + q))).alias("g"))
    g = np.array([r["g"] for r in summed.orderBy("i").collect()])
    if not len(g):
        return rows.select(key, F.array().cast("array<double>").alias("latent")), np.zeros(0), np.zeros((0, 0))
    values, right = np.linalg.eigh(g)
    order = np.argsort(-values)[:k]
    right = right[:, order] * np.sign(right[np.abs(right[:, order]).argmax(axis=0), order])
    singular = np.sqrt(np.maximum(values[order], 0))
    latent = F.array(*[V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in right[:, j]])) for j in range(len(order))])
    return rows.select(key, latent.alias("latent")), singular, right


def latent_sparse(vectors: DataFrame, key: str, vector: str, k: int, passes: int = 2, more: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((key, latent), right vectors) of a wide sparse matrix: randomised subspace iteration, whose passes are products by
    the tasks.  The columns of a task's product are added row by row in Spark; the columns x (k + more) sum is collected."""
    first = vectors.select(vector).first()
    width = int(first[0].size) if first else 0
    k = min(k, width)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(width, min(width, k + more))))[0] if width else np.zeros((0, 0))
    sparse = F.struct("indices", "values")
    to_parts = F.udf(lambda v: (v.indices.tolist(), v.values.tolist()) if hasattr(v, "indices") else (list(range(len(v))), list(map(float, v))), "struct<indices:array<int>,values:array<double>>")
    rows = workspace.materialise(vectors.select(key, to_parts(vector).alias("p")).select(key, "p.indices", "p.values"), "sparse")

    def product(batches: Iterator[pd.DataFrame], basis: np.ndarray) -> Iterator[pd.DataFrame]:
        out, seen = np.zeros_like(basis), np.zeros(len(basis), bool)
        for pdf in batches:
            for i, x in zip(pdf["indices"], pdf["values"], strict=True):
                if len(i):
                    out[i] += np.outer(x, x @ basis[i])
                    seen[i] = True
        at = np.flatnonzero(seen)
        if len(at):
            yield pd.DataFrame({"i": at.astype(np.int32), "g": list(out[at])})

    for _ in range(passes):
        parts = rows.select("indices", "values").mapInPandas(lambda b, basis=basis: product(b, basis), "i int, g array<double>")
        summed = parts.groupBy("i").agg(F.aggregate(F.collect_list("g"), F.array_repeat(F.lit(0.0), basis.shape[1]), lambda s, v: F.zip_with(s, v, lambda p, q: p + q)).alias("g"))
        y = np.zeros_like(basis)
        for r in summed.collect():  # a row per column of the bounded hash space
            y[r["i"]] = r["g"]
        left, _, _ = np.linalg.svd(y, full_matrices=False)
        basis = left
    right = basis[:, :k]
    if width:
        right = right * np.where(right[np.abs(right).argmax(axis=0), range(k)] < 0, -1.0, 1.0)

    @F.pandas_udf("array<double>")
    def project_(p: pd.DataFrame) -> pd.Series:
        return pd.Series([(np.asarray(x) @ right[np.asarray(i, int)]).tolist() if len(i) else [0.0] * k for i, x in zip(p["indices"], p["values"], strict=True)])

    return rows.select(key, project_(sparse).alias("latent")), right


def hashed_topics(docs: DataFrame, key: str, words: str, features: int = 10_000, clusters: int = 10, latent: int = 100, seed: int = 1) -> DataFrame:
    """(key, cluster): hashed counts, idf, latent directions, unit length, k-means."""
    tf = HashingTF(numFeatures=features, inputCol=words, outputCol="tf").transform(docs)
    idf = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    space, _ = latent_sparse(idf.select(key, "idf"), key, "idf", latent, seed=seed)
    x = Normalizer(inputCol="v", outputCol="x").transform(space.select(key, array_to_vector("latent").alias("v")))
    model = KMeans(k=clusters, seed=seed, featuresCol="x", predictionCol="cluster").fit(x)
    return model.transform(x).select(key, "cluster")


def _labelled(df: DataFrame, label: str, vector: str) -> DataFrame:
    return df.select((F.col(label) > 0).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))


def train_svm(df: DataFrame, label: str, vector: str, c: float = 0.01) -> LinearSVCModel:
    """Linear classifier of labels 1 and -1."""
    return LinearSVC(regParam=c, maxIter=50).fit(_labelled(df, label, vector))


def cross_validate(df: DataFrame, label: str, vector: str, cs: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0), folds: int = 5, seed: int = 1) -> tuple[LinearSVCModel, dict[float, float]]:
    """(model of the best c, accuracy of each c over the folds)."""
    svm = LinearSVC(maxIter=50)
    grid = ParamGridBuilder().addGrid(svm.regParam, list(cs)).build()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = workspace.materialise(_labelled(df, label, vector), "folds")
    found = CrossValidator(estimator=svm, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed).fit(rows)
    return found.bestModel, dict(zip(cs, (round(float(x), 6) for x in found.avgMetrics), strict=True))


def predict_one(model: LinearSVCModel, vector: list[float]) -> int:
    """1 or -1 for one vector, on the driver."""
    return 1 if float(np.dot(model.coefficients.toArray(), np.asarray(vector, float)) + model.intercept) > 0 else -1


def paraphrase_search(query: list[str], stored: DataFrame, key: str, words: str, weights: DataFrame, training_pairs: DataFrame, latent: int = 50, c: float = 0.01) -> DataFrame:
    """(key, score, same): whether stored sentences say what the query says.

    The query joins the sentences as one more; the latent space is fitted on all sentences together, the classifier on
    the labelled pairs (key, label, words1, words2) in that space, and each stored sentence is judged beside the query.
    """
    from textloom.ml import weighting

    told = training_pairs.select(F.concat(F.lit("t"), F.col(key).cast("string")).alias("_tx_p"), "label", "words1", "words2")
    asked = stored.select(F.concat(F.lit("s"), F.col(key).cast("string")).alias("_tx_p"), F.lit(0).alias("label"), F.array(*[F.lit(w) for w in query]).cast("array<string>").alias("words1"), F.col(words).alias("words2"))
    f = workspace.materialise(weighting.paraphrase_features(told.unionByName(asked), "_tx_p", weights, latent), "paraphrase")
    model = train_svm(f.filter("label <> 0"), "label", "features", c)
    scored = f.filter("label = 0").select(F.substring("_tx_p", 2, 1 << 30).alias("k"), svm_score(model, F.col("features")).alias("score"))
    scored = scored.withColumnRenamed("k", "_tx_k")
    return stored.select(key).join(scored, F.col(key).cast("string") == F.col("_tx_k")).select(key, "score", (F.col("score") > 0).alias("same"))


def svm_score(model: LinearSVCModel, vector: Column) -> Column:
    """Decision value as a column expression."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients.toArray()])
    return V.dot(vector, w) + F.lit(float(model.intercept))


def orthonormal_basis(rows: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Gram-Schmidt; its length is the rank."""
    basis: list[np.ndarray] = []
    for v in np.asarray(rows, float):
        for b in basis:
            v = v - (v @ b) * b
        n = np.linalg.norm(v)
        if n > tolerance:
            basis.append(v / n)
    return np.array(basis)


def project(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return basis.T @ (basis @ v) if len(basis) else np.zeros_like(v)


def embed_plane(x: np.ndarray, perplexity: float = 20.0, steps: int = 300, rate: float | None = None, seed: int = 1) -> np.ndarray:
    """t-SNE in two dimensions of a bounded sample (at most 3,000 rows), exact gradients."""
    x = np.asarray(x, float)
    n = len(x)
    if n > 3000:
        raise ValueError("a sample of at most 3,000 rows")
    rate = max(n / 12, 5.0) if rate is None else rate
    d2 = np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        di = np.delete(d2[i], i)
        for _ in range(60):
            e = np.exp(-(di - di.min()) * beta)
            q = e / e.sum()
            h = -(q * np.log(np.maximum(q, 1e-12))).sum()
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-2, (n, 2))
    v = np.zeros_like(y)
    for t in range(steps):
        num = 1 / (1 + np.maximum(0, (y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), 1e-12)
        pq = (p * (4 if t < 100 else 1) - q) * num
        v = (0.5 if t < 100 else 0.8) * v - rate * 4 * (np.diag(pq.sum(1)) - pq) @ y
        y = y + v
        y -= y.mean(0)
    return y
