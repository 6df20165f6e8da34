"""A trained autoencoder: the mean squared error that a narrow network leaves of a row.

Training is data-parallel.  The train rows are dealt into blocks by a hash of their vector and written
once; a step reads one block, every task adds up the gradients of its rows, Spark sums those of the
tasks, and the driver takes one Adam step.  So an epoch reads the train rows once, whatever their number, and the
driver only holds the parameters (about 4,200 numbers for 43 features).  All learning rates are
trained side by side: a row is read once for all of them.

Against the usual form for one machine, batches are large and rates are larger in turn; there is no
normalisation over batches and no dropout, as inputs are scaled and the network is small.

Defined results: a row whose vector is null, holds a null or non-finite component or has another length than
the network takes no part in training and has a null score; without any train row the network keeps its
seeded start and has no losses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from auditmill.operators import scoring
from auditmill.operators.models import apply_threshold, scale_rows
from auditmill.session import materialize, scratch_path, ship_package

HIDDEN = (32, 16, 8)
RATES = (0.02, 0.01, 0.005)
EPOCHS, BLOCKS = 12, 4
DECAY = 1e-5        # of the weights
LARGEST = 5.0       # length of a step's gradient; longer ones are shortened
PATIENCE = 5        # epochs without progress after which the rate is halved
TOGETHER = 4096     # rows multiplied at once


def sizes_of(width: int, hidden=HIDDEN) -> list[int]:
    """Units of every layer: narrowing to the code and widening again."""
    return [width, *hidden, *hidden[-2::-1], width]


def seeded(sizes: list[int], seed: int) -> np.ndarray:
    """All parameters as one row of numbers, layer by layer, weights before biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for n, m in zip(sizes, sizes[1:]):
        parts += [rng.normal(size=n * m) * np.sqrt(2.0 / n), np.zeros(m)]
    return np.concatenate(parts)


def layers_of(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def outputs(x: np.ndarray, layers) -> list[np.ndarray]:
    """What every layer gives; all but the last cut negative values off."""
    out = [x]
    for i, (weights, bias) in enumerate(layers):
        y = out[-1] @ weights + bias
        out.append(np.maximum(y, 0) if i + 1 < len(layers) else y)
    return out


def row_errors(x: np.ndarray, layers) -> np.ndarray:
    return ((outputs(x, layers)[-1] - x) ** 2).mean(axis=1)


def gradient(x: np.ndarray, flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, float]:
    """Gradient of the summed row errors, and that sum."""
    layers = layers_of(flat, sizes)
    seen = outputs(x, layers)
    left = seen[-1] - x
    back, parts = 2.0 * left / x.shape[1], []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(seen[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ layers[i][0].T) * (seen[i] > 0)
    return np.concatenate(parts), float((left ** 2).mean(axis=1).sum())


def usable(vector: Column, width: int | None = None) -> Column:
    """The vector where it can be read as numbers, else null."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole & (F.size(vector) > 0 if width is None else F.size(vector) == width), vector)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


@dataclass
class Network:
    """A trained network; ``losses`` is the mean error of the train rows in each epoch."""

    rate: float
    sizes: list[int]
    flat: np.ndarray
    losses: list[float] = field(default_factory=list)

    def rows(self):
        for layer, (weights, bias) in enumerate(layers_of(self.flat, self.sizes)):
            for unit in range(len(bias)):
                yield self.rate, layer, unit, weights[:, unit].tolist(), float(bias[unit])


NETWORK = "rate double, layer int, unit int, weights array<double>, bias double"


def to_table(spark: SparkSession, networks: list[Network]) -> DataFrame:
    """One row for each unit of each network."""
    return spark.createDataFrame([r for n in networks for r in n.rows()], NETWORK)


def from_table(table: DataFrame) -> list[Network]:
    """Networks of a parameter table, by descending rate; as many rows as they have units."""
    by_rate: dict[float, dict[int, list]] = {}
    for r in table.orderBy("layer", "unit").collect():
        by_rate.setdefault(r.rate, {}).setdefault(r.layer, []).append(r)
    out = []
    for rate, layers in sorted(by_rate.items(), reverse=True):
        parts = [np.concatenate([np.array([u.weights for u in units]).T.ravel(), [u.bias for u in units]]) for _, units in sorted(layers.items())]
        out.append(Network(rate, [len(layers[0][0].weights), *[len(u) for _, u in sorted(layers.items())]], np.concatenate(parts)))
    return out


class Adam:
    """Steps for one network; the rate is halved when epochs bring nothing."""

    def __init__(self, size: int, rate: float):
        self.first, self.second, self.n, self.rate = np.zeros(size), np.zeros(size), 0, rate
        self.best, self.idle = np.inf, 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        grad = grad * min(1.0, LARGEST / max(float(np.linalg.norm(grad)), 1e-12)) + DECAY * flat
        self.n += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad ** 2
        mean, spread = self.first / (1 - 0.9 ** self.n), self.second / (1 - 0.999 ** self.n)
        return flat - self.rate * mean / (np.sqrt(spread) + 1e-8)

    def settle(self, loss: float) -> None:
        self.idle = 0 if loss < self.best else self.idle + 1
        self.best = min(self.best, loss)
        if self.idle > PATIENCE:
            self.rate, self.idle = self.rate / 2, 0


def summed_gradients(rows: DataFrame, flats: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, int]:
    """(networks x (parameters and error)) summed over ``rows(vector)``, and the number of rows."""
    width = sizes[0]

    def run(batches):
        total, n = [np.zeros(len(f) + 1) for f in flats], 0
        for batch in batches:
            x = matrix(batch["vector"], width)
            n += len(x)
            for a in range(0, len(x), TOGETHER):
                for i, flat in enumerate(flats):
                    grad, error = gradient(x[a:a + TOGETHER], flat, sizes)
                    total[i][:-1] += grad
                    total[i][-1] += error
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.list_(pa.float64()))],
                names=["network", "n", "sums"])

    parts = rows.mapInArrow(run, "network int, n long, sums array<double>")
    added = parts.select("network", "n", F.posexplode("sums").alias("at", "v")).groupBy("network", "at").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(flats), len(flats[0]) + 1))
    out[added["network"], added["at"]] = added["v"]
    return out, int(added["n"].max()) if len(added) else 0


def fit(train: DataFrame, width: int, hidden=HIDDEN, rates=RATES, epochs: int = EPOCHS, blocks: int = BLOCKS, seed: int = 42,
        vector: str = "vector") -> list[Network]:
    """A network for each of ``rates``, from ``vector`` of ``train``."""
    spark, sizes = train.sparkSession, sizes_of(width, hidden)
    ship_package(spark)
    path = scratch_path(spark, "train-blocks")
    # one task writes parts of all blocks, so no shuffle is needed to deal the rows
    train.select(usable(F.col(vector), width).alias("vector")).filter("vector is not null").withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    stored = spark.read.schema("vector array<double>, block int").parquet(path)
    networks = [Network(rate, sizes, seeded(sizes, seed)) for rate in rates]
    ways = [Adam(len(n.flat), n.rate) for n in networks]
    for _ in range(epochs):
        errors, rows = np.zeros(len(networks)), 0
        for block in range(blocks):
            sums, n = summed_gradients(stored.filter(F.col("block") == block).select("vector"), [x.flat for x in networks], sizes)
            if not n:
                continue
            for network, way, total in zip(networks, ways, sums, strict=True):
                network.flat = way.step(network.flat, total[:-1] / n)
            errors, rows = errors + sums[:, -1], rows + n
        if rows:
            for network, way, error in zip(networks, ways, errors / rows, strict=True):
                network.losses.append(float(error))
                way.settle(float(error))
    return networks


def score_all(rows: DataFrame, networks: list[Network], vector: str = "vector") -> DataFrame:
    """Add ``scores``: the row's error under each network; null where the vector cannot be read."""
    width, every = networks[0].sizes[0], [layers_of(n.flat, n.sizes) for n in networks]
    read = rows.drop("scores", "_usable").withColumn("_usable", usable(F.col(vector), width))
    at = read.columns.index("_usable")

    def run(batches):
        for batch in batches:
            told = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, len(every)))
            x = matrix(batch.column(at).drop_null(), width)
            out[told] = np.stack([row_errors(x, layers) for layers in every], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(every)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "scores"])

    ship_package(rows.sparkSession)
    schema = T.StructType([*read.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return read.mapInArrow(run, schema).withColumn("scores", F.when(F.col("_usable").isNotNull(), F.col("scores"))).drop("_usable")


def score(rows: DataFrame, network: Network, vector: str = "vector") -> DataFrame:
    """Add ``score`` of one network."""
    return score_all(rows.drop("score"), [network], vector).withColumn("score", F.col("scores")[0]).drop("scores")


def selection(rows: DataFrame, networks: list[Network], percentiles) -> tuple[DataFrame, DataFrame]:
    """Per network the percentile of the scores with the best F1 against ``is_attack``, and the scored rows without their vector.

    ``best`` marks the first network, in the order given, with the best F1.
    """
    # without the vector, and read three times below
    scored = materialize(score_all(rows, networks).drop("vector"), "network-scores").select(
        "*", F.posexplode("scores").alias("network", "score")).drop("scores").filter("score is not null")
    table = scoring.best_f1_threshold(scored, percentiles, "score", by="network")
    first = table.agg(F.max_by("network", F.struct("f1", -F.col("network")))).scalar()
    rates = F.element_at(F.array(*[F.lit(n.rate) for n in networks]), F.col("network") + 1)
    return table.withColumns({"best": F.col("network") == first, "rate": rates}), scored


def save(path: str, scaler_row: DataFrame, network: Network, threshold: DataFrame) -> None:
    """Scaler, parameters and threshold as tables below ``path``."""
    scaler_row.write.mode("overwrite").parquet(f"{path}/scaler")
    threshold.write.mode("overwrite").parquet(f"{path}/threshold")
    to_table(scaler_row.sparkSession, [network]).coalesce(1).write.mode("overwrite").parquet(f"{path}/network")


def score_new_rows(spark: SparkSession, rows: DataFrame, path: str, columns=None) -> DataFrame:
    """Scale, score and flag rows with what ``save`` stored; ``columns`` as in the scaler."""
    scaled = scale_rows(rows, spark.read.parquet(f"{path}/scaler"), columns)
    scored = score(scaled, from_table(spark.read.parquet(f"{path}/network"))[0])
    return apply_threshold(scored, spark.read.parquet(f"{path}/threshold"), strict=False)
