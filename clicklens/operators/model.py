"""The prior model: a few scalars plus a distributed table of weights."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions import scalar
from clicklens.functions.plan import local_rows
from clicklens.schemas import WEIGHTS

_MAPS = {"ad": "w_ad", "domain": "w_dom", "context": "w_ctx"}


@dataclass(frozen=True)
class Head:
    """The scalar part of a model. It has a fixed size, so it may live on the driver."""

    snapshot_name: str
    w0: float
    baseline_ctr: float
    global_strength: float = K.SEED_GLOBAL_STRENGTH
    triplet_strength: float = K.SEED_TRIPLET_STRENGTH
    family_strengths: dict[str, float] = field(
        default_factory=lambda: dict(K.SEED_FAMILY_STRENGTHS)
    )

    def __post_init__(self) -> None:
        if set(self.family_strengths) != set(K.FAMILY_COLUMNS):
            raise ValueError("family strengths must name ad, domain and context")
        strengths = [self.global_strength, self.triplet_strength, *self.family_strengths.values()]
        if any(s <= 0 for s in strengths):
            raise ValueError("prior strengths must be positive")
        if not 0 < self.baseline_ctr < 1:
            raise ValueError("baseline CTR must be between 0 and 1")


@dataclass(frozen=True)
class Model:
    """Head and weights ``(family, feature, weight)``; the weights are never collected.

    ``features`` is the number of weights where it is known to be small, as for a configured
    model. Such weights are broadcast; otherwise their stored size decides.
    """

    head: Head
    weights: DataFrame
    features: int | None = None

    def renamed(self, name: str) -> "Model":
        return replace(self, head=replace(self.head, snapshot_name=name))

    def snapshot_row(self) -> DataFrame:
        """The model as one row with a map per family.

        A snapshot is one row by definition, so this suits weight families that fit one row.
        """
        maps = self.weights.agg(
            *[
                F.map_from_entries(
                    F.array_sort(
                        F.collect_list(F.when(F.col("family") == f, F.struct("feature", "weight")))
                    )
                ).alias(m)
                for f, m in _MAPS.items()
            ]
        )
        h = self.head
        return maps.select(
            F.lit(h.snapshot_name).alias("snapshot_name"),
            F.lit(h.w0).alias("w0"),
            F.struct(*_MAPS.values()).alias("weights"),
            F.struct(
                F.lit(h.baseline_ctr).alias("baseline_ctr"),
                F.lit(h.global_strength).alias("global_prior_strength"),
                F.lit(h.triplet_strength).alias("triplet_prior_strength"),
                F.create_map(
                    *[F.lit(x) for f in sorted(h.family_strengths) for x in (f, h.family_strengths[f])]
                ).alias("family_prior_strengths"),
            ).alias("metrics"),
        )


def seed_weights(spark: SparkSession) -> DataFrame:
    rows = [(f, v, w) for f, pairs in K.SEED_WEIGHTS.items() for v, w in pairs]
    return local_rows(spark, rows, WEIGHTS)


def seed_model(spark: SparkSession, baseline_ctr: float = K.SEED_BASELINE_CTR) -> Model:
    import math

    head = Head(K.SEED_SNAPSHOT_NAME, math.log(baseline_ctr / (1.0 - baseline_ctr)), baseline_ctr)
    return Model(head, seed_weights(spark), sum(len(v) for v in K.SEED_WEIGHTS.values()))


def weights_from_maps(snapshot: DataFrame) -> DataFrame:
    """Long form of the weight maps of a snapshot row."""
    maps = F.map_from_arrays(
        F.array(*[F.lit(f) for f in _MAPS]), F.array(*[F.col(f"weights.{m}") for m in _MAPS.values()])
    )
    return snapshot.select(F.explode(maps).alias("family", "_map")).select(
        "family", F.explode("_map").alias("feature", "weight")
    )


def current_snapshot(history: DataFrame) -> DataFrame:
    """The last appended row of a snapshot history (empty history gives NULLs)."""
    columns = [c for c in history.columns if c != "id"]
    return history.agg(
        F.max("id").alias("id"), F.max_by(F.struct(*columns), F.col("id")).alias("_row")
    ).select("id", "_row.*")


def load_model(snapshot: DataFrame) -> Model:
    """Model of a one-row snapshot; a missing or incomplete one is an error."""
    row = snapshot.select("snapshot_name", "w0", "metrics").limit(1).collect()
    if not row or row[0]["snapshot_name"] is None or row[0]["w0"] is None or row[0]["metrics"] is None:
        raise ValueError("current model is missing")
    name, w0, m = row[0]
    head = Head(
        name,
        w0,
        m["baseline_ctr"],
        m["global_prior_strength"],
        m["triplet_prior_strength"],
        dict(m["family_prior_strengths"]),
    )
    return Model(head, weights_from_maps(snapshot))


def prior_mean(w0: float | Column, *weights: Column) -> Column:
    total = w0 if isinstance(w0, Column) else F.lit(float(w0))
    for w in weights:
        total = total + F.coalesce(w, F.lit(0.0))
    return scalar.sigmoid(total)


def with_priors(buckets: DataFrame, model: Model) -> DataFrame:
    """Look the three keys up in the weight families (absent means 0) and add the Beta priors.

    Applied to buckets, after counting, so each triplet is looked up once. Weights are
    broadcast by Catalyst if their measured size is below the session threshold, and shuffled otherwise.
    """
    columns = buckets.columns
    found = buckets
    for family, key in K.FAMILY_COLUMNS.items():
        side = model.weights.filter(F.col("family") == family).select(
            F.col("feature").alias(key), F.col("weight").alias(f"_w_{family}")
        )
        found = found.join(side, key, "left")
    strength = F.lit(float(model.head.triplet_strength))
    mean = prior_mean(model.head.w0, *[F.col(f"_w_{f}") for f in K.FAMILY_COLUMNS])
    return found.select(*columns, mean.alias("prior_ctr")).select(
        *columns,
        "prior_ctr",
        (F.col("prior_ctr") * strength).alias("alpha_prior"),
        ((F.lit(1.0) - F.col("prior_ctr")) * strength).alias("beta_prior"),
    )


def unknown_features(marginals: DataFrame, weights: DataFrame) -> DataFrame:
    """Evidence values that the model has no weight for."""
    return marginals.join(weights, ["family", "feature"], "left_anti").select("family", "feature")
