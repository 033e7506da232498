"""End-to-end plans: baseline blocking, candidate generation, data set and model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import EXACT, LinkageConfig
from kinfold.operators import blocking, dataset, evaluate, model, truth
from kinfold.operators.pairs import FEATURES, entity_features
from kinfold.operators.profile import cleaned


@dataclass
class Linkage:
    """The stages over ``entities`` and ``truth``; each is a DataFrame and nothing runs before it is asked for."""

    entities: DataFrame
    truth_rows: DataFrame
    config: LinkageConfig = field(default_factory=LinkageConfig)

    @property
    def truth(self) -> DataFrame:
        return truth.truth_pairs(self.truth_rows)

    @property
    def keys(self) -> DataFrame:
        return blocking.channel_keys(blocking.with_keys(self.entities), self.config)

    def baseline(self) -> DataFrame:
        """Metrics of the uncapped exact-name channel over cleaned records."""
        rows = cleaned(self.entities)
        keys = blocking.channel_keys(blocking.with_keys(rows), self.config, (EXACT,))
        return evaluate.channel_metrics(keys, self.truth, rows, None)

    def candidates(self) -> DataFrame:
        return blocking.union_candidates(blocking.channel_pairs(self.keys, self.config.caps))

    def dataset(self) -> DataFrame:
        return dataset.build(self.candidates(), self.truth, entity_features(self.entities), self.config)

    def summary(self) -> DataFrame:
        """Fit the model on the training split; one row of validation metrics and counts."""
        rows = self.dataset().cache()
        try:
            train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
            fitted = model.fit(train, self.config)
            scored = model.score(fitted, val).cache()
            best, auc = model.best_threshold(model.threshold_sweep(scored)).first(), model.roc_auc(scored).first()
            counts = {r.split: r for r in dataset.split_counts(rows, self.entities, self.config).collect()}
            total = lambda n: sum(getattr(r, n) for r in counts.values())
            spark = rows.sparkSession
            weights = [(n, float(w)) for n, w in model.top_weights(fitted)]
            scored.unpersist()
            row = (total("positives"), total("negatives"), len(FEATURES), auc.auc, best.best_f05, best.best_threshold, weights)
            return spark.createDataFrame([row], "total_positive_pairs long, total_negative_pairs long, num_features int, val_auc double, val_f05 double, threshold double, top_features array<struct<feature: string, weight: double>>")
        finally:
            rows.unpersist()


def report(df: DataFrame, digits: int = 4) -> list[dict]:
    """A report of every row of ``df`` for a console or a JSON file, so ``df`` should be one: doubles rounded half-even on
    their exact values."""
    clean = lambda v: round(v, digits) if isinstance(v, float) else v
    return [{k: clean(v) for k, v in r.asDict(recursive=True).items()} for r in df.toLocalIterator()]


def report_frame(df: DataFrame) -> DataFrame:
    """A report as one JSON document per row."""
    return df.select(F.to_json(F.struct("*")).alias("document"))
