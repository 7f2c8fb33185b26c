"""Lazy wiring of the layers: raw -> silver -> gold -> features -> scores.

``Pipeline`` memoises DataFrame *objects* (not data): asking twice for a
table returns the same logical plan, so one query that reads a table twice
lets Catalyst reuse the exchange. When materialising, asking for a table writes
it (and the tables it reads) the first time; nothing else runs a job here.
"""

from __future__ import annotations

import copy
import hashlib
import threading
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import martflow
from martflow.config import DEFAULT, FIXTURE_SIGNAL_AS_OF, Config
from martflow.operators import facts, gold, silver
from martflow.session import file_status, materialize
from martflow.sources import bronze, fixtures


def _input_key(spark: SparkSession, sf_dir: str, cfg: Config, run_id: str | None) -> str:
    """Id of the tables that a pipeline writes: the run (by default this Spark
    application, so nothing is taken from an earlier one), the input files as the
    path's own file system lists them, the configuration and the package's code."""
    h = hashlib.sha1((run_id or spark.sparkContext.applicationId).encode())
    h.update(sf_dir.encode())
    for name in sorted(fixtures.DRIVER_TABLES):
        h.update(repr((name, file_status(spark, f"{sf_dir}/{name}.parquet"))).encode())
    h.update(repr(cfg).encode())
    for f in sorted(Path(martflow.__file__).parent.rglob("*.py")):
        h.update(f.read_bytes())
    return h.hexdigest()[:16]


class Tables(Mapping):
    """Tables of a layer by name, each built (and written, when the pipeline
    materialises) the first time it is asked for."""

    def __init__(self, names, build):
        self._names, self._build = list(names), build
        self._made: dict[str, DataFrame] = {}
        self._locks = {n: threading.Lock() for n in self._names}

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = self._build(name)
            return self._made[name]

    def made(self, name: str) -> bool:
        return name in self._made

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Pipeline:
    """``materialize=True`` writes Silver and the feature dataset once as
    parquet under ``spark.checkpoint.dir`` (the medallion layers are tables)
    and builds everything downstream on those scans."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT,
                 silver_tables: dict[str, DataFrame] | None = None, materialize: bool = True,
                 run_id: str | None = None, scorer=None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.cfg = cfg
        self._silver = silver_tables
        self.materialize = materialize
        self._scorer = scorer
        self.parallel_writes = 4
        self.key = _input_key(spark, sf_dir, cfg, run_id) if materialize else ""

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(self.spark, df, name, self.key) if self.materialize else df

    @classmethod
    def fixture(cls, spark: SparkSession, sf_dir: str, cfg: Config | None = None) -> "Pipeline":
        """The pipeline on the driver tables, with the fixture's signal period."""
        cfg = cfg or DEFAULT.with_(signal_as_of=FIXTURE_SIGNAL_AS_OF)
        return cls(spark, sf_dir, cfg)

    # ---------------------------------------------------------- layers
    @cached_property
    def bronze(self) -> "Tables":
        """A3: the raw tables as ingested, with lineage columns."""
        return Tables(fixtures.BRONZE_BUILDERS,
                      lambda n: self._table(bronze.to_bronze(self._arriving(n), n), f"bronze_{n}"))

    def _arriving(self, name: str) -> DataFrame:
        """A raw table straight from the adapter."""
        t = fixtures.DriverTables(self.spark, self.sf_dir)
        shared = {"lines": self._lines} if name in ("order_items", "inventory_items") else {}
        return fixtures.BRONZE_BUILDERS[name](t, **shared)

    @cached_property
    def _lines(self) -> DataFrame:
        """Enriched order lines of the adapter, shared by two Bronze tables."""
        t = fixtures.DriverTables(self.spark, self.sf_dir)
        return self._table(fixtures.enriched_lines(t), "fixture_lines")

    @cached_property
    def raw(self) -> "Tables":
        """Bronze without its lineage columns."""
        return Tables(fixtures.BRONZE_BUILDERS, lambda n: self.bronze[n].drop("_ingested_at", "_source_file"))

    @cached_property
    def once(self) -> "Tables":
        """The raw tables for a reader that scans a table once: Bronze where this pipeline has
        written it, else the same rows as they arrive, so no copy is written to be read once."""
        return Tables(fixtures.BRONZE_BUILDERS, lambda n: self.raw[n] if self.bronze.made(n) else self._arriving(n))

    @cached_property
    def silver(self) -> "Tables | dict[str, DataFrame]":
        if self._silver is not None:
            return self._silver
        return Tables(silver.SILVER_BUILDERS,
                      lambda n: self._table(silver.build(n, self.once), f"silver_{n}"))

    @cached_property
    def facts(self) -> "Tables":
        """Facts that several Gold tables roll up from."""
        return Tables(facts.FACTS, lambda n: self._table(facts.FACTS[n](self.silver, self.cfg), f"fact_{n}"))

    @cached_property
    def gold(self) -> "Tables":
        """The five Gold tables; analytics read them like snapshots."""
        return Tables(gold.GOLD_BUILDERS,
                      lambda n: self._table(gold.GOLD_BUILDERS[n](self.silver, self.facts, self.cfg), f"gold_{n}"))

    def write_layer(self, tables: "Tables") -> None:
        """Write every table of a layer, independent ones as concurrent jobs."""
        with ThreadPoolExecutor(max_workers=self.parallel_writes) as pool:
            list(pool.map(tables.__getitem__, list(tables)))

    def s(self, name: str) -> DataFrame:
        return self.silver[name]

    def g(self, name: str) -> DataFrame:
        return self.gold[name]

    # ---------------------------------------------------------- features
    @cached_property
    def features(self):
        from martflow.operators.features import FeatureBuilder
        return FeatureBuilder(self.silver, self.cfg)

    # ---------------------------------------------------------- model rows and serving
    def with_scorer(self, scorer) -> "Pipeline":
        """This pipeline with another scorer: same layers and dataset, own batch and monitoring."""
        other = copy.copy(self)
        other._scorer = scorer
        for name in ("scorer", "snapshot", "predictions", "monitoring_frame", "baseline", "batch_profile", "paired", "monitoring", "signals"):
            other.__dict__.pop(name, None)
        return other

    @cached_property
    def scorer(self):
        from martflow.operators import serving
        return self._scorer or serving.surrogate()

    @cached_property
    def encoders(self) -> DataFrame:
        """encoder table fitted on the train split."""
        from martflow.operators import modeldata as md
        return self._table(md.fit_encoders(self._split.filter("split = 'train'")), "encoders")

    @cached_property
    def _split(self) -> DataFrame:
        from martflow.operators import modeldata as md
        return md.train_test_split(md.null_policy(md.training_set(self.dataset)), self.cfg)

    @cached_property
    def model_frame(self) -> DataFrame:
        """Model-ready rows (F1-F4): null policy, ``split``, encoded categories."""
        from martflow.operators import modeldata as md
        return self._table(md.apply_encoders(self._split, self.encoders), "model_frame")

    @cached_property
    def snapshot(self) -> DataFrame:
        """The batch's features as the model gets them, written before scoring. A batch is
        every customer of the dataset, or ``cfg.batch_size`` of them."""
        from martflow.operators import modeldata as md, serving
        rows = self.dataset if self.cfg.batch_size is None else md.fixed_sample(self.dataset, self.cfg.batch_size)
        encoders = self.encoders if self.scorer.encoders is None else self.scorer.encoders
        return self._table(serving.inference_snapshot(md.training_set(rows).drop("churned"), encoders),
                           f"inference_features_{self.scorer.key}")

    @cached_property
    def predictions(self) -> DataFrame:
        """the scored batch, a table that monitoring, signals and explorer read."""
        from martflow.operators import serving
        return self._table(serving.predictions(self.snapshot, self.scorer, self.cfg), f"predictions_{self.scorer.key}")

    # ---------------------------------------------------------- monitoring
    @cached_property
    def monitoring_frame(self) -> DataFrame:
        """Train, test and batch rows, scored, with the outcomes known."""
        from martflow.operators import serving
        return self._table(serving.monitoring_frame(self.model_frame, self.scorer, self.snapshot, self.predictions,
                                                    self.dataset.select("user_id", "churned")),
                           f"monitoring_frame_{self.scorer.key}")

    def _population(self, name: str) -> DataFrame:
        from pyspark.sql import functions as F
        return self.monitoring_frame.filter(F.col("population") == name)

    @cached_property
    def baseline(self) -> DataFrame:
        """Profile of the train rows' features and of the test rows' scores, stored at training."""
        from martflow.operators import modeldata as md, profiles, serving
        return self._table(profiles.profile(self._population(serving.TRAIN), md.MODEL_FEATURES)
                           .unionByName(profiles.profile(self._population(serving.TEST), ["score"])),
                           f"baseline_profile_{self.scorer.key}")

    @cached_property
    def batch_profile(self) -> DataFrame:
        from martflow.operators import modeldata as md, profiles, serving
        return self._table(profiles.profile(self._population(serving.BATCH), [*md.MODEL_FEATURES, "score"]),
                           f"batch_profile_{self.scorer.key}")

    @cached_property
    def paired(self) -> DataFrame:
        """Stored reference profile and batch profile side by side, written once for all statistics."""
        from martflow.operators import profiles
        return self._table(profiles.paired(self.baseline, self.batch_profile), f"paired_profile_{self.scorer.key}")

    def counts(self, scores: bool) -> DataFrame:
        """Paired counts of the scores or of the features."""
        from pyspark.sql import functions as F
        return self.paired.filter(F.col("feature") == "score" if scores else F.col("feature") != "score")

    @cached_property
    def monitoring(self) -> dict[str, DataFrame]:
        """Drift of the batch's features against train, of its scores against
        test, model quality on test and batch, one-row summary."""
        from martflow.operators import drift, modeldata as md, serving
        key = self.scorer.key
        metrics = serving.quality_metrics(self.monitoring_frame, self.cfg)
        # Independent jobs run side by side; the reports are small tables, written once (like
        # a summary file) so consumers do not recompute drift.
        with ThreadPoolExecutor(max_workers=3) as pool:
            fm = pool.submit(self._table, metrics, f"model_metrics_{key}")
            for side in [pool.submit(getattr, self, name) for name in ("baseline", "batch_profile")]:
                side.result()
            table = drift.drift_table(self.counts(scores=False), md.MODEL_CATEGORICAL, self.cfg)
            pdrift = drift.prediction_drift(self.counts(scores=True), self.cfg)
            ft = pool.submit(self._table, table, f"drift_table_{key}")
            fp = pool.submit(self._table, pdrift, f"prediction_drift_{key}")
            table, pdrift, metrics = ft.result(), fp.result(), fm.result()
        quality = drift.model_quality(metrics, serving.TEST, serving.BATCH, self.cfg)
        summary = self._table(drift.monitoring_summary(table, pdrift, quality), f"monitoring_summary_{key}")
        return {"drift_table": table, "prediction_drift": pdrift, "metrics": metrics,
                "model_quality": quality, "summary": summary}

    # ---------------------------------------------------------- insight
    @cached_property
    def signals(self) -> DataFrame:
        from martflow.operators.signals import kpi_signals
        return kpi_signals(self.gold, self.predictions, self.cfg)

    @cached_property
    def dataset(self) -> DataFrame:
        """The churn feature dataset as a table (the run timestamp column is
        stamped when the table is written)."""
        return self._table(self.features.dataset(), "churn_feature_dataset")
