"""The whole path of a batch of raw logs: normalise, gateway, ingest, escalate, with stores in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rules
from ..functions.numeric import US
from ..operators import detector, incidents as inc
from ..session import cut_lineage, drop_folder, names_in
from ..sources import store
from . import pipeline, train

#: What later batches must know of a batch's events to correlate their own.
TRACE = ["event_id", "client_id", "ts_us", "asset_id", "src_ip", "event_type", "threat_intel"]
FEATURE_STORE = ["event_id", "client_id", "asset_id", "ts_us", "src_ip", "event_type", "pattern_hint", "raw_hash", "severity_score",
                 "asset_value", "command_risk", "numeric_anomaly", "river_score", "nmap_score", "combined_score", "via", "route", "batch"]
META = ["ef", "sle", "valor_activo_snapshot", "clasificacion_criticidad", "aro_confidence", "model_mode", "lateral", "status"]


class EventPath:
    """Runs numbered batches over stores in one folder.

    Read and written are the detector's state, six minutes of events for correlation, the
    feature store, the store of escalated features and the incidents. Batches in a row give
    what one joint batch gives, but for money: a yearly rate knows the history up to its batch.
    Everything is named by batch, or marked with it: a batch that runs again sees what was there
    before it and replaces or skips what it had left. Batches are taken in order of time.

    Events are matched to assets by technical id (if a column is named), host name, asset name
    and address. Events without a tenant go no further than the gateway.
    """

    def __init__(self, folder: str, assets: DataFrame, intel: DataFrame, model: train.Trained | None = None,
                 reviews: DataFrame | None = None, mode: str = "SHADOW", window: int = rules.HST_WINDOW,
                 technical_id: str | None = None, columns: Callable[[], dict[str, Column]] = dict):
        self.folder, self.assets, self.intel, self.model, self.reviews = folder, assets, intel, model, reviews
        self.mode, self.window, self.technical_id, self.columns = mode, window, technical_id, columns

    def _stored(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        """The rows that earlier batches left in a store."""
        try:
            if not names_in(spark, f"{self.folder}/{name}"):
                return None
            return spark.read.parquet(f"{self.folder}/{name}").where(F.col("batch") < batch)
        except Exception as exc:  # nothing was written yet
            if "FileNotFound" not in str(exc) and "UNABLE_TO_INFER" not in str(exc):
                raise
            return None

    def _numbered(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        """The newest whole table before this batch of those that are written anew with each."""
        try:
            there = [int(n) for n in names_in(spark, f"{self.folder}/{name}") if n.isdigit() and int(n) < batch]
        except Exception as exc:
            if "FileNotFound" not in str(exc):
                raise
            there = []
        whole = [n for n in there if "_SUCCESS" in names_in(spark, f"{self.folder}/{name}/{n}")]
        return spark.read.parquet(f"{self.folder}/{name}/{max(whole)}") if whole else None

    def __call__(self, raw: DataFrame, batch: int) -> DataFrame:
        """Runs one batch and returns its routed events."""
        spark = raw.sparkSession
        trace = self._numbered(spark, "trace", batch)
        seen = cut_lineage(pipeline.gateway_batch(raw, self.assets, self.intel, technical_id=self.technical_id, earlier=trace, **self.columns()))
        new = seen.select(*TRACE)
        all_seen = new if trace is None else trace.unionByName(new)
        since = all_seen.agg(F.max("ts_us")).scalar() - F.lit(rules.CORRELATION_WINDOW_S * US)
        all_seen.where(F.col("ts_us") >= since).write.mode("overwrite").parquet(f"{self.folder}/trace/{batch}")

        vector = {c: F.col(f"features_vector.{c}") for c in ("asset_value", "command_risk", "numeric_anomaly")}
        passed = seen.where(F.col("passed")).withColumns(vector)
        before = detector.load(spark, f"{self.folder}/state", batch)
        routed, state = pipeline.ingest_after(passed, before, self.window)
        routed = cut_lineage(routed.withColumn("batch", F.lit(batch).cast("bigint")))
        detector.save(state, f"{self.folder}/state", batch)
        store.sink_features(routed.select(*FEATURE_STORE), f"{self.folder}/features")

        history = self._stored(spark, "features", batch + 1)
        escalated = self._stored(spark, "escalated", batch)
        known = None if escalated is None else escalated.where("raw_hash is not null").select("client_id", "raw_hash")
        found = cut_lineage(pipeline.escalate_batch(routed, self.assets, history, self.model, known, self.reviews, self.mode, recent=before.recent))
        self._keep(spark, found, routed, batch)
        store.sink_features(routed.where("route = 'escalated'").select(*FEATURE_STORE), f"{self.folder}/escalated")
        for name in ("trace", "state", "open"):
            drop_folder(spark, f"{self.folder}/{name}/{batch - 2}")
        return routed

    def _keep(self, spark: SparkSession, found: DataFrame, routed: DataFrame, batch: int) -> None:
        """Merges a batch's incidents with the open ones; what no later event can reach is closed."""
        stored = self._numbered(spark, "open", batch)
        if stored is not None:
            meta = stored.select("opener_id", *META).unionByName(found.select("opener_id", *META)).dropDuplicates(["opener_id"])
            found = inc.merge_incidents(stored, found, self.reviews).join(meta, "opener_id", "left")
        found = cut_lineage(found)
        longest = max([*rules.CONSOLIDATION_MINUTES.values(), rules.CONSOLIDATION_DEFAULT_MINUTES]) * 60 * US
        open_ = F.coalesce(F.col("last_seen_us") >= routed.agg(F.max("ts_us")).scalar() - F.lit(longest), F.lit(True))
        found.where(~open_).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={batch}")
        found.where(open_).write.mode("overwrite").parquet(f"{self.folder}/open/{batch}")

    def incidents(self, spark: SparkSession) -> DataFrame:
        """All incidents, closed and open."""
        now_open = self._numbered(spark, "open", 2**62)
        closed = spark.read.schema(now_open.schema).parquet(f"{self.folder}/closed").select(*now_open.columns)
        return closed.unionByName(now_open)
