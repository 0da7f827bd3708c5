"""Tables of one run, built lazily from the driver's tables, and damaged copies.

Damaged copies change whole tables by the rows' own values, so that each check
has something to find. Nothing is sampled or cut down.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.definitions import DEFAULT, ENFORCED_TESTS, NEVER_FEATURES, SIGNALS, PanelParams
from riskpanel.functions.frames import single_row
from riskpanel.operators import (
    gates, lineage, metrics, model, outcomes, panel, population, quality, reconcile, signals,
)
from riskpanel.session import cut_lineage, write_once
from riskpanel.sources import adapter
from riskpanel.sources.tables import WIDE_SCHEMA

c = F.col


#: Columns that a source delivers; the rest of a wide row is provenance.
PROVENANCE = ("source_id", "source_file_sha256", "source_row_number", "ingestion_run_id", "ingested_at")
DELIVERED = tuple(x for x in WIDE_SCHEMA.fieldNames() if x not in PROVENANCE)


class Workspace:
    """Lazy frames of one scale-factor folder. Nothing runs until a result is read."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: PanelParams = DEFAULT):
        self.spark, self.sf_dir, self.p = spark, sf_dir, params

    def table(self, name: str) -> DataFrame:
        return adapter.table(self.spark, self.sf_dir, name)

    def stored(self) -> Workspace:
        """The same run over wide rows that are written once, as after a load.

        For results that read the core tables many times.
        """
        other = Workspace(self.spark, self.sf_dir, self.p)
        other.raw = write_once(self.raw, "raw")
        return other

    # --- raw and core ---------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        return adapter.wide_rows(self.spark, self.sf_dir)

    @cached_property
    def fields(self) -> list[str]:
        """Compared fields of a wide row: values and provenance, without the key."""
        return [x for x in self.raw.columns if x != self.p.wide_key]

    @cached_property
    def borrowers(self) -> DataFrame:
        return panel.borrower(self.raw, self.p)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.unpivot_periods(self.raw, self.p)

    @cached_property
    def registry(self) -> DataFrame:
        """Two registrations of the source: an earlier part delivery and the whole one."""
        rows = self.table("customer").agg(
            F.count_if(c("c_acctbal") >= 0).alias("part"), F.count(F.lit(1)).alias("whole")
        )
        sha = F.sha2(F.lit(adapter.SOURCE_ID).cast("binary"), 256).alias("file_sha256")
        cells = [
            F.struct(
                F.lit(adapter.SOURCE_ID).alias("source_id"),
                sha,
                c(column).alias("data_row_count"),
                F.lit(len(DELIVERED)).cast("bigint").alias("column_count"),
                F.lit(at).cast("timestamp").alias("registered_at"),
            )
            for column, at in (("part", "2005-10-01 00:00:00"), ("whole", "2005-10-02 00:00:00"))
        ]
        return rows.select(F.explode(F.array(*cells)).alias("r")).select("r.*")

    # --- load targets -----------------------------------------------------------
    def target(self, state: str) -> DataFrame:
        """State of the load target: empty, replay, partial or conflict."""
        if state == "empty":
            return self.raw.where("false")
        if state == "partial":
            return self.raw.where("education <> 6")
        if state == "conflict":
            return self.raw.withColumn("limit_bal", F.when(c("marriage") == 0, c("limit_bal") + 1).otherwise(c("limit_bal")))
        return self.raw

    # --- damaged core -----------------------------------------------------------
    @cached_property
    def damaged(self) -> quality.Tables:
        raw = self.raw.unionByName(self.raw.where("age = 30"))
        borrowers = self.borrowers.where("education_code <> 6").withColumns(
            {
                "credit_limit_ntd": F.when((c("marriage_code") == 3) & (c("sex_code") == 2), 0).otherwise(c("credit_limit_ntd")),
                "age_years": F.when(c("age_years") == 21, 17).otherwise(c("age_years")),
                "sex_code": F.when(c("education_code") == 5, 3).otherwise(c("sex_code")),
                "next_month_default": F.when(
                    (c("education_code") == 4) & (c("sex_code") == 1), 2
                ).otherwise(c("next_month_default")),
            }
        )
        cells = self.panel.where("NOT (repayment_status = 0 AND month_offset = -3)").withColumns(
            {
                "statement_month_end": F.when(
                    (c("month_offset") == -5) & (c("bill_amount_ntd") == 0), F.date_add("statement_month_end", 1)
                ).otherwise(c("statement_month_end")),
                "payment_amount_ntd": F.when(c("repayment_status") == 2, None).otherwise(c("payment_amount_ntd")),
            }
        )
        rec = reconcile.reconciliation(raw, borrowers, cells, self.p)
        return quality.Tables(raw, borrowers, cells, self.registry, rec)

    @cached_property
    def clean(self) -> quality.Tables:
        return quality.Tables(self.raw, self.borrowers, self.panel, self.registry, self.reconciliation)

    # --- evidence ---------------------------------------------------------------
    @cached_property
    def reconciliation(self) -> DataFrame:
        return reconcile.reconciliation(self.raw, self.borrowers, self.panel, self.p)

    @cached_property
    def tests(self) -> DataFrame:
        return quality.quality_suite(self.clean, self.p)

    # --- marts ------------------------------------------------------------------
    @cached_property
    def signals(self) -> DataFrame:
        return signals.signal_table_wide(self.raw, self.p)

    @cached_property
    def summary(self) -> DataFrame:
        return outcomes.signal_summary(self.signals, self.p)

    @cached_property
    def bands(self) -> DataFrame:
        return outcomes.band_summary(self.signals, self.p)

    @cached_property
    def damaged_summary(self) -> DataFrame:
        """Summary with a wrong rate, an impossible count, a repeat and a dropped signal."""
        changed = self.summary.where("signal_name <> 'recent_bill_growth'").withColumns(
            {
                "observed_default_rate": F.when(
                    c("signal_name") == "zero_payment_streak", c("observed_default_rate") + 0.01
                ).otherwise(c("observed_default_rate")),
                "default_count": F.when(
                    (c("signal_name") == "latest_utilization_ratio") & (c("bucket_order") == 3), c("sample_size") + 1
                ).otherwise(c("default_count")),
            }
        )
        return changed.unionByName(changed.where("signal_name = 'delinquent_months_6m' AND bucket_order = 1"))

    # --- model ------------------------------------------------------------------
    @cached_property
    def extract(self) -> DataFrame:
        return panel.model_extract(self.borrowers, self.signals)

    @cached_property
    def frame(self) -> DataFrame:
        return model.model_frame(self.extract)

    @cached_property
    def stored_frame(self) -> DataFrame:
        """The prepared frame, written once for the many passes of fits."""
        return cut_lineage(self.frame)

    @cached_property
    def scored(self) -> DataFrame:
        """Prepared frame with three stand-in probabilities, made from codes,
        points and a digest, so that every metric has an exact SQL counterpart."""
        whole = self.frame
        points = self.signals.select(c("customer_id"), c("risk_points"))
        digest = F.sha2(c("customer_id").cast("string").cast("binary"), 256)
        static = (c("age_years") * 13 + c("sex_code") * 7 + c("education_code") * 29 + c("marriage_code") * 3) % 100
        return whole.join(points, "customer_id").withColumns(
            {
                "p_static": static.cast("double") / 100.0,
                "p_behavioral": c("risk_points").cast("double") / 10.0,
                "p_combined": F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double")
                / F.lit(281474976710656.0),
            }
        )

    @cached_property
    def population(self) -> DataFrame:
        return self.scored.select(
            c("customer_id").alias("borrower_id"),
            c("next_month_default").alias("actual_default"),
            "split", "sex_code", "education_code", "marriage_code", "age_band", "risk_band",
        )

    @cached_property
    def pred(self) -> DataFrame:
        """Stand-in test predictions of three models."""
        cells = [
            F.struct(F.lit(m).alias("model"), c(f"p_{m}").alias("predicted_pd"))
            for m in ("static", "behavioral", "combined")
        ]
        rows = self.scored.where("split = 'test'").select(
            c("customer_id").alias("borrower_id"),
            c("next_month_default").alias("actual_default"),
            "split", "education_code", "marriage_code",
            F.explode(F.array(*cells)).alias("m"),
        )
        return rows.select("m.*", "borrower_id", "actual_default", "split", "education_code", "marriage_code")

    @cached_property
    def fitted_pred(self) -> DataFrame:
        """Calibrated test predictions of three models fitted on this run, written once.

        At nine decimals, so that equal rows tie in whatever order sums are taken.
        """
        pred = model.predictions(model.fit_three(self.stored_frame), self.stored_frame)
        return write_once(pred.withColumn("predicted_pd", F.round("predicted_pd", 9)), "predictions")

    @cached_property
    def damaged_pred(self) -> DataFrame:
        """Predictions with every fault the checks look for."""
        base = self.pred.where("NOT (education_code = 6 AND model = 'combined')")
        changed = base.withColumns(
            {
                "predicted_pd": F.when(
                    (c("education_code") == 4) & (c("model") == "static"), c("predicted_pd") + 1.0
                ).otherwise(c("predicted_pd")),
                "actual_default": F.when(
                    (c("marriage_code") == 3) & (c("model") == "combined"), 1 - c("actual_default")
                ).otherwise(c("actual_default")),
                "split": F.when((c("education_code") == 2) & (c("marriage_code") == 2), "train").otherwise(c("split")),
                "borrower_id": F.when(
                    (c("education_code") == 3) & (c("model") == "behavioral"), -c("borrower_id")
                ).otherwise(c("borrower_id")),
            }
        )
        return changed.unionByName(changed.where("education_code = 5 AND model = 'static'"))

    @cached_property
    def damaged_population(self) -> DataFrame:
        changed = self.population.withColumns(
            {
                "split": F.when(c("education_code") == 5, "holdout").otherwise(c("split")),
                "age_band": F.when(c("marriage_code") == 0, " ").otherwise(c("age_band")),
                "actual_default": F.when(c("education_code") == 1, 3).otherwise(c("actual_default")),
            }
        )
        return changed.unionByName(changed.where("age_band = '60+'"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Metric table of the stand-in predictions, written once: comparisons read it twice."""
        return cut_lineage(metrics.metric_table(self.pred))

    # --- graph ------------------------------------------------------------------
    @cached_property
    def nodes(self) -> DataFrame:
        return lineage.with_node_id(adapter.graph_nodes(self.spark, self.sf_dir))

    @cached_property
    def edges(self) -> DataFrame:
        return lineage.edges_by_id(adapter.graph_edges(self.spark, self.sf_dir))

    @cached_property
    def damaged_nodes(self) -> DataFrame:
        kind, name = c("node_type"), c("canonical_name")
        return self.nodes.withColumns(
            {
                "graph_scope": F.when(kind == "Source", "elsewhere").otherwise(c("graph_scope")),
                "status": F.when(kind == "Transformation", "  ").otherwise(c("status")),
                "owner": F.when(name.rlike("^c[0-9]*7$"), "").when(name.rlike("^c[0-9]*8$"), None).otherwise(c("owner")),
                "version": F.when(name.rlike("^o[0-9]*99$"), " ").otherwise(c("version")),
                "path_or_object": F.when(name.rlike("^o[0-9]*55$"), "").otherwise(c("path_or_object")),
                "node_type": F.when(name.rlike("^c[0-9]*3$"), "Thing").otherwise(kind),
                "canonical_name": F.when(name.rlike("^n[0-9]*4$"), "   ").otherwise(name),
            }
        )

    @cached_property
    def damaged_edges(self) -> DataFrame:
        by_name = adapter.graph_edges(self.spark, self.sf_dir)
        tail = c("from_name")
        changed = by_name.withColumns(
            {
                "to_name": F.when(tail.rlike("^o[0-9]*77$"), tail)
                .when(tail.rlike("^o[0-9]*88$"), "absent")
                .otherwise(c("to_name")),
                "edge_type": F.when(tail.rlike("^c[0-9]*5$"), "touches").otherwise(c("edge_type")),
                "expected_sign": F.when(tail.rlike("^c[0-9]*6$"), "positive").when(tail.rlike("^c[0-9]*1$"), "up"),
                "lag_months": F.when(tail.rlike("^c[0-9]*2$"), -1),
                "evidence_reference": F.when(tail.rlike("^o[0-9]*33$"), None)
                .when(tail.rlike("^o[0-9]*44$"), " ")
                .otherwise(c("evidence_reference")),
                "status": F.when(tail.rlike("^o[0-9]*3$"), "approved")
                .when(tail.rlike("^n"), "")
                .otherwise(c("status")),
                "valid_to": F.when(tail.rlike("^c[0-9]*9$"), F.date_sub("valid_from", 1)).when(
                    tail.rlike("^c[0-9]*0$"), c("valid_from")
                ),
                "graph_scope": F.when(tail.rlike("^n[0-9]*2$"), "elsewhere").otherwise(c("graph_scope")),
            }
        )
        return lineage.edges_by_id(changed)

    @cached_property
    def cross_edges(self) -> DataFrame:
        """Edges whose own scope was changed while their endpoints kept theirs."""
        kind = self.edges
        return kind.withColumn(
            "graph_scope",
            F.when(c("evidence_reference").rlike("(c[0-9]*3|n[0-9]*)$"), "economic_transmission").otherwise(c("graph_scope")),
        )

    # --- gates ------------------------------------------------------------------
    @cached_property
    def integrity(self) -> DataFrame:
        return population.integrity(self.borrowers, self.panel)

    @cached_property
    def totals(self) -> DataFrame:
        """One row: source, raw, borrower and panel rows and wide and long amounts."""
        rec = self.reconciliation

        def value(ident: str, column: str) -> Column:
            return F.max(F.when(c("reconciliation_id") == ident, c(column)))

        from_rec = rec.agg(
            value("REC-001", "source_value").alias("raw_rows"),
            value("REC-001", "derived_value").alias("borrower_rows"),
            value("REC-002", "source_value").alias("expected_panel_rows"),
            value("REC-002", "derived_value").alias("panel_rows"),
            value("REC-003", "source_value").alias("wide_bill"),
            value("REC-003", "derived_value").alias("long_bill"),
            value("REC-003", "difference").alias("bill_difference"),
            value("REC-004", "source_value").alias("wide_payment"),
            value("REC-004", "derived_value").alias("long_payment"),
            value("REC-004", "difference").alias("payment_difference"),
        )
        source = self.registry.agg(
            F.max_by("data_row_count", "registered_at").alias("source_rows"),
            F.max_by("column_count", "registered_at").alias("source_columns"),
            F.count(F.lit(1)).alias("registered_sources"),
            F.max(F.when(c("file_sha256").rlike("^[0-9a-f]{64}$"), 1).otherwise(0)).cast("bigint").alias("sha256_valid"),
        )
        return single_row(from_rec, source)

    @cached_property
    def review(self) -> DataFrame:
        """One row: timing and leakage review of the signals that have outcome rows."""
        return gates.signal_review(self.summary, signals.signal_inputs(self.p), sorted(NEVER_FEATURES))

    def gate_parts(self, gate: int) -> list[DataFrame]:
        """One-row aggregates that hold the metrics of one gate.

        No time-ordered validation and no sensitivity run exist for one
        snapshot, and no limitations are recorded for it, so gates 4 and 5 stay
        closed, as they must.
        """
        if gate == 1:
            columns = ("registered_sources", "sha256_valid", "source_rows", "source_columns", "raw_rows", "unlogged_rejects")
            return [self._gap.select(*columns)]
        if gate == 2:
            enforced = self.tests.where(c("test_id").isin(*ENFORCED_TESTS))
            rows = self.totals.select(
                "raw_rows", "borrower_rows", "panel_rows", "expected_panel_rows", "bill_difference", "payment_difference"
            )
            return [
                rows,
                self.integrity,
                population.core_counts(self.borrowers, self.panel).select("periods"),
                gates.suite_checks(enforced).select("executed_tests", "failed_tests"),
            ]
        if gate == 3:
            faults = outcomes.rate_consistency(self.summary, self.bands).agg(
                F.sum(
                    c("bad_size") + c("bad_defaults") + c("bad_rate") + c("duplicate_buckets") + c("blank_buckets")
                ).alias("invalid_summaries")
            )
            per_signal = self.summary.groupBy("signal_name").agg(
                F.sum("default_count").alias("d"), F.count(F.lit(1)).alias("n")
            )
            summary_counts = per_signal.agg(
                F.sum("n").alias("summary_rows"),
                F.count(F.lit(1)).alias("signals_with_summary"),
                F.when(F.min("d") == F.max("d"), F.max("d")).alias("signal_default_total"),
            )
            band_counts = self.bands.agg(
                F.count(F.lit(1)).alias("band_rows"), F.sum("default_count").alias("band_default_total")
            )
            version = self.signals.agg(
                F.lit(len(SIGNALS)).cast("bigint").alias("signals"),
                F.when(F.min(F.trim("definition_version")) != "", 1).otherwise(0).cast("bigint").alias("version_present"),
            )
            again = gates.reproduced_signals(self.signals, signals.signal_table_wide(self.raw, self.p), SIGNALS)
            return [faults, summary_counts, band_counts, version, self.review, again]
        if gate == 4:
            def complete(df: DataFrame, column: str, wanted: int, name: str) -> DataFrame:
                reached = F.when(F.count_distinct(column) == wanted, 1).otherwise(0).cast("bigint")
                return df.agg(reached.alias(name))

            return [
                complete(metrics.calibration_bins(self.fitted_pred), "model", 3, "calibration_completed"),
                complete(metrics.segments(self.fitted_pred, self.population), "segment_field", 5, "segment_stability_completed"),
                self.signals.agg(F.count_if(c("risk_band").isNull()).alias("missing_labels")),
            ]
        identity = gates.run_identity({"borrower": self.borrowers, "panel": self.panel, "signals": self.signals})
        ties = outcomes.population_tie_out(self.summary, self.bands, self.borrowers).agg(
            F.count_if(~c("ties_out")).alias("mismatches")
        )
        return [identity, ties, self.claims.select("unresolved_claims")]

    @cached_property
    def claims(self) -> DataFrame:
        """One row: whether every defined signal has a claim of this run, made from its outcome rows."""
        evidence = F.sha2(F.concat_ws("|", c("file_sha256"), F.lit(self.p.run_id)).cast("binary"), 256)
        identity = self.registry.agg(F.max_by(evidence, "registered_at").alias("evidence_sha256")).withColumn("run_id", F.lit(self.p.run_id))
        named = self.summary.select(F.concat(F.lit("outcome."), "signal_name").alias("claim_id")).distinct()
        made = named.withColumn("i", identity.select(F.struct("run_id", "evidence_sha256")).scalar()).select("claim_id", "i.*")
        needed = self.spark.createDataFrame([(f"outcome.{s}",) for s in SIGNALS], "claim_id string")
        return gates.claim_cover(made, needed, identity)

    @cached_property
    def _gap(self) -> DataFrame:
        """Row counts with the source rows that are neither loaded nor logged as rejected."""
        own = self.totals.select("raw_rows")
        rest = self.totals.drop("raw_rows")
        return population.unlogged_rejects(rest, own, adapter.ledger_events(self.spark, self.sf_dir))

    def gate_evidence(self, gate: int) -> DataFrame:
        """``(metric, value)`` for the rules of one gate, from this run's tables."""
        return gates.metric_evidence(*self.gate_parts(gate))

    def gate_checks(self) -> DataFrame:
        """Status per check over all gates."""
        run = self.stored()
        parts = [gates.gate(run.gate_evidence(g), g) for g in (1, 2, 3, 4, 5)]
        return gates.check_results(reduce(DataFrame.unionByName, parts))
