"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from prioscope.operators import breakdowns, classify, evidence, fusion, profiling, rule_signal, splitting, text_signal, time_signal
from prioscope.operators.features import vocabulary
from prioscope.plans import catalog
from prioscope.plans.audit import audit_batch, audit_fast, label_tickets
from prioscope.session import local_session
from prioscope.sources.tables import ticket_table
from prioscope.operators.cleaning import clean_tickets


def spend(df) -> None:
    """Compute every column of every row without collecting."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.range(1000).selectExpr("sum(id)").collect()

    took: dict[str, float] = {}

    def run(name: str, work) -> None:
        start = time.time()
        work()
        took[name] = round(time.time() - start, 3)

    run("ticket_table", lambda: spend(ticket_table(spark, folder)))
    run("stage_tickets", lambda: catalog.tickets(spark, folder))
    raw = catalog.tickets(spark, folder)
    run("clean", lambda: spend(clean_tickets(raw)))
    run("stage_clean", lambda: catalog.clean(spark, folder))
    clean = catalog.clean(spark, folder)
    rows = clean.count()
    run("rule_signal", lambda: spend(rule_signal.rule_signal(clean)))
    run("time_signal", lambda: spend(time_signal.time_signal(clean, filled=True)))
    run("text_signal", lambda: spend(text_signal.semantic_signal(clean)))
    run("fast_audit", lambda: spend(audit_fast(clean)))
    run("full_labeling", lambda: spend(label_tickets(clean)))
    run("stage_audited", lambda: catalog.audited(spark, folder))
    run("stage_labeled", lambda: catalog.labeled(spark, folder))
    audited = catalog.audited(spark, folder)
    labeled = catalog.labeled(spark, folder)
    run("evidence", lambda: spend(evidence.evidence_records(audited)))
    run("summary", lambda: fusion.label_summary(labeled).collect())
    run("pairwise_agreement", lambda: fusion.pairwise_agreement(labeled).collect())
    run("mismatch_rate", lambda: breakdowns.mismatch_rate_by_priority(audited).collect())
    run("priority_matrix", lambda: breakdowns.priority_matrix(audited).collect())
    run("hours_box", lambda: breakdowns.hours_box_by(audited, "inferred_severity").collect())
    run("histogram", lambda: profiling.histogram(audited, "resolution_hours", 50).collect())
    run("describe", lambda: profiling.describe_all(clean).collect())
    run("vocabulary", lambda: spend(vocabulary(clean)))
    run("split", lambda: spend(splitting.stratified_split(labeled.select("ticket_id", "label"))))

    parts = splitting.stratified_split(labeled.drop("rule_features"))
    fitted = []
    run("train_text_model", lambda: fitted.append(classify.fit_text_model(parts.where("split = 'train'").drop("split"))))
    run("audit_with_model", lambda: spend(audit_batch(raw, fitted[0], "baseline").records))

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "tickets": rows,
                "tickets_per_sec": {n: round(rows / took[n]) for n in ("rule_signal", "fast_audit", "full_labeling", "audit_with_model")},
            }
        )
    )


if __name__ == "__main__":
    main()
