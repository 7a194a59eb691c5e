"""Plan checks over every registered query at the smallest scale."""

import __spark_entry__ as entry
from versarium.queries import catalog

SF = "/root/testdata/sf0.001"
# Jobs that run while they are built; their parts are checked by other queries.
EAGER = {"latest_per_key_stream", "upsert_stream", "ingest_stream", "backlog_stream", "align_stream", "upsert_versions", "cache_fill_stream", "variant_match_indexed",
         "write_partitioned", "knn_ivf", "knn_all"}


def test_no_query_pairs_everything_with_everything(spark):
    bad = {}
    for name, run in catalog.QUERIES.items():
        if name in EAGER:
            continue
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoop" in plan:
            bad[name] = "pairs"
        for line in plan.splitlines():
            if "Window [" in line and "windowspecdefinition(" in line:
                spec = line.split("windowspecdefinition(")[1]
                # a window without partition columns starts with its order
                if spec.split(",")[0].strip().endswith((" ASC NULLS FIRST", " DESC NULLS LAST", " ASC NULLS LAST")):
                    bad.setdefault(name, "global window")
    assert bad == {}


def test_every_key_has_a_twin_or_is_listed():
    without = {"embed_backlog", "extract_sections", "corpus_build"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == without
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_what_it_needs(spark):
    plan = entry.queries()["point_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "l_shipdate" not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "original", "cleaned", "removed"] and df.count() > 1


def test_duplicates_are_dropped_in_one_pass(spark):
    for name, scans in {"dup_key_first": 1, "quality_gate": 1, "corpus_quality": 2}.items():
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans, name
