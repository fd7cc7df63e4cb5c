"""Queries and operators that must treat all of their input."""

from catalogspark import registry


def test_every_line_is_a_fact(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    got = registry.queries()["match_ladder"](spark, sf_dir)
    assert got.count() == lines.count() == got.select("fact_id").distinct().count()


def test_sessions_stay_off_the_driver(spark, sf_dir):
    out = registry.queries()["stream_sessions"](spark, sf_dir)
    assert out.inputFiles() and all("/streams/sessions-" in f for f in out.inputFiles())
