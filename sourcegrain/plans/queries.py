"""The registered queries over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, limits, rules
from . import composed, corpus, declared, entities, tables

FINDING = ["method_id", "rule_id", "kind", "subject", "description", "confidence"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _analyzer(name):
    def run(spark, sf_dir):
        return rules.findings(corpus.methods(table(spark, sf_dir, "part")), name).select(*FINDING)

    return run


QUERIES = {name: _analyzer(name) for name in rules.ANALYZERS}
SQL = {name: corpus.findings_sql(name) for name in rules.ANALYZERS}


def variable_limits(spark, sf_dir):
    return limits.variable_limits(corpus.limit_methods(table(spark, sf_dir, "part"))).select("method_id", "name", "scope", "limit", "source")


def method_analyses(spark, sf_dir):
    """All rules of all analysers in one pass."""
    return rules.analyses(corpus.methods(table(spark, sf_dir, "part"))).select("analyzer", *FINDING)


def variable_usage(spark, sf_dir):
    return rules.variable_usage(corpus.methods(table(spark, sf_dir, "part")))


def execution_steps(spark, sf_dir):
    return flow.execution_steps(corpus.flow_methods(table(spark, sf_dir, "part")))


QUERIES |= {"method_analyses": method_analyses, "execution_steps": execution_steps, "variable_limits": variable_limits, "variable_usage": variable_usage}
SQL |= {"method_analyses": corpus.analyses_sql(), "execution_steps": corpus.flow_sql(), "variable_limits": corpus.limits_sql(), "variable_usage": corpus.usage_sql()}
QUERIES |= tables.QUERIES
SQL |= tables.SQL
QUERIES |= entities.QUERIES
SQL |= entities.SQL
QUERIES |= declared.QUERIES
SQL |= declared.SQL
QUERIES |= composed.QUERIES
SQL |= composed.SQL
