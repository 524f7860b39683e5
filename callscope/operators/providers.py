"""Hosts to providers: exact and longest-suffix joins, then what a call's other facts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import fixed, hosts
from callscope.functions.urls import once


def provider_hosts(spark: SparkSession) -> DataFrame:
    """Dimension (listed, is_suffix, provider); suffixes without their dot."""
    rows = [(h.removeprefix("."), h.startswith("."), p) for h, p in fixed.PROVIDER_HOSTS]
    return spark.createDataFrame(rows, "listed string, is_suffix boolean, provider string")


def join_providers(calls: DataFrame, dimension: DataFrame, host_col: str = "host", out: str = "provider") -> DataFrame:
    """Add the provider of each row's host: listed exactly, else by the longest suffix, else null.

    Each distinct host is exploded into its domains, so the join is an equi-join whatever the
    dimension's size; Spark broadcasts the dimension only below its own size threshold. A templated
    host meets suffixes only, by the labels behind its last placeholder.
    """
    one_each = calls.select(F.col(host_col).alias("_host")).filter("_host is not null and _host <> ''").distinct()
    one_each = once(one_each, F.regexp_replace(F.lower(F.col("_host")), r":\d+\z", ""), "_clean")
    plain = ~F.col("_clean").contains("{")
    one_each = once(one_each, F.when(plain, F.col("_clean")).otherwise(F.regexp_extract("_clean", r"\}\.([^}]*)\z", 1)), "_name")
    domains = one_each.select("_host", "_clean", plain.alias("_plain"), F.explode(hosts.suffixes(F.col("_name"))).alias("listed"))
    # A suffix needs a label before it, unless that is a placeholder.
    fits = F.when(F.col("is_suffix"), (F.col("listed") != F.col("_clean")) | ~F.col("_plain")).otherwise(F.col("_plain") & (F.col("listed") == F.col("_clean")))
    found = domains.join(dimension, "listed").filter(fits).groupBy("_host").agg(F.max_by("provider", F.struct(~F.col("is_suffix"), F.length("listed"), "provider")).alias(out))
    return calls.join(found, F.col(host_col) == F.col("_host"), "left").drop("_host")


def from_env_name(calls: DataFrame, names: DataFrame, env_col: str = "env_name", out: str = "env_provider") -> DataFrame:
    """Add the provider that an environment variable's name says. ``names``: (name, provider), names of letters and digits."""
    core = F.regexp_replace(F.regexp_replace(F.upper(F.col(env_col)), fixed.ENV_PREFIX, ""), fixed.ENV_SUFFIX, "")
    squeezed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    service = core.rlike(fixed.SERVICE_WORDS)
    tries = F.array(
        F.struct(F.lit(0).alias("rank"), squeezed(core).alias("name")),
        F.struct(F.lit(1).alias("rank"), F.when(service, squeezed(F.regexp_replace(core, fixed.SERVICE_WORDS, ""))).alias("name")),
        F.struct(F.lit(2).alias("rank"), F.when(service, squeezed(F.split_part(core, F.lit("_"), F.lit(1)))).alias("name")),
    )
    one_each = calls.select(F.col(env_col).alias("_env")).filter("_env is not null").distinct()
    core_of = one_each.withColumnRenamed("_env", env_col).select(F.col(env_col).alias("_env"), F.explode(tries).alias("t")).select("_env", "t.rank", "t.name")
    found = core_of.join(names, "name").groupBy("_env").agg(F.min_by("provider", "rank").alias(out))
    return calls.join(found, F.col(env_col) == F.col("_env"), "left").drop("_env")


def resolved(sdk: Column, host_kind: Column, host: Column, by_host: Column, by_env: Column, env_name: Column) -> Column:
    """Struct (provider, source): SDK, local service, internal, host table, environment name, plain host, vendor's domain, variable, unknown."""
    none = F.lit(None).cast("string")

    def say(provider: Column, source: Column = none) -> Column:
        return F.struct(provider.alias("provider"), source.alias("source"))

    plain = F.coalesce(host.rlike(fixed.PLAIN_HOST) & ~host.isin(fixed.UNSAFE_KEYS), F.lit(False))
    return (
        F.when(sdk.isNotNull(), say(sdk, F.lit("sdk")))
        .when(hosts.local_service(host).isNotNull(), say(hosts.local_service(host), F.lit("host")))
        .when((host_kind == "relative") | hosts.is_localhost(host), say(F.lit("internal")))
        .when(by_host.isNotNull(), say(by_host, F.lit("host")))
        .when(by_env.isNotNull(), say(by_env, F.lit("env-name")))
        .when(plain, say(host))
        .when(hosts.vendor_domain(host).isNotNull(), say(hosts.vendor_domain(host)))
        .when(env_name.isNotNull(), say(F.concat(F.lit("env:"), env_name)))
        .otherwise(say(F.lit("unknown")))
    )


def resolve(calls: DataFrame, dimension: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``provider`` and ``source``. ``calls``: sdk_provider, host_kind, host, env_name."""
    named = calls.withColumn("env_name", F.coalesce("env_name", F.nullif(F.regexp_extract("host", r"\{env:([^}]+)\}", 1), F.lit(""))))
    found = from_env_name(join_providers(named, dimension, out="_by_host"), names, out="_by_env")
    said = resolved(*[F.col(c) for c in ("sdk_provider", "host_kind", "host", "_by_host", "_by_env", "env_name")])
    return found.withColumn("_said", said).withColumns({"provider": F.col("_said.provider"), "source": F.col("_said.source")}).drop("_said", "_by_host", "_by_env")
