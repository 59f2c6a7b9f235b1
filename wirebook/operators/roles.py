"""Device roles: fingerprint rules, profiles, features and a classifier."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions.literals import all_of, lookup, lowest
from wirebook.operators.zones import purdue_level

FEATURES = [
    "connections_out",
    "connections_in",
    "log_packets_sent",
    "log_packets_recv",
    "interval_ms",
    "periodic",
    "uses_modbus",
    "uses_dnp3",
    "uses_s7comm",
    "uses_opc",
    "fan_out_ratio",
]
MAX_CONFIDENCE = 0.99


def _ranked(rules: list[catalog.RoleRule] | None) -> list[catalog.RoleRule]:
    """Rules best first: by confidence, an earlier rule before a later one."""
    rules = catalog.ROLE_RULES if rules is None else rules
    return sorted((r for r in rules if r.confidence > 0.0), key=lambda r: -r.confidence)


def rule_rank(protocol: Column, port: Column, function_code: Column, rules: list[catalog.RoleRule] | None = None) -> Column:
    """Rank of the best rule one observation matches, null for none."""
    ranks = []
    for rank, rule in enumerate(_ranked(rules)):
        conditions = []
        if rule.protocol is not None:
            conditions.append(F.lower(protocol) == rule.protocol.lower())
        if rule.port is not None:
            conditions.append(port == rule.port)
        if rule.function_code is not None:
            conditions.append(F.upper(function_code) == rule.function_code.upper())
        ranks.append(F.when(all_of(conditions), F.lit(rank)))
    return lowest(ranks, "int")


def _role_of(rank: Column, rules: list[catalog.RoleRule] | None) -> list[Column]:
    ranked = _ranked(rules)
    role = F.coalesce(lookup({i: r.role for i, r in enumerate(ranked)}, rank, "string"), F.lit(catalog.UNKNOWN_ROLE))
    confidence = F.coalesce(lookup({i: r.confidence for i, r in enumerate(ranked)}, rank, "double"), F.lit(0.0))
    return [role.alias("role"), confidence.alias("confidence")]


def fingerprint(
    observations: DataFrame, by: str = "ip", rules: list[catalog.RoleRule] | None = None
) -> DataFrame:
    """Role of every group of (protocol, port, function_code) observations.

    The rank of the best rule is an integer, so the aggregation is a hash
    aggregation with one row per group and map task reaching the shuffle.
    """
    protocol = F.coalesce("protocol", F.lit("tcp"))
    port = F.coalesce("port", F.lit(0))
    rank = rule_rank(protocol, port, F.col("function_code"), rules)
    best = observations.groupBy(by).agg(F.min(rank).alias("rank"))
    return best.select(by, *_role_of(F.col("rank"), rules))


def device_profiles(
    edges: DataFrame, devices: DataFrame, device_zone: DataFrame, zones: DataFrame, mode: str = "exact"
) -> DataFrame:
    """What each device speaks, with how many, and how much.

    ``exact`` counts distinct neighbours and sums all packets.  ``reference``
    counts distinct combinations of edge properties without the peer, and for
    inbound edges distinct packet counts; sums run over those.  Edges without
    a protocol do not count as outbound.  Sets are of protocols, ports and
    function codes, whose number does not grow with the data.
    """
    out = edges.where((F.col("protocol") != "") & F.col("protocol").isNotNull()).withColumnRenamed("src_ip", "ip")
    inbound = edges.where(F.col("packet_count") > 0).withColumnRenamed("dst_ip", "ip")
    if mode == "reference":
        out = out.select(
            "ip", "protocol", "port", "function_code", "packet_count", "avg_interval_ms", "is_periodic"
        ).distinct()
        inbound = inbound.select("ip", "packet_count").distinct()
        n_out, n_in = F.count("*"), F.count("*")
    elif mode == "exact":
        n_out, n_in = F.count_distinct("dst_ip"), F.count_distinct("src_ip")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # Sets are collected from distinct rows, of which a device has few; apart
    # from the numbers, which then stay in a plain hash aggregation.
    vocabulary = out.select("ip", "protocol", "port", "function_code").distinct().groupBy("ip").agg(
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
        F.sort_array(F.collect_set("port")).alias("ports"),
        F.sort_array(F.collect_set(F.when(F.col("function_code") != "", F.col("function_code")))).alias(
            "function_codes"
        ),
    )
    sent = out.groupBy("ip").agg(
        n_out.alias("connections_out"),
        F.sum("packet_count").alias("total_packets_sent"),
        F.avg(F.when(F.col("avg_interval_ms") > 0, F.col("avg_interval_ms"))).alias("avg_interval_ms"),
        F.max("is_periodic").alias("is_periodic"),
    )
    received = inbound.groupBy("ip").agg(
        n_in.alias("connections_in"), F.sum("packet_count").alias("total_packets_recv")
    )
    # One zone per device: the lowest level, then the first name.
    zone = (
        device_zone.join(zones, device_zone.zone_name == zones.name)
        .groupBy("ip")
        .agg(F.min(F.struct("purdue_level", F.col("name").alias("zone"))).alias("z"))
        .select("ip", "z.zone", F.col("z.purdue_level").alias("purdue_level"))
    )
    profile = devices.select("ip", "role")
    for part in (vocabulary, sent, received, zone):
        profile = profile.join(part, "ip", "left")
    none = F.array().cast("array<string>")
    return profile.select(
        "ip",
        F.coalesce("protocols", none).alias("protocols"),
        F.coalesce("ports", F.array().cast("array<int>")).alias("ports"),
        F.coalesce("function_codes", none).alias("function_codes"),
        *[
            F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("connections_out", "connections_in", "total_packets_sent", "total_packets_recv")
        ],
        "avg_interval_ms",
        F.coalesce("is_periodic", F.lit(False)).alias("is_periodic"),
        "zone",
        "purdue_level",
        "role",
    )


def feature_columns(profiles: DataFrame) -> DataFrame:
    """The eleven features of a profile, as columns in the order of FEATURES."""
    names = F.transform("protocols", F.lower)

    def uses(protocol: str) -> Column:
        return F.array_contains(names, protocol).cast("double")

    out, inbound = F.col("connections_out"), F.col("connections_in")
    return profiles.select(
        "*",
        F.log1p("total_packets_sent").alias("log_packets_sent"),
        F.log1p("total_packets_recv").alias("log_packets_recv"),
        F.coalesce("avg_interval_ms", F.lit(0.0)).alias("interval_ms"),
        F.col("is_periodic").cast("double").alias("periodic"),
        uses("modbus").alias("uses_modbus"),
        uses("dnp3").alias("uses_dnp3"),
        uses("s7comm").alias("uses_s7comm"),
        F.exists(names, lambda p: p.contains("opc")).cast("double").alias("uses_opc"),
        (out / F.greatest(out + inbound, F.lit(1))).alias("fan_out_ratio"),
    )


def fit(profiles: DataFrame, label: str = "label") -> PipelineModel | None:
    """Train on labelled profiles; None when there is too little to learn.

    At least two examples and two labels are needed.
    """
    # The optimizer passes over the rows many times; they are kept for that.
    labelled = feature_columns(profiles.where(F.col(label).isNotNull())).select(label, *FEATURES)
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if len(labelled.select(label).distinct().limit(2).collect()) < 2:
            return None
        return _pipeline(labelled, label).fit(labelled)
    finally:
        labelled.unpersist()


def _pipeline(labelled: DataFrame, label: str) -> Pipeline:
    indexer = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(labelled)
    stages = [
        indexer,
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=50, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted_role", labels=indexer.labels),
    ]
    return Pipeline(stages=stages)


def predict(
    profiles: DataFrame, edges: DataFrame, model: PipelineModel | None = None, port_choice: str = "pairs"
) -> DataFrame:
    """(ip, role, confidence) by the model, or by fingerprint without one."""
    if model is None:
        return predict_by_fingerprint(profiles, edges, port_choice)
    # The indexer is for training only; new rows carry no label.
    scored = PipelineModel(model.stages[1:]).transform(feature_columns(profiles))
    return scored.select(
        "ip",
        F.col("predicted_role").alias("role"),
        F.least(F.array_max(vector_to_array("probability")), F.lit(MAX_CONFIDENCE)).alias("confidence"),
    )


def _protocol_ports(profiles: DataFrame, edges: DataFrame, port_choice: str) -> DataFrame:
    """(ip, protocol, port) of every profiled device.

    ``pairs`` takes the pairs as seen on the wire; ``min`` pairs each protocol
    with the lowest port of the device.
    """
    if port_choice == "min":
        return profiles.select(
            "ip",
            F.explode("protocols").alias("protocol"),
            F.coalesce(F.array_min("ports"), F.lit(0)).alias("port"),
        )
    if port_choice != "pairs":
        raise ValueError(f"unknown port choice {port_choice!r}")
    seen = edges.where((F.col("protocol") != "") & F.col("protocol").isNotNull())
    return seen.select(F.col("src_ip").alias("ip"), "protocol", F.coalesce("port", F.lit(0)).alias("port"))


def _rank_and_level(profiles: DataFrame, edges: DataFrame, port_choice: str) -> DataFrame:
    pairs = _protocol_ports(profiles, edges, port_choice)
    # No function code is known to a profile's protocols.
    rank = rule_rank(F.col("protocol"), F.col("port"), F.lit(None).cast("string"))
    best = pairs.groupBy("ip").agg(
        F.min(rank).alias("rank"), F.min(purdue_level(F.col("protocol"), F.col("port"))).alias("level")
    )
    return profiles.select("ip").join(best, "ip", "left")


def predict_by_fingerprint(profiles: DataFrame, edges: DataFrame, port_choice: str = "pairs") -> DataFrame:
    ranked = _rank_and_level(profiles, edges, port_choice)
    return ranked.select("ip", *_role_of(F.col("rank"), None))


def infer_roles(
    profiles: DataFrame, edges: DataFrame, model: PipelineModel | None = None, port_choice: str = "pairs"
) -> DataFrame:
    """Role, confidence and Purdue level of devices without a set role."""
    open_ = profiles.where(F.col("role").isNull() | F.col("role").isin("", catalog.UNKNOWN_ROLE))
    ranked = _rank_and_level(open_, edges, port_choice)
    level = F.coalesce("level", F.lit(catalog.DEFAULT_LEVEL)).alias("purdue_level")
    if model is None:
        return ranked.select("ip", *_role_of(F.col("rank"), None), level)
    return predict(open_, edges, model).join(ranked.select("ip", level), "ip")


def write_roles(devices: DataFrame, inferred: DataFrame) -> DataFrame:
    """Devices with inferred role, level and confidence filled in."""
    new = inferred.select(
        "ip",
        F.col("role").alias("new_role"),
        F.col("purdue_level").alias("new_level"),
        F.col("confidence").alias("new_confidence"),
    )
    joined = devices.join(new, "ip", "left")
    replace = {"role": "new_role", "inferred_purdue_level": "new_level", "role_confidence": "new_confidence"}
    return joined.select(
        *[F.coalesce(replace[c], c).alias(c) if c in replace else F.col(c) for c in devices.columns]
    )
