"""The test tables, read as audit events.

Every row of ``events`` becomes one audit event; nothing is filtered or capped.
Windows in the registered queries are longer than the defaults (12 hours inside
7 days instead of 5 minutes inside an hour), because a user of the test table has a
few events per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditmill import vocab
from auditmill.functions.scalars import is_business_hours
from auditmill.session import ensure_sizes, ensure_utc, scratch_path, write_table

FINE_MINUTES = 720
CONTEXT_MINUTES = 10080


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read as it is stored."""
    ensure_sizes(ensure_utc(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attack_name(attack_id):
    out = None
    for i, name in vocab.ATTACK_NAMES.items():
        out = F.when(attack_id == i, name) if out is None else out.when(attack_id == i, name)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised, labelled events."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    names = {"view": "GetObject", "click": "ListUsers", "purchase": "PutObject",
             "signup": "CreateUser", "error": "DeleteObject"}
    name = None
    for value, mapped in names.items():
        name = F.when(kind == value, mapped) if name is None else name.when(kind == value, mapped)
    ts = F.col("ts").cast("timestamp")
    iam = kind.isin("click", "signup")
    attack = F.when(F.col("value") > 200, 1 + F.col("event_id") % 5).otherwise(F.lit(0)).cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("eventID"),
        ts.alias("eventTime"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime_str"),
        name.alias("eventName"),
        F.when(iam, "iam.amazonaws.com").otherwise("s3.amazonaws.com").alias("eventSource"),
        F.when(iam, "iam").otherwise("s3").alias("service"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_name"),
        F.lit("IAMUser").alias("user_type"),
        F.concat(F.lit("arn:aws:iam::1:user/"), F.col("user_id").cast("string")).alias("user_arn"),
        kind.isin("view", "click").alias("is_read_only"),
        (kind == "error").alias("is_error"),
        F.when(kind == "error", "AccessDenied").alias("error_code"),
        F.when(~iam, F.concat(F.lit("bucket-"), (k % 10).cast("string"))).alias("request_bucket_name"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), k.cast("string"))
        .alias("sourceIPAddress"),
        F.when(kind == "view", F.col("value") * 1024).otherwise(F.lit(0.0)).alias("bytes_transferred_out"),
        is_business_hours(ts).alias("is_business_hours"),
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"),
        attack.alias("attack_id"),
    )
    return rows.withColumns({
        "is_attack": F.col("attack_id") > 0, "attack_name": attack_name(F.col("attack_id"))})


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as nested raw records, with the irregular forms real logs have."""
    ev = table(spark, sf_dir, "events")
    kind, uid, eid = F.col("event_type"), F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    who = F.concat(F.lit("user-"), uid.cast("string"))
    null = F.lit(None).cast("string")
    name = (F.when(kind == "view", "GetObject").when(kind == "click", "ListUsers")
            .when(kind == "purchase", "PutObject").when(kind == "signup", "CreateUser")
            .otherwise("DeleteObject"))
    source = (F.when(kind == "click", "sts.amazonaws.com").when(kind == "signup", "iam.amazonaws.com")
              .when(kind == "error", "monitoring.amazonaws.com").otherwise("s3.amazonaws.com"))
    agent = (F.when(k % 5 == 0, "aws-cli/2.1 Botocore/2").when(k % 5 == 1, "Boto3/1.3")
             .when(k % 5 == 2, "Mozilla/5.0").when(k % 5 == 3, "AWS-Internal").otherwise(null))
    ip = (F.when(k % 4 == 0, F.concat(F.lit("10.1.2."), k.cast("string")))
          .when(k % 4 == 1, F.concat(F.lit("172.99.0."), k.cast("string")))
          .when(k % 4 == 2, F.concat(F.lit("192.168.0."), k.cast("string")))
          .otherwise(F.concat(F.lit("8.8.8."), k.cast("string"))))
    form = uid % 3
    identity = F.struct(
        F.when(form == 0, "IAMUser").when(form == 1, "AssumedRole").otherwise("Root").alias("type"),
        F.when(form == 1, F.concat(F.lit("AROAX:"), who)).otherwise(F.concat(F.lit("AIDA-"), who))
        .alias("principalId"),
        F.concat(F.lit("arn:aws:iam::1:"), who).alias("arn"),
        F.lit("1").alias("accountId"),
        F.concat(F.lit("AKIA"), uid.cast("string")).alias("accessKeyId"),
        F.when(form == 0, who).when(form == 1, F.lit("")).alias("userName"),
        F.when(k % 3 == 0, F.struct(
            F.struct(F.lit("Role").alias("type"), null.alias("principalId"), null.alias("arn"),
                     null.alias("accountId"), F.lit("deploy").alias("userName")).alias("sessionIssuer"),
            F.struct(null.alias("creationDate"),
                     F.when(k % 2 == 0, "true").otherwise("false").alias("mfaAuthenticated"))
            .alias("attributes"))).alias("sessionContext"),
    )
    bucket = F.concat(F.lit("bucket-"), (k % 10).cast("string"))
    request = F.when(~kind.isin("click", "signup"), F.struct(
        F.when(k % 3 == 0, bucket).when(k % 3 == 1, F.lit("")).alias("bucketName"),
        F.when(k % 3 == 1, bucket).alias("bucket"),
        F.when(k % 2 == 0, F.concat(F.lit("key-"), eid.cast("string"))).otherwise(F.lit("")).alias("key"),
        F.when(k % 2 == 1, F.concat(F.lit("obj-"), eid.cast("string"))).alias("objectKey"),
        F.when(k % 7 == 0, "logs/").alias("prefix"),
        F.when(k % 3 == 2, F.struct(F.lit("eu-west-1").alias("locationConstraint")))
        .alias("createBucketConfiguration"),
    ))
    return ev.select(
        F.lit("1.08").alias("eventVersion"),
        eid.cast("string").alias("eventID"),
        F.concat(F.lit("req-"), eid.cast("string")).alias("requestID"),
        F.when(k == 13, "not-a-time").otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("eventTime"),
        source.alias("eventSource"), name.alias("eventName"),
        F.lit("us-east-1").alias("awsRegion"), F.lit("AwsApiCall").alias("eventType"),
        ip.alias("sourceIPAddress"), agent.alias("userAgent"),
        F.when(k % 11 != 0, kind.isin("view", "click")).alias("readOnly"),
        F.when(k % 11 != 1, kind == "signup").alias("managementEvent"),
        F.lit("1").alias("recipientAccountId"),
        F.when(kind == "error", "AccessDenied").alias("errorCode"),
        F.when(kind == "error", "denied").alias("errorMessage"),
        identity.alias("userIdentity"),
        request.alias("requestParameters"),
        F.when(kind == "view", F.struct(
            F.lit(None).cast("long").alias("byteTransferredIn"),
            (F.col("value") * 100).cast("long").alias("byteTransferredOut"))).alias("additionalEventData"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label records: one per attack event."""
    ev = events(spark, sf_dir).filter("is_attack")
    return ev.select("eventID", F.col("eventTime_str").alias("eventTime"), "eventName",
                     F.col("user_name").alias("userName"), "attack_id", "attack_name", "is_attack")


_STAGES: dict = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stored output of a pipeline stage: written once per session, then read.

    Windows, scores and alerts are stage outputs that later steps read from storage;
    queries about a stage itself (such as ``feature_matrix``) compute it from the events.
    """
    ensure_sizes(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        df, path = build(), scratch_path(spark, name)
        write_table(df, path)
        _STAGES[key] = (path, df.schema)
    path, schema = _STAGES[key]
    return spark.read.schema(schema).parquet(path)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feature matrix."""
    from auditmill.operators.features import feature_matrix

    ensure_utc(spark)
    return stage(spark, sf_dir, "features", lambda: feature_matrix(
        events(spark, sf_dir), FINE_MINUTES, CONTEXT_MINUTES))


def stand_in_scores(features: DataFrame) -> dict[str, DataFrame]:
    """Deterministic scores per model, flagged at their 90th percentile."""
    from auditmill.functions.ranks import exact_percentiles

    formulas = {
        "if": F.col("total_events"),
        "lof": F.round("bytes_out_total", 2),
        "ae": F.col("unique_event_types") + F.col("write_ratio"),
    }
    out = {}
    for model, formula in formulas.items():
        rows = features.select("user_name", "window", formula.cast("double").alias(f"{model}_score"))
        cut = exact_percentiles(rows, f"{model}_score", [0.9]).select(F.col("percentiles")[0]).scalar()
        out[model] = rows.withColumn(f"{model}_pred", (F.col(f"{model}_score") >= cut).cast("int"))
    return out


def scores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stored score table of each model."""
    made: dict = {}

    def build(model):
        if not made:
            made.update(stand_in_scores(features(spark, sf_dir)))
        return made[model]

    return {m: stage(spark, sf_dir, f"scores-{m}", lambda m=m: build(m)) for m in ("if", "lof", "ae")}


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ensemble table over the stand-in scores."""
    from auditmill.operators.scoring import ensemble_scores

    def build():
        s = scores(spark, sf_dir)
        return ensemble_scores(s["if"], s["lof"], s["ae"], features(spark, sf_dir))

    return stage(spark, sf_dir, "ensemble", build)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditmill.operators.scoring import alert_table

    return alert_table(ensemble(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points; class 0 plays the attack class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label",
        (F.col("label") == 0).alias("is_attack"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The stored bridge graph: windows, indicator edges, nodes, edges."""
    from auditmill import knowledge
    from auditmill.operators import graph as gr

    windows = stage(spark, sf_dir, "graph-windows", lambda: gr.window_nodes(
        features(spark, sf_dir), ensemble(spark, sf_dir))[0])
    had = windows.select(gr.node_id("User", F.col("user_name")).alias("src"), F.col("id").alias("dst"),
                         F.lit("HAD_WINDOW").alias("type"))
    indicator = stage(spark, sf_dir, "graph-indicator-edges", lambda: gr.triggers_indicator_edges(
        windows, knowledge.patterns(spark)))

    def nodes():
        props = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
        win = windows.select("id", F.lit("Window").alias("type"), F.expr("substr(id, 8)").alias("key"),
                             F.expr("substr(id, 8)").alias("label"), props(attack_name=F.col("attack_name")).alias("props"))
        users = windows.select("user_name").distinct().select(
            gr.node_id("User", F.col("user_name")).alias("id"), F.lit("User").alias("type"),
            F.col("user_name").alias("key"), F.col("user_name").alias("label"),
            props(name=F.col("user_name")).alias("props"))
        return win.unionByName(users).unionByName(knowledge.nodes(spark))

    def edges():
        return (had.unionByName(indicator.select("src", "dst", "type"))
                .unionByName(gr.anomalous_for_edges(windows)).unionByName(knowledge.edges(spark)))

    return (windows, indicator, stage(spark, sf_dir, "graph-nodes", nodes), stage(spark, sf_dir, "graph-edges", edges))


def kb_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The dimension tables read as a rule base: nations are techniques, regions services,
    suppliers patterns and parts playbooks."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    technique = F.concat(F.lit("T"), (1000 + F.col("n_nationkey")).cast("string"))
    pattern = lambda c: F.concat(F.lit("IOC-SUP-"), text(c))
    playbook = lambda c: F.concat(F.lit("IR-PART-"), text(c))
    nation, region, supplier, part = t("nation"), t("region"), t("supplier"), t("part")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    severity = F.when(F.col("s_acctbal") > 8000, "Critical").when(F.col("s_acctbal") > 4000, "High").otherwise("Low")

    def relation(df, src, st, rel, dst, dt, conf):
        return df.select(src.alias("source_entity"), F.lit(st).alias("source_type"), F.lit(rel).alias("relationship"),
                         dst.alias("target_entity"), F.lit(dt).alias("target_type"), conf.cast("double").alias("confidence"))

    sup = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("c"))
    relations = (
        relation(sup, technique, "MITRETechnique", "detected-by", pattern("s_suppkey"), "DetectionPattern", F.lit(None))
        .unionByName(relation(sold, pattern("l_suppkey"), "DetectionPattern", "triggers", playbook("l_partkey"), "Playbook", F.col("c")))
        .unionByName(relation(both, technique, "MITRETechnique", "Affects", F.concat(F.lit("Zone "), "r_name"), "AWSService", F.lit(0.8)))
        .unionByName(relation(nation, technique, "MITRETechnique", "often enables",
                              F.concat(F.lit("T"), (1005 + F.col("n_nationkey")).cast("string")), "MITRETechnique", F.lit(0.7)))
        .unionByName(relation(t("customer"), pattern("c_custkey"), "Customer", "buys", playbook("c_custkey"), "Playbook", F.lit(0.1))))
    return {
        "techniques": both.select(technique.alias("technique_id"), F.col("n_name").alias("name"),
                                  F.array(F.lower("r_name"), F.concat(F.lit("tactic-"), (F.col("n_nationkey") % 3).cast("string"))).alias("tactics"),
                                  F.array(F.when(F.col("n_nationkey") % 2 == 0, "AWS").otherwise("Linux"), F.lit("IaaS")).alias("platforms"),
                                  F.concat(F.lit("Seen in "), "r_name").alias("description")),
        "services": region.select(F.concat(F.lit("Zone "), "r_name").alias("service_name"),
                                  F.when(F.col("r_regionkey") % 2 == 1, F.concat(F.lit("Z"), text("r_regionkey"))).alias("service_id"),
                                  none.alias("description"), F.lit("High").alias("security_sensitivity")),
        "patterns": supplier.select(pattern("s_suppkey").alias("pattern_id"), F.col("s_name").alias("name"), severity.alias("severity"),
                                    F.concat(F.lit("Balance "), F.col("s_acctbal").cast("string")).alias("description")),
        "playbooks": part.select(playbook("p_partkey").alias("playbook_id"), F.col("p_name").alias("name")),
        "relations": relations,
    }
