"""A small rule base: detection patterns, techniques, playbooks, services and their relations.

Sites load their own from files (``sources.tables.read_knowledge_base``); this one lets
the enrichment operators run without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# id, name, severity, event names, techniques, playbooks, indicators {feature: (threshold, direction)}
PATTERNS = [
    ("IOC-IAM-001", "New credentials created", "High", ["CreateUser", "CreateAccessKey"],
     ["T1098", "T1136"], ["IR-IAM-002"],
     {"iam_write_events": (0.5, "above"), "iam_write_ratio": (0.3, "above"), "after_hours_ratio": (0.5, "above")}),
    ("IOC-IAM-002", "Account enumeration", "Medium", ["ListUsers", "ListRoles"],
     ["T1087"], ["IR-IAM-004", "IR-ENUM-001"],
     {"iam_list_events": (1.0, "above"), "iam_ratio": (0.4, "above")}),
    ("IOC-S3-001", "Mass object download", "Critical", ["GetObject"],
     ["T1530"], ["IR-S3-001"],
     {"s3_get_events": (1.0, "above"), "s3_get_events_zscore": (1.0, "above"), "s3_get_slope_3d": (0.4, "above")}),
    ("IOC-S3-002", "Upload to foreign bucket", "High", ["PutObject"],
     ["T1537"], ["IR-S3-002"],
     {"write_ratio": (0.6, "above"), "bytes_out_total": (1000.0, "below")}),
    ("IOC-DESTRUCT-001", "Mass deletion", "Critical", ["DeleteObject", "DeleteBucket"],
     ["T1485"], ["IR-DESTRUCT-001"],
     {"s3_delete_events": (0.5, "above"), "delete_ratio": (0.5, "above"), "error_rate": (0.4, "above")}),
    ("IOC-BEHAV-001", "Unusual volume", "Low", [],
     ["T1078"], ["IR-IAM-001"],
     {"total_events_zscore": (1.5, "above"), "unseen_signal": (1.0, "above")}),
    ("IOC-BEHAV-002", "Quiet off-hours access", "Low", ["ConsoleLogin"],
     ["T1078"], [],
     {"after_hours_ratio": (0.9, "above"), "total_events_zscore": (0.0, "below")}),
]
# id, name, tactics
TECHNIQUES = [
    ("T1078", "Valid Accounts", ["defense-evasion", "persistence"]),
    ("T1087", "Account Discovery", ["discovery"]),
    ("T1098", "Account Manipulation", ["persistence"]),
    ("T1136", "Create Account", ["persistence"]),
    ("T1485", "Data Destruction", ["impact"]),
    ("T1530", "Data from Cloud Storage", ["collection"]),
    ("T1537", "Transfer Data to Cloud Account", ["exfiltration"]),
]
# id, name, triage questions, containment (action, command)
PLAYBOOKS = [
    ("IR-IAM-001", "Account review", ["Is the account in use?"], [("Rotate keys", "iam update-access-key")]),
    ("IR-IAM-002", "Credential containment", ["Who asked for the key?", "Is it in use?"],
     [("Disable key", "iam update-access-key --status Inactive"), ("Remove user", "iam delete-user")]),
    ("IR-IAM-004", "Enumeration response", ["Is this a scan?"], [("Limit role", "iam put-role-policy")]),
    ("IR-ENUM-001", "Discovery response", ["Which calls failed?"], [("Block address", "wafv2 update-ip-set")]),
    ("IR-S3-001", "Download response", ["Which objects?", "Which address?"],
     [("Deny bucket", "s3api put-bucket-policy")]),
    ("IR-S3-002", "Upload response", ["Which account?"], [("Block copy", "s3api put-bucket-policy")]),
    ("IR-DESTRUCT-001", "Deletion response", ["Are versions kept?"], [("Restore", "s3api restore-object")]),
]
SERVICES = [("IAM", "Critical"), ("S3", "High"), ("EC2", "Medium")]
# technique -> technique
ENABLES = [("T1078", "T1087"), ("T1087", "T1098"), ("T1098", "T1530"), ("T1136", "T1098"), ("T1530", "T1537"),
           ("T1530", "T1485")]
# technique -> service
AFFECTS = [("T1078", "IAM"), ("T1087", "IAM"), ("T1098", "IAM"), ("T1136", "IAM"), ("T1485", "S3"),
           ("T1530", "S3"), ("T1537", "S3"), ("T1537", "EC2")]


def edge_rows() -> list[tuple]:
    """(source id, target id, type) with ids of the form ``Type:key``."""
    out = [(f"MITRETechnique:{t}", f"DetectionPattern:{p[0]}", "DETECTED_BY") for p in PATTERNS for t in p[4]]
    out += [(f"DetectionPattern:{p[0]}", f"Playbook:{b}", "TRIGGERS") for p in PATTERNS for b in p[5]]
    out += [(f"MITRETechnique:{a}", f"MITRETechnique:{b}", "ENABLES") for a, b in ENABLES]
    out += [(f"MITRETechnique:{a}", f"AWSService:{b}", "AFFECTS") for a, b in AFFECTS]
    return out


def node_rows() -> list[tuple]:
    """(id, type, key, label, name)."""
    out = [(f"DetectionPattern:{p[0]}", "DetectionPattern", p[0], p[1], p[1]) for p in PATTERNS]
    out += [(f"MITRETechnique:{t[0]}", "MITRETechnique", t[0], t[0], t[1]) for t in TECHNIQUES]
    out += [(f"Playbook:{p[0]}", "Playbook", p[0], p[0], p[1]) for p in PLAYBOOKS]
    out += [(f"AWSService:{s[0]}", "AWSService", s[0], s[0], s[0]) for s in SERVICES]
    return out


def patterns(spark: SparkSession) -> DataFrame:
    rows = [(i, n, s, e, t, b, {f: {"threshold": x, "direction": d} for f, (x, d) in ind.items()})
            for i, n, s, e, t, b, ind in PATTERNS]
    return spark.createDataFrame(
        rows, "pattern_id string, name string, severity string, event_names array<string>, "
              "techniques array<string>, playbooks array<string>, "
              "indicators map<string,struct<threshold:double,direction:string>>")


def techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "technique_id string, name string, tactics array<string>")


def playbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLAYBOOKS, "playbook_id string, name string, triage_questions array<string>, "
                   "containment array<struct<action:string,cli:string>>")


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICES, "service_name string, sensitivity string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), "src string, dst string, type string")


def nodes(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(node_rows(), "id string, type string, key string, label string, name string")
    return rows.select("id", "type", "key", "label", F.create_map(F.lit("name"), F.col("name")).alias("props"))
