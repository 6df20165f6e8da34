"""Texts built from windows and the rule base, and knowledge lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditmill import schema, vocab
from auditmill.functions.scalars import any_contains, fixed, ts_text
from auditmill.operators.embedding import TextModel
from auditmill.operators.graph import type_bonus
from auditmill.operators.knn import MetricIndex, knn_join
from auditmill.session import materialize


def _count(c: str) -> Column:
    return F.col(c).cast("long").cast("string")


def window_summary_text(window_length: str = "5 minutes") -> Column:
    """A sentence per feature row."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("User "), "user_name", F.lit(" at "), ts_text(F.col("window"))),
        F.concat(F.lit("performed "), _count("total_events"), F.lit(f" total events in {window_length}.")),
        F.concat(F.lit("S3 GetObject: "), _count("s3_get_events"), F.lit(" (z-score="),
                 fixed(F.col("s3_get_events_zscore"), 1), F.lit(").")),
        F.concat(F.lit("IAM writes: "), _count("iam_write_events"), F.lit(". IAM list ops: "), _count("iam_list_events"), F.lit(".")),
        F.concat(F.lit("S3 deletes: "), _count("s3_delete_events"), F.lit(". Errors: "), _count("error_events"), F.lit(".")),
        F.concat(F.lit("Bytes transferred out: "), fixed(F.col("bytes_out_total"), 0), F.lit(".")),
        F.concat(F.lit("Overall volume z-score: "), fixed(F.col("total_events_zscore"), 1), F.lit(".")),
        F.concat(F.lit("3-day S3 GET slope: "), fixed(F.col("s3_get_slope_3d"), 2), F.lit(".")),
        F.concat(F.lit("Time context: "), F.when(F.col("window_is_business_hours") == 1, "business hours").otherwise("off hours"),
                 F.lit(", "), F.when(F.col("window_is_weekend") == 1, "weekend").otherwise("weekday"), F.lit(".")),
        F.concat(F.lit("Label: "), "attack_name", F.lit(".")))


def incident_documents(features: DataFrame, window_length: str = "5 minutes") -> DataFrame:
    """Documents of the attack windows: id, text and flat metadata."""
    signals = [F.concat(F.lit(f"* {c} = "), fixed(F.col(c), 2)) for c in ("total_events_zscore", "s3_get_slope_3d", "after_hours_ratio")]
    signals += [F.concat(F.lit(f"* {c} = "), _count(c)) for c in ("iam_write_events", "iam_list_events", "s3_get_events", "s3_delete_events")]
    text = F.concat(window_summary_text(window_length), F.lit("\n\nAnomaly Signals:\n"), F.concat_ws("\n", *signals),
                    F.lit("\nAttack label: "), F.col("attack_name"))
    doc_id = F.concat(F.lit("inc_"), "user_name", F.lit("_"), ts_text(F.col("window")))
    meta = ["user_name", "attack_name", "attack_id", "total_events", "s3_get_events", "iam_write_events", "iam_list_events",
            "s3_delete_events", "total_events_zscore", "s3_get_slope_3d", "after_hours_ratio"]
    return features.filter("is_attack").select(
        F.substring(F.translate(doc_id, " :", "_-"), 1, 128).alias("id"), F.lower(F.trim(text)).alias("document"),
        F.struct(*meta, ts_text(F.col("window")).alias("window"), F.lit("incident").alias("document_type")).alias("metadata"))


# --- rule base documents -----------------------------------------------------


def _list(c, sep=", ", n: int | None = None) -> Column:
    items = F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))
    return F.array_join(F.slice(items, 1, n) if n else items, sep)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _documents(df: DataFrame, key: str, prefix: str, kind: str, text: Column) -> DataFrame:
    return df.filter(_text(key) != "").select(
        F.concat(F.lit(f"{prefix}_"), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.lower(F.trim(text)).alias("document"))


def technique_documents(df: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("MITRE "), "technique_id", F.lit(": "), _text("name"), F.lit(". Tactics: "), _list("tactics"), F.lit(". Platforms: "),
        _list("platforms"), F.lit(". "), _text("description"), F.lit(" CloudTrail events: "),
        _list(F.col("aws_indicators.cloudtrail_events"), n=5), F.lit(". Enables: "), _list("enables"), F.lit("."))
    return _documents(df, "technique_id", "mitre", "technique", text)


def pattern_documents(df: DataFrame) -> DataFrame:
    rules = F.array_sort(F.transform(F.map_entries("behavioral_indicators"), lambda e: F.concat(
        e["key"], F.when(e["value"]["direction"] == "above", ">").otherwise("<"), fixed(e["value"]["threshold"], 2))))
    text = F.concat(
        F.lit("Detection Pattern: "), _text("name"), F.lit("\n\nSeverity: "), _text("severity"), F.lit("\n\nDescription:\n"),
        F.coalesce(F.nullif("embedding_description", F.lit("")), _text("description")), F.lit("\n\nBehavioral Indicators:\n"),
        _list(rules, " "), F.lit("\n\nMITRE Techniques:\n"), _list("techniques_detected"), F.lit("\n\nPlaybooks Triggered:\n"),
        _list("triggers_playbook"), F.lit("\n\nUser Context: "), F.coalesce("user_context.persona_note", F.lit("")))
    return _documents(df, "pattern_id", "dp", "detection_pattern", text)


def playbook_documents(df: DataFrame) -> DataFrame:
    steps = F.transform("response_phases.investigate", lambda s: s["step"])
    actions = F.size(F.coalesce("response_phases.containment", F.array().cast("array<struct<action:string,cli:string>>")))
    text = F.concat(
        F.lit("Playbook: "), _text("name"), F.lit("\n\nPlaybook ID: "), "playbook_id", F.lit("\n\nIncident Types: "),
        _list("incident_types"), F.lit("\n\nMITRE Techniques Addressed: "), _list("techniques_addressed"),
        F.lit("\n\nTriage Questions: "), _list("triage_questions", " ", 3), F.lit("\n\nInvestigation Steps: "), _list(steps, " ", 2),
        F.lit("\n\nContainment Actions: "), actions.cast("string"), F.lit(" available."))
    return _documents(df, "playbook_id", "pb", "playbook", text)


def service_documents(df: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("AWS Service: "), "service_name", F.lit("\n\nSecurity Sensitivity: "), _text("security_sensitivity"),
        F.lit("\n\nDescription:\n"), _text("description"), F.lit("\n\nSensitive Operations:\n"), _list("sensitive_operations", n=6),
        F.lit("\n\nDetection Focus:\n"), _list("detection_focus", " ", 3), F.lit("\n\nRelated MITRE Techniques:\n"), _list("related_techniques"))
    return _documents(df, "service_name", "svc", "aws_service", text)


def knowledge_documents(techniques: DataFrame, patterns: DataFrame, playbooks: DataFrame, services: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [technique_documents(techniques), pattern_documents(patterns),
                                          playbook_documents(playbooks), service_documents(services)])


# --- vectors and collections -------------------------------------------------


def embed_text(df: DataFrame, text: str, size: int = 256, encoder=None) -> DataFrame:
    """Add ``vector``: hashed term frequencies of unit length, or what ``encoder`` gives.

    ``encoder`` is a fitted ``TextModel``, or a function of a string column, such as a ``pandas_udf``
    around a model.
    """
    if isinstance(encoder, TextModel):
        return encoder.embed(df, text)
    if encoder is not None:
        return df.withColumn("vector", encoder(F.col(text)))
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("vector", vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def upsert_collection(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by id: new ones replace existing ones."""
    one = new.groupBy("id").agg(F.max(F.struct(*[c for c in new.columns if c != "id"])).alias("v")).select("id", "v.*")
    kept = existing.join(one.select("id"), "id", "left_anti")
    return kept.unionByName(one.select(*existing.columns))


def semantic_search(queries: DataFrame, collections: dict[str, DataFrame | MetricIndex], n: int = 5) -> DataFrame:
    """The best ``n`` documents per query over all collections, similarity ``1 / (1 + d)``.

    A collection is a table of id and vector, or an index of it that was fitted with ``cosine``.
    """
    parts = [
        knn_join(queries, docs, n, metric="cosine").withColumn("collection", F.lit(name))
        for name, docs in collections.items()]
    both = reduce(DataFrame.unionByName, parts).withColumn("similarity", F.round(1.0 / (1.0 + F.col("distance")), 3))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "collection", "neighbor_id")
    return (both.drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .select("query_id", "collection", F.col("neighbor_id").alias("document_id"), "similarity", "rank"))


def collection_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))


def search_summary_json(results: DataFrame, documents: DataFrame, collection: str = "all") -> DataFrame:
    """One JSON document per query with its results, best first."""
    rows = results.join(documents.select(F.col("id").alias("document_id"), "collection", "document"), ["document_id", "collection"])
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("document").alias("content"), "collection", "similarity"))).alias("results"))
    return listed.select("query_id", F.to_json(F.struct(
        F.col("query_id").alias("query"), F.lit(collection).alias("collection"), F.size("results").alias("result_count"), "results")).alias("json"))


def grounding_context(results: DataFrame, documents: DataFrame, nodes: DataFrame | None = None,
                      edges: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One context text per query: source headers and texts cut to 600 characters for display.

    ``nodes(query_id, rank, type, name, description)`` and ``edges(query_id, rank, src, type,
    dst)`` are the subgraph of each query; the first 15 and 10 are listed.
    """
    def texts(df, line, limit, sep, name):
        top = df.filter(F.col("rank") <= limit).groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
        return top.select("query_id", F.array_join(F.transform("l", lambda r: r["t"]), sep).alias(name))

    rows = results.join(documents.select(F.col("id").alias("document_id"), "source", "technique_id", "document"), "document_id")
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), "source",
                    F.when(_text("technique_id") != "", F.concat(F.lit(" | "), "technique_id", F.lit("]"))).otherwise(F.lit("]")))
    out = texts(rows, F.concat(head, F.lit("\n"), F.substring("document", 1, 600)), n, "\n\n", "sources")
    extra = []
    if nodes is not None:
        line = F.concat(F.lit("  - ["), "type", F.lit("] "), "name", F.lit(": "), F.substring("description", 1, 200))
        out = out.join(texts(nodes, line, 15, "\n", "entities"), "query_id", "left")
        extra.append(F.coalesce("entities", F.lit("No graph entities found.")))
    if edges is not None:
        line = F.concat(F.lit("  - "), "src", F.lit(" --["), "type", F.lit("]--> "), "dst")
        out = out.join(texts(edges, line, 10, "\n", "relations"), "query_id", "left")
        extra.append(F.coalesce("relations", F.lit("No relationships found.")))
    return out.select("query_id", F.concat_ws("\n\n", "sources", *extra).alias("context"))


# --- questions ---------------------------------------------------------------


def extract_entities(text: Column) -> Column:
    """Distinct technique, playbook and pattern ids, in upper case and sorted."""
    up = F.upper(text)
    found = [F.regexp_extract_all(up, F.lit(p), F.lit(0)) for p in (vocab.TECHNIQUE_ID, vocab.PLAYBOOK_ID, vocab.PATTERN_ID)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def question_keywords(text: Column) -> Column:
    """Words of more than three letters that are not stop words, in order."""
    words = F.split(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"\s+")
    stop = F.array(*[F.lit(w) for w in vocab.QUESTION_STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


GRAM = 4


def grams(text: Column) -> Column:
    """The distinct pieces of ``GRAM`` letters, the text itself where it is shorter."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM))))


class GramIndex:
    """Stored posting rows of the pieces of texts, for exact substring search.

    ``nodes(id, type, text)`` in lower case; nodes without an id or text are not found.  The postings hold ids
    only, one row for each (piece, node), so a frequent piece is many rows and no long list.
    """

    def __init__(self, nodes: DataFrame):
        self.nodes = materialize(nodes.select("id", "type", "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull()), "gram-nodes")
        self.postings = materialize(self.nodes.select(F.explode(grams(F.col("text"))).alias("gram"), "id").distinct(), "gram-postings")
        self.lengths = materialize(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-lengths")

    def find(self, terms: DataFrame) -> DataFrame:
        """(term, id, type) of the nodes that contain each distinct ``term`` of at least ``GRAM`` letters.

        A term is looked up by its rarest piece; one with a piece that no text holds is found nowhere.
        """
        asked = terms.select("term").distinct().filter(F.length("term") >= GRAM).withColumn("pieces", grams(F.col("term")))
        known = asked.select("term", F.size("pieces").alias("of"), F.explode("pieces").alias("gram")).join(self.lengths, "gram")
        rarest = known.groupBy("term").agg(
            F.min(F.struct("n", "gram")).alias("r"), F.count(F.lit(1)).alias("held"), F.first("of").alias("of")).filter("held = of")
        at = rarest.select("term", F.col("r.gram").alias("gram")).join(self.postings, "gram").select("term", "id").distinct()
        return at.join(self.nodes, "id").filter(F.col("text").contains(F.col("term"))).select("term", "id", "type").distinct()


def entity_focus(questions: DataFrame, nodes: DataFrame | GramIndex, max_terms: int | None = None, per_term: int | None = None) -> DataFrame:
    """Best node per question over the nodes that contain one of its terms.

    ``questions(question_id, text)``; ``nodes(id, type, text)`` in lower case, or their index.  Each distinct
    list of terms is answered once, whatever the number of questions that have it, and each distinct
    term searched once.  ``max_terms`` and ``per_term`` limit the terms of a question and the nodes of a
    term; without them all count.  Questions without a hit give no row.
    """
    index = nodes if isinstance(nodes, GramIndex) else GramIndex(nodes)
    all_terms = F.concat(F.transform(extract_entities(F.col("text")), F.lower), question_keywords(F.col("text")))
    if max_terms is not None:
        all_terms = F.slice(all_terms, 1, max_terms)
    asked = questions.select("question_id", all_terms.alias("terms")).withColumn("list_id", F.sha2(F.to_json("terms"), 256))
    lists = materialize(asked.groupBy("list_id").agg(F.first("terms").alias("terms")), "term-lists")
    rows = lists.select("list_id", F.posexplode("terms").alias("pos", "term"))
    hits = index.find(rows)
    if per_term is not None:
        order = Window.partitionBy("term").orderBy("id")
        hits = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_term)
    found = rows.join(hits, "term").groupBy("list_id", "id", "type").agg(F.min("pos").alias("pos"))
    best = F.max_by(F.struct("id", "type"), F.struct(type_bonus(F.col("type"), vocab.FOCUS_PRIORITY), -F.col("pos")))
    answers = found.groupBy("list_id").agg(F.count(F.lit(1)).alias("candidates"), best["type"].alias("focus_type"))
    return asked.select("question_id", "list_id").join(answers, "list_id").select("question_id", "candidates", "focus_type")


def classify_query(text: Column) -> Column:
    """The kind of question; the first kind with a hit wins."""
    t = F.lower(text)
    out = F
    for kind, words in vocab.QUERY_TYPE_WORDS.items():
        out = out.when(any_contains(t, words), kind)
    return out.otherwise(vocab.QUERY_TYPE_DEFAULT)


def technique_by_id(techniques: DataFrame, technique_id: str) -> DataFrame:
    return techniques.filter(F.col("technique_id") == technique_id)


def techniques_by_tactic(techniques: DataFrame, tactic: str, limit: int = 20) -> DataFrame:
    return techniques.filter(F.exists("tactics", lambda t: F.lower(t) == tactic.lower())).orderBy("technique_id").limit(limit)


def playbook_by_id(playbooks: DataFrame, playbook_id: str) -> DataFrame:
    return playbooks.filter(F.col("playbook_id") == playbook_id)


# --- attack bundle -----------------------------------------------------------


def read_attack_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of ``{"objects": [...]}`` documents."""
    docs = spark.read.schema(f"objects array<struct<{schema.ATTACK_OBJECT}>>").option("multiLine", True).json(path)
    return docs.select(F.explode("objects").alias("o")).select("o.*")


def parse_attack_bundle(objects: DataFrame) -> DataFrame:
    """Current cloud techniques with their tactics, platforms and audit events."""
    none = F.array().cast("array<string>")
    platforms = F.array_sort(F.array_distinct(F.transform(F.coalesce("x_mitre_platforms", none), F.lower)))
    cloud = F.array(*[F.lit(p) for p in vocab.CLOUD_PLATFORMS])
    tactics = F.transform(F.filter("kill_chain_phases", lambda k: k["kill_chain_name"] == "mitre-attack"), lambda k: k["phase_name"])
    ref = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))
    text = _text("description")
    events = F.create_map(*[x for t, ev in vocab.TECHNIQUE_EVENTS.items() for x in (F.lit(t), F.array(*[F.lit(e) for e in ev]))])
    rows = objects.filter(
        (F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
        & F.arrays_overlap(platforms, cloud))
    return rows.select(
        F.coalesce(ref["external_id"], F.lit("")).alias("technique_id"), _text("name").alias("name"),
        F.when(F.length(text) > 1000, F.concat(F.substring(text, 1, 1000), F.lit("..."))).otherwise(text).alias("description"),
        F.coalesce(tactics, none).alias("tactics"), platforms.alias("platforms"),
        F.substring(_text("x_mitre_detection"), 1, 500).alias("detection"), F.coalesce(ref["url"], F.lit("")).alias("url"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
    ).withColumn("aws_indicators", F.coalesce(events[F.col("technique_id")], none)).orderBy("technique_id", "name")


def tactic_summary(techniques: DataFrame, n: int = 5) -> DataFrame:
    """Totals per platform group, enriched techniques and the most covered tactics."""
    count = lambda c: F.sum(c.cast("long"))
    totals = techniques.agg(
        F.count(F.lit(1)).alias("total"), count(F.array_contains("platforms", "aws")).alias("aws"),
        count(F.array_contains("platforms", "iaas")).alias("iaas"), count(F.size("aws_indicators") > 0).alias("with_events"),
    ).select(F.explode(F.create_map(*[x for c in ("total", "aws", "iaas", "with_events") for x in (F.lit(c), F.col(c))])).alias("item", "techniques"))
    tactics = (techniques.select(F.explode("tactics").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("techniques"))
               .orderBy(F.desc("techniques"), "item").limit(n))
    return totals.withColumn("kind", F.lit("total")).unionByName(tactics.withColumn("kind", F.lit("tactic")))
