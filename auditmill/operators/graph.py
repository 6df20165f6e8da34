"""The property graph as two tables, and queries over it.

``nodes(id, type, key, label, props)`` and ``edges(src, dst, type, ...)`` with ids ``Type:key``.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill import vocab
from auditmill.functions.scalars import any_contains, ts_text
from auditmill.session import materialize

SEARCH_TYPES = list(vocab.GRAPH_TYPE_BONUS)


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


# --- building ----------------------------------------------------------------


def event_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User, Event and Resource nodes, and PERFORMED and ON edges.

    The last write by (time, event id) sets the properties of a node; users are reduced
    by a partial aggregation, so a busy user is not one task's work.
    """
    user = F.coalesce(F.nullif("user_name", F.lit("")), F.lit("unknown"))
    order = F.struct("eventTime", "eventID")
    ev = events.withColumn("user", user)
    last = lambda c: F.max_by(F.coalesce(F.col(c).cast("string"), F.lit("")), order)
    users = ev.groupBy("user").agg(F.create_map(
        F.lit("user_type"), last("user_type"), F.lit("arn"), last("user_arn")).alias("props")
    ).select(node_id("User", F.col("user")).alias("id"), F.lit("User").alias("type"),
             F.col("user").alias("key"), F.col("user").alias("label"), "props")
    kept = ["eventName", "eventSource", "is_read_only", "is_error", "error_code", "sourceIPAddress",
            "is_attack", "attack_id", "attack_name"]
    event_nodes = ev.groupBy("eventID").agg(F.create_map(
        *[x for c in kept for x in (F.lit(c), last(c))]).alias("props")
    ).select(node_id("Event", F.col("eventID")).alias("id"), F.lit("Event").alias("type"),
             F.col("eventID").alias("key"), F.col("eventID").alias("label"), "props")
    resources = ev.filter("request_bucket_name is not null").select("request_bucket_name").distinct().select(
        node_id("Resource", F.col("request_bucket_name")).alias("id"), F.lit("Resource").alias("type"),
        F.col("request_bucket_name").alias("key"), F.col("request_bucket_name").alias("label"),
        F.create_map(F.lit("type"), F.lit("s3_bucket")).alias("props"))
    performed = ev.select(node_id("User", F.col("user")).alias("src"),
                          node_id("Event", F.col("eventID")).alias("dst"), F.lit("PERFORMED").alias("type"))
    on = ev.filter("request_bucket_name is not null").select(
        node_id("Event", F.col("eventID")).alias("src"),
        node_id("Resource", F.col("request_bucket_name")).alias("dst"), F.lit("ON").alias("type"))
    return users.unionByName(event_nodes).unionByName(resources), performed.unionByName(on).distinct()


def knowledge_nodes(techniques: DataFrame, services: DataFrame, patterns: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Typed nodes keyed by id; one row per id, rows without an id are dropped."""
    service_id = F.coalesce("service_id", F.upper(F.replace("service_name", F.lit(" "), F.lit("_"))))
    parts = [
        techniques.select(F.lit("MITRETechnique").alias("type"), F.col("technique_id").alias("key"), "name",
                          F.coalesce("description", F.lit("")).alias("description")),
        services.filter("service_name <> ''").select(
            F.lit("AWSService").alias("type"), service_id.alias("key"), F.col("service_name").alias("name"),
            F.coalesce("description", F.lit("")).alias("description")),
        patterns.select(F.lit("DetectionPattern").alias("type"), F.col("pattern_id").alias("key"), "name",
                        F.coalesce("description", F.lit("")).alias("description")),
        playbooks.select(F.lit("Playbook").alias("type"), F.col("playbook_id").alias("key"), "name",
                         F.lit("").alias("description")),
    ]
    rows = reduce(DataFrame.unionByName, parts).filter(F.coalesce("key", F.lit("")) != "")
    label = F.when(F.col("type").isin("DetectionPattern", "AWSService"), F.col("name")).otherwise(F.col("key"))
    one = rows.groupBy("type", "key").agg(F.max(F.struct("name", "description")).alias("v"))
    return one.select(
        F.concat_ws(":", "type", "key").alias("id"), "type", "key", F.col("v.name").alias("name"),
        F.col("v.description").alias("description"),
    ).withColumn("label", label)


def knowledge_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid relations between existing nodes; services are found by id or by name.

    A repeated edge keeps its highest confidence.
    """
    types = ["MITRETechnique", "DetectionPattern", "Playbook", "AWSService"]
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    valid = relations.filter(
        filled("source_entity") & filled("target_entity") & filled("relationship")
        & F.col("source_type").isin(types) & F.col("target_type").isin(types))
    valid = valid.select(
        "source_entity", "source_type", "target_entity", "target_type",
        F.regexp_replace(F.upper("relationship"), "[- ]", "_").alias("type"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    names = nodes.select("type", F.col("key").alias("name"), "id").unionByName(
        nodes.filter("type = 'AWSService'").select("type", "name", "id")).distinct()
    src = names.select(F.col("type").alias("source_type"), F.col("name").alias("source_entity"), F.col("id").alias("src"))
    dst = names.select(F.col("type").alias("target_type"), F.col("name").alias("target_entity"), F.col("id").alias("dst"))
    return (valid.join(src, ["source_type", "source_entity"]).join(dst, ["target_type", "target_entity"])
            .groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence")))


def window_key() -> Column:
    return F.concat_ws("_", "user_name", ts_text(F.col("window")))


def window_nodes(features: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Window nodes with features and score, and HAD_WINDOW edges."""
    s = scores.select("user_name", "window", "ensemble_score", "ensemble_pred")
    rows = features.join(s, ["user_name", "window"], "left").select(
        node_id("Window", window_key()).alias("id"), "user_name", "window", *vocab.WINDOW_NODE_FEATURES,
        "total_events", "is_attack", "attack_name",
        F.coalesce("ensemble_score", F.lit(0.0)).alias("ensemble_score"),
        F.coalesce("ensemble_pred", F.lit(0)).alias("ensemble_pred"))
    had = rows.select(node_id("User", F.col("user_name")).alias("src"), F.col("id").alias("dst"),
                      F.lit("HAD_WINDOW").alias("type"))
    return rows, had


def matches_pattern_edges(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """Event -> pattern where the pattern lists the event's name."""
    names = patterns.select("pattern_id", F.explode("event_names").alias("eventName")).distinct()
    return events.join(names, "eventName").select(
        node_id("Event", F.col("eventID")).alias("src"),
        node_id("DetectionPattern", F.col("pattern_id")).alias("dst"),
        F.lit("MATCHES_PATTERN").alias("type"), F.lit(0.9).alias("confidence")).distinct()


def indicator_hits(rows: DataFrame, keys: list[str], features: list[str], patterns: DataFrame) -> DataFrame:
    """Per (row, pattern): indicators hit, comparable and in all, and the features that hit.

    The rule base is one array that every row reads; the counts are formed inside the row, so
    nothing is shuffled.  Patterns without a hit give no row.
    """
    known = F.array(*[F.lit(f) for f in features])
    # what a rule compares is settled once for the rule base: rows only look up a place and compare two numbers
    placed = F.transform(F.map_entries("indicators"), lambda r: F.struct(
        r["key"].alias("key"), F.array_position(known, r["key"]).cast("int").alias("at"), r["value"]["threshold"].alias("limit"),
        F.coalesce(r["value"]["direction"] == "below", F.lit(False)).alias("below")))
    entry = F.struct("pattern_id", F.size("indicators").alias("total"), F.filter(placed, lambda r: r["at"] > 0).alias("rules"))
    base = patterns.agg(F.collect_list(entry).alias("base")).scalar()
    values = F.array(*[F.col(f).cast("double") for f in features])

    def is_hit(rule):
        value, limit = F.get(F.col("_values"), rule["at"] - 1), rule["limit"]
        return F.coalesce(F.when(rule["below"], value < limit).otherwise(value > limit), F.lit(False))

    def counted(p):
        return F.struct(p["pattern_id"].alias("pattern_id"), p["total"].alias("total"), F.size(p["rules"]).alias("comparable"),
                        F.filter(p["rules"], is_hit).alias("found"))

    per_row = rows.select(*keys, values.alias("_values"), base.alias("_base")).select(
        *keys, F.explode(F.filter(F.transform("_base", counted), lambda p: F.size(p["found"]) > 0)).alias("p"))
    return per_row.select(*keys, "p.pattern_id", "p.total", "p.comparable", F.size("p.found").alias("hits"),
                          F.sort_array(F.col("p.found.key")).alias("matched_features"))


def triggers_indicator_edges(windows: DataFrame, patterns: DataFrame, min_score: float = 0.5, min_hits: int = 1) -> DataFrame:
    """Window -> pattern where enough of the comparable indicators hit."""
    hits = indicator_hits(windows, ["id"], vocab.WINDOW_NODE_FEATURES, patterns)
    return hits.filter((F.col("hits") / F.col("comparable") >= min_score) & (F.col("hits") >= min_hits)).select(
        F.col("id").alias("src"), node_id("DetectionPattern", F.col("pattern_id")).alias("dst"),
        F.lit("TRIGGERS_INDICATOR").alias("type"),
        F.round(F.col("hits") / F.col("comparable"), 3).alias("match_score"), "matched_features")


def anomalous_for_edges(windows: DataFrame) -> DataFrame:
    return windows.filter("ensemble_pred = 1").select(
        F.col("id").alias("src"), node_id("User", F.col("user_name")).alias("dst"), F.lit("ANOMALOUS_FOR").alias("type"))


# --- statistics --------------------------------------------------------------


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges per type, with totals (type null)."""
    both = nodes.select(F.lit("node").alias("kind"), "type").unionByName(edges.select(F.lit("edge").alias("kind"), "type"))
    return (both.groupingSets([["kind", "type"], ["kind"]], "kind", "type")
            .agg(F.count(F.lit(1)).alias("count")).orderBy("kind", F.desc("count"), "type"))


def bridge_coverage(windows: DataFrame, indicator_edges: DataFrame) -> DataFrame:
    """Windows, attack windows and anomalies that have at least one pattern."""
    matched = indicator_edges.select(F.col("src").alias("id")).distinct().withColumn("m", F.lit(1))
    rows = windows.join(matched, "id", "left").withColumn("matched", F.col("m").isNotNull())

    def pair(name, cond):
        total, hit = F.sum(cond.cast("long")), F.sum((cond & F.col("matched")).cast("long"))
        return [total.alias(name), hit.alias(f"{name}_matched"),
                F.round(F.when(total > 0, 100.0 * hit / total).otherwise(F.lit(0.0)), 1).alias(f"{name}_pct")]

    return rows.agg(*pair("windows", F.lit(True)), *pair("attack_windows", F.col("is_attack")),
                    *pair("anomalies", F.col("ensemble_pred") == 1))


def top_patterns(indicator_edges: DataFrame, n: int = 3) -> DataFrame:
    return (indicator_edges.groupBy(F.col("dst").alias("pattern")).agg(F.count_distinct("src").alias("windows"))
            .orderBy(F.desc("windows"), "pattern").limit(n))


def attack_chains(windows: DataFrame, indicator_edges: DataFrame, kb_edges: DataFrame, only: str = "anomalies") -> DataFrame:
    """User -> window -> pattern -> technique / playbook rows of anomalies or attacks."""
    keep = F.col("ensemble_pred") == 1 if only == "anomalies" else F.col("is_attack")
    detected = kb_edges.filter("type = 'DETECTED_BY'").select(F.col("src").alias("technique"), F.col("dst").alias("pattern"))
    triggers = kb_edges.filter("type = 'TRIGGERS'").select(F.col("src").alias("pattern"), F.col("dst").alias("playbook"))
    return (
        windows.filter(keep).select("user_name", F.col("id").alias("window_id"))
        .join(indicator_edges.select(F.col("src").alias("window_id"), F.col("dst").alias("pattern"), "match_score"), "window_id")
        .join(detected, "pattern", "left").join(triggers, "pattern", "left"))


# --- neighbourhoods ----------------------------------------------------------


def expand_node(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 30) -> DataFrame:
    """Undirected neighbours of one node."""
    around = edges.filter((F.col("src") == node) | (F.col("dst") == node)).select(
        "src", "dst", F.col("type").alias("edge_type"),
        F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    return around.join(nodes, "id").orderBy("edge_type", "id").limit(limit)


def expand_all(edges: DataFrame) -> DataFrame:
    """The neighbourhood of every node as rows: node, neighbour, edge type, direction."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "type", F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def subgraph(windows: DataFrame, edges: DataFrame, attack_type: str = "", technique: str = "", limit: int = 30,
             overview_limit: int = 100) -> DataFrame:
    """Edges around the highest-scored windows, filtered by attack or by reachable technique.

    Without a filter hit the first ``overview_limit`` edges of the graph stand in as an overview.
    """
    picked = windows
    if attack_type:
        picked = picked.filter(F.col("attack_name") == attack_type)
    if technique:
        t = f"MITRETechnique:{technique}"
        patterns = edges.filter((F.col("type") == "DETECTED_BY") & (F.col("src") == t)).select(F.col("dst").alias("p"))
        hit = edges.filter("type = 'TRIGGERS_INDICATOR'").join(patterns, F.col("dst") == F.col("p"), "left_semi")
        picked = picked.join(hit.select(F.col("src").alias("id")), "id", "left_semi")
    top = picked.orderBy(F.desc("ensemble_score"), "id").limit(limit).select("id")
    around = edges.filter(F.col("type").isin("HAD_WINDOW", "TRIGGERS_INDICATOR", "ANOMALOUS_FOR"))
    first = around.join(top, F.col("dst") == F.col("id"), "left_semi").unionByName(
        around.join(top, F.col("src") == F.col("id"), "left_semi"))
    patterns = first.filter("type = 'TRIGGERS_INDICATOR'").select(F.col("dst").alias("p")).distinct()
    kb = edges.filter(F.col("type").isin("DETECTED_BY", "TRIGGERS"))
    second = kb.join(patterns, F.col("dst") == F.col("p"), "left_semi").unionByName(
        kb.join(patterns, F.col("src") == F.col("p"), "left_semi"))
    found = first.unionByName(second).distinct()
    empty = F.col("n") == 0
    none = found.agg(F.count(F.lit(1)).alias("n")).select(empty).scalar()
    overview = edges.select(*found.columns).orderBy("type", "src", "dst").limit(overview_limit).filter(none)
    return found.unionByName(overview)


def searchable_text(nodes: DataFrame) -> DataFrame:
    """Nodes of the searched types with their text fields in lower case."""
    props = F.col("props")
    fields = ["name", "technique_id", "attack_name", "id", "description"]
    text = F.lower(F.concat_ws(" ", "key", "label", *[F.coalesce(props[f], F.lit("")) for f in fields]))
    parts = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in (F.col("key"), F.col("label"), *[props[f] for f in fields])])
    about = F.lower(F.concat_ws(" ", F.coalesce(props["name"], F.lit("")), F.coalesce(props["description"], F.lit(""))))
    return nodes.filter(F.col("type").isin(SEARCH_TYPES)).withColumns({"text": text, "parts": parts, "about": about})


def type_bonus(kind: Column, table: dict) -> Column:
    out = F
    for name, bonus in table.items():
        out = out.when(kind == name, bonus)
    return out.otherwise(0)


def keyword_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that match a free-text query, with a relevance score; the best is the focus."""
    q = query.strip().lower()
    tokens = [t for t in q.split() if len(t) >= 2]
    keywords = [w for w in q.split() if w not in vocab.GRAPH_STOP_WORDS and len(w) > 2]
    expanded = list(dict.fromkeys(keywords + [s for w in keywords for s in vocab.GRAPH_SYNONYMS.get(w, [])]))
    rows = searchable_text(nodes)
    # a candidate holds the query in one of its fields; the joined text counts for the score only
    full = F.col("text").contains(q)
    inside = F.exists("parts", lambda p: F.contains(p, F.lit(q)))
    some = any_contains(F.col("about"), expanded) if expanded else F.lit(False)
    bonus = type_bonus(F.col("type"), vocab.GRAPH_TYPE_BONUS)
    hits = reduce(lambda a, b: a + b, [F.col("text").contains(t).cast("int") for t in tokens], F.lit(0))
    return (rows.filter(inside | some)
            .withColumn("score", F.when(full, 1000 + bonus).otherwise(bonus + 60 * hits))
            .select("id", "type", "key", "label", "score").orderBy(F.desc("score"), "id"))


def search_summary(matches: DataFrame, edges: DataFrame, top_types: int = 3, first: int = 12) -> DataFrame:
    """Matches per type (the dominant ones), the first matches and the focus with its degree."""
    per_type = matches.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(top_types)
    shown = matches.orderBy(F.desc("score"), "id").limit(first)
    focus = matches.orderBy(F.desc("score"), "id").limit(1)
    # only the focus's own edges are expanded
    near = edges.join(focus.select(F.col("id").alias("src")), "src", "left_semi").unionByName(
        edges.join(focus.select(F.col("id").alias("dst")), "dst", "left_semi"))
    degree = expand_all(near).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = [
        per_type.select(F.lit("type").alias("part"), F.col("type").alias("item"), F.col("n").alias("value")),
        shown.select(F.lit("match").alias("part"), F.col("id").alias("item"), F.col("score").cast("long").alias("value")),
        focus.join(degree, F.col("id") == F.col("node"), "left").select(
            F.lit("focus").alias("part"), F.col("id").alias("item"), F.coalesce("degree", F.lit(0)).alias("value")),
    ]
    return reduce(DataFrame.unionByName, rows)


TRACE_TARGETS = ["Playbook", "MITRETechnique", "DetectionPattern"]


def nearest_targets(nodes: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hops, target, via): the two nearest targets of every node, and the next node on the way.

    A breadth-first search from all targets at once; a target is its own nearest one, with hops 0.  Ties go
    to the smaller target, then the smaller next node.  A node that has its two leaves the search: links and
    what is known are only those of open nodes.  Each round is written to the shared folder, which
    cuts the lineage; the loop ends with the frontier, and only that emptiness test returns to the driver.
    """
    links = materialize(expand_all(edges).select("node", "neighbour").distinct(), "links")
    frontier = materialize(nodes.filter(F.col("type").isin(TRACE_TARGETS)).select(
        F.col("id").alias("node"), F.lit(0).alias("hops"), F.col("id").alias("target"),
        F.lit(None).cast("string").alias("via")), "frontier-0")
    rounds, open_nodes = [frontier], frontier.select("node", "target")
    order = Window.partitionBy("node").orderBy("target")
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        reach = (
            links.join(frontier.select(F.col("node").alias("neighbour"), "target"), "neighbour")
            .groupBy("node", "target").agg(F.min("neighbour").alias("via"))
            .join(open_nodes, ["node", "target"], "left_anti"))
        known = open_nodes.groupBy("node").agg(F.count(F.lit(1)).alias("known"))
        new = materialize(
            reach.join(known, "node", "left").withColumn("r", F.row_number().over(order) + F.coalesce("known", F.lit(0)))
            .filter(F.col("r") <= 2).select("node", F.lit(hop).alias("hops"), "target", "via", "r"), f"frontier-{hop}")
        if new.isEmpty():
            break
        closed = new.filter("r = 2").select("node").distinct()
        links = materialize(links.join(closed, "node", "left_anti"), "links")
        open_nodes = materialize(open_nodes.unionByName(new.select("node", "target")).join(closed, "node", "left_anti"), "open")
        frontier = new.drop("r")
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def trace_paths(nodes: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """For every node the nearest pattern, technique or playbook other than itself: node, hops, target, via."""
    return nearest_of(nearest_targets(nodes, edges, max_hops))


def nearest_of(found: DataFrame) -> DataFrame:
    return found.filter(F.col("target") != F.col("node")).groupBy("node").agg(
        F.min(F.struct("hops", "target", "via")).alias("b")).select("node", "b.*")


def trace_rows(nodes: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Every node's path to its nearest target as rows: start, step (from 0), node, node_type, edge_type, next.

    ``edge_type`` is that of the edge to ``next``, null at the target.  Pointer doubling: a jump leads from a
    (node, target) over a power of two of steps; the places of a path before that power give those after
    it, so all paths unfold in log2(hops) joins.
    """
    found = materialize(nearest_targets(nodes, edges, max_hops), "nearest-targets")
    steps = found.select("node", "target", "hops", "via")
    jump = steps.filter("hops >= 1").select("node", "target", "hops", F.col("via").alias("to"))
    rows = materialize(nearest_of(found).select(F.col("node").alias("start"), "target", F.lit(0).alias("step"), "node", F.col("hops").alias("left")), "places")
    longest, reach = rows.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0], 1
    while reach <= longest:
        # the nodes ``reach`` steps after every place that is known
        further = rows.filter(F.col("left") >= reach).join(jump.select("node", "target", "to"), ["node", "target"])
        rows = materialize(rows.unionByName(further.select(
            "start", "target", (F.col("step") + reach).alias("step"), F.col("to").alias("node"), (F.col("left") - reach).alias("left"))), "places")
        reach *= 2
        if reach <= longest:
            half = jump.select(F.col("node").alias("to"), "target", F.col("to").alias("end"))
            jump = materialize(jump.filter(F.col("hops") >= reach).join(half, ["to", "target"]).select("node", "target", "hops", F.col("end").alias("to")), "jumps")
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    kinds = edges.select(*pair, "type").groupBy("a", "b").agg(F.min("type").alias("edge_type"))
    onward = rows.join(steps.select("node", "target", F.col("via").alias("next")), ["node", "target"])
    onward = onward.withColumns({"next": F.when(F.col("left") > 0, F.col("next")), "a": F.least("node", "next"), "b": F.greatest("node", "next")})
    named = onward.join(kinds, ["a", "b"], "left").join(nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type")), "node", "left")
    return named.select("start", "step", "node", "node_type", F.when(F.col("left") > 0, F.col("edge_type")).alias("edge_type"), "next")


def path_of(rows: DataFrame, start: str) -> list[str]:
    """Node ids from ``start`` to its nearest target, from ``trace_rows``."""
    return [r.node for r in rows.filter(F.col("start") == start).orderBy("step").select("node").collect()]


def trace_path(traces: DataFrame, start: str) -> list[str]:
    """Node ids from ``start`` to its nearest target, by following the next nodes."""
    path, row = [start], traces.filter(F.col("node") == start).first()  # one row per step
    while row is not None:
        path.append(row.via)
        if row.hops == 1:
            return path
        row = traces.filter(F.col("node") == row.via).first()
    return []


def shared_resource_users(edges: DataFrame) -> DataFrame:
    """Per user and resource: events, and how many other users touch it (no user pairs are formed)."""
    performed = edges.filter("type = 'PERFORMED'").select(F.col("src").alias("user"), F.col("dst").alias("event"))
    on = edges.filter("type = 'ON'").select(F.col("src").alias("event"), F.col("dst").alias("resource"))
    uses = performed.join(on, "event").groupBy("user", "resource").agg(F.count(F.lit(1)).alias("events"))
    users = uses.groupBy("resource").agg(F.count(F.lit(1)).alias("users"))
    return uses.join(users, "resource").withColumn("other_users", F.col("users") - 1).drop("users")


def users_sharing_with(edges: DataFrame, user: str) -> DataFrame:
    """Users that touched a resource of ``user``."""
    performed = edges.filter("type = 'PERFORMED'").select(F.col("src").alias("user"), F.col("dst").alias("event"))
    on = edges.filter("type = 'ON'").select(F.col("src").alias("event"), F.col("dst").alias("resource"))
    uses = performed.join(on, "event").select("user", "resource").distinct()
    mine = uses.filter(F.col("user") == user).select("resource")
    return uses.join(mine, "resource", "left_semi").filter(F.col("user") != user).groupBy("user").agg(
        F.count(F.lit(1)).alias("shared"))


def resources_before(events: DataFrame, user: str, before) -> DataFrame:
    """Resources a user touched before a time."""
    return (events.filter((F.col("user_name") == user) & (F.col("eventTime") < F.lit(before))
                          & F.col("request_bucket_name").isNotNull())
            .groupBy("request_bucket_name").agg(F.count(F.lit(1)).alias("events"), F.max("eventTime").alias("last_time")))


