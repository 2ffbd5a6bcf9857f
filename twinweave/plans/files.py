"""Registered queries over files that are written and read back, edits, displays and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinweave.functions import text
from twinweave.functions.chunks import chunk_text
from twinweave.operators import embed, extract, qubo, report
from twinweave.operators import triples as graph
from twinweave.operators.numbering import numbered
from twinweave.plans import pipelines
from twinweave.plans import standin as given
from twinweave.plans.catalogue import CHUNKS, _best, _greedy, query
from twinweave.runtime import materialise, run_folder, table
from twinweave.sources import articles, bundles, graphstore, turtle, turtle_splits


def _place(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Triples and articles as files.


@query(f"WITH {given.TRIPLES} SELECT DISTINCT s, p, o, true AS o_is_uri FROM triples")
def turtle_round_trip(spark, d):
    path = _place(spark, "turtle")
    turtle.write_turtle(given.triples(spark, d), path)
    return turtle.scan_turtle(spark, path).select("s", "p", "o", "o_is_uri")


@query("""WITH t AS (SELECT 'http://e/part_' || p_partkey AS s, 'http://e/' AS e, p_partkey, p_name, p_type, p_size, p_brand FROM part)
    SELECT 'parts' AS graph, s, e || 'name' AS p, p_name || '. "' || p_type || '"' AS o, false AS o_is_uri, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'de-AT' END AS lang, NULL AS datatype FROM t
    UNION ALL SELECT 'parts', s, e || 'size', p_size::VARCHAR, false, NULL, 'http://www.w3.org/2001/XMLSchema#integer' FROM t
    UNION ALL SELECT 'parts', s, e || 'note', E'first .\n@prefix x . ' || p_brand, false, NULL, NULL FROM t
    UNION ALL SELECT 'parts', s, e || 'next', e || 'part_' || (p_partkey + 1), true, NULL, NULL FROM t""")
def turtle_literals(spark, d):
    """Literals with languages and datatypes, written with prefixes and read back in splits."""
    part = table(spark, d, "part")
    s, none = F.concat(F.lit("http://e/part_"), F.col("p_partkey").cast("string")), F.lit(None).cast("string")
    row = lambda p, o, is_uri=False, lang=none, datatype=none: part.select(s.alias("s"), F.lit(f"http://e/{p}").alias("p"), o.alias("o"), F.lit(is_uri).alias("o_is_uri"), lang.alias("lang"), datatype.alias("datatype"))
    names = row("name", F.concat("p_name", F.lit('. "'), "p_type", F.lit('"')), lang=F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("de-AT"))
    sizes = row("size", F.col("p_size").cast("string"), datatype=F.lit(f"{turtle.XSD}integer"))
    notes = row("note", F.concat(F.lit("first .\n@prefix x . "), "p_brand"))
    links = row("next", F.concat(F.lit("http://e/part_"), (F.col("p_partkey") + 1).cast("string")), True)
    path = _place(spark, "turtle")
    turtle_splits.write_turtle(names.unionByName(sizes).unionByName(notes).unionByName(links), path, {"ex": "http://e/", "xsd": turtle.XSD})
    return turtle_splits.read_turtle(spark, path, "parts")


_ARTICLES = """a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_name || ' ' || p_partkey AS key, trim(p_type) AS title, 'http://x/' || p_partkey AS url, p_type || ' ' || p_brand AS body, p_partkey FROM part)"""


def _article_rows(spark, d):
    part = table(spark, d, "part")
    cached = part.where("p_partkey % 2 = 0").select(F.concat("p_name", F.lit(" "), "p_partkey").alias("key"), F.trim("p_type").alias("title"), F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.concat("p_type", F.lit(" "), "p_brand").alias("body"))
    pinned = part.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("key"), F.col("p_partkey").alias("pos"))
    return pinned, cached


@query(f"""WITH {_ARTICLES} SELECT p_partkey AS pos, key, CASE WHEN p_partkey % 2 = 0 THEN title ELSE 'found ' || key END AS title, CASE WHEN p_partkey % 2 = 0 THEN url ELSE 'http://y/' END AS url, CASE WHEN p_partkey % 2 = 0 THEN body ELSE 'two lines of ' || key END AS body
    FROM a WHERE p_partkey % 5 <> 3 OR p_partkey % 2 = 0""")
def fetch_documents(spark, d):
    """What the cache lacks is loaded; every fifth load finds nothing."""
    pinned, cached = _article_rows(spark, d)

    def loader(key):
        if int(key.rsplit(" ", 1)[1]) % 5 == 3:
            return None
        return {"title": f" found {key}\n", "url": "http://y/", "body": f"two lines\nof {key}"}

    return articles.fetch(pinned, cached, loader)


@query("SELECT 'part ' || p_partkey AS key, p_type || ' ' || p_brand AS body FROM part")
def article_round_trip(spark, d):
    """A file per part."""
    path = _place(spark, "articles")
    docs = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("n"), F.concat(F.lit("part "), "p_partkey").alias("key"), F.lit("http://x/").alias("url"), F.concat("p_type", F.lit(" "), "p_brand").alias("body"))
    articles.write_article_files(docs, path, "Parts")
    return articles.scan_articles(spark, path).select("key", "body")


@query("""SELECT name, type, description
    FROM (SELECT arg_min(p_brand, p_partkey) AS name, arg_min(p_type, p_partkey) AS type, arg_min(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, p_partkey) AS description
    FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS p_brand, p_type, p_name, p_partkey FROM part)
    GROUP BY lower(p_brand))""")
def entity_files(spark, d):
    """The metadata file of entities, read back."""
    k, path = F.col("p_partkey"), _place(spark, "entities")
    found = table(spark, d, "part").select(F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.lower("p_brand")).alias("name"), F.col("p_type").alias("type"), F.when(k % 3 == 0, None).otherwise(F.col("p_name")).alias("description"), k.alias("pos"))
    extract.write_entities(found, path)
    listed = spark.read.text(f"{path}/entities").select(F.col("value").alias("name"))
    return spark.read.schema("name string, type string, description string").json(f"{path}/entities_metadata").join(listed, "name", "left_semi")


# Vectors and the objective as files.


@query(f"WITH {given.NODES} SELECT graph, idx, uri, label, round(list_sum(vec), 6) AS total, len(vec)::INTEGER AS dim FROM nodes WHERE graph = 'left'")
def embedding_bundle(spark, d):
    path = _place(spark, "bundle")
    bundles.save_embeddings(given.nodes(spark, d), path)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), 6)
    return bundles.load_embeddings(spark, path, "left").select("graph", "idx", "uri", "label", total.alias("total"), F.size("vec").alias("dim"))


@query(f"""WITH {given.NODES} SELECT label, (pos - 1)::INTEGER AS pos, round(avg(v), 6) AS value
    FROM (SELECT 'rel_' || kind AS label, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM nodes) GROUP BY label, pos""")
def relation_bundle(spark, d):
    path = _place(spark, "relations")
    vectors = given.relation_vectors(spark, d).withColumn("label", F.concat(F.lit(" "), F.upper(F.replace("label", F.lit("_"), F.lit(" ")))))
    bundles.save_relations(vectors, path)
    return bundles.load_relations(spark, path).select("label", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {given.QUBO}, l AS (SELECT var, 'item_' || i || ' ↔ item_' || a AS pair FROM vars), b AS (SELECT component, u, v, coeff FROM parts
    UNION ALL SELECT component, v, u, coeff FROM parts WHERE u <> v), t AS (SELECT component, u, v, coeff FROM b
    UNION ALL SELECT 'total', u, v, sum(coeff) FROM b GROUP BY u, v) SELECT component, count(*) AS cells, round(sum(coeff), 4) AS total FROM t
    GROUP BY component""")
def qubo_files(spark, d):
    """The four matrices, read back: dense, or cell by cell where they are large."""
    v = materialise(given.variables(spark, d), "variables")
    named = qubo.labelled_variables(v, given.side(spark, d, "left"), given.side(spark, d, "right"))
    terms = materialise(qubo.components(v, given.variable_weights(spark, d, v)), "terms")
    path, out = _place(spark, "qubo"), None
    written, dense = qubo.export_matrices(terms, materialise(named, "named"), path)
    for at in written:
        if dense:
            cells = spark.read.option("header", True).option("maxColumns", 1_000_000).csv(at)
            cells = cells.select(F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in cells.columns if c != "pair"])).alias("x"))
        else:
            cells = qubo.scan_cells(spark, at).select(F.col("coeff").alias("x"))
        own = cells.where("x <> 0").agg(F.count("*").alias("cells"), F.sum("x").alias("total"))
        own = own.where("cells > 0").select(F.lit(at.rsplit("/", 1)[1]).alias("component"), "cells", F.round("total", 4).alias("total"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{given.GREEDY}, un AS (SELECT graph, idx, label FROM nodes WHERE (graph = 'left' AND idx NOT IN (SELECT i
    FROM pairs)) OR (graph = 'right' AND idx NOT IN (SELECT a
    FROM pairs))) SELECT 'item_' || i AS left_entity, 'item_' || a AS right_entity, NULL::VARCHAR AS not_aligned FROM pairs
    UNION ALL SELECT NULL, NULL, graph || ': ' || label FROM un""", recursive=True)
def report_round_trip(spark, d):
    path = _place(spark, "report")
    report.report_csv(report.alignment_report(_greedy(spark, d), given.side(spark, d, "left"), given.side(spark, d, "right")), path)
    return report.read_report(spark, path)


# Editable graphs and sessions.


def _editable(spark, d):
    """nodes(id, label, description, position) and edges(pos, source, target, relation) of nations and regions; one target is missing."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    here = F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"))
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("").alias("description"), here.alias("position"))
    nodes = nodes.unionByName(r.where("r_regionkey > 0").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("big").alias("description"), F.array(F.lit(50.0), F.lit(50.0)).alias("position")))
    edges = n.select(F.col("n_nationkey").cast("int").alias("pos"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("relation"))
    return nodes, edges


_EDITABLE = """ns AS (SELECT 'n' || n_nationkey AS id, n_name AS label, '' AS description, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'big', 50.0, 50.0 FROM region WHERE r_regionkey > 0),
    es AS (SELECT n_nationkey::INTEGER AS pos, 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'in' AS relation FROM nation)"""


@query(f"WITH {_EDITABLE} SELECT 'node' AS kind, id AS a, label AS b, description AS c, x, y FROM ns UNION ALL SELECT 'edge', source, target, relation, pos, NULL FROM es")
def graph_round_trip(spark, d):
    """A graph file by its name, exploded into nodes and edges."""
    nodes, edges = _editable(spark, d)
    folder = _place(spark, "graphs")
    graphstore.save_graph(nodes, edges, folder, "My graph", 31)
    found, drawn = graphstore.graph_tables(graphstore.load_graph(spark, folder, "My graph"))
    x = found.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("description").alias("c"), F.col("position")[0].alias("x"), F.col("position")[1].alias("y"))
    return x.unionByName(drawn.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c"), F.col("pos").cast("double").alias("x"), F.lit(None).cast("double").alias("y")))


def session_grid(spark, d):
    return graphstore.rehydrate_similarity(given.similarity(spark, d).select("i", "a"), given.similarity(spark, d, given.THRESHOLD))


@query(f"""WITH {given.CAND} SELECT 'cell' AS kind, x.k AS i, y.k AS a, coalesce(c.sim, 0.0) AS value FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k
    FROM nodes WHERE graph = 'left') x CROSS JOIN (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS k FROM nodes WHERE graph = 'right') y LEFT
    JOIN cand c ON c.i = x.idx AND c.a = y.idx UNION ALL SELECT 'weight', 1, 2, 0.5""")
def session_round_trip(spark, d):
    """The whole grid as a session, read back: one file, or lines of the grid where it is large."""
    weights = spark.createDataFrame([(1, 2, 3, 4, 0.25), (1, 2, 3, 4, 0.5)], "i int, j int, a int, b int, w double")
    path = _place(spark, "session")
    rows, columns = (given.side(spark, d, s).count() for s in ("left", "right"))
    if rows * columns <= graphstore.WHOLE:
        cells = session_grid(spark, d).select(F.expr("i div 2").alias("i"), F.expr("a div 2").alias("a"), "sim")
        graphstore.session_json(cells, weights, ["l"], ["r"]).coalesce(1).write.text(path)
        session = graphstore.scan_session(spark, path)
        found = graphstore.session_cells(session)
    else:
        place = lambda s, idx, name: numbered(given.side(spark, d, s).select(F.col("idx").alias(idx)), [idx], name)
        cells = given.similarity(spark, d, given.THRESHOLD).join(place("left", "i", "x"), "i").join(place("right", "a", "y"), "a")
        graphstore.save_session(cells.select(F.col("x").alias("i"), F.col("y").alias("a"), "sim"), rows, columns, weights, ["l"], ["r"], path)
        session, found = graphstore.load_session(spark, path)
    back = found.select(F.lit("cell").alias("kind"), "i", "a", F.col("sim").alias("value"))
    return back.unionByName(graphstore.session_weights(session).select(F.lit("weight").alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("a"), F.col("w").alias("value")))


@query(f"""WITH {_EDITABLE}, e AS (SELECT id, CASE WHEN id LIKE '%1' THEN 'New' ELSE label END AS label, CASE WHEN id LIKE '%1' OR id LIKE '%2' THEN 'edited' ELSE description END AS description, CASE WHEN id LIKE '%3' THEN 7.0 ELSE x END AS x
    FROM ns) SELECT * FROM e UNION ALL SELECT 'n99', 'Node n99', '', 50.0""")
def edit_nodes(spark, d):
    """One node added, labels and descriptions updated (a blank label is no label), some moved, unknown ids ignored."""
    nodes, _ = _editable(spark, d)
    edits = nodes.where("id like '%1' or id like '%2'").select("id", F.when(F.col("id").like("%1"), " New ").otherwise("  ").alias("label"), F.lit(" edited").alias("description"))
    edits = edits.unionByName(spark.createDataFrame([("none", "x", "y")], "id string, label string, description string"))
    moves = nodes.where("id like '%3'").select("id", F.array(F.lit(7.0), F.lit(7.0)).alias("position"))
    done = graphstore.add_node(graphstore.move_nodes(graphstore.update_nodes(nodes, edits), moves), 99, "  ")
    return done.select("id", "label", "description", F.col("position")[0].alias("x"))


@query(f"WITH {_EDITABLE} SELECT (CASE WHEN pos > 3 THEN pos - 1 ELSE pos END)::INTEGER AS pos, source, target FROM es WHERE pos <> 3")
def remove_edge(spark, d):
    """The edge at place 3 goes; places that don't exist change nothing."""
    edges = _editable(spark, d)[1]
    return graphstore.remove_edge(graphstore.remove_edge(graphstore.remove_edge(edges, 3), -1), 1000).select("pos", "source", "target")


@query("SELECT 0::BIGINT AS nodes, 0::BIGINT AS edges, 1::INTEGER AS next_id, 1::BIGINT AS relations")
def clear_graph(spark, d):
    nodes, edges = _editable(spark, d)
    none, cut, following = graphstore.clear(nodes, edges)
    return none.agg(F.count("*").alias("nodes")).join(cut.agg(F.count("*").alias("edges"))).join(graphstore.relations(edges).agg(F.count("*").alias("relations"))).select("nodes", "edges", F.lit(following).alias("next_id"), "relations")


@query(f"WITH {_EDITABLE} SELECT e.pos, x.label || ' --in--> ' || coalesce(y.label, e.target) AS line FROM es e JOIN ns x ON x.id = e.source LEFT JOIN ns y ON y.id = e.target")
def edge_lines(spark, d):
    return graphstore.edge_lines(*_editable(spark, d))


@query(f"WITH {_EDITABLE} SELECT e.pos, x.x AS x0, y.x AS x1, (x.y + y.y) / 2 AS middle FROM es e JOIN ns x ON x.id = e.source JOIN ns y ON y.id = e.target")
def edge_strokes(spark, d):
    return graphstore.edge_strokes(*_editable(spark, d)).select("pos", F.col("start")[0].alias("x0"), F.col("end")[0].alias("x1"), F.col("middle")[1].alias("middle"))


# Displays, filters, samples.


@query(f"""WITH {given.TRIPLES}, l AS (SELECT DISTINCT replace(regexp_replace(regexp_replace(s, '(?s)^.*#', ''), '(?s)^.*/', ''), '_', ' ') AS src, replace(regexp_replace(regexp_replace(o, '(?s)^.*#', ''), '(?s)^.*/', ''), '_', ' ') AS dst, replace(regexp_replace(p, '(?s)^.*/', ''), '_', ' ') AS label
    FROM triples) SELECT src AS label FROM l WHERE label = 'in region' UNION SELECT dst FROM l WHERE label = 'in region'""")
def edge_filter(spark, d):
    """The nodes that a filter on the relation keeps visible."""
    return graph.selected_nodes(*graph.visible_graph(given.triples(spark, d), text.local_name), "edge", "label", ["in region"])


@query(f"WITH {given.TRIPLES} SELECT DISTINCT s, p, o FROM triples ORDER BY s, p, o LIMIT 100")
def first_triples(spark, d):
    """The cap on raw triples: a limit is the feature."""
    return graph.first_triples(graph.distinct_triples(given.triples(spark, d).select("s", "p", "o")), 100)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY {given.MIXED.format('o_orderkey')}, o_orderkey LIMIT 10)")
def random_sample(spark, d):
    """Ten orders in a seeded order: a sampling operator."""
    return embed.seeded_sample(table(spark, d, "orders"), "o_orderkey", 10).select("o_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '-' ELSE printf('%.3f', event_id / 8.0) END AS shown FROM events")
def display_number(spark, d):
    return table(spark, d, "events").select("event_id", text.display_number(F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("event_id") / 8)).alias("shown"))


@query("SELECT page_id, trim(replace(regexp_replace(regexp_replace(url || '_', '(?s)^.*#', ''), '(?s)^.*/', ''), '_', ' '), E' \t\n\r') AS label FROM pages")
def stripped_local_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.stripped_local_name(F.concat("url", F.lit("_"))).alias("label"))


@query(f"""WITH {given.SIM}, best AS (SELECT 'left' AS graph, 'item_' || i AS label, max(sim) AS best FROM sim GROUP BY i
    UNION ALL SELECT 'right', 'item_' || a, max(sim) FROM sim GROUP BY a) SELECT graph, label, 'greedy threshold 0.30' AS reason, best FROM best
    WHERE best < {given.THRESHOLD}""")
def first_unaligned(spark, d):
    """Several tables of misses, the first of each (graph, label, reason)."""
    misses = report.threshold_misses(_best(spark, d), given.THRESHOLD, "greedy")
    return report.first_unaligned(misses, misses.withColumn("best", F.lit(0.0)), misses)


# Prompts and answers.


@query(
    f"""{CHUNKS}, places AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM (SELECT DISTINCT doc_id FROM documents)),
    pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq))::INTEGER AS pos, count(*) OVER (PARTITION BY doc_id) AS total, chunk FROM ch WHERE seq > 0 AND chunk <> '')
    SELECT doc_id, pos, 'Source: docs_' || place || ' (chunk ' || pos || '/' || total || ')' || chr(10) || 'Text: ' || chunk AS prompt FROM pieces JOIN places USING (doc_id)""",
    recursive=True,
)
def prompt_build(spark, d):
    """A prompt per chunk; a source is named by its document's place, skipped ones counted."""
    docs = table(spark, d, "documents")
    pieces = chunk_text(docs.where("text is not null"))
    total = pieces.groupBy("doc_id").agg(F.max("pos").alias("total"))
    asked = pieces.join(total, "doc_id").join(numbered(docs.select("doc_id").distinct(), ["doc_id"], "place"), "doc_id")
    return asked.select("doc_id", "pos", text.prompt("Text: {text}", F.col("chunk"), pipelines.source_id("docs", F.col("place")), F.col("pos"), F.col("total")).alias("prompt"))


@query("""SELECT n_nationkey, 0::INTEGER AS k, n_name AS canonical, ['the ' || n_name] AS aliases FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 2, n_name || ' II', [] FROM nation WHERE n_nationkey % 3 = 0""")
def parse_reconciliation(spark, d):
    """A name with an alias, a blank one, one without aliases; other answers are broken."""
    n = table(spark, d, "nation")
    answer = F.concat(F.lit('So: {"canonical_entities": [{"canonical": " '), "n_name", F.lit('", "aliases": ["the '), "n_name", F.lit('"]}, {"canonical": " "}, {"canonical": "'), "n_name", F.lit(' II"}]}'))
    broken = F.when(F.col("n_nationkey") % 3 == 1, "{\"canonical_entities\": 5").otherwise("none")
    rows = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, answer).otherwise(broken).alias("answer"))
    return extract.parse_reconciliation(rows, "n_nationkey").select("pos.n_nationkey", "pos.k", "canonical", "aliases")


@query("SELECT n_nationkey, k::INTEGER AS pos, 's' || k AS subject FROM nation CROSS JOIN range(20) g(k)")
def chunk_caps(spark, d):
    """Answers of 30 triples; the cap keeps the first 20."""
    one = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit('{"subject": "s'), k.cast("string"), F.lit('", "object": "o"}')))
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"triples": ['), F.array_join(one, ", "), F.lit("]}")).alias("answer"))
    return extract.parse_triples(rows, "n_nationkey").select("n_nationkey", "pos", "subject")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k' || event_id WHEN 1 THEN 'flat' END AS code, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'not json: ' || event_type END AS message
    FROM events""")
def error_details(spark, d):
    """An error object inside, one outside, plain text, none."""
    e = F.col("event_id") % 4
    inner = F.concat(F.lit('{"error": {"code": "k'), "event_id", F.lit('", "message": "'), "event_type", F.lit('"}}'))
    body = F.when(e == 0, inner).when(e == 1, F.concat(F.lit('{"code": "flat", "message": "'), "event_type", F.lit('"}'))).when(e == 2, F.concat(F.lit("not json: "), "event_type"))
    return table(spark, d, "events").select("event_id", text.error_details(body).alias("x")).select("event_id", "x.code", "x.message")


@query("SELECT p_partkey AS doc, p_name AS subject, 'is_a' AS relation, p_brand AS object FROM part WHERE p_name <> p_brand")
def dependency_attributes(spark, d):
    """The attribute rule: "X is Y" with attr, "X remains Y" with acomp, and an attribute of a head that is an entity itself."""
    row = lambda i, head, pos, dep, lemma: F.struct(F.lit(i).alias("i"), F.lit(head).alias("head"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), lemma.alias("lemma"), lemma.alias("text"))
    s, o, w = F.col("p_name"), F.col("p_brand"), F.lit
    attr = F.array(row(0, 1, "NOUN", "nsubj", s), row(1, 1, "AUX", "ROOT", w("be")), row(2, 1, "NOUN", "attr", o))
    acomp = F.array(row(0, 1, "NOUN", "nsubj", s), row(1, 1, "VERB", "ROOT", w("remain")), row(2, 1, "ADJ", "acomp", o))
    head = F.array(row(0, 0, "NOUN", "ROOT", s), row(1, 0, "PUNCT", "punct", w(",")), row(2, 0, "NOUN", "attr", o))
    k = F.col("p_partkey") % 3
    part = table(spark, d, "part")
    span = lambda e, at, name: F.struct(F.lit(e).alias("ent_id"), F.lit(at).alias("start"), F.lit(at + 1).alias("end"), name.alias("text"))
    tokens = part.select(F.col("p_partkey").alias("doc"), F.inline(F.when(k == 0, attr).when(k == 1, acomp).otherwise(head)))
    return extract.dependency_triples(tokens, part.select(F.col("p_partkey").alias("doc"), F.inline(F.array(span(0, 0, s), span(1, 2, o)))))


@query("""SELECT n_nationkey AS doc, n_name AS subject, CASE n_nationkey % 4 WHEN 0 THEN 'take_over' WHEN 1 THEN 'is_a' WHEN 2 THEN 'is_a' ELSE 'lie_in_' || lower(r_name) END AS relation, r_name AS object
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dependency_rules(spark, d):
    """Each rule on its own sentence: a verb with particle and direct object, a copula, an appositive, a verb with preposition."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda i, head, pos, dep, lemma: F.struct(F.lit(i).alias("i"), F.lit(head).alias("head"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), lemma.alias("lemma"), lemma.alias("text"))
    s, o, w = F.col("n_name"), F.col("r_name"), F.lit
    direct = F.array(row(0, 1, "PROPN", "nsubj", s), row(1, 1, "VERB", "ROOT", w("take")), row(2, 1, "ADP", "prt", w("over")), row(3, 1, "PROPN", "dobj", o))
    copula = F.array(row(0, 3, "PROPN", "nsubj", s), row(1, 3, "AUX", "cop", w("be")), row(2, 3, "DET", "det", w("a")), row(3, 3, "NOUN", "ROOT", o))
    appositive = F.array(row(0, 0, "PROPN", "ROOT", s), row(1, 0, "PUNCT", "punct", w(",")), row(2, 3, "DET", "det", w("the")), row(3, 0, "PROPN", "appos", o))
    through = F.array(row(0, 1, "PROPN", "nsubj", s), row(1, 1, "VERB", "ROOT", w("lie")), row(2, 1, "ADP", "prep", w("in")), row(3, 2, "PROPN", "pobj", o))
    k = F.col("n_nationkey") % 4
    tokens = n.select(F.col("n_nationkey").alias("doc"), F.inline(F.when(k == 0, direct).when(k == 1, copula).when(k == 2, appositive).otherwise(through)))
    span = lambda e, at, name: F.struct(F.lit(e).alias("ent_id"), F.lit(at).alias("start"), F.lit(at + 1).alias("end"), name.alias("text"))
    return extract.dependency_triples(tokens, n.select(F.col("n_nationkey").alias("doc"), F.inline(F.array(span(0, 0, s), span(1, 3, o)))))
