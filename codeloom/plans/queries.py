"""The registered queries: each operator over whole tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph, index, lookup, packing, refs, resolve, vote
from codeloom.sources import facts
from codeloom.sources.facts import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FILES = "files AS (SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path, doc_id, source, lang, text FROM documents)"
WORDS = (
    FILES
    + """, lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
 listed AS (SELECT path, line, regexp_extract_all(lower(line_text), '[a-z]+') AS w FROM lines),
 words AS (SELECT path, line, unnest(w) AS name, generate_subscripts(w, 1) AS pos FROM listed),
 defs AS (SELECT path, name, line FROM words WHERE pos = 1 AND length(name) >= 7),
 symbols AS (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) - 1 AS end_line, row_number() OVER (PARTITION BY path, name ORDER BY line) - 1 AS ordinal FROM defs),
 refs AS (SELECT path, name, line FROM words WHERE NOT (pos = 1 AND length(name) >= 7))"""
)
IMPORTS = "imports AS (SELECT src, dst FROM (SELECT path AS src, lag(path) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM files) WHERE dst IS NOT NULL)"
INDEX = """counts AS (SELECT path, name, count(*) AS n FROM refs GROUP BY ALL),
 defined AS (SELECT name, count(DISTINCT path) AS candidates FROM symbols GROUP BY name),
 spreads AS (SELECT name, count(DISTINCT path) AS spread FROM refs GROUP BY name),
 name_index AS (SELECT name, candidates, coalesce(spread, 0) AS spread FROM defined LEFT JOIN spreads USING (name))"""
EDGES = """foreign_counts AS (SELECT c.* FROM counts c SEMI JOIN defined d ON c.name = d.name ANTI JOIN symbols s ON c.path = s.path AND c.name = s.name),
 weighted AS (SELECT path AS src, name, n * CASE WHEN length(name) <= 2 THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN candidates = 1 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END / (1 + ln(1 + spread)) AS w FROM foreign_counts JOIN name_index USING (name)),
 file_edges AS (SELECT src, dst, round(sum(w), 9) AS weight FROM (
   SELECT w.src, d.path AS dst, w.w FROM weighted w JOIN (SELECT DISTINCT path, name FROM symbols) d ON w.name = d.name WHERE w.src <> d.path
   UNION ALL SELECT src, dst, 3.0::DOUBLE FROM imports) GROUP BY src, dst)"""
TRADE = """trade AS (SELECT a.n_name AS src, b.n_name AS dst, round(sum(l_extendedprice * (1 - l_discount) / 1e6), 6) AS weight
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY ALL)"""
HEAVY = "heavy AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade) WHERE r <= 2)"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents")
    return facts.symbols(docs), facts.references(docs), facts.imports(docs)


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's two largest trade edges."""
    return packing.listing(facts.trade_edges(spark, sf_dir), ["src"], [F.desc("weight"), "dst"], 2).select("src", "dst")


@query(f"WITH {FILES} SELECT path, CAST(strlen(text) AS BIGINT) AS size, lang, sha256(text) AS sha256, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines, CAST(length(text) // 4 AS BIGINT) AS tokens FROM files")
def scan_files(spark, sf_dir):
    f = facts.files(read(spark, sf_dir, "documents"))
    return f.select("path", F.octet_length("text").cast("long").alias("size"), "lang", F.sha2("text", 256).alias("sha256"), packing.line_count(F.col("text")).cast("long").alias("lines"), packing.tokens(F.col("text")).cast("long").alias("tokens"))


@query(f"WITH {WORDS} SELECT 'txt:' || path || '::' || name || CASE WHEN ordinal > 0 THEN '#' || CAST(ordinal AS VARCHAR) ELSE '' END AS id, name, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line FROM symbols")
def extract_symbols(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    return s.select(refs.stable_id().alias("id"), "name", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"WITH {WORDS} SELECT path, name, CAST(ordinal AS BIGINT) AS ordinal FROM symbols")
def parse_stable_ids(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    path, name, ordinal = refs.parse_id(F.col("id"))
    return s.select(refs.stable_id().alias("id")).select(path.alias("path"), name.alias("name"), ordinal.cast("long").alias("ordinal"))


@query(f"WITH {WORDS} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT path) AS BIGINT) AS files FROM refs GROUP BY name")
def occurrence_counts(spark, sf_dir):
    _, r, _ = _facts(spark, sf_dir)
    return refs.occurrence_counts(r).groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


@query(f"WITH {WORDS}, {INDEX} SELECT name, CAST(candidates AS BIGINT) AS candidates, CAST(spread AS BIGINT) AS spread, round(1 + ln(1 + spread), 9) AS damping FROM name_index")
def name_index(spark, sf_dir):
    s, r, _ = _facts(spark, sf_dir)
    return refs.name_index(s, r).withColumn("damping", F.round(refs.damping(F.col("spread")), 9))


@query(f"WITH {WORDS} SELECT name, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT name, path FROM symbols) GROUP BY name")
def defining_paths(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    return s.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


@query(f"WITH {FILES}, {IMPORTS} SELECT src, dst FROM imports")
def import_edges(spark, sf_dir):
    return facts.imports(read(spark, sf_dir, "documents"))


@query(f"WITH {WORDS}, {IMPORTS}, {INDEX}, {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM file_edges")
def file_edges(spark, sf_dir):
    return graph.file_edges(*_facts(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _rank_sql(rounds: int) -> str:
    """The unrolled rounds of PageRank over `g` (src, dst, weight) and `nodes` (node)."""
    parts = ["outs AS (SELECT src, sum(weight) AS o FROM g GROUP BY src)", "nn AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, nn)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(m.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM outs)) / n) AS rank FROM nodes CROSS JOIN nn"
            f" LEFT JOIN (SELECT g.dst, sum(r.rank * g.weight / o) AS got FROM g JOIN outs USING (src) JOIN r{i} r ON g.src = r.node GROUP BY g.dst) m ON nodes.node = m.dst)"
        )
    return ", ".join(parts)


@query(f"WITH {TRADE}, g AS (SELECT * FROM trade), nodes AS (SELECT n_name AS node FROM nation), {_rank_sql(20)} SELECT node, round(rank, 6) AS rank FROM r20")
def pagerank_trade(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    return graph.pagerank(nodes, graph.cut(facts.trade_edges(spark, sf_dir)), iterations=20, epsilon=None).withColumn("rank", F.round("rank", 6))


@query()
def pagerank_trade_converged(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    return graph.pagerank(nodes, graph.cut(facts.trade_edges(spark, sf_dir))).withColumn("rank", F.round("rank", 6))


@query(
    f"WITH {WORDS}, {IMPORTS}, {INDEX}, {EDGES}, g AS MATERIALIZED (SELECT * FROM file_edges), nodes AS (SELECT path AS node FROM files), {_rank_sql(6)},"
    " best AS (SELECT node AS path, rank FROM r6 ORDER BY round(rank, 9) DESC, node LIMIT 10),"
    " inbound AS (SELECT s.path, s.name, s.line, (SELECT count(*) FROM refs r WHERE r.name = s.name AND r.path <> s.path) AS inbound FROM symbols s SEMI JOIN best b ON s.path = b.path),"
    " scored AS (SELECT i.*, round(rank * (1 + inbound), 6) AS score, 12 + length(i.name) AS cost FROM inbound i JOIN best USING (path)),"
    " packed AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, path, line ROWS UNBOUNDED PRECEDING) AS used FROM scored)"
    " SELECT path, name, CAST(line AS BIGINT) AS line, CAST(inbound AS BIGINT) AS inbound, score, CAST(used AS BIGINT) AS used FROM packed WHERE used <= 2000"
)
def ranked_map(spark, sf_dir):
    """ranked_map_converged after the six rounds that its SQL unrolls."""
    return _ranked_map(spark, sf_dir, iterations=6, epsilon=None, every=3)


@query()
def ranked_map_converged(spark, sf_dir):
    return _ranked_map(spark, sf_dir)


def _ranked_map(spark: SparkSession, sf_dir: str, **rank) -> DataFrame:
    """Files ranked by references, the symbols of the ten best by score, packed into a budget."""
    s, r, i = _facts(spark, sf_dir)
    nodes = facts.files(read(spark, sf_dir, "documents")).select(F.col("path").alias("node"))
    links, into = graph.file_links(s, r, i)
    ranks = graph.pagerank(nodes, links, into=into, **rank)
    best = ranks.withColumn("k", F.round("rank", 9)).orderBy(F.desc("k"), "node").limit(10).select(F.col("node").alias("path"), "rank")
    few = graph.cut(s.join(F.broadcast(best), "path"))  # ten files' ranks
    names = few.select("name").distinct()
    counts = graph.cut(refs.occurrence_counts(r).join(names, "name", "left_semi"))  # counted first: a row a word is never dealt
    total, own = counts.groupBy("name").agg(F.sum("n").alias("all")), counts.select("path", "name", F.col("n").alias("own"))
    inbound = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))
    scored = few.join(total, "name", "left").join(own, ["path", "name"], "left").select("path", "name", "line", inbound.alias("inbound"), F.round(F.col("rank") * (1 + inbound), 6).alias("score"), (F.length("name") + 12).alias("cost"))
    out = packing.pack(scored, [], [F.desc("score"), F.col("path"), F.col("line")], "cost", F.lit(2000)).where("included")
    return out.select("path", "name", F.col("line").cast("long").alias("line"), "inbound", "score", F.col("used").cast("long").alias("used"))


_TIERED = f"""WITH {WORDS}, {IMPORTS}, defined AS (SELECT DISTINCT name, path AS target FROM symbols), n AS (SELECT name, count(*) AS n FROM defined GROUP BY name),
 uses AS (SELECT DISTINCT path, name FROM refs),
 cand AS (SELECT u.path, u.name, d.target, CASE WHEN u.path = d.target THEN 0 WHEN i.src IS NOT NULL THEN 1 WHEN n.n = 1 THEN 2 ELSE 3 END AS t
   FROM uses u JOIN defined d ON u.name = d.name JOIN n ON n.name = u.name LEFT JOIN (SELECT DISTINCT src, dst FROM imports) i ON i.src = u.path AND i.dst = d.target),
 best AS (SELECT *, min(t) OVER (PARTITION BY path, name) AS m FROM cand),
 won AS (SELECT path, name, target, list_element(['same_file', 'imported', 'unique', 'ambiguous'], CAST(t + 1 AS INTEGER)) AS tier FROM best WHERE t = m)"""


@query(f"{_TIERED} SELECT path, name, tier, CAST(count(*) AS BIGINT) AS targets FROM won GROUP BY path, name, tier")
def resolve_tiers(spark, sf_dir):
    s, r, i = _facts(spark, sf_dir)
    return resolve.resolve(r, s, i)


@query(f"{_TIERED}, edges AS (SELECT path AS src, target AS dst, name, 'references' AS relation, tier FROM won WHERE path <> target UNION SELECT src, dst, '', 'imports', 'imported' FROM imports) SELECT src, relation, tier, CAST(count(*) AS BIGINT) AS edges, min(dst) AS first, max(name) AS last_name FROM edges GROUP BY ALL")
def symbol_edges(spark, sf_dir):
    s, r, i = _facts(spark, sf_dir)
    return resolve.edge_counts(r, s, i)


@query(f"{_TIERED}, node AS (SELECT min(path) AS p FROM files), edges AS (SELECT path AS src, target AS dst, name, 'references' AS relation, tier FROM won WHERE path <> target UNION SELECT src, dst, '', 'imports', 'imported' FROM imports) SELECT tier, CAST(total AS BIGINT) AS total, dst AS other, name, relation FROM (SELECT *, count(*) OVER (PARTITION BY tier) AS total, row_number() OVER (PARTITION BY tier ORDER BY dst, name, relation) AS r FROM edges, node WHERE src = p) WHERE r <= 10")
def explain_file(spark, sf_dir):
    """The tiered fan-out of the first file."""
    s, r, i = _facts(spark, sf_dir)
    node = facts.files(read(spark, sf_dir, "documents")).agg(F.min("path")).first()[0]
    return resolve.tier_groups(resolve.symbol_edges(r.where(F.col("path") == node), s, i.where(F.col("src") == node)), node, 10)


@query(f"WITH {WORDS} SELECT owner, CAST(owner_line AS BIGINT) AS owner_line, path, CAST(count(*) AS BIGINT) AS n FROM (SELECT r.path, (SELECT max(s.line) FROM symbols s WHERE s.path = r.path AND r.line >= s.line AND r.line <= coalesce(s.end_line, 1073741824)) AS owner_line FROM refs r) r LEFT JOIN (SELECT path, line AS owner_line, name AS owner FROM symbols) USING (path, owner_line) GROUP BY ALL")
def enclosing_symbols(spark, sf_dir):
    s, r, _ = _facts(spark, sf_dir)
    lines = graph.cut(r.groupBy("path", "line").agg(F.count(F.lit(1)).alias("n")))
    return refs.enclosing(lines, graph.cut(s)).groupBy("owner", F.col("owner_line").cast("long").alias("owner_line"), "path").agg(F.sum("n").alias("n"))


@query(f"WITH {WORDS} SELECT s.path, s.name, CAST(s.line AS BIGINT) AS line, CAST(count(r.line) AS BIGINT) AS sites FROM symbols s LEFT JOIN refs r ON r.name = s.name AND NOT (r.path = s.path AND r.line BETWEEN s.line AND coalesce(s.end_line, 1073741824)) GROUP BY ALL")
def references_to(spark, sf_dir):
    s, r, _ = _facts(spark, sf_dir)
    return refs.references_to(s, r).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {WORDS}, hits AS (SELECT CASE WHEN name = 'tion' THEN 0 WHEN starts_with(name, 'tion') THEN 2 ELSE 3 END AS rank, name, path, line FROM symbols WHERE contains(name, 'tion')) SELECT CAST(rank AS BIGINT) AS rank, name, path, CAST(line AS BIGINT) AS line, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY rank, name, path, line LIMIT 20")
def find_symbol(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    return refs.find(s, "tion", 20).select(F.col("rank").cast("long").alias("rank"), "name", "path", F.col("line").cast("long").alias("line"), "total")


_TARGET = "target AS (SELECT name FROM (SELECT name, count(*) AS c FROM refs SEMI JOIN symbols USING (name) GROUP BY name) ORDER BY c DESC, name LIMIT 1)"


def _target(s: DataFrame, r: DataFrame) -> str:
    """The defined name that is mentioned most."""
    found = r.groupBy("name").count().join(s.select("name").distinct(), "name", "left_semi").orderBy(F.desc("count"), "name").first()
    return found["name"] if found else ""


@query(f"WITH {WORDS}, {_TARGET}, sites AS (SELECT DISTINCT path, line FROM refs WHERE name = (SELECT name FROM target)), ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM sites) SELECT path, CAST(count(*) AS BIGINT) AS n, string_agg(CASE WHEN r <= 5 THEN CAST(line AS VARCHAR) END, ',' ORDER BY line) AS lines FROM ranked GROUP BY path")
def reference_sites(spark, sf_dir):
    s, r, _ = _facts(spark, sf_dir)
    return refs.sites_by_file(r, _target(s, r))


@query(
    f"WITH {WORDS}, {INDEX}, {_TARGET}, owned AS (SELECT r.path, r.name, r.line, (SELECT max(s.line) FROM symbols s WHERE s.path = r.path AND r.line >= s.line AND r.line <= coalesce(s.end_line, 1073741824)) AS owner_line FROM refs r),"
    " callers AS (SELECT DISTINCT path, owner_line FROM owned WHERE name = (SELECT name FROM target) AND owner_line IS NOT NULL),"
    " called AS (SELECT DISTINCT o.path, o.owner_line, o.name, x.spread FROM owned o JOIN callers USING (path, owner_line) JOIN name_index x ON x.name = o.name JOIN symbols s ON s.path = o.path AND s.line = o.owner_line WHERE o.name <> (SELECT name FROM target) AND o.name <> s.name),"
    " degree AS (SELECT path, owner_line, count(*) AS d FROM called GROUP BY ALL),"
    " per_file AS (SELECT name, path, max(1 / (1 + ln(1 + d))) AS vote, count(*) AS callers, any_value(spread) AS spread FROM called JOIN degree USING (path, owner_line) GROUP BY name, path)"
    " SELECT name AS candidate, round(sum(vote) / (1 + ln(1 + any_value(spread))), 6) AS score, CAST(count(*) AS BIGINT) AS files, CAST(sum(callers) AS BIGINT) AS callers FROM per_file GROUP BY name HAVING sum(callers) > 1"
)
def shared_callers(spark, sf_dir):
    s, r, _ = _facts(spark, sf_dir)
    s = graph.cut(s)  # words are read again rather than kept: they are most of the text
    return refs.shared_callers(s, r, _target(s, r))




@query(f"WITH {WORDS}, names AS (SELECT DISTINCT name FROM symbols), pairs AS (SELECT a.name, b.name AS near, levenshtein(a.name, b.name) AS distance FROM names a JOIN names b ON abs(length(a.name) - length(b.name)) <= 2 AND a.name <> b.name) SELECT name, near, CAST(distance AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, near) AS r FROM pairs WHERE distance <= 2) WHERE r <= 3")
def near_names(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    names = s.select("name").distinct()
    return refs.near_names(names, names).withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH {WORDS} SELECT name, CAST(count(DISTINCT path) AS BIGINT) AS files FROM refs WHERE length(name) >= 7 AND name NOT IN (SELECT name FROM symbols) AND name NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) GROUP BY name")
def undeclared_names(spark, sf_dir):
    """Long names that are used, defined nowhere and not in the benchmark's words: a chain of anti joins."""
    s, r, _ = _facts(spark, sf_dir)
    known = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()
    rest = r.where(F.length("name") >= 7).join(s.select("name").distinct(), "name", "left_anti").join(known, "name", "left_anti")
    return rest.groupBy("name").agg(F.countDistinct("path").alias("files"))


@query(f"WITH {WORDS}, d AS (SELECT DISTINCT path, name FROM symbols) SELECT a.path, a.name, CAST(count(*) AS BIGINT) AS elsewhere FROM d a JOIN d b ON a.name = b.name AND a.path <> b.path GROUP BY ALL")
def shadowed_names(spark, sf_dir):
    """Definitions whose name other files define too: a count by name, not pairs."""
    s, _, _ = _facts(spark, sf_dir)
    d = s.select("path", "name").distinct()
    n = d.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(n, "name").select("path", "name", (F.col("n") - 1).alias("elsewhere"))


@query(f"WITH {TRADE}, {HEAVY}, both_ways AS (SELECT src, dst FROM heavy UNION SELECT dst, src FROM heavy), walk AS (SELECT src, dst FROM both_ways) " + "SELECT node, CAST(min(h) AS BIGINT) AS hops FROM (SELECT 'NATION_7' AS node, 0 AS h " + "".join(" UNION ALL SELECT a{0}.dst, {1} FROM ".format(i, i + 1) + " JOIN ".join(f"both_ways a{j}" + (f" ON a{j - 1}.dst = a{j}.src" if j else "") for j in range(i + 1)) + " WHERE a0.src = 'NATION_7'" for i in range(4)) + ") GROUP BY node")
def hop_counts(spark, sf_dir):
    return graph.hops(_heavy(spark, sf_dir), "NATION_7", most=4).select("node", F.col("hops").cast("long").alias("hops"))


@query(f"WITH {TRADE}, {HEAVY}, both_ways AS (SELECT src, dst FROM heavy UNION SELECT dst, src FROM heavy) SELECT node, CAST(min(h) AS BIGINT) AS hops FROM (SELECT 'NATION_18' AS node, 0 AS h UNION ALL SELECT dst, 1 FROM both_ways WHERE src = 'NATION_18' UNION ALL SELECT b.dst, 2 FROM both_ways a JOIN both_ways b ON a.dst = b.src WHERE a.src = 'NATION_18') GROUP BY node")
def neighbourhood(spark, sf_dir):
    return graph.neighbourhood(_heavy(spark, sf_dir), "NATION_18", 2).select("node", F.col("hops").cast("long").alias("hops"))


@query()
def shortest_path(spark, sf_dir):
    return graph.shortest_path(_heavy(spark, sf_dir), "NATION_18", "NATION_7")


@query(f"WITH RECURSIVE {TRADE}, {HEAVY}, reach AS (SELECT src AS a, dst AS b FROM heavy UNION SELECT r.a, h.dst FROM reach r JOIN heavy h ON r.b = h.src), mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) SELECT a AS node, least(a, min(b)) AS component FROM mutual GROUP BY a HAVING count(*) > 1")
def import_cycles(spark, sf_dir):
    return graph.cycle_groups(_heavy(spark, sf_dir))


def _ends(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first and the last path."""
    ends = facts.files(read(spark, sf_dir, "documents")).agg(F.min("path"), F.max("path")).first()
    return ends[0] or "", ends[1] or ""


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    """All edges between files, by imports and symbols, as pairs, and the first and the last path. Pairs grow with the square
    of the input: the queries walk _hubs, which stands for the same edges, and tests compare the two."""
    return graph.cut(graph.file_edges(*_facts(spark, sf_dir)).select("src", "dst")), *_ends(spark, sf_dir)


def _hubs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.file_links(*_facts(spark, sf_dir))


@query()
def file_hops(spark, sf_dir):
    """Hops from the first file over the whole file graph, however many."""
    return graph.hub_hops(*_hubs(spark, sf_dir), _ends(spark, sf_dir)[0]).select("node", F.col("hops").cast("long").alias("hops"))


@query()
def file_neighbourhood(spark, sf_dir):
    return graph.hub_hops(*_hubs(spark, sf_dir), _ends(spark, sf_dir)[0], most=2).select("node", F.col("hops").cast("long").alias("hops"))


@query()
def file_path(spark, sf_dir):
    return graph.hub_path(*_hubs(spark, sf_dir), *_ends(spark, sf_dir))


@query()
def file_cycles(spark, sf_dir):
    return graph.hub_cycles(*_hubs(spark, sf_dir))


_SYM = "sym AS (SELECT src AS a, dst AS b, weight FROM trade UNION ALL SELECT dst, src, weight FROM trade), und AS (SELECT a, b, sum(weight) AS weight FROM sym GROUP BY a, b)"


@query(f"WITH {TRADE}, {_SYM}, m AS (SELECT n_name AS node, r_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey), m2 AS (SELECT sum(weight) AS m2 FROM und), s AS (SELECT ma.community, sum(CASE WHEN ma.community = mb.community THEN weight ELSE 0 END) AS internal, sum(weight) AS total FROM und JOIN m ma ON a = ma.node JOIN m mb ON b = mb.node GROUP BY ma.community) SELECT community, (SELECT count(*) FROM m WHERE m.community = s.community) AS members, round(internal, 6) AS internal, round(total, 6) AS total, round(internal / m2 - (total / m2) * (total / m2), 6) AS q FROM s, m2")
def partition_score(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    m = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("community"))
    return graph.partition_score(facts.trade_edges(spark, sf_dir), m)


@query(f"WITH {TRADE}, {_SYM} SELECT a AS node, round(sum(weight), 6) AS degree, CAST(count(*) AS BIGINT) AS neighbours FROM und GROUP BY a")
def degrees(spark, sf_dir):
    return graph.symmetrise(facts.trade_edges(spark, sf_dir)).groupBy(F.col("a").alias("node")).agg(F.round(F.sum("weight"), 6).alias("degree"), F.count(F.lit(1)).alias("neighbours"))


@query()
def communities(spark, sf_dir):
    return graph.communities(facts.trade_edges(spark, sf_dir))


@query(f"WITH {FILES}, m AS (SELECT path, lang || CAST(length(text) % 7 AS VARCHAR) AS community FROM files), n AS (SELECT community, count(*) AS n FROM m GROUP BY community), p AS (SELECT community, 1 AS depth, split_part(path, '/', 1) AS prefix FROM m UNION ALL SELECT community, 2, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM m), c AS (SELECT community, depth, prefix, count(*) AS c FROM p GROUP BY ALL), best AS (SELECT community, arg_min(prefix, (-depth, prefix)) AS label FROM c JOIN n USING (community) WHERE c >= n // 2 + 1 GROUP BY community) SELECT community, n AS members, coalesce(label, 'repository root') AS label FROM n LEFT JOIN best USING (community)")
def community_labels(spark, sf_dir):
    f = facts.files(read(spark, sf_dir, "documents"))
    return graph.community_labels(f.select(F.col("path").alias("node"), F.concat("lang", (F.length("text") % 7).cast("string")).alias("community")))


@query(f"WITH {TRADE}, g AS (SELECT * FROM trade), nodes AS (SELECT n_name AS node FROM nation), {_rank_sql(10)}, best AS (SELECT node FROM r10 ORDER BY round(rank, 9) DESC, node LIMIT 8) SELECT src, dst, kind, weight, CAST(row_number() OVER (ORDER BY kind, weight DESC, src, dst) AS BIGINT) AS ord FROM (SELECT src, dst, CASE WHEN weight >= 1 THEN 'import' ELSE 'reference' END AS kind, weight FROM trade WHERE src IN (SELECT node FROM best) AND dst IN (SELECT node FROM best)) ORDER BY ord LIMIT 40")
def drawn_edges(spark, sf_dir):
    """drawn_edges_converged after the ten rounds that its SQL unrolls."""
    return _drawn_edges(spark, sf_dir, iterations=10, epsilon=None)


@query()
def drawn_edges_converged(spark, sf_dir):
    return _drawn_edges(spark, sf_dir)


def _drawn_edges(spark: SparkSession, sf_dir: str, **rank) -> DataFrame:
    edges = graph.cut(facts.trade_edges(spark, sf_dir))
    nodes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    ranks = graph.pagerank(nodes, edges, **rank).withColumn("rank", F.round("rank", 9))
    return graph.drawn(edges.withColumn("kind", F.when(F.col("weight") >= 1, "import").otherwise("reference")), ranks, 8, 40).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {FILES} SELECT folder, CAST(depth AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS files FROM (SELECT split_part(path, '/', 1) AS folder, 1 AS depth FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM files) GROUP BY ALL")
def folder_counts(spark, sf_dir):
    return packing.folders(facts.files(read(spark, sf_dir, "documents")).select("path")).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {FILES}, n AS (SELECT DISTINCT p, d FROM (SELECT [split_part(path, '/', 1)] AS p, 1 AS d FROM files UNION ALL SELECT [split_part(path, '/', 1), split_part(path, '/', 2)], 2 FROM files)) SELECT CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS place, repeat('    ', d - 1) || p[d] || '/' || CASE WHEN d = 2 THEN ' ...' ELSE '' END AS line FROM n ORDER BY p LIMIT 200")
def tree_lines(spark, sf_dir):
    return packing.tree(facts.files(read(spark, sf_dir, "documents")).select("path"), 2, 200).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {WORDS}, spans AS (SELECT path, greatest(line - 2, 1) AS s, line + 2 AS e FROM symbols), flagged AS (SELECT *, CASE WHEN s > max(e) OVER w OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM spans WINDOW w AS (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), islands AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM flagged) SELECT path, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\" FROM islands GROUP BY path, i")
def merged_slices(spark, sf_dir):
    """Two lines around each definition, overlapping ones as one."""
    s, _, _ = _facts(spark, sf_dir)
    spans = s.select("path", F.greatest(F.col("line") - 2, F.lit(1)).cast("long").alias("start"), (F.col("line") + 2).cast("long").alias("end"))
    return packing.merge_intervals(spans, ["path"])


@query("WITH t AS (SELECT conv_id, turn, length(text) // 4 AS cost, text FROM conversations), p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(max(used) AS BIGINT) AS used FROM p WHERE used <= 300 GROUP BY conv_id")
def packed_turns(spark, sf_dir):
    """The turns of each conversation that fit a budget of 300 tokens."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", packing.tokens(F.col("text")).alias("cost"))
    p = packing.pack(rows, ["conv_id"], [F.col("turn"), F.col("text")], "cost", F.lit(300)).where("included")
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("used").alias("used"))


@query()
def fair_shares(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", packing.tokens(F.col("text")).alias("cost"))
    return packing.fair_shares(rows, ["source"], "doc_id", "cost", 12_000)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS asked, role FROM conversations")
def carried_questions(spark, sf_dir):
    """Each turn with the last user turn so far."""
    rows = read(spark, sf_dir, "conversations").withColumn("q", F.when(F.col("role") == "user", F.md5("text")))
    return packing.carry_forward(rows, ["conv_id"], ["turn", "role", "text"], "q", "asked").select("conv_id", "turn", "asked", "role")


@query("SELECT user_id, event_type, min(ts) AS first FROM events GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return packing.ordered_distinct(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")


@query("SELECT user_id, event_id, CAST(total AS BIGINT) AS total, CAST(place AS BIGINT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def listed_events(spark, sf_dir):
    out = packing.listing(read(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 5)
    return out.select("user_id", "event_id", "total", F.col("place").cast("long").alias("place"))


@query(f"WITH {FILES}, t AS (SELECT source, sum(length(text) // 4) AS full_size FROM files GROUP BY source) SELECT source, CAST(full_size AS BIGINT) AS full_size, CAST(greatest(2000, least(8000, full_size // 6)) AS BIGINT) AS budget FROM t")
def auto_budgets(spark, sf_dir):
    sums = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(packing.tokens(F.col("text"))).alias("full_size"))
    return sums.withColumn("budget", packing.auto_budget(F.col("full_size")).cast("long"))


@query("SELECT page_id, list_contains(string_split(regexp_replace(url, '[^/]*$', ''), '/'), 'test') OR list_contains(string_split(regexp_replace(url, '[^/]*$', ''), '/'), 'tests') OR split_part(regexp_extract(url, '[^/]*$'), '.', 1) = 'conftest' AS in_tests FROM pages")
def test_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", packing.in_tests(F.col("url")).alias("in_tests"))


_VOTE = """WITH c AS (SELECT user_id AS run, 'c' || CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS key, event_id % 11 <> 0 AS applied, event_id % 7 <> 0 AS measured, value >= 40 AS reg, value >= 80 AS rep FROM events),
 r AS (SELECT *, CASE WHEN reg AND rep THEN 0 WHEN reg THEN 1 WHEN rep THEN 2 ELSE 3 END AS rung FROM c WHERE applied AND measured),
 best AS (SELECT * FROM (SELECT *, min(rung) OVER (PARTITION BY run) AS m FROM r) WHERE rung = m)"""


@query(f"{_VOTE}, g AS (SELECT run, list_element(['reproduction_and_regression', 'regression', 'reproduction', 'applied'], CAST(rung + 1 AS INTEGER)) AS rung, key, count(*) AS size, arg_min(id, idx) AS representative, min(idx) AS f, string_agg(id, ',' ORDER BY idx) AS members FROM best GROUP BY run, rung, key) SELECT run, rung, key, size, representative, members, CAST(row_number() OVER (PARTITION BY run ORDER BY size DESC, f) AS BIGINT) AS place FROM g")
def vote_clusters(spark, sf_dir):
    return vote.clusters(vote.ladder(facts.event_candidates(read(spark, sf_dir, "events")))).withColumn("place", F.col("place").cast("long"))


@query("SELECT user_id AS run, 'c' || CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 11 = 0 THEN 'apply_failed' WHEN event_type = 'click' THEN 'not_evaluated' WHEN value > 300 THEN 'timeout' WHEN floor(value) % 5 = 4 THEN 'error' WHEN floor(value) % 5 = 0 THEN 'pass' ELSE 'fail' END AS status FROM events")
def verdicts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    code = F.floor("value") % 5
    runs = e.where("event_type <> 'click'").select(F.col("user_id").alias("run"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.when(code == 4, -1).otherwise(code).alias("exit_code"), F.col("value").alias("seconds"))
    return vote.verdicts(facts.event_candidates(e).select("run", "id", "applied"), runs, 300)


@query("SELECT user_id AS run, CAST(count(*) AS BIGINT) AS repeats, count(*) FILTER (WHERE NOT (value < 95)) = 0 AS verified FROM events GROUP BY user_id")
def baselines(spark, sf_dir):
    return vote.baseline(read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.col("value") < 95).alias("passed")))


@query("SELECT user_id AS candidate, CAST(count(*) FILTER (WHERE value >= 60) AS BIGINT) AS warning, CAST(count(*) FILTER (WHERE value >= 20 AND value < 60) AS BIGINT) AS advisory, CAST(count(*) FILTER (WHERE value < 20) AS BIGINT) AS not_checked FROM events GROUP BY user_id")
def severity_counts(spark, sf_dir):
    s = F.when(F.col("value") >= 60, "warning").when(F.col("value") >= 20, "advisory").otherwise("not_checked")
    return vote.severity_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("candidate"), s.alias("severity")))


_STORED = "stored AS (SELECT path, CASE WHEN source = 'src3' THEN sha256('old') ELSE sha256(text) END AS sha, CASE WHEN source = 'src4' THEN 'v0' ELSE 'v1' END AS version FROM files WHERE source <> 'src5' UNION ALL SELECT 'gone/' || url, sha256(html), 'v1' FROM pages)"


@query(f"WITH {FILES}, {_STORED} SELECT path, CASE WHEN f.sha IS NULL THEN 'prune' WHEN s.sha IS NULL THEN 'extract_new' WHEN f.sha = s.sha AND s.version = 'v1' THEN 'reuse' ELSE 'extract_changed' END AS status FROM (SELECT path, sha256(text) AS sha FROM files) f FULL JOIN stored s USING (path)")
def index_plan(spark, sf_dir):
    """The present files against a stored index that lacks, outdates and outlives some of them."""
    f = facts.files(read(spark, sf_dir, "documents"))
    now = f.select("path", F.sha2("text", 256).alias("sha256"), F.lit("v1").alias("version"))
    old = f.where("source <> 'src5'").select("path", F.sha2(F.when(F.col("source") == "src3", "old").otherwise(F.col("text")), 256).alias("sha256"), F.when(F.col("source") == "src4", "v0").otherwise("v1").alias("version"))
    gone = read(spark, sf_dir, "pages").select(F.concat(F.lit("gone/"), "url").alias("path"), F.sha2("html", 256).alias("sha256"), F.lit("v1").alias("version"))
    return index.plan(now, old.unionByName(gone))


@query(f"WITH {FILES}, {_STORED}, p AS (SELECT CASE WHEN f.sha IS NULL THEN 'prune' WHEN s.sha IS NULL THEN 'extract_new' WHEN f.sha = s.sha AND s.version = 'v1' THEN 'reuse' ELSE 'extract_changed' END AS status FROM (SELECT path, sha256(text) AS sha FROM files) f FULL JOIN stored s USING (path)) SELECT status, CAST(count(*) AS BIGINT) AS files FROM p GROUP BY status")
def index_report(spark, sf_dir):
    return index.report(index_plan(spark, sf_dir))


@query(f"WITH {FILES}, r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path || chr(0) || CAST(strlen(text) AS VARCHAR) || chr(0) || sha256(text) AS row FROM files), d AS (SELECT folder, sha256(string_agg(row, chr(10) ORDER BY row)) AS d, count(*) AS n FROM r GROUP BY folder) SELECT sha256(string_agg(folder || chr(0) || d, chr(10) ORDER BY folder || chr(0) || d)) AS generation, CAST(sum(n) AS BIGINT) AS files FROM d")
def generation_stamp(spark, sf_dir):
    f = facts.files(read(spark, sf_dir, "documents"))
    return index.generation(f.select("path", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256")))


@query(f"WITH {FILES}, k AS (SELECT path, sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS key FROM files) SELECT key, CAST(count(*) AS BIGINT) AS size, min(path) AS representative FROM k GROUP BY key HAVING count(*) > 1")
def equal_contents(spark, sf_dir):
    return index.equal_contents(facts.files(read(spark, sf_dir, "documents")))


@query(f"WITH {FILES}, c AS (SELECT source AS candidate, path, sha256(text) AS key FROM files) SELECT candidate, sha256(string_agg(path || chr(0) || key || chr(10), '' ORDER BY path || chr(0) || key || chr(10))) AS key FROM c GROUP BY candidate")
def equivalence_keys(spark, sf_dir):
    f = facts.files(read(spark, sf_dir, "documents"))
    return index.equivalence_key(f.select(F.col("source").alias("candidate"), "path", F.sha2("text", 256).alias("key")))


@query(f"WITH {FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS body FROM files), k AS (SELECT sha256(body) AS key, path FROM l WHERE len(regexp_extract_all(body, '[a-z]+')) >= 12) SELECT key, CAST(count(*) AS BIGINT) AS places, CAST(count(DISTINCT path) AS BIGINT) AS files, min(path) AS first FROM k GROUP BY key HAVING count(*) > 1")
def equal_bodies(spark, sf_dir):
    """Lines of at least 12 words that stand in several places: an equality join on their digest, as counts."""
    lines = facts.files(read(spark, sf_dir, "documents")).select("path", F.explode(F.split("text", "\n", -1)).alias("body"))
    lines = lines.where(F.size(F.regexp_extract_all("body", F.lit("[a-z]+"), F.lit(0))) >= 12)
    return lines.groupBy(F.sha2("body", 256).alias("key")).agg(F.count(F.lit(1)).alias("places"), F.countDistinct("path").alias("files"), F.min("path").alias("first")).where("places > 1")


@query(
    f"WITH {WORDS}, entries AS (SELECT lang || '/' || lpad(CAST(min(doc_id) AS VARCHAR), 9, '0') || '.txt' AS entry FROM documents GROUP BY lang UNION SELECT lpad(CAST(max(doc_id) AS VARCHAR), 9, '0') FROM documents GROUP BY source UNION SELECT min(name) FROM symbols GROUP BY path UNION SELECT 'no/such.txt'),"
    " ends AS (SELECT path, path AS entry FROM files UNION ALL SELECT path, regexp_replace(path, '^[^/]*/', '') FROM files UNION ALL SELECT path, regexp_replace(path, '^.*/', '') FROM files),"
    " found AS (SELECT DISTINCT entry, path, CASE WHEN entry = path THEN 0 ELSE 1 END AS rank FROM entries JOIN ends USING (entry) UNION SELECT e.entry, n.path, 2 FROM entries e JOIN ends n ON e.entry || '.txt' = n.entry UNION SELECT e.entry, s.path, 3 FROM entries e JOIN symbols s ON s.name = e.entry)"
    " SELECT entry, path, list_element(['path', 'suffix', 'stem', 'qualified'], CAST(rank + 1 AS INTEGER)) AS how FROM (SELECT *, min(rank) OVER (PARTITION BY entry) AS m FROM found) WHERE rank = m"
)
def focus_paths(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    s = facts.symbols(docs)
    entries = docs.groupBy("lang").agg(F.min("doc_id").alias("d")).select(F.concat("lang", F.lit("/"), name(F.col("d")), F.lit(".txt")).alias("entry"))
    entries = entries.union(docs.groupBy("source").agg(F.max("doc_id").alias("d")).select(name(F.col("d")))).union(s.groupBy("path").agg(F.min("name").alias("n")).select("n")).union(spark.createDataFrame([("no/such.txt",)], "entry string"))
    return lookup.focus(entries, facts.files(docs), s)


@query(f"WITH {WORDS}, t AS (SELECT DISTINCT name AS target FROM symbols) SELECT target, path, name, CAST(line AS BIGINT) AS line, CAST(row_number() OVER (PARTITION BY target ORDER BY path, line) AS BIGINT) AS place FROM t JOIN symbols s ON s.name = t.target")
def definitions_by_name(spark, sf_dir):
    s = facts.symbols(read(spark, sf_dir, "documents"))
    out = lookup.definitions(s.select(F.col("name").alias("target")), s)
    return out.withColumn("line", F.col("line").cast("long")).withColumn("place", F.col("place").cast("long"))
