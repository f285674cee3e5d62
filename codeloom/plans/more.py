"""More registered queries: look-ups by qualified name, scopes, listings, sinks' rows and small column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns
from codeloom.operators import graph, index, packing, refs, resolve, vote
from codeloom.plans.queries import _STORED, _TIERED, FILES, IMPORTS, INDEX, QUERIES, SQL, WORDS, _facts, query
from codeloom.sources import facts
from codeloom.sources.facts import read

_QUALIFIED = "qualified AS (SELECT s.*, lang || '.' || name AS qualname, source AS kind FROM symbols s JOIN files USING (path))"


@query(
    f"WITH {WORDS}, {_QUALIFIED}, hits AS (SELECT CASE WHEN name = 'en.' THEN 0 WHEN qualname = 'en.' THEN 1 WHEN starts_with(name, 'en.') THEN 2 ELSE 3 END AS rank, name, path, line FROM qualified WHERE kind = 'src0' AND (contains(name, 'en.') OR contains(qualname, 'en.')))"
    " SELECT CAST(rank AS BIGINT) AS rank, name, path, CAST(line AS BIGINT) AS line, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY rank, name, path, line LIMIT 20"
)
def find_qualified(spark, sf_dir):
    """The first matches among symbols of one kind (their source) by qualified name (language and name)."""
    s, _, _ = _facts(spark, sf_dir)
    f = facts.files(read(spark, sf_dir, "documents")).select("path", F.col("source").alias("kind"), "lang")
    s = s.join(f, "path").withColumn("qualname", F.concat("lang", F.lit("."), "name"))
    return refs.find(s, "en.", 20, kind="src0").withColumn("rank", F.col("rank").cast("long")).withColumn("line", F.col("line").cast("long"))


@query(
    f"WITH {WORDS}, {INDEX}, ids AS (SELECT name AS candidate, regexp_matches(path, '(^|/)tests?/') AS in_tests, 'txt:' || path || '::' || name || CASE WHEN ordinal > 0 THEN '#' || CAST(ordinal AS VARCHAR) ELSE '' END AS id FROM symbols),"
    " firsts AS (SELECT candidate, arg_min(in_tests, (in_tests, id)) AS in_tests, arg_min(id, (in_tests, id)) AS id FROM ids GROUP BY candidate), sc AS (SELECT name AS candidate, round(candidates / (1 + ln(1 + spread)), 6) AS score, CAST(spread AS BIGINT) AS files FROM name_index)"
    " SELECT *, CAST(row_number() OVER (ORDER BY in_tests, score DESC, files DESC, id) AS BIGINT) AS place FROM sc JOIN firsts USING (candidate) ORDER BY place LIMIT 20"
)
def listed_candidates(spark, sf_dir):
    """The order of shared callers over all defined names, scored by their definitions and spread."""
    s, r, _ = _facts(spark, sf_dir)
    scored = refs.name_index(s, r).select(F.col("name").alias("candidate"), F.round(F.col("candidates") / refs.damping(F.col("spread")), 6).alias("score"), F.col("spread").alias("files"))
    return refs.order_shared(scored, s).withColumn("place", F.col("place").cast("long"))


@query(
    f"WITH {WORDS}, whole AS (SELECT path, string_split(text, chr(10)) AS l FROM files), b AS (SELECT s.path, name, line, trim(regexp_replace(array_to_string(l[line + 1 : least(coalesce(end_line, len(l)), len(l))], chr(10)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS stream FROM symbols s JOIN whole USING (path))"
    " SELECT path, name, CAST(line AS BIGINT) AS line, CASE WHEN stream <> '' AND len(string_split(stream, ' ')) >= 12 THEN sha256(stream) END AS body_key FROM b"
)
def body_keys(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    return refs.body_keys(s, facts.files(read(spark, sf_dir, "documents"))).select("path", "name", F.col("line").cast("long").alias("line"), "body_key")


@query(f"WITH {FILES}, {IMPORTS} SELECT src AS importer, dst AS target FROM imports")
def submodule_targets(spark, sf_dir):
    """Each file's import, written as a name of its folder (and one that is no file): found as submodules of the dotted folder."""
    i = facts.imports(read(spark, sf_dir, "documents"))
    stem, folder = F.substring_index(F.substring_index("dst", "/", -1), ".", 1), F.regexp_replace(F.regexp_replace("dst", "/[^/]*$", ""), "/", ".")
    statements = i.select(F.col("src").alias("importer"), folder.alias("module"), F.lit(0).alias("level"), F.array(stem, F.lit("missing")).alias("names"))
    paths = facts.files(read(spark, sf_dir, "documents")).select("path")
    scopes = resolve.import_scopes(statements, paths, suffixes=(".txt",), roots=("",))
    return scopes.where("kind = 'module'").select(F.col("path").alias("importer"), "target")


@query(
    f"WITH {WORDS}, {IMPORTS}, b AS (SELECT src AS path, split_part(dst, '/', 1) AS qualifier, dst AS target FROM imports), words_used AS (SELECT path, name FROM refs UNION SELECT src, name FROM imports JOIN symbols ON path = dst), uses AS (SELECT path, CASE WHEN length(name) % 2 = 0 THEN 'other' ELSE split_part(path, '/', 1) END AS qualifier, name FROM words_used)"
    " SELECT path, qualifier, name, target FROM uses JOIN b USING (path, qualifier) JOIN (SELECT DISTINCT path AS target, name FROM symbols) USING (target, name)"
)
def qualified_uses(spark, sf_dir):
    """Names of odd length, a file's own words and what its import defines, taken as attributes of the source, which names
    the imported file; names of even length are attributes of nothing."""
    s, r, i = _facts(spark, sf_dir)
    source = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    bindings = i.select(F.col("src").alias("path"), source(F.col("dst")).alias("binding"), F.col("dst").alias("target"))
    defined = i.join(s.select(F.col("path").alias("dst"), "name").distinct(), "dst").select(F.col("src").alias("path"), "name")
    used = r.select("path", "name").unionByName(defined)
    return resolve.module_attributes(used.withColumn("qualifier", F.when(F.length("name") % 2 == 0, "other").otherwise(source(F.col("path")))), bindings, s)


@query(f"{_TIERED} SELECT path, name, tier, bool_or(starts_with(target, 'src1/')) AS lands FROM won GROUP BY path, name, tier")
def tier_lands(spark, sf_dir):
    """Whether a use's deciding tier reaches a file of one source."""
    s, r, i = _facts(spark, sf_dir)
    targets = facts.files(read(spark, sf_dir, "documents")).where(F.col("path").startswith("src1/")).select("path")
    return resolve.lands_on(r, s, i, targets)


@query(
    f"{_TIERED}, node AS (SELECT max(path) AS p FROM files), edges AS (SELECT path AS src, target AS dst, name, 'references' AS relation, tier FROM won WHERE path <> target UNION SELECT src, dst, '', 'imports', 'imported' FROM imports),"
    " both_ways AS (SELECT 'out' AS direction, relation, tier, dst AS other, name FROM edges, node WHERE src = p UNION ALL SELECT 'in', relation, tier, src, name FROM edges, node WHERE dst = p)"
    " SELECT direction, relation, tier, CAST(total AS BIGINT) AS total, CAST(place AS BIGINT) AS place, other, name FROM (SELECT *, count(*) OVER (PARTITION BY direction, relation, tier) AS total, row_number() OVER (PARTITION BY direction, relation, tier ORDER BY other, name) AS place FROM both_ways) WHERE place <= 10"
)
def explain_card(spark, sf_dir):
    """What leads out of the last file and into it, by relation and tier."""
    s, r, i = _facts(spark, sf_dir)
    node = facts.files(read(spark, sf_dir, "documents")).agg(F.max("path")).first()[0]
    names = s.where(F.col("path") == node).select("name").distinct()
    near = r.where(F.col("path") == node).unionByName(r.join(names, "name", "left_semi")).distinct()  # uses that may touch the file
    return resolve.explain(resolve.symbol_edges(near, s, i), node or "").withColumn("place", F.col("place").cast("long"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY length, first) AS BIGINT) AS place, length, files FROM (SELECT CAST(count(*) AS BIGINT) AS length, min(node) AS first, string_agg(node, ',' ORDER BY node) AS files FROM ({SQL['import_cycles']}) GROUP BY component) ORDER BY place LIMIT 20")
def listed_cycles(spark, sf_dir):
    return graph.listed_cycles(QUERIES["import_cycles"](spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


_COMMUNITY = "m AS (SELECT path AS node, lang || CAST(length(text) % 7 AS VARCHAR) AS community FROM files)"


def _members(spark, sf_dir):
    f = facts.files(read(spark, sf_dir, "documents"))
    return f.select(F.col("path").alias("node"), F.concat("lang", (F.length("text") % 7).cast("string")).alias("community"))


@query(
    f"WITH {FILES}, {_COMMUNITY}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS r FROM m)"
    " SELECT CAST(row_number() OVER (ORDER BY size DESC, first) AS BIGINT) AS place, community, CAST(size AS BIGINT) AS size, members FROM (SELECT community, count(*) AS size, min(node) AS first, string_agg(CASE WHEN r <= 12 THEN node END, ',' ORDER BY node) AS members FROM r GROUP BY community) ORDER BY place LIMIT 20"
)
def listed_communities(spark, sf_dir):
    return graph.listed_communities(_members(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH l AS (SELECT * FROM ({SQL['community_labels']})) SELECT community, label, CASE WHEN n = 1 THEN label ELSE label || ' ' || CAST(n AS VARCHAR) END AS title FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY members DESC, community) AS n FROM l)")
def community_titles(spark, sf_dir):
    rows = QUERIES["community_labels"](spark, sf_dir)
    return packing.label_ordinals(rows, "label", [F.desc("members"), "community"]).select("community", "label", "title")


@query(f"WITH {WORDS}, sl AS (SELECT * FROM ({SQL['merged_slices']})) SELECT s.path, min(sl.start) AS start, CAST(s.line AS BIGINT) AS header FROM symbols s JOIN sl ON s.path = sl.path AND s.line < sl.start AND sl.start <= coalesce(s.end_line, 1073741824) GROUP BY s.path, s.line")
def sticky_headers(spark, sf_dir):
    s, _, _ = _facts(spark, sf_dir)
    return packing.sticky_headers(QUERIES["merged_slices"](spark, sf_dir), s).withColumn("header", F.col("header").cast("long"))


@query("WITH t AS (SELECT conv_id, turn, length(text) // 4 AS cost, text FROM conversations), p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT conv_id, CAST(count(*) FILTER (WHERE used <= 20) AS BIGINT) AS shown, CAST(count(*) FILTER (WHERE NOT used <= 20) AS BIGINT) AS omitted FROM p GROUP BY conv_id")
def regrouped_turns(spark, sf_dir):
    """Shown and omitted turns of every conversation under a small budget, also of those that show none."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", packing.tokens(F.col("text")).alias("cost"))
    return packing.regroup(packing.pack(rows, ["conv_id"], [F.col("turn"), F.col("text")], "cost", F.lit(20)), ["conv_id"])


@query(
    f"WITH {WORDS}, {_STORED}, p AS (SELECT path, CASE WHEN f.sha IS NULL THEN 'prune' WHEN s.sha IS NULL THEN 'new' WHEN f.sha = s.sha AND s.version = 'v1' THEN 'reuse' ELSE 'new' END AS status FROM (SELECT path, sha256(text) AS sha FROM files) f FULL JOIN stored s USING (path))"
    " SELECT path, CASE WHEN status = 'reuse' THEN 'stored' ELSE 'extracted' END AS origin, CAST(count(*) AS BIGINT) AS symbols FROM symbols JOIN p USING (path) GROUP BY ALL"
)
def index_applied(spark, sf_dir):
    """Symbols of the next generation by where they come from, after applying the plan of index_plan."""
    s, _, _ = _facts(spark, sf_dir)
    rows = index.apply(QUERIES["index_plan"](spark, sf_dir), s.withColumn("origin", F.lit("stored")), s.withColumn("origin", F.lit("extracted")))
    return rows.groupBy("path", "origin").agg(F.count(F.lit(1)).alias("symbols"))


@query(
    f"WITH {FILES}, a AS (SELECT path, unnest(string_split(text, chr(10))) AS now, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files), b AS (SELECT path, line, replace(now, 'e', 'E') AS before FROM a),"
    " d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM a JOIN b USING (path, line) WHERE now <> before) SELECT path, CAST(line AS BIGINT) AS line, now, before FROM d WHERE r = 1"
)
def drifted_lines(spark, sf_dir):
    """The first line of each document that an edited copy has otherwise."""
    f = facts.files(read(spark, sf_dir, "documents")).select("path", "text")
    return index.drift(f, f.withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))))


@query(f"SELECT run, id, '{{\"record\":\"candidate\",\"run\":' || CAST(run AS VARCHAR) || ',\"id\":\"' || id || '\",\"status\":\"' || status || '\"}}' AS line FROM ({SQL['verdicts']})")
def verdict_lines(spark, sf_dir):
    return vote.verdict_lines(QUERIES["verdicts"](spark, sf_dir))


@query("WITH e AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '[T, U]' WHEN page_id % 3 = 1 THEN ' ' ELSE '=x' END AS expression FROM pages), h AS (SELECT *, trim(split_part(expression, '[', 1)) AS head FROM e) SELECT page_id, CASE WHEN contains(head, '=') THEN '' ELSE trim(list_extract(string_split(head, '.'), -1)) END AS base FROM h")
def base_names(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, "[T, U]").when(F.col("page_id") % 3 == 1, " ").otherwise("=x")
    return read(spark, sf_dir, "pages").select("page_id", columns.base_name(F.concat("url", end)).alias("base"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct(CASE event_id % 5 WHEN 0 THEN [event_type, 'user'] WHEN 1 THEN [event_type, 'i'] WHEN 2 THEN [event_type] WHEN 3 THEN [event_type] ELSE []::VARCHAR[] END)), ',') AS bound FROM events")
def bound_names(spark, sf_dir):
    """Names bound by lines of code made from the events: assignment, loop, alias, walrus, and a comparison that binds none."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    forms = [F.concat(kind, F.lit(", user = f(1)")), F.concat(F.lit("for i, "), kind, F.lit(" in rows:")), F.concat(F.lit("import x.y as "), kind), F.concat(F.lit("if ("), kind, F.lit(" := f()):")), F.concat(kind, F.lit(" == 1"))]
    line = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.array_join(columns.bound_names(line), ",").alias("bound"))


@query("SELECT doc_id, CAST(coalesce(toxic, quality, -1) AS BIGINT) AS value FROM documents LEFT JOIN (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN toxic END AS toxic FROM labels) USING (doc_id)")
def settled_values(spark, sf_dir):
    """A given value, else a configured one, else the default."""
    l = read(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, F.col("toxic")).alias("toxic"))  # noqa: E741
    rows = read(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left")
    return rows.select("doc_id", columns.precedence(F.col("toxic"), F.col("quality"), F.lit(-1)).cast("long").alias("value"))


@query("SELECT doc_id, round((length(text) // 4) / greatest(1, length(split_part(text, chr(10), 1)) // 4), 6) AS ratio FROM documents")
def compression_ratios(spark, sf_dir):
    """Tokens of each text for each token of its first line."""
    first = F.substring_index("text", "\n", 1)
    ratio = columns.compression_ratio(packing.tokens(F.col("text")), packing.tokens(first))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(ratio, 6).alias("ratio"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 30.0::DOUBLE WHEN value < 80 THEN least(30.0::DOUBLE, 80 - value) END AS seconds FROM events")
def command_timeouts(spark, sf_dir):
    """Seconds a command may take in a run of 80 of which `value` have passed; every fourth user's run has no limit."""
    left = F.when(F.col("user_id") % 4 != 0, 80 - F.col("value"))
    return read(spark, sf_dir, "events").select("event_id", columns.command_timeout(F.lit(30), left).alias("seconds"))
