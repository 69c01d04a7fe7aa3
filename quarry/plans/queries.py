"""Registered queries over the driver's tables: name to (spark, sf_dir) -> DataFrame, and the SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as X
from quarry.operators import findings as O
from quarry.operators import flow, intervals, measures
from quarry.sources import corpus
from quarry.sources.store import materialised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    {"id": "txt.credential", "severity": "high", "pattern": r"(?i)(password|passwd|secret|api_?key|token)[ \t]*[:=][ \t]*[^ \t]{6,}", "unless": r"(?i)example", "langs": ["en", "de", "fr", "es"], "cwe": ["CWE-798"], "owasp": ["A07"]},
    {"id": "txt.email", "severity": "low", "pattern": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "langs": ["en", "de", "fr"], "cwe": ["CWE-200", "CWE-359"], "owasp": ["A01"]},
    {"id": "txt.ipv4", "severity": "medium", "pattern": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "langs": ["en", "es"], "cwe": ["CWE-200"], "owasp": []},
    {"id": "txt.licence", "severity": "info", "pattern": r"(?i)(licen[cs]ed? under|all rights reserved|copyright)", "langs": ["en", "de", "fr", "es"], "cwe": [], "owasp": []},
    {"id": "txt.phone", "severity": "low", "pattern": r"\+?[0-9][0-9() -]{8,}[0-9]", "langs": ["en", "de", "fr", "es"], "cwe": ["CWE-359"], "owasp": ["A01"]},
    {"id": "txt.shouting", "severity": "critical", "pattern": r"[A-Z]{4,}!!", "langs": ["en", "de"], "cwe": ["CWE-1120"], "owasp": ["A04"]},
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]::VARCHAR[]"


RULE_ROWS = ", ".join(f"({_quoted(r['id'])}, {_quoted(r['severity'])}, {X.SEVERITIES.index(r['severity'])}, {_quoted(r['pattern'])}, {_quoted(r.get('unless', '')) if r.get('unless') else 'NULL'}, {_list(r['langs'])}, {_list(r['cwe'])}, {_list(r['owasp'])})" for r in RULES)
#: The DuckDB side of the findings that most queries start from.
FINDINGS = rf"""
rules(rule_id, severity, severity_rank, pattern, unless, langs, cwe, owasp) AS (VALUES {RULE_ROWS}),
files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, lang, source, text, strlen(text) AS size, sha256(text) AS content_hash FROM documents),
cut AS (SELECT *, string_split_regex(text, '\r?\n') AS p FROM files),
numbered AS (SELECT doc_id, path, lang, source, unnest(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS line_text, unnest(range(1, len(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) + 1)) AS line FROM cut),
met AS (SELECT n.*, r.*, regexp_extract_all(line_text, r.pattern) AS m, string_split_regex(line_text, r.pattern) AS pieces
  FROM numbered n JOIN rules r ON list_contains(r.langs, n.lang) AND regexp_matches(n.line_text, r.pattern)),
found AS (SELECT *, unnest(m) AS match, unnest(range(1, len(m) + 1)) AS nth FROM met),
findings AS (SELECT doc_id, path, lang, source, rule_id, severity, severity_rank, line, strlen(array_to_string(pieces[1:nth], '')) + strlen(array_to_string(m[1:nth - 1], '')) + 1 AS start_col, match,
  substr(regexp_replace(regexp_replace(line_text, '^\s+', ''), '\s+$', ''), 1, 400) AS snippet FROM found WHERE unless IS NULL OR NOT regexp_matches(match, unless)),
printed AS (SELECT *, substr(sha256('finding.v1' || chr(31) || rule_id || chr(31) || path || chr(31) || regexp_replace(snippet, '\s+$', '') || chr(31) || occurrence), 1, 32) AS fingerprint
  FROM (SELECT *, row_number() OVER (PARTITION BY path, rule_id, snippet ORDER BY line, start_col) - 1 AS occurrence FROM findings))
"""


def query(sql: str | None = None, findings: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + FINDINGS + ("," if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")) if findings else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.line_findings(corpus.documents(spark, sf_dir), RULES)


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(r["id"], r["severity"], r["langs"], r["cwe"], r["owasp"]) for r in RULES]
    return spark.createDataFrame(rows, "rule_id string, severity string, langs array<string>, cwe array<string>, owasp array<string>")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# -- sources, scope, caches ------------------------------------------------------------------------------------------------
@query("SELECT source, count(*) AS considered, count(*) FILTER (strlen(text) <= 4000) AS scanned, count(*) FILTER (strlen(text) > 4000) AS skipped, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def file_inventory(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    small = F.col("size") <= 4000
    return d.groupBy("source").agg(F.count("*").alias("considered"), F.count_if(small).alias("scanned"), F.count_if(~small).alias("skipped"), F.sum("size").alias("bytes"))


@query(r"SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE (regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^.*/en/.*$') OR regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^m\..*$')) AND NOT regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^.*\?.*$')")
def glob_scope(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return corpus.scoped(pages, include=["*/en/*", "m.*"], exclude=["*[?]*"])


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    return corpus.documents(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT a.doc_id, coalesce(b.hit, false) AS hit FROM (SELECT doc_id, doc_id % 7 = 0 AS edited FROM documents) a LEFT JOIN (SELECT doc_id, true AS hit FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id AND NOT a.edited")
def cache_partition(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    cache = d.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"))
    return corpus.cache_partition(d, cache).select("doc_id", "hit")


@query("SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def scanned_semi(spark, sf_dir):
    return corpus.documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


# -- findings ----------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, rule_id, severity, severity_rank::BIGINT AS severity_rank, line::BIGINT AS line, start_col::BIGINT AS start_col, match, snippet FROM findings", findings=True)
def line_pattern_findings(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", "rule_id", "severity", *long("severity_rank", "line", "start_col"), "match", "snippet")


@query("SELECT doc_id, 'Credential ' || coalesce(substr(match, 1, 120), '?') || ' in ? of ' || path AS message FROM findings WHERE rule_id = 'txt.credential'", findings=True)
def secret_rule_filters(spark, sf_dir):
    hits = found(spark, sf_dir).where("rule_id = 'txt.credential'")
    return hits.select("doc_id", X.message("Credential ${match} in ${scope} of ${path}", {"match": F.col("match"), "path": F.col("path")}).alias("message"))


@query("SELECT path, rule_id, line::BIGINT AS line, occurrence::BIGINT AS occurrence, fingerprint FROM printed", findings=True)
def occurrence_fingerprint(spark, sf_dir):
    return O.with_fingerprints(found(spark, sf_dir)).select("path", "rule_id", *long("line", "occurrence"), "fingerprint")


@query("SELECT rule_id, snippet, path, line::BIGINT AS line FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, snippet ORDER BY path, line, start_col) AS n FROM findings) WHERE n = 1", findings=True)
def finding_dedup(spark, sf_dir):
    return O.one_each(found(spark, sf_dir), ["rule_id", "snippet"], ["path", "line", "start_col"]).select("rule_id", "snippet", "path", *long("line"))


@query("SELECT row_number() OVER (ORDER BY severity_rank DESC, path, line, start_col, rule_id) AS place, path, rule_id, line::BIGINT AS line FROM findings QUALIFY place <= 50", findings=True)
def report_order_top(spark, sf_dir):
    order = Window.orderBy(F.desc("severity_rank"), "path", "line", "start_col", "rule_id")
    return O.report_order(found(spark, sf_dir)).limit(50).withColumn("place", F.row_number().over(order)).select(*long("place"), "path", "rule_id", *long("line"))


@query("SELECT severity, severity_rank::BIGINT AS severity_rank, count(*) AS n FROM findings GROUP BY ALL", findings=True)
def severity_counts(spark, sf_dir):
    return O.severity_counts(found(spark, sf_dir)).select("severity", *long("severity_rank", "n"))


@query("SELECT max(severity_rank)::BIGINT AS worst, max(severity_rank) >= 3 AS fails FROM findings", findings=True)
def threshold_gate(spark, sf_dir):
    return O.exceeds(found(spark, sf_dir), 3).select(*long("worst"), "fails")


@query("SELECT lang, rule_id, count(*) AS n, count(DISTINCT path) AS files, max(severity_rank)::BIGINT AS worst FROM findings GROUP BY ROLLUP (lang, rule_id)", findings=True)
def findings_rollup(spark, sf_dir):
    return O.rollup(found(spark, sf_dir)).select("lang", "rule_id", *long("n", "files", "worst"))


@query("SELECT rule_id, count(*) AS fresh FROM printed p WHERE NOT EXISTS (SELECT 1 FROM printed b WHERE b.doc_id % 2 = 0 AND b.fingerprint = p.fingerprint) GROUP BY rule_id", findings=True)
def baseline_suppression(spark, sf_dir):
    hits = materialised(O.with_fingerprints(found(spark, sf_dir)).select("doc_id", "rule_id", "fingerprint"))
    return O.suppress(hits, hits.where("doc_id % 2 = 0").select("fingerprint")).groupBy("rule_id").agg(F.count("*").alias("fresh"))


@query("SELECT rule_id, severity, (row_number() OVER (ORDER BY rule_id) - 1)::BIGINT AS rule_index, CASE severity WHEN 'info' THEN 'note' WHEN 'low' THEN 'warning' WHEN 'medium' THEN 'warning' ELSE 'error' END AS level, CASE severity WHEN 'info' THEN '0.0' WHEN 'low' THEN '3.0' WHEN 'medium' THEN '5.5' WHEN 'high' THEN '8.0' ELSE '9.5' END AS score FROM (SELECT DISTINCT rule_id, severity FROM findings)", findings=True)
def sarif_rule_index(spark, sf_dir):
    return O.rule_index(found(spark, sf_dir)).select("rule_id", "severity", *long("rule_index"), X.sarif_level(F.col("severity")).alias("level"), X.security_severity(F.col("severity")).alias("score"))


@query("SELECT doc_id, count(*) AS n FROM findings f WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AND rule_id <> 'txt.phone' GROUP BY doc_id", findings=True)
def disabled_and_scoped(spark, sf_dir):
    active = [r for r in RULES if r["id"] != "txt.phone"]
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return O.line_findings(corpus.documents(spark, sf_dir).join(good, "doc_id", "left_semi"), active).groupBy("doc_id").agg(F.count("*").alias("n"))


def fired_rules(spark, sf_dir):
    return rule_table(spark).join(found(spark, sf_dir).select("rule_id").distinct(), "rule_id", "left_semi")


# -- measures ----------------------------------------------------------------------------------------------------------------
@query("+ fired AS (SELECT * FROM rules WHERE rule_id IN (SELECT rule_id FROM findings)), flat AS (SELECT rule_id, unnest(langs) AS lang, cwe, owasp FROM fired UNION ALL SELECT rule_id, 'all', cwe, owasp FROM fired) SELECT lang, count(DISTINCT rule_id) AS rules, (SELECT count(DISTINCT c) FROM (SELECT unnest(cwe) AS c, f2.lang AS l FROM flat f2) WHERE l = f.lang) AS cwes, (SELECT count(DISTINCT c) FROM (SELECT unnest(owasp) AS c, f2.lang AS l FROM flat f2) WHERE l = f.lang) AS owasps FROM flat f GROUP BY lang", findings=True)
def coverage_matrix(spark, sf_dir):
    """What the rules that find something in the documents cover."""
    return measures.coverage(fired_rules(spark, sf_dir)).select("lang", *long("rules", "cwes", "owasps"))


@query("SELECT item FROM (SELECT 'A' || lpad(i::VARCHAR, 2, '0') AS item FROM range(1, 11) t(i)) WHERE item NOT IN (SELECT unnest(owasp) FROM rules WHERE rule_id IN (SELECT rule_id FROM findings))", findings=True)
def coverage_missing(spark, sf_dir):
    hit = rule_table(spark).join(found(spark, sf_dir).select("rule_id").distinct(), "rule_id", "left_semi").select(F.explode("owasp").alias("item"))
    return spark.range(1, 11).select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("item")).join(hit, "item", "left_anti")


@query("SELECT source, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, CASE WHEN count(*) FILTER (quality = 1) >= 2 AND count(*) FILTER (quality = 0) >= 2 THEN 'high' WHEN count(*) FILTER (quality = 1) >= 1 AND count(*) FILTER (quality = 0) >= 1 THEN 'medium' ELSE 'low' END AS tier FROM documents JOIN labels USING (doc_id) GROUP BY source")
def precision_tier(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    out = d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("positives"), F.count_if(F.col("quality") == 0).alias("negatives"))
    return out.withColumn("tier", measures.precision_tier(F.col("positives"), F.col("negatives")))


@query("+ e AS (SELECT doc_id, toxic = 1 AS expect FROM labels), n AS (SELECT doc_id, count(*) AS n FROM findings WHERE rule_id IN ('txt.shouting', 'txt.phone') GROUP BY doc_id) SELECT doc_id, CASE WHEN expect IS NULL THEN 'unannotated' WHEN expect AND coalesce(n, 0) > 0 THEN 'positive' WHEN expect THEN 'missed' WHEN coalesce(n, 0) > 0 THEN 'unwanted' ELSE 'negative' END AS outcome FROM e FULL JOIN n USING (doc_id)", findings=True)
def expectation_outer(spark, sf_dir):
    n = found(spark, sf_dir).where(F.col("rule_id").isin("txt.shouting", "txt.phone")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return measures.outcomes(read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("expect")), n, ["doc_id"]).select("doc_id", "outcome")


@query(r"""WITH t AS (SELECT source, count(*) FILTER (quality = 0 AND bad) AS tp, count(*) FILTER (quality = 1 AND bad) AS fp, count(*) FILTER (quality = 0 AND NOT bad) AS fn, count(*) FILTER (quality = 1 AND NOT bad) AS tn
  FROM (SELECT source, quality, regexp_matches(text, '[A-Z]{4,}!!') AS bad FROM documents JOIN labels USING (doc_id)) GROUP BY source),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END AS r, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0.0 END AS fpr FROM t)
SELECT source, tp, fp, fn, tn, round(p::DOUBLE, 9) AS "precision", round(r::DOUBLE, 9) AS recall, round(fpr::DOUBLE, 9) AS fpr, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9)::DOUBLE AS f1, round((r - fpr)::DOUBLE, 9) AS youden FROM m""")
def confusion_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").rlike("[A-Z]{4,}!!").alias("bad")).join(read(spark, sf_dir, "labels"), "doc_id")
    is_bad = F.col("quality") == 0
    t = d.groupBy("source").agg(F.count_if(is_bad & F.col("bad")).alias("tp"), F.count_if(~is_bad & F.col("bad")).alias("fp"), F.count_if(is_bad & ~F.col("bad")).alias("fn"), F.count_if(~is_bad & ~F.col("bad")).alias("tn"))
    return measures.metrics(t).select("source", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f1", "youden")])


# -- intervals: each event is the span [event_id, event_id + its value in tens] of its user ------------------------------------
SPANS = "spans AS (SELECT user_id, event_id AS span_id, event_id AS s, event_id + floor(abs(value) * 10)::BIGINT AS e, event_type FROM events)"


def spans(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("span_id"), F.col("event_id").alias("s"), (F.col("event_id") + F.floor(F.abs("value") * 10).cast("long")).alias("e"), "event_type")


@query(f"WITH {SPANS}, pairs AS (SELECT p.user_id, p.span_id AS point_id, o.span_id, o.e - o.s AS width FROM spans p JOIN spans o ON p.user_id = o.user_id AND o.s <= p.s AND p.s <= o.e AND o.span_id % 3 > 0) SELECT user_id, point_id, span_id FROM pairs QUALIFY row_number() OVER (PARTITION BY user_id, point_id ORDER BY width, span_id DESC) = 1")
def innermost_interval(spark, sf_dir):
    s = spans(spark, sf_dir)
    points = s.select("user_id", F.col("span_id").alias("point_id"), F.col("s").alias("ps"), F.col("s").alias("pe"))
    return intervals.innermost(points, s.where("span_id % 3 > 0"), "user_id", "point_id", "span_id").select("user_id", "point_id", "span_id")


@query(f"WITH {SPANS} SELECT c.user_id, c.span_id, coalesce(max(p.span_id), -1) AS parent_id FROM spans c LEFT JOIN spans p ON p.user_id = c.user_id AND p.s <= c.s AND c.e <= p.e AND p.span_id < c.span_id GROUP BY ALL")
def interval_parent(spark, sf_dir):
    return intervals.parents(spans(spark, sf_dir), "user_id", "span_id").select("user_id", "span_id", F.coalesce("parent_id", F.lit(-1)).cast("long").alias("parent_id"))


@query(f"WITH RECURSIVE {SPANS}, up AS (SELECT c.span_id AS child, max(p.span_id) AS parent FROM spans c JOIN spans p ON p.user_id = c.user_id AND p.s <= c.s AND c.e <= p.e AND p.span_id < c.span_id GROUP BY c.span_id), chain AS (SELECT child, parent AS ancestor, 1 AS distance FROM up UNION ALL SELECT chain.child, up.parent, distance + 1 FROM chain JOIN up ON up.child = chain.ancestor WHERE distance < 4) SELECT child, ancestor, distance::BIGINT AS distance FROM chain")
def scope_chain(spark, sf_dir):
    up = intervals.nearest(spans(spark, sf_dir), "user_id", "span_id").select(F.col("span_id").alias("child"), F.col("parent_id").alias("parent"))
    return intervals.ancestors(up, 4).select("child", "ancestor", *long("distance"))


@query(f"WITH {SPANS} SELECT user_id, span_id FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans) WHERE reach IS NULL OR e > reach")
def interval_prune(spark, sf_dir):
    return intervals.maximal(spans(spark, sf_dir), "user_id").select("user_id", "span_id")


@query(f"""WITH {SPANS}, w AS (SELECT span_id, event_id, e.user_id, event_type, floor(value)::BIGINT % 3 AS base FROM events e JOIN (SELECT span_id FROM spans) ON span_id = event_id),
up AS (SELECT c.span_id AS child, max(p.span_id) AS parent FROM spans c JOIN spans p ON p.user_id = c.user_id AND p.s <= c.s AND c.e <= p.e AND p.span_id < c.span_id GROUP BY c.span_id),
anc AS (SELECT child, parent AS ancestor FROM up UNION SELECT a.child, b.parent FROM up a JOIN up b ON b.child = a.parent),
uses AS (SELECT event_id AS use_id, event_id // 4 AS scope, base, event_id AS at FROM w WHERE event_type = 'purchase'), writes AS (SELECT event_id // 4 AS scope, base, event_id AS written, event_type AS origin FROM w WHERE event_type <> 'purchase')
SELECT use_id, origin, min(written) AS written FROM (SELECT u.use_id, w.origin, w.written FROM uses u JOIN writes w USING (scope, base) WHERE w.written < u.at UNION ALL SELECT u.use_id, w.origin, w.written FROM uses u JOIN anc ON child = u.scope JOIN writes w ON w.scope = anc.ancestor AND w.base = u.base) GROUP BY ALL""")
def statement_order_visibility(spark, sf_dir):
    """Scopes are runs of four events; those of a chain of enclosing spans (by number) are around each other."""
    e = read(spark, sf_dir, "events").withColumns({"base": F.floor("value").cast("long") % 3, "scope": F.floor(F.col("event_id") / 4)})
    up = intervals.nearest(spans(spark, sf_dir), "user_id", "span_id").select(F.col("span_id").alias("child"), F.col("parent_id").alias("parent"))
    around = intervals.ancestors(up, 2).select("child", "ancestor").distinct()
    uses = e.where("event_type = 'purchase'").select(F.col("event_id").alias("use_id"), "scope", "base", F.col("event_id").alias("at"))
    writes = e.where("event_type <> 'purchase'").select("scope", "base", F.col("event_id").alias("written"), F.col("event_type").alias("origin"))
    return flow.visible(uses, writes, around).select("use_id", "origin", *long("written"))


# -- paths and links ---------------------------------------------------------------------------------------------------------
@query("WITH n AS (SELECT DISTINCT source || '.' || lang || '.k' || (doc_id % 3) || '.x.y' AS a FROM documents UNION SELECT DISTINCT source || '.' || lang FROM documents UNION SELECT source FROM documents), d AS (SELECT a, string_split(a, '.') AS p FROM n) SELECT a.a, b.a AS b FROM d a JOIN d b ON a.p[1] = b.p[1] AND a.p[2:least(len(a.p), len(b.p), 4)] = b.p[2:least(len(a.p), len(b.p), 4)] WHERE a.a < b.a")
def path_overlap(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    names = d.select(F.concat(F.concat_ws(".", "source", "lang"), F.lit(".k"), (F.col("doc_id") % 3).cast("string"), F.lit(".x.y")).alias("a")).unionByName(d.select(F.concat_ws(".", "source", "lang").alias("a"))).unionByName(d.select(F.col("source").alias("a")))
    h = names.distinct().select("a", X.access_path(F.col("a")).alias("p"))
    a, b = h.toDF("a", "pa"), h.toDF("b", "pb")
    return a.join(b, F.col("pa.base") == F.col("pb.base")).where(X.paths_overlap(F.col("pa"), F.col("pb")) & (F.col("a") < F.col("b"))).select("a", "b")


@query("SELECT doc_id, array_to_string(list_filter([CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/m' || doc_id % 10 WHEN 1 THEN source || '/m' || doc_id % 10 WHEN 2 THEN source || '/shared/m' || doc_id % 10 ELSE 'm' || doc_id % 10 END], lambda x: true), '') AS target FROM documents")
def normalize_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    name = F.concat(F.lit("m"), (F.col("doc_id") % 10).cast("string"))
    k = F.col("doc_id") % 4
    relative = F.when(k == 0, F.concat(F.lit("./"), name)).when(k == 1, F.concat(F.lit("../"), name)).when(k == 2, F.concat(F.lit(".././shared//"), name)).otherwise(F.concat(F.lit("../../../../"), name))
    return d.select("doc_id", X.normalize_join(F.concat_ws("/", "source", "lang"), relative).alias("target"))


@query("WITH f AS (SELECT DISTINCT 'm' || doc_id % 50 || CASE doc_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '/index.js' END AS path FROM documents WHERE doc_id % 5 < 3), i AS (SELECT doc_id AS import_id, 'm' || doc_id % 60 AS target FROM documents), c AS (SELECT import_id, target, 0 AS nth, target AS path FROM i UNION ALL SELECT import_id, target, 1, target || '.ts' FROM i UNION ALL SELECT import_id, target, 2, target || '.js' FROM i UNION ALL SELECT import_id, target, 3, target || '/index.js' FROM i) SELECT import_id, path, nth::BIGINT AS nth FROM c JOIN f USING (path) QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY nth) = 1")
def link_first_hit(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    end = F.when(F.col("doc_id") % 3 == 0, ".js").when(F.col("doc_id") % 3 == 1, ".ts").otherwise("/index.js")
    files = d.where("doc_id % 5 < 3").select(F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string"), end).alias("path"))
    imports = d.select(F.col("doc_id").alias("import_id"), F.concat(F.lit("m"), (F.col("doc_id") % 60).cast("string")).alias("target"))
    return flow.first_hit(imports, files, ["ts", "js"], ["index.js"]).select("import_id", "path", *long("nth"))


@query("WITH RECURSIVE x AS (SELECT doc_id AS src, 'n' || doc_id % 5 AS name, doc_id + 1 + doc_id % 3 AS dst, 'n' || (doc_id + 1 + doc_id % 3) % 5 AS other FROM documents WHERE doc_id % 4 > 0), h AS (SELECT src AS start, name, dst AS target, other AS wanted, 1 AS hop FROM x UNION ALL SELECT h.start, h.name, x.dst, x.other, hop + 1 FROM h JOIN x ON x.src = h.target AND x.name = h.wanted WHERE hop < 4) SELECT start, name, target, hop::BIGINT AS hop FROM h QUALIFY row_number() OVER (PARTITION BY start, name ORDER BY hop DESC, target) = 1")
def reexport_hops(spark, sf_dir):
    d, dst = read(spark, sf_dir, "documents"), F.col("doc_id") + 1 + F.col("doc_id") % 3
    n = lambda c: F.concat(F.lit("n"), (c % 5).cast("string"))
    edges = d.where("doc_id % 4 > 0").select(F.col("doc_id").alias("src"), n(F.col("doc_id")).alias("name"), dst.alias("dst"), n(dst).alias("other"))
    return flow.hops(edges, 4).select("start", "name", "target", *long("hop"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_quantity > 45 UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity < 3), r AS (SELECT 'p1' AS node, 0 AS hop UNION SELECT e.dst, hop + 1 FROM r JOIN e ON e.src = r.node WHERE hop < 3) SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY node")
def bounded_reachability(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    edges = li.where("l_quantity > 45").select(p.alias("src"), s.alias("dst")).unionByName(li.where("l_quantity < 3").select(s.alias("src"), p.alias("dst"))).distinct()
    return flow.reach(edges, spark.range(1).select(F.lit("p1").alias("node")), 3).select("node", *long("hop"))


@query("SELECT l_partkey, min(l_shipdate) AS l_shipdate, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_linenumber, (l_shipdate, l_orderkey, l_linenumber))::BIGINT AS l_linenumber FROM lineitem GROUP BY l_partkey")
def earliest_witness(spark, sf_dir):
    return flow.earliest(read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_shipdate", "l_orderkey", *long("l_linenumber"))


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS call_id, 'f' || o_custkey % 97 AS func, (o_orderkey % 2)::INT AS arg, o_totalprice > 300000 AS source, 'f' || o_orderkey % 89 AS caller, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 2)::INT END AS caller_param FROM orders),
k AS (SELECT c_custkey AS sink_id, 'f' || c_custkey % 101 AS func, (c_custkey % 2)::INT AS arg FROM customer WHERE c_custkey % 5 = 0),
p AS (SELECT sink_id, func, arg, 1 AS level FROM k UNION SELECT p.sink_id, c.caller, c.caller_param, level + 1 FROM p JOIN c USING (func, arg) WHERE NOT source AND caller_param IS NOT NULL AND level < 3),
h AS (SELECT p.sink_id, level, call_id FROM p JOIN c USING (func, arg) WHERE source)
SELECT sink_id, level::BIGINT AS level, call_id FROM h QUALIFY row_number() OVER (PARTITION BY sink_id ORDER BY level, call_id) = 1""")
def call_stitch(spark, sf_dir):
    """Orders as calls, customers as sinks: each sink's nearest caller that passes a source, through up to three callers."""
    f = lambda c, n: F.concat(F.lit("f"), (F.col(c) % n).cast("string"))
    two = lambda c: (F.col(c) % 2).cast("int")
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), f("o_custkey", 97).alias("func"), two("o_orderkey").alias("arg"), (F.col("o_totalprice") > 300000).alias("source"), f("o_orderkey", 89).alias("caller"), F.when(F.col("o_orderkey") % 3 > 0, two("o_orderkey")).alias("caller_param"))
    sinks = read(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("sink_id"), f("c_custkey", 101).alias("func"), two("c_custkey").alias("param"))
    return flow.stitch(sinks, calls).select("sink_id", *long("level"), "call_id")


@query("SELECT user_id % 50 AS file, 'r' || user_id % 3 AS rule_id, event_type AS func, min(event_id) FILTER (event_id % 4 = 0) AS source, coalesce(array_to_string(list_sort(list(DISTINCT event_id % 6) FILTER (event_id % 4 = 1)), ','), '') AS params, coalesce(array_to_string(list_sort(list(DISTINCT event_id % 6) FILTER (event_id % 4 = 2)), ','), '') AS sinks FROM events GROUP BY ALL")
def summary_merge(spark, sf_dir):
    kind = F.when(F.col("event_id") % 4 == 0, "source").when(F.col("event_id") % 4 == 1, "returned").when(F.col("event_id") % 4 == 2, "sink")
    facts = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("file"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("rule_id"), F.col("event_type").alias("func"), kind.alias("origin"), (F.col("event_id") % 6).alias("param"), F.col("event_id").alias("place"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return flow.merge_summaries(facts).select("file", "rule_id", "func", "source", text("params"), text("sinks"))


@query("WITH d AS (SELECT DISTINCT source, sha256(text) AS h FROM documents), p AS (SELECT source, substr(h, 1, 2) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest, count(*) AS n FROM d GROUP BY ALL) SELECT source, sha256(string_agg(digest, chr(10) ORDER BY part)) AS link_fp, sum(n)::BIGINT AS deps FROM p GROUP BY source")
def link_fingerprint(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("source", "content_hash")
    return flow.set_hash(d, "source", "content_hash").select("source", F.col("digest").alias("link_fp"), F.col("count").alias("deps"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def trace_normalise(spark, sf_dir):
    return flow.without_repeats(read(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'source reaches sink' WHEN d.doc_id % 3 = 0 AND l.quality = 1 THEN 'caller passes a source' WHEN l.quality = 0 THEN 'parameter without a tainted caller' WHEN d.n_chars > 2000 THEN 'sanitised' ELSE 'nothing reaches it' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)")
def verdict_case(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    no = F.lit(False)
    return d.select("doc_id", flow.verdict(F.coalesce(F.col("toxic") == 1, no), F.coalesce((F.col("doc_id") % 3 == 0) & (F.col("quality") == 1), no), F.coalesce(F.col("quality") == 0, no), F.col("n_chars") > 2000).alias("verdict"))


#: The inline scripts of pages, every one, whatever its tag says.
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
SCRIPTS = rf"scripts AS (SELECT page_id, 'pages/' || page_id || '/' || nth AS path, nth, body FROM (SELECT page_id, unnest(m) AS body, unnest(range(1, len(m) + 1)) AS nth FROM (SELECT page_id, regexp_extract_all(html, '{SCRIPT}', 1) AS m FROM pages)))"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, nth, body of the inline scripts of pages."""
    found = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("at", "body"))
    return found.select("page_id", F.concat_ws("/", F.lit("pages"), F.col("page_id").cast("string"), (F.col("at") + 1).cast("string")).alias("path"), (F.col("at") + 1).alias("nth"), "body")


@query(rf"""WITH {SCRIPTS}, c AS (SELECT page_id, path, body, regexp_extract(body, 'var ([A-Za-z_]+)=', 1) AS variable, unnest(m) AS arg, unnest(range(0, len(m))) AS k FROM (SELECT *, regexp_extract_all(body, '\btrack\(([^)]*)\)', 1) AS m FROM scripts))
SELECT page_id, path, variable, arg, 'track(' || substr(arg, 1, 120) || ') beside ' || variable AS message, substr(sha256('finding.v1' || chr(31) || 'js.tracking-call' || chr(31) || path || chr(31) || body || chr(31) || k), 1, 32) AS fingerprint FROM c""")
def inline_script_calls(spark, sf_dir):
    s = scripts(spark, sf_dir).select("page_id", "path", "body", F.regexp_extract("body", r"var ([A-Za-z_]+)=", 1).alias("variable"), F.posexplode(F.regexp_extract_all("body", F.lit(r"\btrack\(([^)]*)\)"), F.lit(1))).alias("k", "arg"))
    return s.select("page_id", "path", "variable", "arg", X.message("track(${a}) beside ${v}", {"a": F.col("arg"), "v": F.col("variable")}).alias("message"), X.fingerprint(F.lit("js.tracking-call"), F.col("path"), F.col("body"), F.col("k")).alias("fingerprint"))


# -- trees and flows ---------------------------------------------------------------------------------------------------------
TREE_RULES = [
    {"id": "page.tracking-call", "severity": "info", "category": "quality", "message": "track(${n})", "query": '(call_expression function: (identifier) @fn arguments: (arguments . (number) @n .) (#eq? @fn "track")) @finding'},
    {"id": "page.text-variable", "severity": "low", "category": "quality", "message": "${name}", "query": "(variable_declarator name: (identifier) @name value: (string)) @finding"},
]


@query(rf"WITH {SCRIPTS} SELECT path, 'page.tracking-call' AS rule_id, 1::BIGINT AS line, (strlen(split_part(body, 'track(', 1)) + 1)::BIGINT AS start_col, 'track(' || regexp_extract(body, 'track\(([0-9]+)\)', 1) || ')' AS message FROM scripts WHERE regexp_matches(body, 'track\([0-9]+\);$') UNION ALL SELECT path, 'page.text-variable', 1, strlen(split_part(body, 't=', 1)) + 1, 't' FROM scripts WHERE regexp_matches(body, 'var t=\"')")
def pattern_findings_js(spark, sf_dir):
    from quarry.operators.rules import pattern_findings
    from quarry.sources.javascript import nodes

    files = scripts(spark, sf_dir).select("path", F.col("body").alias("text"))
    return pattern_findings(nodes(files), files, TREE_RULES).select("path", "rule_id", *long("line", "start_col"), "message")


@query(rf"WITH {SCRIPTS} SELECT path, 'string' AS kind, len(regexp_extract_all(body, '\"[^\"]*\"')) AS n FROM scripts UNION ALL SELECT path, 'call_expression', len(regexp_extract_all(body, '[a-z]+\(')) FROM scripts UNION ALL SELECT path, 'variable_declarator', len(regexp_extract_all(body, '\bvar ')) FROM scripts")
def script_nodes(spark, sf_dir):
    from quarry.sources.javascript import nodes

    files = scripts(spark, sf_dir).select("path", F.col("body").alias("text"))
    return nodes(files).where(F.col("kind").isin("string", "call_expression", "variable_declarator")).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("+ r AS (SELECT rule_id, (row_number() OVER (ORDER BY rule_id) - 1)::BIGINT AS rule_index FROM (SELECT DISTINCT rule_id FROM findings)) SELECT rule_id, rule_index, CASE severity WHEN 'info' THEN 'note' WHEN 'low' THEN 'warning' WHEN 'medium' THEN 'warning' ELSE 'error' END AS level, path, line::BIGINT AS line, start_col::BIGINT AS start_col, snippet, fingerprint FROM printed JOIN r USING (rule_id)", findings=True)
def sarif_document(spark, sf_dir):
    """Each finding as it stands in the document, read back from its JSON."""
    from quarry.operators.reports import sarif_results

    hits = materialised(found(spark, sf_dir))
    out = sarif_results(O.with_fingerprints(hits), O.rule_index(hits))
    region = "region:struct<startLine:bigint,startColumn:bigint,snippet:struct<text:string>>"
    r = F.from_json("result", f"ruleId string, ruleIndex bigint, level string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,{region}>>>, partialFingerprints map<string,string>")
    place = F.col("r.locations")[0]["physicalLocation"]
    return out.select(r.alias("r")).select(F.col("r.ruleId").alias("rule_id"), F.col("r.ruleIndex").alias("rule_index"), "r.level", place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("start_col"), place["region"]["snippet"]["text"].alias("snippet"), F.col("r.partialFingerprints")["finding/v1"].alias("fingerprint"))


#: A module and a page that uses it, made of each script: whether the module reads the request goes by the script's number, whether
#: the page escapes goes by its own length.
MODULE = "export function name(req) {{ return {0}; }}\nexport function show(el, v) {{ el.innerHTML = v; }}\n"


def sites(spark: SparkSession, sf_dir: str, parts: str = "both") -> DataFrame:
    """path, lang, text of two files for each script. Scripts are a small part of the pages and their parsing is most of the work,
    so they are dealt anew, whatever files the pages lie in."""
    s = scripts(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id", "nth").withColumn("k", F.concat_ws("-", F.col("page_id").cast("string"), F.col("nth").cast("string")))
    number = F.regexp_extract("body", r"track\((\d+)\)", 1).cast("int")
    value = F.when(number % 2 == 0, "req.query.name").otherwise("'fixed'")
    module = s.select(F.concat(F.lit("lib/"), "k", F.lit(".js")).alias("path"), F.concat(F.lit("export function name(req) { return "), value, F.lit("; }\nexport function show(el, v) { el.innerHTML = v; }\n")).alias("text"))
    shown = F.when(F.length("body") % 2 == 0, "name(req)").otherwise("encode(other)")
    page = F.concat(F.col("body"), F.lit("\nimport { name, show as put } from '../lib/"), "k", F.lit("';\nfunction view(req, el) {\n  el.innerHTML = "), shown, F.lit(";\n  put(el, req.body.text);\n}\n"))
    pages = s.select(F.concat(F.lit("site/"), "k", F.lit(".js")).alias("path"), page.alias("text"))
    return module.unionByName(pages).select("path", F.lit("javascript").alias("lang"), "text")


@query(rf"WITH {SCRIPTS}, s AS (SELECT 'site/' || page_id || '-' || nth || '.js' AS path, body, len(string_split(body, chr(10))) AS n, regexp_extract(body, 'track\((\d+)\)', 1)::INT AS number FROM scripts) SELECT path, 'js.xss.dom' AS rule_id, (n + 3)::BIGINT AS line, 'source: request' AS first_step FROM s WHERE length(body) % 2 = 0 AND number % 2 = 0 UNION ALL SELECT path, 'js.xss.dom', n + 4, 'source: request' FROM s")
def cross_file_flows(spark, sf_dir):
    """Findings between files: a source that a module returns reaches a sink here, an argument reaches a sink there."""
    from quarry.operators import dataflow, rulebook

    rules = [r for r in rulebook.load()[0] if r["id"] == "js.xss.dom"]
    first = materialised(dataflow.solved(sites(spark, sf_dir), rules).select("path", "lang", "facts", "summaries"))
    linked = first.join(dataflow.links(first, dataflow.flat_summaries(first)), "path").select("path", "lang", "facts", "links")
    out = dataflow.solved(linked, rules).select("path", F.explode("found").alias("f"))
    return out.select("path", "f.rule_id", F.col("f.line").cast("long").alias("line"), F.col("f.trace")[0]["label"].alias("first_step"))


@query(rf"WITH {SCRIPTS}, s AS (SELECT page_id || '-' || nth AS k, regexp_extract(body, 'track\((\d+)\)', 1)::INT AS number FROM scripts) SELECT 'lib/' || k || '.js' AS file, 'name' AS function, number % 2 = 0 AS returns_source, '' AS sinks FROM s WHERE number % 2 = 0 UNION ALL SELECT 'lib/' || k || '.js', 'show', false, '1' FROM s")
def portable_summaries(spark, sf_dir):
    """What functions of modules return and do, for those who import them."""
    from quarry.operators import dataflow, rulebook

    rules = [r for r in rulebook.load()[0] if r["id"] == "js.xss.dom"]
    done = dataflow.flat_summaries(dataflow.solved(sites(spark, sf_dir).where("path LIKE 'lib/%'"), rules))
    return done.select("file", "function", F.col("source").isNotNull().alias("returns_source"), F.array_join(F.transform("sinks", lambda s: s["param"].cast("string")), ",").alias("sinks"))


@query(rf"WITH {SCRIPTS}, s AS (SELECT 'site/' || page_id || '-' || nth || '.js' AS path, body FROM scripts) SELECT path, 'js.xss.dom' AS rule_id, CASE WHEN length(body) % 2 = 0 THEN 'parameter without a tainted caller' ELSE 'nothing reaches it' END AS verdict, count(*) AS n FROM s GROUP BY ALL")
def explain_fixture(spark, sf_dir):
    """Verdicts on the sinks of single files, without what other files say."""
    from quarry.operators import dataflow, rulebook

    rules = [r for r in rulebook.load()[0] if r["id"] == "js.xss.dom"]
    done = dataflow.solved(sites(spark, sf_dir).where("path LIKE 'site/%'"), rules)
    return done.select("path", F.explode("verdicts").alias("v")).groupBy("path", "v.rule_id", "v.verdict").agg(F.count("*").alias("n"))


@query(rf"WITH {SCRIPTS}, s AS (SELECT 'site/' || page_id || '-' || nth || '.js' AS path, body FROM scripts) SELECT path, 'call' AS fact, 'track' AS name, len(regexp_extract_all(body, '\btrack\(')) AS n FROM s UNION ALL SELECT path, 'assign', 't', len(regexp_extract_all(body, '\bvar t=')) FROM s UNION ALL SELECT path, 'import', 'name', 1 FROM s UNION ALL SELECT path, 'import', 'put', 1 FROM s UNION ALL SELECT path, 'function', 'view', 1 FROM s UNION ALL SELECT path, 'call', 'put', 1 FROM s UNION ALL SELECT path, 'call', CASE WHEN length(body) % 2 = 0 THEN 'name' ELSE 'encode' END, 1 FROM s UNION ALL SELECT path, 'param', 'req', 1 FROM s UNION ALL SELECT path, 'param', 'el', 1 FROM s UNION ALL SELECT path, 'assign', 'innerHTML', 1 FROM s")
def script_facts(spark, sf_dir):
    from quarry.sources import facts

    flat = facts.facts(facts.with_facts(sites(spark, sf_dir).where("path LIKE 'site/%'"))).where("fact IN ('call', 'assign', 'import', 'function', 'param')")
    return flat.groupBy("path", "fact", "name").agg(F.count("*").alias("n"))


# -- names -------------------------------------------------------------------------------------------------------------------
#: Calls, imports and functions made of documents: a file is a source and language.
NAMES = """c AS (SELECT doc_id AS start, source || '/' || lang AS path, 'f' || doc_id % 7 AS name, CASE doc_id % 3 WHEN 0 THEN 'f' || doc_id % 7 WHEN 1 THEN 'm' || doc_id % 5 || '.f' || doc_id % 7 ELSE 'x.y.f' || doc_id % 7 END AS target FROM documents),
i AS (SELECT path, local, min((module, name)) AS b FROM (SELECT DISTINCT source || '/' || lang AS path, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id % 4 ELSE 'm' || doc_id % 3 END AS local, 'mod' || doc_id % 3 AS module, CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id % 4 ELSE '*' END AS name FROM documents WHERE doc_id % 11 < 4) GROUP BY ALL),
f AS (SELECT DISTINCT source || '/' || lang AS path, 'f' || doc_id % 7 AS name FROM documents WHERE doc_id % 13 < 3),
r AS (SELECT c.path, c.start, c.target, CASE WHEN contains(target, '.') THEN c.name WHEN i.b[2] <> '*' THEN i.b[2] ELSE c.name END AS symbol, CASE WHEN contains(target, '.') OR i.b[2] <> '*' THEN i.b[1] END AS module,
  CASE WHEN contains(target, '.') THEN CASE WHEN i.b IS NULL THEN 'member' ELSE 'external' END WHEN i.b[2] <> '*' THEN 'external' WHEN f.name IS NOT NULL THEN 'local' ELSE 'unresolved' END AS resolution
  FROM c LEFT JOIN i ON i.path = c.path AND i.local = split_part(c.target, '.', 1) LEFT JOIN f ON f.path = c.path AND f.name = c.target)""".replace("b[1]", "b.module").replace("b[2]", "b.name").replace("min((module, name))", "arg_min(struct_pack(module := module, name := name), (module, name))")


def named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, imports, functions."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    n = lambda letter, k: F.concat(F.lit(letter), (F.col("doc_id") % k).cast("string"))
    f7, even = n("f", 7), F.col("doc_id") % 2 == 0
    target = F.when(F.col("doc_id") % 3 == 0, f7).when(F.col("doc_id") % 3 == 1, F.concat(n("m", 5), F.lit("."), f7)).otherwise(F.concat(F.lit("x.y."), f7))
    calls = d.select("path", F.col("doc_id").alias("start"), f7.alias("name"), target.alias("target"))
    imports = d.where("doc_id % 11 < 4").select("path", F.when(even, n("f", 4)).otherwise(n("m", 3)).alias("local"), n("mod", 3).alias("module"), F.when(even, n("g", 4)).otherwise(F.lit("*")).alias("name")).distinct()
    return calls, imports, d.where("doc_id % 13 < 3").select("path", f7.alias("name")).distinct()


@query(f"WITH {NAMES} SELECT * FROM r")
def call_resolution(spark, sf_dir):
    from quarry.operators import binder

    return binder.resolved_calls(*named(spark, sf_dir)).select("path", "start", "target", "symbol", "module", "resolution")


@query(f"WITH {NAMES} SELECT c.path, c.start, split_part(c.target, '.', 1) AS base, array_to_string(string_split(c.target, '.')[2:4], '.') AS fields, i.b.module AS module FROM c LEFT JOIN i ON i.path = c.path AND i.local = split_part(c.target, '.', 1)")
def read_resolution(spark, sf_dir):
    from quarry.operators import binder

    calls, imports, _ = named(spark, sf_dir)
    return binder.resolved_reads(calls, imports).select("path", "start", "base", F.array_join("fields", ".").alias("fields"), "module")


@query(rf"WITH {NAMES}, m(matcher_id, name, module, unresolved) AS (VALUES (1, 'g1', 'mod1', false), (2, 'f1', 'mod0', false), (3, 'f2', NULL, false), (4, 'f5', NULL, true), (5, 'f3', 'x.y', false)) SELECT matcher_id::BIGINT AS matcher_id, path, start, target FROM r JOIN m ON m.name = r.symbol WHERE CASE WHEN m.module IS NOT NULL THEN coalesce(r.module, regexp_extract(target, '^(.*)\.[^.]*$', 1)) = m.module ELSE unresolved OR resolution <> 'unresolved' END")
def identity_matches(spark, sf_dir):
    from quarry.operators import binder

    matchers = spark.createDataFrame([(1, "g1", "mod1", False), (2, "f1", "mod0", False), (3, "f2", None, False), (4, "f5", None, True), (5, "f3", "x.y", False)], "matcher_id long, name string, module string, unresolved boolean")
    return binder.identity_hits(binder.resolved_calls(*named(spark, sf_dir)), matchers)


@query(f"WITH {NAMES}, q AS (SELECT c.path, c.start, c.target, split_part(c.target, '.', 1) AS base, string_split(c.target, '.')[2:4] AS fields, i.b.module AS module FROM c LEFT JOIN i ON i.path = c.path AND i.local = split_part(c.target, '.', 1)), m(matcher_id, module, member_of, fields) AS (VALUES (1, 'mod1', NULL, []), (2, NULL, 'x', ['y']), (3, NULL, NULL, ['f3']), (4, NULL, 'x', ['f1'])) SELECT matcher_id::BIGINT AS matcher_id, path, start, target FROM q JOIN m ON CASE WHEN m.module IS NOT NULL THEN q.module = m.module WHEN member_of IS NOT NULL THEN base = member_of ELSE true END AND q.fields[1:len(m.fields)] = m.fields")
def read_matches(spark, sf_dir):
    from quarry.operators import binder

    calls, imports, _ = named(spark, sf_dir)
    matchers = spark.createDataFrame([(1, "mod1", None, []), (2, None, "x", ["y"]), (3, None, None, ["f3"]), (4, None, "x", ["f1"])], "matcher_id long, module string, member_of string, fields array<string>")
    return binder.reads_matched(binder.resolved_reads(calls, imports), matchers)


# -- rules, benchmark, states --------------------------------------------------------------------------------------------------
@query("+ u AS (SELECT rule_id, path, line, start_col FROM findings WHERE rule_id IN ('txt.email', 'txt.ipv4') UNION SELECT 'txt.any', path, line, start_col FROM findings WHERE rule_id IN ('txt.phone', 'txt.licence')) SELECT rule_id, path, line::BIGINT AS line, start_col::BIGINT AS start_col FROM u", findings=True)
def multi_rule_union(spark, sf_dir):
    """Two rules as they are, and two patterns of one rule, whose equal places count once."""
    files = corpus.documents(spark, sf_dir)
    own = [r for r in RULES if r["id"] in ("txt.email", "txt.ipv4")]
    one = [r | {"id": "txt.any"} for r in RULES if r["id"] in ("txt.phone", "txt.licence")]
    both = O.line_findings(files, own).unionByName(O.line_findings(files, one))
    return O.one_each(both, ["path", "rule_id", "line", "start_col"], ["severity"]).select("rule_id", "path", *long("line", "start_col"))


@query("+ e AS (SELECT rule_id, count(DISTINCT path) FILTER (quality = 1) AS positives, count(DISTINCT path) FILTER (quality = 0) AS negatives FROM findings JOIN labels USING (doc_id) GROUP BY rule_id) SELECT rule_id, severity, CASE WHEN positives >= 2 AND negatives >= 2 THEN 'high' WHEN positives >= 1 AND negatives >= 1 THEN 'medium' ELSE 'low' END AS precision FROM rules LEFT JOIN e USING (rule_id)", findings=True)
def rule_evidence(spark, sf_dir):
    """Rules with the tier that evidence gives them; those without any are low."""
    from quarry.operators import rulebook

    of = lambda q: F.count_distinct(F.when(F.col("quality") == q, F.col("path")))
    seen = found(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").groupBy("rule_id").agg(of(1).alias("p"), of(0).alias("n"))
    evidence = {r["rule_id"]: (r["p"], r["n"]) for r in seen.collect()}  # a row a rule
    rules = [{"id": r["id"], "severity": r["severity"], "category": "security", "kind": "pattern", "languages": [], "message": "", "cwe": r["cwe"], "owasp": r["owasp"], "nist": [], "tags": []} for r in RULES]
    return rulebook.table(spark, rules, evidence).select("rule_id", "severity", "precision")


@query("""WITH f AS (SELECT doc_id, doc_id // 3 AS tc, 'CWE-' || (CASE doc_id // 3 % 4 WHEN 0 THEN '89' WHEN 1 THEN '78' WHEN 2 THEN '22' ELSE '999' END) AS cwe, doc_id // 3 % 2 = 0 AS first FROM documents),
hit AS (SELECT f.doc_id, line FROM f JOIN labels USING (doc_id), (VALUES (3), (12)) t(line) WHERE (toxic = 1 AND line = 3) OR (quality = 0 AND line = 12)),
g AS (SELECT f.*, exists(SELECT 1 FROM hit WHERE hit.doc_id = f.doc_id AND line = 3) AS bad_hit, exists(SELECT 1 FROM hit WHERE hit.doc_id = f.doc_id AND line = 12) AS good_hit FROM f WHERE cwe <> 'CWE-999'),
t AS (SELECT cwe, tc, bool_or(bad_hit) AS struck, count(*) FILTER (good_hit) AS fp, count(*) FILTER (NOT good_hit) AS tn FROM g GROUP BY cwe, tc)
SELECT cwe, count(*) FILTER (struck) AS tp, sum(fp)::BIGINT AS fp, count(*) FILTER (NOT struck) AS fn, sum(tn)::BIGINT AS tn FROM t GROUP BY ROLLUP (cwe)""")
def benchmark_score(spark, sf_dir):
    """Documents as files of test cases of three files, each with a bad function (lines 1 to 9) that holds a smaller block, and a good one."""
    from quarry.operators import benchmark

    d, k = read(spark, sf_dir, "documents").select("doc_id"), F.floor(F.col("doc_id") / 3)
    number = F.when(k % 4 == 0, "89").when(k % 4 == 1, "78").when(k % 4 == 2, "22").otherwise("999")
    letter = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("t/CWE"), number, F.lit("_case"), k.cast("string"), F.lit("_"), F.when(k % 2 == 0, "01").otherwise("81"), letter, F.lit(".cs"))
    files = benchmark.named(d.select("doc_id", name.alias("path")))
    regions = files.select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("region_id"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(kind).alias("kind")) for i, s, e, kind in ((1, 1, 9, "bad"), (2, 10, 15, "good"))])).alias("r")).select("path", "r.*")
    rule = F.when(F.col("cwe") == "CWE-89", "cs.sql-injection").when(F.col("cwe") == "CWE-78", "cs.cmd-injection").otherwise("cs.path-traversal")
    labelled = files.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("rule_id", rule)
    findings = labelled.where("toxic = 1").select("path", "rule_id", F.lit(3).alias("line")).unionByName(labelled.where("quality = 0").select("path", "rule_id", F.lit(12).alias("line")))
    return benchmark.score(files, regions, findings)[0].select("cwe", *long("tp", "fp", "fn", "tn"))


@query("SELECT doc_id, 'a' || doc_id % 9 AS local, CASE WHEN doc_id % 9 > 4 THEN 'b' || (doc_id % 9 - 4) % 3 ELSE 'b' || doc_id % 9 END AS target FROM documents WHERE doc_id % 9 < 5 UNION ALL SELECT doc_id, 'c', 'b' || doc_id % 9 FROM documents WHERE doc_id % 9 < 5 UNION ALL SELECT doc_id, 'd', 'z' FROM documents")
def alias_hops(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).cast("string").alias("k"))
    own = d.where("doc_id % 9 < 5").select(F.col("doc_id").alias("path"), F.concat(F.lit("a"), "k").alias("local"), F.concat(F.lit("b"), "k").alias("target"))
    to_own = d.where("doc_id % 9 < 5").select(F.col("doc_id").alias("path"), F.lit("c").alias("local"), F.concat(F.lit("a"), "k").alias("target"))
    other = d.select(F.col("doc_id").alias("path"), F.lit("d").alias("local"), F.lit("z").alias("target"))
    rows = own.unionByName(to_own).unionByName(other).withColumn("name", F.lit("*"))
    return flow.alias_hop(rows).select(F.col("path").alias("doc_id"), "local", "target")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::BIGINT AS external FROM events")
def external_origins(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("rule_id"), F.col("event_id").alias("start"))
    return flow.minted(calls).select(F.col("path").alias("user_id"), F.col("start").alias("event_id"), *long("external"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, sha256(h || chr(31) || 'rules' || chr(31) || '1') AS key FROM d")
def summary_keys(spark, sf_dir):
    from quarry.state import summary_key

    return corpus.documents(spark, sf_dir).select("doc_id", summary_key(F.col("content_hash"), "rules").alias("key"))


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source || '/' || lang || '/' || doc_id = 'nothing' OR starts_with(source || '/' || lang || '/' || doc_id, (SELECT min(source) FROM documents) || '/en/') OR source = (SELECT max(source) FROM documents)")
def paths_under(spark, sf_dir):
    """Files at or below explicit paths: prefixes end at a folder."""
    from quarry.scan import under

    d = corpus.documents(spark, sf_dir)
    low, high = d.agg(F.min("source"), F.max("source")).first()
    return d.where(under(F.col("path"), [f"{low}/en", high, "nothing"])).select("doc_id", "path")


@query("+ f AS (SELECT p.*, string_split_regex(d.text, '\\r?\\n') AS l FROM printed p JOIN documents d USING (doc_id) WHERE severity_rank >= 2), g AS (SELECT *, greatest(1, line - 2) AS first, least(line + 4, line) AS last FROM f), n AS (SELECT fingerprint, line, unnest(range(first, last + 1)) AS number, l FROM g) SELECT fingerprint, number::BIGINT AS number, substr(l[number], 1, 160) AS text, number >= line AS inside FROM n", findings=True)
def code_frames(spark, sf_dir):
    """The lines shown around each finding of medium severity and above."""
    from quarry.operators.reports import with_frames

    hits = O.with_fingerprints(found(spark, sf_dir)).where("severity_rank >= 2").withColumn("end_line", F.col("line"))
    frames = with_frames(hits, corpus.documents(spark, sf_dir).select("path", "text"))
    return frames.select("fingerprint", F.explode("frame").alias("k")).select("fingerprint", F.col("k.number").cast("long").alias("number"), "k.text", "k.inside")


@query("SELECT rule_id, array_to_string(list_concat(list_concat(list_transform(cwe, lambda x: 'external/cwe/' || lower(x)), list_transform(owasp, lambda x: 'owasp/' || x)), ['own']), ' ') AS tags, CASE WHEN severity = 'high' THEN 'about' || chr(10) || chr(10) || 'fix' WHEN severity = 'low' THEN 'fix' ELSE 'said' END AS help FROM rules WHERE rule_id IN (SELECT rule_id FROM findings)", findings=True)
def rule_tags(spark, sf_dir):
    """Tags and help of the rules that fired, as a SARIF document has them."""
    from quarry.operators.reports import help_text, sarif_tags

    none = F.lit(None).cast("string")
    rules = fired_rules(spark, sf_dir).withColumns({"about": F.when(F.col("severity") == "high", "about").otherwise(none), "fix": F.when(F.col("severity").isin("high", "low"), "fix").otherwise(none)})
    tags = sarif_tags(F.col("cwe"), F.col("owasp"), F.lit(None).cast("array<string>"), F.array(F.lit("own")))
    return rules.select("rule_id", F.array_join(tags, " ").alias("tags"), help_text(F.col("about"), F.col("fix"), F.lit("said")).alias("help"))


@query("""WITH i AS (SELECT doc_id, source || '/' || lang AS path, 'org/pkg' || doc_id % 4 || '.Unit' || doc_id % 9 AS module FROM documents), d AS (SELECT DISTINCT 'lib' || doc_id % 50 AS file, CASE WHEN doc_id % 2 = 0 THEN 'Unit' || doc_id % 9 ELSE 'org/pkg' || doc_id % 4 || '.Unit' || doc_id % 9 END AS name FROM documents WHERE doc_id % 7 = 0)
SELECT DISTINCT i.path, i.module, d.file FROM i JOIN d ON d.name = i.module OR d.name = string_split_regex(i.module, '[/:.]+')[-1]""")
def symbol_imports(spark, sf_dir):
    """Imports by name, with the files that declare the whole name or its last part."""
    from quarry.operators import dataflow

    d = read(spark, sf_dir, "documents")
    unit = F.concat(F.lit("Unit"), (F.col("doc_id") % 9).cast("string"))
    whole = F.concat(F.lit("org/pkg"), (F.col("doc_id") % 4).cast("string"), F.lit("."), unit)
    imported = d.select(F.concat_ws("/", "source", F.col("lang")).alias("path"), F.lit("csharp").alias("lang"), unit.alias("local"), whole.alias("module"), F.lit("*").alias("name"))
    declared = d.where("doc_id % 7 = 0").select(F.concat(F.lit("lib"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.when(F.col("doc_id") % 2 == 0, unit).otherwise(whole).alias("name")).distinct()
    return dataflow.by_symbol(imported, declared).select("path", "module", "file").distinct()


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'build/a' WHEN 1 THEN 'src/build/b.min.js' WHEN 2 THEN 'src/keep.min.js' WHEN 3 THEN 'only.js' WHEN 4 THEN 'src/only.js' ELSE 'docs/x/y/' || lang || '.md' END AS path FROM documents)
SELECT doc_id FROM p WHERE NOT (CASE WHEN path = 'src/keep.min.js' THEN false WHEN regexp_matches(path, '(^|/)build/') OR path LIKE '%.min.js' OR path = 'only.js' OR (path LIKE 'docs/%' AND path LIKE '%/en.md') THEN true ELSE false END)""")
def ignore_scope(spark, sf_dir):
    """Paths that ignore files let through: folders, suffixes, what is kept after all, what stands at the top only."""
    from quarry.scan import ignore_patterns, ignored

    k = F.col("doc_id") % 6
    path = F.when(k == 0, "build/a").when(k == 1, "src/build/b.min.js").when(k == 2, "src/keep.min.js").when(k == 3, "only.js").when(k == 4, "src/only.js").otherwise(F.concat(F.lit("docs/x/y/"), "lang", F.lit(".md")))
    rules = ignore_patterns("", ["# note", "build/", "*.min.js", "/only.js", "docs/**/en.md"]) + ignore_patterns("src/", ["!keep.min.js"])
    return read(spark, sf_dir, "documents").withColumn("path", path).where(~ignored(F.col("path"), rules)).select("doc_id")


@query(r"""WITH d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'a.b.c.d.e' WHEN 1 THEN '$x' WHEN 2 THEN 'f(y.z).w' WHEN 3 THEN 'r[0].q' ELSE '12' END AS expr, CASE doc_id % 6 WHEN 0 THEN ' Note' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'error' WHEN 3 THEN 'High' WHEN 4 THEN 'info ' ELSE 'loud' END AS word FROM documents)
SELECT doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, string_split_regex(path || ':x.y' || doc_id % 3, '[/:.]')[-1] AS last, 'k' || doc_id % 4 AS bare, substr(path, 1, 6) || '…' AS short,
  CASE doc_id % 6 WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'info' END AS severity, CASE doc_id % 5 WHEN 0 THEN 'a.b.c.d' WHEN 1 THEN '$x' WHEN 2 THEN 'f' WHEN 3 THEN 'r' END AS node,
  CASE doc_id % 3 WHEN 0 THEN 'al' WHEN 1 THEN 'na' ELSE 'z' || doc_id % 7 END AS local, doc_id % 3 < 2 AS is_source, doc_id % 4 <= doc_id % 5 AND doc_id % 6 <= doc_id % 7 AS held, CASE WHEN doc_id % 2 = 0 THEN 'quality' END AS category FROM d""")
def scalar_functions(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc_id", "path")
    k = lambda n: F.col("doc_id") % n
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k(n) + 1).cast("int"))
    text = lambda n: k(n).cast("string")
    none = F.lit(None).cast("string")
    return d.select(
        "doc_id", X.parent_dir(F.col("path")).alias("parent"), X.last_segment(F.concat("path", F.lit(":x.y"), text(3))).alias("last"), X.unquote(F.concat(F.lit("'`k"), text(4), F.lit('"'))).alias("bare"), X.truncate(F.col("path"), 6).alias("short"),
        X.parse_severity(pick(6, " Note", "WARNING", "error", "High", "info ", "loud")).alias("severity"), X.render_path(X.node_path(pick(5, "a.b.c.d.e", "$x", "f(y.z).w", "r[0].q", "12"))).alias("node"),
        X.import_local(F.when(k(3) == 0, "al").otherwise(none), F.when(k(3) < 2, "na").otherwise(none), F.concat(F.lit("x/y/z"), text(7))).alias("local"), X.is_source(pick(3, "s", "x", "p")).alias("is_source"), X.contains(k(4), k(7), k(5), k(6)).alias("held"), X.category(pick(2, " Quality", "other")).alias("category"),
    )


@query("SELECT rule_id FROM rules r WHERE EXISTS (SELECT 1 FROM documents d WHERE d.lang > 'en' AND list_contains(r.langs, d.lang))", findings=True)
def live_rules(spark, sf_dir):
    """Rules that run for at least one of the languages of some documents."""
    from quarry.operators import rulebook

    rules = rule_table(spark).withColumnRenamed("langs", "languages")
    return rulebook.live(rules, read(spark, sf_dir, "documents").where("lang > 'en'").select("lang").distinct()).select("rule_id")


@query("+ t AS (SELECT path, count(*) FILTER (rule_id = 'txt.email') AS n FROM findings GROUP BY path) SELECT count(*) AS files, count(*) FILTER (n > 0) AS passed, round(count(*) FILTER (n > 0) / count(*), 9) AS ratio FROM t", findings=True)
def verified_ratio(spark, sf_dir):
    """How many of the files with findings have one of a kind: a count of those that pass, and their share."""
    from quarry.operators import measures

    t = found(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("rule_id") == "txt.email").alias("n"))
    return measures.passed(t, F.col("n") > 0).select(F.col("total").alias("files"), "passed", F.round("ratio", 9).alias("ratio"))


@query(r"""WITH RECURSIVE a AS (SELECT user_id AS path, event_id AS id, event_id % 4 AS scope, event_type AS base, CASE WHEN event_id % 3 = 0 THEN ['k' || event_id % 2, 'z'] WHEN event_id % 3 = 1 THEN ['k' || event_id % 2] ELSE [] END AS fields,
    ['click', 'view', 'purchase', 'error', 'signup'][1 + floor(value)::BIGINT % 5] AS rbase, CASE WHEN event_id % 5 < 3 THEN ['k' || event_id % 2] ELSE ['k0', 'z', 'y'] END AS rfields, floor(value * 10)::BIGINT % 12 = 0 AS source, event_id % 7 = 0 AS clean FROM events),
anc(child, ancestor) AS (VALUES (1, 0), (2, 0), (3, 0), (2, 1), (3, 1)),
vis AS (SELECT i.id AS i, j.id AS j FROM a i JOIN a j ON i.path = j.path AND i.base = j.rbase AND i.fields[1:least(len(i.fields), len(j.rfields))] = j.rfields[1:least(len(i.fields), len(j.rfields))]
    LEFT JOIN anc ON anc.child = j.scope AND anc.ancestor = i.scope WHERE NOT j.clean AND (i.scope = j.scope AND i.id < j.id OR anc.child IS NOT NULL)),
reach(id, origin) AS (SELECT id, id FROM a WHERE source UNION SELECT vis.j, reach.origin FROM reach JOIN vis ON vis.i = reach.id)
SELECT path, scope, base, array_to_string(fields, '.') AS fields, origin, min(a.id) AS written FROM reach JOIN a USING (id) GROUP BY ALL""")
def assignment_fixpoint(spark, sf_dir):
    """Events as assignments of their user: each writes a place, reads one, and some bring an origin of their own. What each place
    comes to hold, with the least write, in rounds over what is new."""
    from quarry.operators import taint

    e = read(spark, sf_dir, "events")
    key = F.concat(F.lit("k"), (F.col("event_id") % 2).cast("string"))
    none = F.array().cast("array<string>")
    third = F.col("event_id") % 3
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "error", "signup")])
    cell = [F.col("user_id").alias("path"), (F.col("event_id") % 4).alias("scope"), F.col("event_type").alias("base"), F.when(third == 0, F.array(key, F.lit("z"))).when(third == 1, F.array(key)).otherwise(none).alias("fields"), F.col("event_id").alias("at")]
    reads = e.select("user_id", F.col("event_id").alias("read"), (F.col("event_id") % 4).alias("scope"), F.get(kinds, (F.floor("value") % 5).cast("int")).alias("base"), F.when(F.col("event_id") % 5 < 3, F.array(key)).otherwise(F.array(F.lit("k0"), F.lit("z"), F.lit("y"))).alias("fields"), F.col("event_id").alias("at")).withColumnRenamed("user_id", "path")
    above = F.array(*[F.struct(F.lit(c).cast("long").alias("child"), F.lit(p).cast("long").alias("ancestor")) for c, p in ((1, 0), (2, 0), (3, 0), (2, 1), (3, 1))])
    around = e.select(F.col("user_id").alias("path")).distinct().select("path", F.explode(above).alias("a")).select("path", "a.child", "a.ancestor")
    cleaned = e.where("event_id % 7 = 0").select(F.col("user_id").alias("path"), F.lit("r").alias("rule"), F.col("event_id").alias("read"))
    put = e.where(F.floor(F.col("value") * 10) % 12 == 0).select(*cell, F.lit("r").alias("rule"), F.col("event_id").alias("origin"))
    held = taint.Spread(reads, e.select(*cell, F.col("event_id").alias("read")), around, cleaned).grow(put).held()
    return held.select("path", "scope", "base", F.array_join("fields", ".").alias("fields"), "origin", F.col("at").alias("written"))


#: Syllables that rules of words are made of: 1,000 rules by a rule.
SYLLABLES = ("th", "an", "er", "in", "on", "re", "ed", "nd", "ha", "at")


def word_rules() -> list[dict]:
    """A rule for each word of three syllables at the start of a word that a mark ends."""
    return [{"id": f"w.{a}{b}{c}", "severity": "info", "pattern": f"(?:^| ){a}{b}{c}[a-z]*[.,!]"} for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]


@query("""WITH s(x) AS (SELECT unnest(['th', 'an', 'er', 'in', 'on', 're', 'ed', 'nd', 'ha', 'at'])), r AS (SELECT a.x || b.x || c.x AS word FROM s a, s b, s c),
cut AS (SELECT string_split_regex(text, '\\r?\\n') AS p FROM documents), l AS (SELECT unnest(p) AS line FROM cut),
w AS (SELECT trim(unnest(regexp_extract_all(line, '(?:^| )[a-z]+[.,!]'))) AS token FROM l)
SELECT 'w.' || word AS rule_id, count(*) AS n FROM w JOIN r ON starts_with(token, word) GROUP BY ALL""")
def word_rule_findings(spark, sf_dir):
    """A thousand rules over all lines, through the index of their literals."""
    from quarry.operators import literals

    return literals.line_findings(corpus.documents(spark, sf_dir), word_rules()).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'org/pkg' || doc_id % 4 || '.Unit' || doc_id % 90 ELSE 'Unit' || doc_id % 120 END AS module FROM documents),
d AS (SELECT DISTINCT 'lib' || doc_id % 50 AS file, CASE WHEN doc_id % 2 = 0 THEN 'Unit' || doc_id % 90 WHEN doc_id % 5 = 0 THEN 'other::pkg1' || '.Unit' || doc_id % 90 ELSE 'pkg' || doc_id % 4 || '/Unit' || doc_id % 90 END AS name FROM documents WHERE doc_id % 7 = 0),
c AS (SELECT array_to_string(string_split_regex(name, '[/:.]+'), '.') AS suffix, count(DISTINCT file) AS files, min(file) AS file FROM d GROUP BY 1),
e AS (SELECT module, string_split_regex(module, '[/:.]+') AS p FROM i), s AS (SELECT module, unnest([array_to_string(p[k:], '.') for k in range(1, len(p) + 1)]) AS suffix FROM e)
SELECT module, suffix, files, CASE WHEN files = 1 THEN file END AS file FROM s JOIN c USING (suffix) QUALIFY row_number() OVER (PARTITION BY module ORDER BY length(suffix) DESC) = 1""")
def symbol_classes(spark, sf_dir):
    """Imports by name: the longest end of each that files declare, as a class with its count."""
    from quarry.operators import dataflow

    d = read(spark, sf_dir, "documents")
    unit = F.concat(F.lit("Unit"), (F.col("doc_id") % 90).cast("string"))
    pkg = F.concat(F.lit("pkg"), (F.col("doc_id") % 4).cast("string"))
    imported = d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("org/"), pkg, F.lit("."), unit)).otherwise(F.concat(F.lit("Unit"), (F.col("doc_id") % 120).cast("string"))).alias("module"))
    name = F.when(F.col("doc_id") % 2 == 0, unit).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("other::pkg1."), unit)).otherwise(F.concat(pkg, F.lit("/"), unit))
    declared = d.where("doc_id % 7 = 0").select(F.concat(F.lit("lib"), (F.col("doc_id") % 50).cast("string")).alias("file"), name.alias("name")).distinct()
    return dataflow.by_longest_suffix(imported, declared).select("module", "suffix", *long("files"), "file")


@query("""WITH o AS (SELECT source || '/' || lang || '/d' || doc_id % 10 || '/' || doc_id AS path, text AS body FROM documents),
n AS (SELECT source || '/' || lang || '/d' || doc_id % 10 || '/' || CASE WHEN doc_id % 103 = 0 THEN 'new/' ELSE '' END || doc_id AS path, CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END AS body FROM documents WHERE doc_id % 101 > 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'edited' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.body IS DISTINCT FROM n.body""")
def snapshot_changes(spark, sf_dir):
    """Documents as files against an edited copy: trees of digests, compared from the top."""
    from quarry.functions.scalars import content_hash
    from quarry.operators import snapshots

    d, number = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    folder = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string")))
    old = d.select(F.concat_ws("/", folder, number).alias("path"), content_hash(F.col("text")).alias("content_hash"))
    moved = F.when(F.col("doc_id") % 103 == 0, F.concat(F.lit("new/"), number)).otherwise(number)
    edited = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 101 > 0").select(F.concat_ws("/", folder, moved).alias("path"), content_hash(edited).alias("content_hash"))
    return snapshots.changes(snapshots.Tree(old), snapshots.Tree(new))[0]
