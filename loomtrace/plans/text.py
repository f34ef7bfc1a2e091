"""Queries of scalar functions over texts, URLs and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intents, shell, text
from ..sources.bridge import Frames
from .registry import query


@query(
    "url_strip",
    r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS stripped, nullif(regexp_extract(url, "
    r"'^https?://([^/?#:]+)', 1), '') AS host FROM pages",
    (),
)
def url_strip(f: Frames) -> DataFrame:
    return f.table("pages").select(
        "page_id", text.strip_url(F.col("url")).alias("stripped"), text.url_host(F.col("url")).alias("host")
    )


@query(
    "normalize_ws",
    r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest, "
    r"length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS chars FROM documents",
    (),
)
def normalize_ws(f: Frames) -> DataFrame:
    clean = text.normalize_space(F.col("text"))
    return f.table("documents").select(
        "doc_id", F.sha2(clean, 256).alias("digest"), F.length(clean).cast("long").alias("chars")
    )


def _error_text(column: str, k: str) -> str:
    return (
        f"CASE {k} % 6 WHEN 0 THEN 'Traceback (most recent call last) ' || {column} WHEN 1 THEN 'fatal: bad object ' "
        f"|| {column} WHEN 2 THEN 'Exit code ' || {k} || chr(10) || 'x' || chr(10) || 'an error in /usr/lib/' || "
        f"{column} WHEN 3 THEN 'HTTP 404 at /srv/a/b.c' WHEN 4 THEN 'tool: command not found' ELSE {column} END"
    )


_SPARK_ERRORS = _error_text("event_type", "k").replace("chr(10)", "'\\n'")
_ERRORS = f"WITH e AS (SELECT *, {_error_text('event_type', 'k')} AS err FROM ev)"


@query(
    "classify_error_text",
    _ERRORS
    + r""" SELECT CASE WHEN regexp_matches(err, '(?i)CategoryInfo|FullyQualifiedErrorId') THEN 'powershell' WHEN
  regexp_matches(err, '(?i)^rg:|regex parse error') THEN 'rg' WHEN regexp_matches(err,
  'Traceback \(most recent call last\)|\w+Error:') THEN 'python'
  WHEN regexp_matches(err, '(?i)^fatal:|not a git repository') THEN 'git' WHEN regexp_matches(err,
    '(?i)\b(?:401|403|404|429|500|502|503)\b|connection refused|timed out') THEN 'service' WHEN regexp_matches(err,
    '(?i)command not found|is not recognized|introuvable') THEN 'command_not_found'
  WHEN regexp_matches(err, '(?i)exit code [1-9]|failed: [1-9]') THEN 'script_result' ELSE 'unclassified' END AS kind,
    count(*) AS n FROM e GROUP BY 1""",
    ("ev",),
)
def classify_error_text(f: Frames) -> DataFrame:
    err = f.events.select(F.expr(_SPARK_ERRORS).alias("err"))
    return err.groupBy(text.error_kind(F.col("err")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "error_signature_top",
    _ERRORS
    + r""", s AS (SELECT split_part(err, chr(10), 1) AS head, regexp_extract(err,
  '(?i)\n([^\n]*(?:error|exception|fatal|denied|not found|introuvable)[^\n]*)', 1) AS found FROM e),
l AS (SELECT CASE WHEN regexp_matches(head, '^Exit code \d+$') AND found <> '' THEN head || ': ' || found ELSE head END
  AS line FROM s),
g AS (SELECT left(regexp_replace(regexp_replace(regexp_replace(line, '[A-Za-z]:\\[^\s:"'']+|/[\w.\-]+(/[\w.\-]+)+',
  '<path>', 'g'), '\b[0-9a-f]{7,}\b', '<hex>', 'g'), '\d+', '<n>', 'g'), 160) AS signature FROM l)
SELECT signature, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, signature LIMIT 10""",
    ("ev",),
)
def error_signature_top(f: Frames) -> DataFrame:
    signed = f.events.select(text.error_signature(F.expr(_SPARK_ERRORS)).alias("signature"))
    return signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(10)


@query(
    "strip_trailer",
    r"SELECT doc_id, length(regexp_replace(text || chr(10) || 'took 3 ms' || chr(10) || 'took 12 ms', '(\n(took \d+ "
    r"ms))+$', '')) AS chars FROM documents",
    (),
)
def strip_trailer(f: Frames) -> DataFrame:
    long_text = F.concat("text", F.lit("\ntook 3 ms\ntook 12 ms"))
    return f.table("documents").select(
        "doc_id", F.length(text.strip_trailer(long_text, r"took \d+ ms")).cast("long").alias("chars")
    )


@query(
    "path_normalize",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path FROM
  pages)
SELECT page_id, array_to_string(list_filter(string_split(replace('/' || path || '/./x', '\', '/'), '/'), lambda x: x <>
  '' AND x <> '.'), '/') AS below, '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/')
  AS normal FROM p""",
    (),
)
def path_normalize(f: Frames) -> DataFrame:
    path = F.regexp_replace(text.strip_url(F.col("url")), "^https?://", "")
    rows = f.table("pages").select("page_id", path.alias("path"))
    root = F.lit("/")
    full = text.normalize_path(F.concat(root, F.col("path"), F.lit("/./x")))
    return rows.select(
        "page_id",
        F.substring(full, F.lit(2), F.length(full)).alias("below"),
        text.normalize_path(F.concat(root, F.col("path"), F.lit("/y/.."))).alias("normal"),
    )


@query(
    "path_touch_join",
    r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#]+)', 1) AS path FROM pages), s AS (SELECT
  path, string_split(path, '/')[-1] AS tail FROM p WHERE path <> '')
SELECT a.path AS path, count(*) AS touching FROM s a JOIN s b ON a.tail = b.tail AND (a.path = b.path OR
  ends_with(a.path, '/' || b.path) OR ends_with(b.path, '/' || a.path)) GROUP BY 1""",
    (),
)
def path_touch_join(f: Frames) -> DataFrame:
    """Paths that may be one: a path meets what it ends with, its last parts one by one, so that paths of one last part
    are not compared with each other."""
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]+)", 1)
    s = f.table("pages").select(path.alias("path")).filter("path <> ''").distinct()
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    short = s.select("path", F.explode(F.when(F.size(parts) > 1, ends)).alias("other")).join(
        s.withColumnRenamed("path", "other"), "other"
    )
    both = short.select(F.explode(F.array("path", "other")).alias("path"))
    return s.unionByName(both).groupBy("path").agg(F.count(F.lit(1)).alias("touching"))


# Parts of commands, put together by the numbers of an event; "#" divides them.
_HEADS = (
    "cat#rg TODO#git status#git push origin#sed -i s/a/b/ x.py#sed -n 1,5p x.py#python run.py#frobnicate#FOO=1 sudo ls#"
    "ssh -p 22 -i key host1 date#curl -s https://api.example.com/r#Get-Content#docker ps#make#/usr/bin/wc "
    "-l#tee#squeue -u me#"
    "gh pr list#aws s3 ls#time pytest -q#python.exe -m http.server#scp a.txt "
    "me@host2:/x#git#https://h.example.org/x?t=1#"
    'cd src#"C:/tools/node.exe" app.js#kubectl get pods#jq .#rm -r tmp#nohup sleep#env A=1 B=2 grep x'
)
_ARGUMENTS = "# a/b.txt# -l# \"two words\"# 2>&1# > out.txt# >> log.txt# x=1# 'it is'# ../up/c.md# -n=3"
_JOINS = " && # | # ; # || #~#   &&"  # ~ is a line end
_N = [len(x.split("#")) for x in (_HEADS, _ARGUMENTS, _JOINS)]


def _part(parts: str, number: str, n: int) -> str:
    text = parts.replace("'", "''")
    return f"replace(split_part('{text}', '#', CAST(({number}) % {n} AS INT) + 1), '~', chr(10))"


_COMMAND = " || ".join([
    _part(_HEADS, "event_id * 7 + k", _N[0]), _part(_ARGUMENTS, "event_id + k * 3", _N[1]),
    _part(_JOINS, "event_id * 5 + k", _N[2]),
    _part(_HEADS, "event_id * 3 + k * 11", _N[0]), _part(_ARGUMENTS, "event_id * 13 + k", _N[1]),
])


def _sql_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_FAMILY = " ".join(f"WHEN head IN {_sql_list(names)} THEN '{family}'" for family, names in shell.SERVICES.items())


@query(
    "shell_classify",
    rf"""WITH c AS (SELECT event_id, {_COMMAND} AS command FROM ev),
g AS (SELECT event_id, command, unnest(segs) AS seg, unnest(range(len(segs))) AS place
  FROM (SELECT event_id, command, list_filter(string_split_regex(trim(command), '\s*(?:&&|\|\||;|\||\n)\s*'), lambda x:
    trim(x) <> '') AS segs FROM c)),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(seg, '"[^"]*"|''[^'']*''|\S+'),
    lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '^("(.*)"|''(.*)'')$') THEN substr(x, 2, length(x) - 2) ELSE
      x END),
    lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*=\S*$')) AS w FROM g),
n AS (SELECT *, regexp_replace(lower(string_split(w[1], '/')[-1]), '\.exe$', '') AS plain, regexp_matches(w[1],
  '^["'']?[A-Za-z][A-Za-z0-9+.\-]*://') AS is_url FROM t WHERE len(w) > 0),
u AS (SELECT *, plain IN {_sql_list(shell.WRAPPERS)} AND len(w) > 1 AND NOT is_url AS wrapped FROM n),
h AS (SELECT *, CASE WHEN is_url THEN '<url>' WHEN wrapped THEN lower(string_split(w[2], '/')[-1]) ELSE plain END AS
  head, CASE WHEN wrapped THEN w[3:] ELSE w[2:] END AS rest FROM u),
k AS (SELECT *, CASE WHEN regexp_matches(seg, '(^|[^<>0-9])>{{1,2}}($|[^&>]|&[^0-9])|[0-9]>{{1,2}}($|[^&>])') THEN 4
  WHEN head = 'git' AND len(rest) > 0 THEN CASE WHEN lower(rest[1]) IN {_sql_list(shell.GIT_READS)} THEN 1 ELSE 4 END
  WHEN head = 'sed' THEN CASE WHEN len(list_filter(rest, lambda x: starts_with(x, '-i') OR x = '--in-place')) > 0 THEN 4
    ELSE 1 END
  WHEN head IN {_sql_list(shell.READERS)} THEN 1 WHEN head IN {_sql_list(shell.WRITERS)} THEN 4 WHEN head IN
    {_sql_list(shell.RUNNERS)} THEN 3 ELSE 2 END AS kind,
  CASE {_FAMILY} END AS family, head IN {_sql_list(shell.SERVICE_WRAPPERS)} AS around FROM h),
s AS (SELECT event_id, ['read', 'unknown', 'run', 'write'][coalesce(max(kind), 2)] AS kind, arg_min(coalesce(family,
  ''), place) FILTER (WHERE NOT around) AS family,
  string_agg(head, ',' ORDER BY place) AS heads FROM k GROUP BY 1)
SELECT event_id, coalesce(kind, 'unknown') AS kind, nullif(family, '') AS family, coalesce(heads, '') AS heads,
  lower(nullif(coalesce(nullif(regexp_extract(command, 'https?://([^/\s''"]+)', 1), ''), nullif(regexp_extract(command,
    '\b(?:scp|rsync|sftp)\b.*?\s(?:[\w.\-]+@)?([\w.\-]+):', 1), ''),
    regexp_extract(command, '\bssh\s+(?:-[pioljJFeP]\s*\S+\s+|-\w+\s+)*(?:[\w.\-]+@)?([\w.\-]+)', 1)), '')) AS service
      FROM c LEFT JOIN s USING (event_id)""",
    ("ev",),
)
def shell_classify(f: Frames) -> DataFrame:
    """Commands put together from many heads, arguments and joins; parsed once, in a column of its own."""
    c = f.events.select("event_id", F.expr(_COMMAND).alias("command"))
    parsed = c.withColumn("parts", shell.parsed(F.col("command")))
    parts = F.col("parts")
    heads = F.array_join(shell.heads_of(parts), ",").alias("heads")
    return parsed.select(
        "event_id",
        shell.kind_of(parts).alias("kind"),
        shell.family_of(parts).alias("family"),
        shell.service_target(F.col("command")).alias("service"),
        heads,
    )


@query(
    "work_units_by_intent",
    """
WITH b AS (SELECT *, 'f' || (k % 7) || '.py' AS file, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS folder FROM
  ev),
w AS (SELECT event_id, user_id, event_type, CASE k % 8
  WHEN 0 THEN 'read:' || folder || '/' || file WHEN 1 THEN 'read:' || folder || '/' || file WHEN 2 THEN 'read:' ||
    folder || '/' || file
  WHEN 3 THEN 'read:' || folder || '/' || file || ':1,' || (k % 5) || 'p' WHEN 4 THEN 'search:' || folder || ':TODO::'
  WHEN 5 THEN 'run_tests:/p/' || folder || ':-q' WHEN 6 THEN 'vcs_read:git status::/p' ELSE 'cmd:/p::mystery --x ' ||
    file END AS op_key,
  CASE k % 8 WHEN 3 THEN 'read' WHEN 4 THEN 'search' WHEN 5 THEN 'run_tests' WHEN 6 THEN 'vcs_read' WHEN 7 THEN
    'unknown' ELSE 'read' END AS op FROM b)
SELECT op, rtrim(op_key, ':') AS op_key, count(*) AS calls, count(DISTINCT user_id) AS agents, count(DISTINCT
  event_type) AS tools FROM w GROUP BY 1, 2""",
    ("ev",),
)
def work_units_by_intent(f: Frames) -> DataFrame:
    """The same work in several forms (a tool, cat, cd and cat) is one unit."""
    file, folder = "'f' || (k % 7) || '.py'", "CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END"
    command = f"""CASE k % 8 WHEN 0 THEN 'cat ' || {folder} || '/' || {file} WHEN 1 THEN 'cd ' || {folder} ||
  ' && cat ./' || {file}
      WHEN 3 THEN 'sed -n ''1,' || (k % 5) || 'p'' ' || {folder} || '/' || {file} WHEN 4 THEN 'rg TODO /p/' || {folder}
      WHEN 5 THEN 'cd ' || {folder} || ' && python -m pytest -q' WHEN 6 THEN 'git status' WHEN 7 THEN 'mystery --x ' ||
        {file} END"""
    rows = f.events.select(
        "event_id", "user_id", "event_type",
        F.expr("CASE WHEN k % 8 = 2 THEN 'read' ELSE 'shell' END").alias("category"), F.col("event_type").alias("tool"),
        F.expr(f"CASE WHEN k % 8 = 2 THEN {folder} || '/' || {file} END").alias("target"), F.lit("{}").alias("params"),
        F.lit(None).cast("string").alias("server_tool"),
        F.lit("/p").alias("cwd"), F.lit("/p").alias("project"), F.expr(command).alias("command"),
    )
    units = intents.with_intent(rows).withColumn("op_key", F.regexp_replace("op_key", ":+$", ""))
    return units.groupBy("op", "op_key").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("user_id").alias("agents"),
        F.count_distinct("event_type").alias("tools"),
    )


@query(
    "mask_secrets_constant",
    r"SELECT doc_id, sha256(regexp_replace(text, "
    r"'(?i)(bearer\s+[a-z0-9._\-]{8,}|(?:api[_-]?key|token|password|secret)\s*[=:]\s*[^\s,;]+|sk-[a-z0-9]{8,}|ghp_[a-z0-9]{8,}|AKIA[0-9A-Z]{12,})', "
    r"'<secret>', 'g')) AS digest FROM documents",
    (),
)
def mask_secrets_constant(f: Frames) -> DataFrame:
    return f.table("documents").select("doc_id", F.sha2(text.mask_secrets(F.col("text")), 256).alias("digest"))


@query(
    "hmac_equivalence_classes",
    "SELECT count(DISTINCT text) AS classes, count(*) AS documents, max(n) AS largest FROM (SELECT text, count(*) "
    "OVER (PARTITION BY text) AS n FROM documents)",
    (),
)
def hmac_equivalence_classes(f: Frames) -> DataFrame:
    """Keyed fingerprints name the same classes as the texts themselves (texts hashed first, so rows shuffle short keys)."""
    keyed = f.table("documents").select(text.hmac_sha256(F.lit("key").cast("binary"), F.sha2("text", 256)).alias("h"))
    return keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("documents"), F.max("n").alias("largest")
    )


@query(
    "declared_intents",
    r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?i)\btests?\b') THEN 'test'
  END, CASE WHEN regexp_matches(t, '(?i)\b(?:fix|corrige)') THEN 'fix' END, CASE WHEN regexp_matches(t, '(?i)\breview')
  THEN 'review' END,
  CASE WHEN regexp_matches(t, '(?i)\b(?:search|cherche|find)') THEN 'search' END, CASE WHEN regexp_matches(t,
    '(?i)\b(?:write|add|ajoute)') THEN 'write' END, CASE WHEN regexp_matches(t, '(?i)\b(?:run|lance)\b') THEN 'run' END,
  CASE WHEN regexp_matches(t, '(?i)\b(?:wait|attend)') THEN 'wait' END, CASE WHEN regexp_matches(t, '(?i)\bplan') THEN
    'plan' END], lambda x: x IS NOT NULL), ',') AS intents FROM (SELECT conv_id, turn, text AS t FROM conversations)""",
    (),
)
def declared_intents(f: Frames) -> DataFrame:
    # named for F29, but its SQL asks for kinds of work; F29 is declared_reasons
    return f.table("conversations").select(
        "conv_id", "turn", F.array_join(text.named_work(F.col("text")), ",").alias("intents")
    )


_EDGE = r"(?:^|$|[^\p{L}\p{N}_])"


def _reason(name: str, pattern: str) -> str:
    # RE2's word boundary knows ASCII only
    edged = pattern.replace(r"\b", _EDGE).replace("'", "''")
    return f"CASE WHEN regexp_matches(t, '(?i){edged}') THEN '{name}' END"


@query(
    "declared_reasons",
    f"SELECT conv_id, turn, array_to_string(list_sort(list_filter([{', '.join(_reason(*x) for x in text.INTENTS)}], "
    f"lambda x: x IS NOT NULL)), ',') AS intents FROM (SELECT conv_id, turn, substr(text, 1, 4000) AS t FROM conversations)",
    (),
)
def declared_reasons(f: Frames) -> DataFrame:
    return f.table("conversations").select(
        "conv_id", "turn", F.array_join(text.declared_intents(F.col("text")), ",").alias("intents")
    )


@query(
    "word_frequency",
    r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM "
    r"documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    (),
)
def word_frequency(f: Frames) -> DataFrame:
    words = f.table("documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word")
    )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)
