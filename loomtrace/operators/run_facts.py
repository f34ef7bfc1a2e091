"""Facts from the output of watched runs: monitor lines, role headers, streams of key=value, JSON summaries, notifications.

Only what is written is a fact: an end is no success, an exit code of zero counts where it stands, a list of failures is no
number of them. Lines that say nothing known are counted; a text that was cut is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The formats in which numbers, marks of cut text, headers, events, counters and exit codes are written.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
CUT = (
    r"(?is)<truncated>|output\s+truncated|ellipsis\s+omitted|"
    r"(?:\.\.\.|…)\s*(?:\[?\d+\s*)?(?:lines?|lignes?|chars?|caracteres?|tokens?)?\s*(?:truncated|omitted|tronque)"
)
KINDS = ("hitch", "ok", "fail", "end", "stream", "pending")
HEADER = r"^=+\s*([^=\s].*?)\s*$"
BLOCK = r"(?is)<(?:event|status|summary)\b[^>]*>.*?</(?:event|status|summary)\s*>"
PAIR = r"([A-Za-z][A-Za-z0-9_.-]*=\S+)"
COUNTERS = (rf"(?i)\b(?:failures|failed|tests_failed)\s*[:=]\s*({NUMBER})\b", rf"(?i)\b({NUMBER})\s+echec(?:s|\(s\))?")
EXIT_CODE = rf"(?i)(?:[\"']?exit(?:_code|\s+code)[\"']?|ExitCode)(?:\s*[:=]\s*|\s+)({NUMBER})\b"
#: Fields of a summary, and the fact each stands for.
SUMMARY = {
    "end": "run_end",
    "ended": "run_end",
    "status": "process_status",
    "exit_code": "process_exit",
    "exitcode": "process_exit",
}

FACT = "array<struct<field:string,value:string,phase:string>>"


def _fact(field: Column | str, value: Column, phase: Column | None = None) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("field"), value.cast("string").alias("value"), (none if phase is None else phase).alias("phase")
    )


def _plain(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"[,;)\]]+$", "")


def _summary(text: Column) -> Column:
    """Facts of a JSON object, only of fields with a known name."""
    at = lambda k: F.get_json_object(text, f"$.{k}")
    counted = lambda k: F.when(
        at(k).isNotNull(), _fact(F.when(at(k).rlike(f"^{NUMBER}$"), "tests_failed").otherwise("failure_details"), at(k))
    )
    named = [F.when(at(k).isNotNull(), _fact(f, at(k))) for k, f in SUMMARY.items()]
    details = F.when(at("failure_details").isNotNull(), _fact("failure_details", at("failure_details")))
    return F.array_compact(F.array(*[counted(k) for k in ("failures", "failed", "tests_failed")], details, *named))


def _stream(detail: Column, prefix: str) -> Column:
    first = F.regexp_extract(F.trim(detail), r"^(\S+)", 1)
    phase = F.when((first != "") & ~first.contains("="), first)

    def one(pair: Column) -> Column:
        key, raw = F.split_part(pair, F.lit("="), F.lit(1)), F.regexp_replace(pair, "^[^=]*=", "")
        timed = raw.rlike(rf"(?i)^{NUMBER}ms$")
        name = F.concat(F.lit(f"{prefix}."), key, F.when(timed, "_ms").otherwise(""))
        return _fact(name, F.when(timed, F.substring(raw, F.lit(1), F.length(raw) - 2)).otherwise(_plain(raw)), phase)

    return F.transform(F.regexp_extract_all(detail, F.lit(PAIR), 1), one)


def _event(kind: Column, detail: Column, line: Column) -> Column:
    none = F.array().cast(FACT)
    hitch = F.regexp_extract(F.concat(F.lit("hitch "), detail), rf"(?i)\bhitch\s+({NUMBER})\s*ms\b", 1)
    place = rf"(?i)\bcarte\s+(\S+)\s+apres\s*({NUMBER})\s*s?(?:\s*\(([^)]*)\))?"
    arrival = F.to_json(F.struct(
        F.lit("map_loaded").alias("kind"),
        F.regexp_replace(F.regexp_extract(detail, place, 1), "[,;]+$", "").alias("map"),
        F.regexp_extract(detail, place, 2).try_cast("double").alias("after_s"),
        F.nullif(F.regexp_extract(detail, place, 3), F.lit("")).alias("mode"),
    ))
    admitted = F.regexp_extract(detail, rf"(?i)\barriv[eé]e?\s+admise\b.*?\bapres\s*({NUMBER})\s*s?", 1)
    admission = F.to_json(
        F.struct(F.lit("arrival_admitted").alias("kind"), admitted.try_cast("double").alias("after_s"))
    )
    text = F.array(_fact("event_text", line))
    counts = F.flatten(F.array(*[F.regexp_extract_all(detail, F.lit(c), 1) for c in COUNTERS]))
    only = F.trim(detail).isin("", "...", ".") | F.trim(detail).rlike(f"^(?:{COUNTERS[0]}|{COUNTERS[1]})$")
    end = F.concat(
        F.array(_fact("run_end", F.lit("true"))),
        F.transform(counts, lambda c: _fact("tests_failed", c)),
        F.when(only, none).otherwise(text),
    )
    return (
        F.when(kind == "hitch", F.when(hitch != "", F.array(_fact("hitch_ms", hitch))).otherwise(text))
        .when(kind == "stream", _stream(detail, "stream"))
        .when(kind == "pending", _stream(detail, "pending"))
        .when(
            kind == "ok",
            F.when(detail.rlike(place), F.array(_fact("arrival", arrival))).when(
                admitted != "", F.array(_fact("arrival", admission))
            ).otherwise(text),
        )
        .when(kind == "end", end)
        .when(kind == "fail", F.array(_fact("failure_event", F.trim(detail))))
        .otherwise(none)
    )


def parsed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of run outputs: key, block and line (places), role (carried from the last header of the text), at (seconds, null
    where unknown), facts, and whether the line was understood. Text outside the marked parts of a notification is left
    out; key must tell texts apart."""
    whole = F.trim(F.col(text))
    # what does not begin as an object is not parsed: a failed parse costs many times a good one
    is_object = lambda c: F.when(F.trim(c).startswith("{"), F.try_parse_json(c).isNotNull()).otherwise(False)
    blocks = F.when(is_object(whole), F.array(whole)).when(
        whole.rlike(BLOCK), F.regexp_extract_all(whole, F.lit(BLOCK), 0)
    ).otherwise(F.array(whole))
    # texts that are null end as lines that are: a filter of them would be put before the text is made, and make it again
    rows = texts.select(
        key, is_object(whole).alias("one"), F.posexplode(blocks).alias("block", "body")
    )
    tag = F.lower(F.regexp_extract("body", r"(?is)^<(event|status|summary)\b", 1))
    inner = F.when(tag != "", F.regexp_replace("body", r"(?is)^<[^>]*>|</\w+\s*>$", "")).otherwise(F.col("body"))
    rows = rows.select(key, "one", "block", tag.alias("tag"), inner.alias("body"))
    # a summary is looked at as a whole, and so is an object that is printed over several lines
    lines = F.when(F.col("one") | (F.col("tag") == "summary"), F.array("body")).otherwise(F.split("body", r"\r?\n"))
    rows = rows.select(key, "one", "block", "tag", F.posexplode(lines).alias("line", "raw")).withColumn(
        "said", F.trim("raw")
    ).filter("said <> ''")
    number = rf"({NUMBER}|\.\.\.)"
    kinds = "|".join(KINDS)
    alone, watched = rf"(?i)^{number}\s+({kinds})\b(.*)$", rf"(?i)^(\S+)(?:\s+{number})?\s+({kinds})\b(.*)$"
    rows = rows.withColumn(
        "header", F.when(F.col("tag").isin("", "event"), F.nullif(F.regexp_extract("said", HEADER, 1), F.lit("")))
    )
    carried = F.last("header", ignorenulls=True).over(
        Window.partitionBy(key).orderBy("block", "line").rowsBetween(Window.unboundedPreceding, 0)
    )
    said = F.col("said")
    own = said.rlike(alone)
    pick = lambda a, b: F.when(own, F.regexp_extract(said, alone, a)).otherwise(F.regexp_extract(said, watched, b))
    rows = rows.withColumns({
        "kind": F.lower(pick(2, 3)), "detail": pick(3, 4), "at": pick(1, 2).try_cast("double"),
        "role": F.when(own | ~said.rlike(watched), carried).otherwise(F.regexp_extract(said, watched, 1)),
        "object": is_object(said), "finished": said.rlike(r"(?i)^run\s+finished$"),
    })
    exits = F.transform(F.regexp_extract_all(said, F.lit(EXIT_CODE), 1), lambda c: _fact("process_exit", c))
    none = F.array().cast(FACT)
    facts = (
        F.when(F.col("tag") == "status", F.array(_fact("process_status", said)))
        .when(F.col("tag") == "summary", exits)
        .when(F.col("object"), _summary(said))
        .when(F.col("header").isNotNull(), none)
        .when(F.col("finished"), F.array(_fact("watcher_end", F.lit("true"))))
        .otherwise(_event(F.col("kind"), F.col("detail"), said))
    )
    rows = rows.withColumn("facts", facts)
    known = F.col("tag").isin("status", "summary") | F.col("header").isNotNull() | F.col("finished") | (
        F.col("kind") != ""
    ) | said.rlike(CUT)
    role = F.when(F.col("tag").isin("status", "summary") | F.col("finished"), None).when(
        F.col("object"), F.coalesce(F.get_json_object("said", "$.role"), F.lit(None))
    ).otherwise(F.col("role"))
    told_at = F.coalesce(F.get_json_object("said", "$.at"), F.get_json_object("said", "$.t")).try_cast("double")
    return rows.select(
        key,
        "block",
        "line",
        role.alias("role"),
        F.when(F.col("object"), told_at).otherwise(F.col("at")).alias("at"),
        "facts",
        (known | (F.col("object") & (F.size("facts") > 0))).alias("understood"),
    )


def facts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, line, role, at, field, value, phase: one row per fact."""
    # outer, as a filter of lists that hold anything would be put before the facts and work them out once more
    each = parsed(texts, key, text).select(key, "block", "line", "role", "at", F.explode_outer("facts").alias("f"))
    return each.filter("f IS NOT NULL").select(key, "block", "line", "role", "at", "f.field", "f.value", "f.phase")


def completeness(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, unparsed_lines, truncated of every text."""
    odd = parsed(texts, key, text).groupBy(key).agg(F.count_if(~F.col("understood")).alias("unparsed_lines"))
    cut = texts.select(key, F.coalesce(F.col(text).rlike(CUT), F.lit(False)).alias("truncated"))
    return cut.join(odd, key, "left").select(
        key, F.coalesce("unparsed_lines", F.lit(0)).alias("unparsed_lines"), "truncated"
    )
