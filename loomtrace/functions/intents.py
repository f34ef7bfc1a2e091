"""What a call is for: an operation, its target and a key that is equal for the same work done by different means.

Native tools are exact. A shell command is translated only where its form is known; any other is work of its own
(`unknown`), equal to nothing but the same text in the same folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shell import program, segments, unquoted
from .text import project_path

# Programs by the operation they stand for, filters that may follow in a pipeline, and what runs tests or builds.
READS = ("cat", "type", "get-content", "gc", "less", "more", "nl", "head", "tail", "sed", "bat")
SEARCHES = ("rg", "grep", "egrep", "fgrep", "ag", "ack", "select-string", "sls", "findstr")
LISTS = ("ls", "dir", "get-childitem", "gci", "tree", "find", "fd")
FILTERS = ("wc", "sort", "uniq", "cut", "tr", "jq", "column", "awk")
GIT_READS = ("status", "diff", "log", "show", "branch", "rev-parse", "ls-files", "blame", "describe", "remote", "tag")
TESTS = ("pytest", "py.test", "jest", "vitest", "mocha", "ctest", "tox", "nox")
TEST_COMMANDS = (
    "cargo test", "go test", "npm test", "pnpm test", "yarn test", "dotnet test", "make test", "python -m pytest",
    "python -m unittest", "python3 -m pytest", "python3 -m unittest", "py -m pytest", "py -m unittest",
)
BUILDS = ("make", "cmake", "ninja", "msbuild", "tsc", "gradle", "mvn")
BUILD_COMMANDS = ("cargo build", "npm run build", "pnpm build", "dotnet build", "python -m build", "go build")
SCRIPTS = ("python", "python3", "py", "node", "deno", "bun", "ruby", "perl", "php")
FOLDERS = ("cd", "set-location", "pushd")
WRAPPERS = ("sudo", "doas", "time", "rtk")
#: Parts of a server tool's name that announce that it reads.
READ_VERBS = (
    "get", "list", "read", "search", "find", "status", "show", "info", "quota", "check", "selfcheck", "self_check",
    "health",
    "ping", "version", "whoami", "query", "describe", "fetch", "lookup", "explore", "diagnose", "forecast",
    "efficiency", "output",
)

TOKEN = r""""[^"]*"|'[^']*'|\S+"""


def reads_by_name(server_tool: Column) -> Column:
    return F.coalesce(server_tool.rlike(rf"(?i)(?:^|_)(?:{'|'.join(READ_VERBS)})(?:_|$)"), F.lit(False))


def _words(segment: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(segment, F.lit(TOKEN), 0), unquoted), lambda w: w != "")


def _key(op: str, target: Column, *details: Column) -> Column:
    return F.concat_ws(
        ":", F.lit(op), F.coalesce(target, F.lit("")), *[F.coalesce(x.cast("string"), F.lit("")) for x in details]
    )


def with_shell_intent(
    calls: DataFrame, command: str = "command", cwd: str = "cwd", project: str = "project"
) -> DataFrame:
    """calls with op, op_target and op_key of their shell command; null where there is none.

    A leading `cd folder &&` (any number of them) sets the folder the rest runs in and is no work itself. A pipeline counts as
    its first command if all that follow only read or filter, and is part of the key; an unknown filter makes it unknown.
    Each step is a column of its own, read by the next.
    """
    split = F.transform(segments(F.col(command)), lambda s: F.struct(F.trim(s).alias("text"), _words(s).alias("words")))
    rows = calls.withColumn("_parts", F.filter(split, lambda x: F.size(x["words"]) > 0))
    moves = lambda x: program(x["words"][0]).isin(*FOLDERS) & (F.size(x["words"]) == 2)
    # how many moves lead; the last segment is never one of them
    lead = F.aggregate(
        F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, x: F.struct((s["n"] + (s["go"] & moves(x)).cast("int")).alias("n"), (s["go"] & moves(x)).alias("go")),
        lambda s: s["n"],
    )
    rows = rows.withColumn("_lead", F.coalesce(lead, F.lit(0)))
    step = lambda at, x: F.when(x.rlike(r"^(/|~|[A-Za-z]:)"), x).otherwise(F.concat_ws("/", at, x))
    folder = F.aggregate(
        F.slice("_parts", 1, F.col("_lead")), F.coalesce(cwd, F.lit("")), lambda at, x: step(at, x["words"][1])
    )
    rows = rows.withColumn("_cwd", F.when(F.col("_lead") == 0, F.col(cwd)).otherwise(folder))
    rows = rows.withColumn("_rest", F.slice("_parts", F.col("_lead") + 1, F.greatest(F.size("_parts"), F.lit(1))))
    rows = rows.withColumn("_first", F.col("_rest")[0]["words"])
    wrapped = program(F.col("_first")[0]).isin(*WRAPPERS) & (F.size("_first") > 1)
    rows = rows.withColumn("_first", F.when(wrapped, F.slice("_first", 2, F.size("_first"))).otherwise(F.col("_first")))
    rows = rows.withColumns({
        "_head": program(F.col("_first")[0]),
        "_args": F.filter(F.slice("_first", 2, F.size("_first")), lambda w: ~w.startswith("-")),
        "_opts": F.filter(F.slice("_first", 2, F.size("_first")), lambda w: w.startswith("-")),
        "_after": F.slice("_first", 2, F.size("_first")),
        "_pipe": F.transform(
            F.slice("_rest", 2, F.greatest(F.size("_rest"), F.lit(1))), lambda x: program(x["words"][0])
        ),
    })
    known = F.forall("_pipe", lambda p: p.isin(*READS, *SEARCHES, *FILTERS))
    args, head, after = F.col("_args"), F.col("_head"), F.col("_after")
    arg = lambda k: F.try_element_at(args, F.lit(k))
    pipe = F.array_join("_pipe", "|")
    text = F.array_join(F.transform("_rest", lambda x: x["text"]), " && ")
    three = F.lower(F.concat_ws(" ", head, F.try_element_at(after, F.lit(1)), F.try_element_at(after, F.lit(2))))
    two = F.lower(F.concat_ws(" ", head, F.try_element_at(after, F.lit(1))))

    # reading: a range of sed, a number of lines of head and tail
    span = F.regexp_extract(arg(1), r"^(\d+),(\d+)p$", 0)
    silent = F.exists("_opts", lambda o: o.startswith("-n"))
    is_sed = head == "sed"
    counted = F.regexp_extract(F.array_join("_opts", " "), r"(?:^|\s)-n?(\d+)", 1)
    spaced = head.isin("head", "tail") & F.array_contains("_opts", "-n") & arg(1).rlike(r"^\d+$")
    amount = F.when(head.isin("head", "tail"), F.concat(head, F.when(spaced, arg(1)).otherwise(counted)))
    files = F.slice(args, F.when(is_sed | spaced, 2).otherwise(1), F.greatest(F.size(args), F.lit(1)))
    readable = head.isin(*READS) & (F.size(files) > 0) & (~is_sed | (silent & (span != "")))
    more_files = F.array_join(
        F.transform(F.slice(files, 2, 5), lambda f: project_path(f, F.col(project), F.col("_cwd"))), ","
    )
    detail = F.concat_ws(
        ";", F.when(is_sed, span), F.nullif(amount, head), F.nullif(more_files, F.lit("")), F.nullif(pipe, F.lit(""))
    )

    flags = F.array_join(F.array_sort(F.filter("_opts", lambda o: F.length(o) <= 3)), ",")
    tests = head.isin(*TESTS) | two.isin(*TEST_COMMANDS) | three.isin(*TEST_COMMANDS)
    test_args = F.array_join(F.slice(F.filter(after, lambda w: ~w.isin("-m", "pytest", "unittest")), 1, 8), " ")
    builds = head.isin(*BUILDS) | two.isin(*BUILD_COMMANDS) | three.isin(*BUILD_COMMANDS)
    script = head.isin(*SCRIPTS) & ~F.coalesce(F.try_element_at(after, F.lit(1)), F.lit("-")).startswith(
        "-"
    ) & F.coalesce(program(arg(1)), F.lit("")).contains(".")
    module = head.isin("python", "python3", "py") & (F.try_element_at(after, F.lit(1)) == "-m") & ~F.coalesce(
        F.try_element_at(after, F.lit(2)), F.lit("-")
    ).startswith("-")
    rest = lambda a, n: F.array_join(F.slice(after, a, n), " ")
    none, blank = F.lit(None).cast("string"), lambda x: F.coalesce(x.cast("string"), F.lit(""))
    made = lambda op, target, key: F.struct(
        F.lit(op).alias("op"), none.alias("raw"), target.alias("target"), none.alias("after"), key.alias("key")
    )
    # of work on a path, only the path as it is written: it is made comparable once, below
    on = lambda op, raw, *after: F.struct(
        F.lit(op).alias("op"), raw.alias("raw"), none.alias("target"),
        F.concat_ws(":", *map(blank, after)).alias("after"), none.alias("key")
    )
    here = lambda k: F.coalesce(arg(k), F.lit("."))
    unknown = made("unknown", text, F.concat(F.lit("cmd:"), F.coalesce("_cwd", F.lit("")), F.lit("::"), text))
    module_name = F.concat(F.lit("module:"), F.try_element_at(after, F.lit(2)))
    test_target = F.coalesce(
        F.try_element_at(F.filter(args, lambda w: ~w.isin("pytest", "unittest", "test")), F.lit(1)), F.lit("(suite)")
    )
    intent = (
        F.when(F.col("_first").isNull(), None)
        .when(~known, unknown)
        .when(readable, on("read", F.try_element_at(files, F.lit(1)), detail))
        .when(head.isin(*READS) & (F.size(args) > 0), unknown)
        .when(head.isin(*SEARCHES) & (F.size(args) > 0), on("search", here(2), arg(1), flags, pipe))
        .when(
            head.isin(*LISTS),
            on("list", here(1), F.array_join(F.array_sort("_opts"), ","), F.when(head.isin("find", "fd"), arg(2)), pipe),
        )
        .when(
            (head == "git") & F.lower(F.try_element_at(after, F.lit(1))).isin(*GIT_READS),
            made("vcs_read", two, _key("vcs_read", two, rest(2, 5), F.col("_cwd"))),
        )
        .when(tests, made("run_tests", test_target, _key("run_tests", F.col("_cwd"), test_args)))
        .when(builds, made("build", head, _key("build", F.col("_cwd"), head, rest(1, 8))))
        .when(script, on("run_script", arg(1), rest(2, 8), F.col("_cwd")))
        .when(module, made("run_script", module_name, _key("run_script", F.col("_cwd"), module_name, rest(3, 8))))
        .otherwise(unknown)
    )
    out = rows.withColumn("_intent", intent)
    out = out.withColumn("_path", project_path(F.col("_intent.raw"), F.col(project), F.col("_cwd")))
    target = F.coalesce("_path", "_intent.target")
    key = F.coalesce("_intent.key", F.concat_ws(":", "_intent.op", F.coalesce("_path", F.lit("")), "_intent.after"))
    inner = [c for c in out.columns if c not in calls.columns]
    found = F.col("_intent").isNotNull()
    out = out.withColumns({"op": F.col("_intent.op"), "op_target": target, "op_key": F.when(found, key)})
    return out.drop(*inner)


def with_intent(calls: DataFrame) -> DataFrame:
    """calls (category, tool, target, params as text, server_tool, command, cwd, project) with op, op_target, op_key. A read
    by a tool and one by a shell command have the same key where they read the same range of the same file."""
    shell = with_shell_intent(calls)
    by_path = F.col("category").isin("read", "search", "list", "edit", "write")
    shell = shell.withColumn(
        "_tool_path", F.when(by_path, project_path(F.col("target"), F.col("project"), F.col("cwd")))
    )
    category, target, params = F.col("category"), F.col("target"), F.col("params").cast("string")
    path = F.col("_tool_path")
    plain = F.when(params.isin("", "{}"), "").otherwise(params)
    op = (
        F.when(category.isin("read", "search", "list", "edit", "write", "agent", "web", "other"), category)
        .when(category == "mcp", F.when(reads_by_name(F.col("server_tool")), "mcp_read").otherwise("mcp"))
        .otherwise("unknown")
    )
    of_tool = F.when(category.isin("read", "search", "list", "edit", "write"), path).otherwise(target)
    key = F.when(op.isin("read", "search", "list", "edit", "write"), F.concat_ws(":", op, F.coalesce(path, F.lit("")), plain)).otherwise(
        F.concat_ws(":", op, F.coalesce("tool", F.lit("")), F.coalesce(target, F.lit("")), plain)
    )
    is_shell = (category == "shell") & F.col("op").isNotNull()
    pick = lambda a, b: F.when(is_shell, F.col(a)).otherwise(b)
    return shell.withColumns(
        {"op": pick("op", op), "op_target": pick("op_target", of_tool), "op_key": pick("op_key", key)}
    ).drop("_tool_path")
