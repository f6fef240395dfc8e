"""Whether a call of a tool is allowed: shell commands taken apart with their quotes, paths made plain, the first rule that a call breaks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let

# Kinds of tools, what a work's folder derives, commands that write or read the files they name.
WRITE_TOOLS, READ_TOOLS, SHELL_TOOLS = ("write", "edit", "multiedit", "notebookedit"), ("read", "grep", "find", "ls", "glob"), ("bash", "shell", "powershell")
DERIVED_DIRS = ("edition", "assembled", "manifests")
DERIVED_FILES = ("expansions.tsv", "pending.tsv", "long-s.tsv", "ASSEMBLY.json", "staged.jsonl")
DERIVED_SUFFIXES = (".preflight.json",)
COPIERS, REMOVERS = ("cp", "mv", "install", "rsync"), ("rm", "touch", "truncate")
READERS = ("cat", "less", "more", "head", "tail", "source", ".", "grep", "bat", "strings", "xxd")


@dataclass(frozen=True)
class Policy:
    """What calls may touch. ``works`` are folders of works, ``producers`` commands that may write what a work derives; a secret without a slash is a name, with one a path."""

    forbidden_roots: tuple[str, ...] = ()
    secret_files: tuple[str, ...] = ()
    producers: tuple[str, ...] = ()
    paid_commands: tuple[str, ...] = ()
    territory: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    home: str = "/root"
    granted: frozenset[str] = field(default_factory=frozenset)


# ---------------------------------------------------------------- shell commands

_TOKEN = "array<struct<kind:string,text:string>>"


def shell_tokens(command: Column) -> Column:
    """An array of (kind, text) of a shell command: word, op (what parts commands), write and read (redirections, whose file is the next word), dup (a redirection to a descriptor). [P15]

    A walk over the characters keeps the quoting: nothing within quotes or behind a backslash parts words or commands or redirects. Words are
    as the shell passes them on, without their quotes; a quote that isn't closed ends with the command.
    """
    struct = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    none = F.array().cast(_TOKEN)
    token = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text"))).cast(_TOKEN)
    zero = struct(out=none, word=F.lit(""), open=F.lit(False), plain=F.lit(True), mode=F.lit("plain"))

    def step(a: Column, c: Column) -> Column:
        def to(out=a["out"], word=a["word"], open=a["open"], plain=a["plain"], mode="plain") -> Column:  # noqa: A002
            return struct(out=out, word=word, open=open if isinstance(open, Column) else F.lit(open), plain=plain if isinstance(plain, Column) else F.lit(plain), mode=F.lit(mode))

        done = F.concat(a["out"], F.when(a["open"], token("word", a["word"])).otherwise(none))
        kept = to(word=F.concat(a["word"], c), open=True)
        last = F.element_at(a["out"], -1)["kind"]
        after = F.coalesce(~a["open"] & last.isin("write", "read"), F.lit(False))
        # a descriptor's number before a redirection is no word
        number = a["open"] & a["plain"] & a["word"].rlike("^[0-9]+$")
        turn = F.when(number, a["out"]).otherwise(done)
        arrow = lambda kind: F.when(after, a["out"]).otherwise(F.concat(turn, token(kind, c)))
        ended = dict(word=F.lit(""), open=False, plain=True)
        dup = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), token("dup", c))
        plain = (
            F.when(c == "\\", to(mode="escape", plain=False)).when(c == "'", to(mode="single", open=True, plain=False)).when(c == '"', to(mode="double", open=True, plain=False))
            .when(c.isin(" ", "\t", "\r"), to(out=done, **ended)).when((c == "&") & after, to(out=dup, **ended)).when(c.isin("\n", ";", "|", "&"), to(out=F.concat(done, token("op", c)), **ended))
            .when(c == ">", to(out=arrow("write"), **ended)).when(c == "<", to(out=arrow("read"), **ended)).otherwise(kept)
        )
        escape = F.when(c == "\n", to()).otherwise(kept)
        single = F.when(c == "'", to()).otherwise(to(word=F.concat(a["word"], c), mode="single"))
        double = F.when(c == '"', to()).when(c == "\\", to(mode="dq")).otherwise(to(word=F.concat(a["word"], c), mode="double"))
        dq = to(word=F.concat(a["word"], F.when(c.isin('"', "\\", "$", "`"), c).when(c == "\n", "").otherwise(F.concat(F.lit("\\"), c))), mode="double")
        return F.when(a["mode"] == "plain", plain).when(a["mode"] == "escape", escape).when(a["mode"] == "single", single).when(a["mode"] == "double", double).otherwise(dq)

    chars = F.filter(F.split(F.coalesce(command, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, zero, step, lambda a: F.concat(a["out"], F.when(a["open"], token("word", a["word"])).otherwise(none)))


_COMMAND = "array<struct<words:array<string>,writes:array<string>,reads:array<string>>>"


def shell_commands(tokens: Column) -> Column:
    """An array of (words, writes, reads) of the commands in ``shell_tokens``: their words without redirections, and the files of those. [P15]"""
    empty = F.array().cast("array<string>")
    zero = F.struct(F.array().cast(_COMMAND).alias("out"), empty.alias("words"), empty.alias("writes"), empty.alias("reads"), F.lit("").alias("want"))
    ended = lambda a: F.concat(a["out"], F.array(F.struct(a["words"].alias("words"), a["writes"].alias("writes"), a["reads"].alias("reads"))).cast(_COMMAND))

    def step(a: Column, t: Column) -> Column:
        word, put = t["kind"] == "word", F.array(t["text"])
        grown = lambda name, want: F.when(word & (a["want"] == want), F.concat(a[name], put)).otherwise(a[name])
        more = F.struct(a["out"].alias("out"), grown("words", "").alias("words"), grown("writes", "write").alias("writes"), grown("reads", "read").alias("reads"), F.when(word, "").otherwise(t["kind"]).alias("want"))
        return F.when(t["kind"] == "op", F.struct(ended(a).alias("out"), empty.alias("words"), empty.alias("writes"), empty.alias("reads"), F.lit("").alias("want"))).otherwise(more)

    return F.filter(F.aggregate(tokens, zero, step, ended), lambda c: (F.size(c["words"]) > 0) | (F.size(c["writes"]) > 0) | (F.size(c["reads"]) > 0))


def shell_files(command: Column) -> Column:
    """A struct (writes, reads) of the files that a shell command names: redirections, and the arguments of commands that write or read them. [P15]"""
    empty = F.array().cast("array<string>")

    def of(c: Column, kind: str) -> Column:
        at = F.array_position(F.transform(c["words"], lambda w: ~w.rlike(r"^[A-Za-z_]\w*=")), True)  # behind settings
        words = F.when(at > 0, F.slice(c["words"], F.greatest(at.cast("int"), F.lit(1)), F.size(c["words"]))).otherwise(empty)
        name = F.element_at(F.split(F.coalesce(F.get(words, F.lit(0)), F.lit("")), "/"), -1)
        rest = F.slice(words, 2, 1 << 30)
        args = F.filter(rest, lambda w: ~w.startswith("-"))
        if kind == "reads":
            return F.concat(c["reads"], F.when(name.isin(*READERS), args).otherwise(empty))
        edits = (name == "sed") & F.exists(rest, lambda w: w.startswith("-i"))
        named = F.when((name == "tee") | name.isin(*REMOVERS), args).when(edits, F.slice(args, 2, 1 << 30)).when(name.isin(*COPIERS) & (F.size(args) >= 2), F.slice(args, -1, 1)).otherwise(empty)
        return F.concat(c["writes"], named)

    return let(shell_commands(shell_tokens(command)), lambda cs: F.struct(*[F.flatten(F.transform(cs, lambda c: of(c, k))).alias(k) for k in ("writes", "reads")]))  # noqa: B023


# ---------------------------------------------------------------- paths and rules


def plain_path(path: Column, cwd: Column, home: str) -> Column:
    """The absolute path: ``~`` is the home, others stand in ``cwd``, and ``.``, ``..`` and doubled slashes are resolved as text."""
    grown = F.when(path == "~", F.lit(home)).when(path.startswith("~/"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)
    full = F.when(grown.startswith("/"), grown).otherwise(F.concat(cwd, F.lit("/"), grown))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _pattern(glob: str) -> str:
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "/_-" else "\\" + c) for c in glob) + "$"


def judge(calls: DataFrame, policy: Policy) -> DataFrame:
    """Add (allow, rule) to calls (tool, path, command, cwd): the first rule that a call breaks, null if none. [P15]

    Written files, in their order, may not lie under a forbidden root, be secret, be derived within a work (unless a producer's command runs), or lie outside the
    territory, in this order; files that are read may not be secret. Paid commands need the grant ``paid`` and come first; commits and pushes in or about a forbidden root
    come last. Other tools are free.
    """
    empty = F.array().cast("array<string>")
    cwd = F.coalesce("cwd", F.lit("/"))
    path = lambda p: plain_path(p, cwd, policy.home)
    fixed = lambda p: plain_path(F.lit(p), cwd, policy.home)
    any_of = lambda tests: F.greatest(F.lit(False), F.lit(False), *tests)
    under = lambda p, root: (p == root) | F.startswith(p, F.concat(root, F.lit("/")))
    tool, command = F.lower("tool"), F.coalesce("command", F.lit(""))
    rows = calls.withColumn("_files", F.when(tool.isin(*SHELL_TOOLS) & (command != ""), shell_files(command)))
    named = F.when(F.col("path").isNotNull() & (F.col("path") != ""), F.array("path")).otherwise(empty)
    writes = F.when(tool.isin(*WRITE_TOOLS), named).otherwise(F.coalesce("_files.writes", empty))
    reads = F.when(tool.isin(*READ_TOOLS), named).otherwise(F.coalesce("_files.reads", empty))
    rows = rows.withColumns({"_w": F.transform(writes, path), "_r": F.transform(reads, path), "_producer": tool.isin(*SHELL_TOOLS) & any_of(F.contains(command, F.lit(p)) for p in policy.producers)})

    def secret(p: Column) -> Column:
        name = F.element_at(F.split(p, "/"), -1)
        return any_of((p == fixed(s)) if "/" in s or s.startswith("~") else (name == s) for s in policy.secret_files)

    def derived(p: Column) -> Column:
        # the innermost work that holds the path
        roots = [F.when(F.startswith(p, F.concat(fixed(w), F.lit("/"))), fixed(w)) for w in policy.works]
        inner = F.array_max(F.transform(F.array_compact(F.array(*roots)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"] if roots else F.lit(None).cast("string")
        rest = F.substr(p, F.length(inner) + 2)
        name = F.element_at(F.split(p, "/"), -1)
        return F.coalesce(F.element_at(F.split(rest, "/"), 1).isin(*DERIVED_DIRS) | name.isin(*DERIVED_FILES) | any_of(name.endswith(s) for s in DERIVED_SUFFIXES), F.lit(False))

    outside = lambda p: ~any_of(p.rlike(_pattern(t)) if t.startswith("/") else F.rlike(p, F.lit(_pattern("*/" + t))) for t in policy.territory) if policy.territory else F.lit(False)
    broken = lambda p: F.when(F.col("_producer") & derived(p), F.lit(None).cast("string")).when(any_of(under(p, fixed(r)) for r in policy.forbidden_roots), "forbidden-root").when(secret(p), "secret").when(derived(p), "derived").when(outside(p), "territory")
    first = lambda xs: F.get(F.array_compact(xs), F.lit(0))
    shell = tool.isin(*SHELL_TOOLS)
    paid = F.lit(False) if "paid" in policy.granted else shell & any_of(command.rlike(p) for p in policy.paid_commands)
    publishes = command.rlike(r"\bgit\s+(commit|push)|\bgh\s+pr\s+create") & any_of(under(path(F.lit(".")), fixed(r)) | F.contains(command, fixed(r)) for r in policy.forbidden_roots)
    rule = F.coalesce(
        F.when(paid, "paid"), first(F.transform("_w", broken)), first(F.transform("_r", lambda p: F.when(secret(p), "secret"))), F.when(shell & ~F.col("_producer") & publishes, "forbidden-root"),
    )
    return rows.withColumn("rule", rule).withColumn("allow", F.col("rule").isNull()).drop("_files", "_w", "_r", "_producer")
