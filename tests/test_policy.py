"""Shell commands with their quotes, plain paths, and the first rule that a call breaks."""

import random
import shlex

from pyspark.sql import functions as F

from quire.operators import policy

CASES = {
    "cat a 'b c' > \"out 1\" 2>&1 | tee -a x y": (["out 1", "x", "y"], ["a", "b c"]), "echo 'a > b; rm c' && echo \"x | tee d\"": ([], []), "echo a\\>b > real": (["real"], []), "sed -i 's/a/b;c/' 'my file' z; cp -r p q 'to here'": (["my file", "z", "to here"], []),
    "sed s/a/b/ f": ([], []), "A=1 B='x y' rm -f k\nmv only": (["k"], []), "/usr/bin/head -n 3 < in.txt >>log&": (["log"], ["in.txt", "3"]), "ls 2>err 1>&2 &>all": (["err", "all"], []), "echo \"un closed > f": ([], []), "": ([], []), "   ": ([], []),
    "a|b||c;;d": ([], []), "grep \"a\\\"b\" f\\ g": ([], ['a"b', "f g"]), "printf x>y": (["y"], []), "echo 3>z": (["z"], []), "echo '3'>z": (["z"], []), ". env; source 'e 2'": ([], ["env", "e 2"]), "touch é中😀": (["é中😀"], []), "x \\\n > f": (["f"], []),
}


def test_files_of_shell_commands(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "c string").select("c", policy.shell_files(F.col("c")).alias("f"))
    got = {r.c: (r.f.writes, r.f.reads) for r in df.collect()}
    assert got.pop(None) == ([], [])
    assert got == CASES


def test_words_as_the_shell_has_them(spark):
    rng = random.Random(5)
    texts = []
    while len(texts) < 400:
        t = "".join(rng.choices(["a", "b", " ", "'", '"', "\\", "$", "c d", "\t"], k=rng.randint(1, 14)))
        try:
            texts.append((t, shlex.split(t)))
        except ValueError:
            continue
    df = spark.createDataFrame(texts, "t string, want array<string>").select("t", "want", F.transform(policy.shell_tokens(F.col("t")), lambda x: x["text"]).alias("got"))
    wrong = [(r.t, r.want, r.got) for r in df.collect() if r.want != r.got and "\\`" not in r.t and "\\$" not in r.t]  # shlex keeps those backslashes
    assert not wrong, wrong[:3]


def test_rules(spark):
    p = policy.Policy(("/plat",), (".env", "~/code/.env"), ("build.py",), ("batch_run",), ("/w/*", "notes/*"), ("/w", "/w/inner"), "/home/u")
    rows = [
        ("edit", "/w/edition/p.md", None, "derived"), ("Write", "edition/p.md", None, "derived"), ("edit", "/w/inner/x/edition.md", None, None), ("edit", "/w/inner/pending.tsv", None, "derived"), ("edit", "/w/a.preflight.json", None, "derived"), ("edit", "/other/edition/p.md", None, "territory"),
        ("bash", None, "echo x > edition/p.md", "derived"), ("bash", None, "echo 'x > edition/p.md'", None), ("bash", None, "python build.py > manifests/b.json", None), ("bash", None, "cat .env", "secret"), ("bash", None, "source ~/code/.env && run", "secret"), ("bash", None, "cat '~/code/.env'", "secret"),
        ("read", "../x/.env", None, "secret"), ("write", "/plat/a.py", None, "forbidden-root"), ("write", "/platform/a.py", None, "territory"), ("bash", None, "rm ../plat/./a ok", "forbidden-root"), ("bash", None, "git -C /plat status", None), ("bash", None, "cd /plat && git commit -m x", "forbidden-root"),
        ("bash", None, "batch_run --all", "paid"), ("read", "/plat/a.py", None, None), ("bash", None, "ls 2>&1 | head", None), ("other", "/plat/x", None, None), ("write", None, None, None), ("bash", None, None, None), ("bash", None, "touch notes/a 'b/../c'", None), ("bash", None, "tee 'a b' /tmp/x", "territory"),
    ]
    df = spark.createDataFrame([(i, *r, "/w") for i, r in enumerate(rows)], "i int, tool string, path string, command string, want string, cwd string")
    assert [(r.i, r.tool, r.path, r.command, r.want, r.rule) for r in policy.judge(df, p).collect() if r.rule != r.want or r.allow != (r.rule is None)] == []
    free = policy.judge(df.where("command = 'batch_run --all'"), policy.Policy(paid_commands=("batch_run",), granted=frozenset({"paid"}))).first()
    assert free.allow
