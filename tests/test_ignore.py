"""Ignore rules: a table of cases, and random trees against a plain walk."""

import fnmatch
import random

import pytest

from loomgraph.operators import ignore


def decided(spark, paths, rules):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    lines = spark.createDataFrame([(s, i, x) for s, xs in rules.items() for i, x in enumerate(xs)], "scope string, position int, line string")
    return {r["path"] for r in ignore.ignored(files, lines).collect() if r["ignored"]}


def test_table_of_cases(spark):
    cases = [
        (["*.log"], ["a.log", "b/c.log", "a.logs"], {"a.log", "b/c.log"}),
        (["/a.log"], ["a.log", "b/a.log"], {"a.log"}),
        (["b/a.log"], ["b/a.log", "c/b/a.log"], {"b/a.log"}),
        (["tmp/"], ["tmp", "x/tmp/y", "tmp2/z"], {"x/tmp/y"}),
        (["**/out"], ["out", "a/out", "a/b/out/c"], {"out", "a/out", "a/b/out/c"}),
        (["a/**/z"], ["a/z", "a/b/c/z", "z", "b/a/z"], {"a/z", "a/b/c/z"}),
        (["a/**"], ["a/x", "a/b/x", "b"], {"a/x", "a/b/x"}),
        (["*.log", "!keep.log"], ["a.log", "keep.log", "d/keep.log"], {"a.log"}),
        (["!keep.log", "*.log"], ["keep.log"], {"keep.log"}),
        (["d/", "!d/keep"], ["d/keep", "d/x"], {"d/keep", "d/x"}),
        (["d/*", "!d/keep"], ["d/keep", "d/x"], {"d/x"}),
        (["", "# no", "\\#yes", "\\!so", "sp\\ ", "t  "], ["# no", "#yes", "!so", "sp ", "t", "no"], {"#yes", "!so", "sp ", "t"}),
        (["file[0-9].t?t", "[!a]x"], ["file1.txt", "filea.txt", "file1.t/t", "ax", "bx"], {"file1.txt", "bx"}),
        (["a.b+c(d)"], ["a.b+c(d)", "aXb+c(d)"], {"a.b+c(d)"}),
        (["é*"], ["été", "x/école/y", "ete"], {"été", "x/école/y"}),
        ([None, "/"], ["a"], set()),
    ]
    for lines, paths, want in cases:
        assert decided(spark, [*paths, "", None], {"": lines}) == want, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_scopes_against_a_walk(spark, seed):
    """Rules of deeper folders come before those of folders above, and nothing is reopened in an ignored folder."""
    rng = random.Random(seed)
    names, ends = ["a", "b", "c", "tmp"], ["x.log", "y.txt", "z", "keep.log"]
    paths = sorted({"/".join([*rng.choices(names, k=rng.randrange(4)), rng.choice(ends)]) for _ in range(150)})
    rules = {"": ["*.log", "tmp/"], **{"/".join(rng.choices(names, k=k)): rng.sample(["*.log", "!*.log", "!keep.log", "z", "!z", "b/", "!tmp/", "y*"], 3) for k in (1, 1, 2, 2, 3)}}

    def leaves_out(at, folder):
        parts = at.split("/")
        for k in range(len(parts) - 1, -1, -1):
            for line in reversed(rules.get("/".join(parts[:k]), [])):
                back, line = line.startswith("!"), line.lstrip("!")
                if (folder or not line.endswith("/")) and fnmatch.fnmatchcase(parts[-1], line.rstrip("/")):
                    return not back
        return False

    want = {p for p in paths if any(leaves_out("/".join(p.split("/")[:k]), k < len(p.split("/"))) for k in range(1, len(p.split("/")) + 1))}
    assert 0 < len(want) < len(paths) and decided(spark, paths, rules) == want
