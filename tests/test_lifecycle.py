"""Facts about changes to records: what is refused, what is applied, and what the heads are afterwards."""

from loomgraph.operators import lifecycle as L

HEAD = "id long, revision long, alive boolean, title string, body string, class int, mandatory boolean, important boolean, refs array<long>, generation long, updated_at long"
CHANGE = "id long, seq int, kind string, expected long, at long, title string, body string, class int, mandatory boolean, important boolean, refs array<long>"
SPEC = "id long, revision long, title string, description string, type string, priority int, checks array<struct<id:int,kind:string,text:string,status:string,evidence:string>>"


def head(i, **k):
    return tuple((dict(id=i, revision=3, alive=True, title="t", body="b", **{"class": 1}, mandatory=False, important=False, refs=[7], generation=2, updated_at=10) | k).values())


def change(i, seq, kind, expected=3, at=11, title=None, refs=None):
    return (i, seq, kind, expected, at, title, None, None, None, None, refs)


def outcomes(df):
    return {(r["id"], r["seq"]): r["outcome"] for r in df.collect()}


def test_mutations(spark):
    heads = spark.createDataFrame([head(1), head(2, important=True), head(3, alive=False), head(4, mandatory=True), head(5), head(6, refs=None), head(None)], HEAD)
    done = L.mutations(heads, spark.createDataFrame([
        change(1, 1, "update", title="t"), change(1, 2, "update", title="u", refs=[8]), change(1, 3, "delete"), change(2, 1, "promote"), change(2, 2, "automatic delete"), change(2, 3, "delete"),
        change(3, 1, "update", title="x"), change(4, 1, "automatic delete"), change(5, 1, "promote", at=9), change(5, 2, "burn"), change(5, 3, "update", expected=None, title="x"),
        change(6, 1, "delete"), change(9, 1, "delete"), change(None, 1, "delete"),
    ], CHANGE))
    assert outcomes(done) == {(1, 1): "no change", (1, 2): "applied", (1, 3): "conflict", (2, 1): "no change", (2, 2): "protected", (2, 3): "applied", (3, 1): "deleted", (4, 1): "protected", (5, 1): "backward clock", (5, 2): "invalid", (5, 3): "conflict", (6, 1): "applied", (9, 1): "unknown", (None, 1): "unknown"}
    now = {r["id"]: r for r in L.settled(heads, done).collect()}
    assert len(now) == 7 and (now[1]["title"], now[1]["body"], now[1]["refs"], now[1]["generation"], now[1]["revision"], now[1]["updated_at"]) == ("u", "b", [8], 3, 4, 11)
    assert (now[2]["alive"], now[2]["refs"], now[2]["generation"]) == (False, [], 3) and now[5]["revision"] == 3 and not now[6]["alive"]
    assert L.mutations(heads, spark.createDataFrame([], CHANGE)).isEmpty() and L.settled(heads, L.mutations(heads, spark.createDataFrame([], CHANGE))).count() == 7


def test_fold(spark):
    heads = spark.createDataFrame([head(1), head(2, mandatory=True, **{"class": 4}), head(3, important=True), head(4), head(5, alive=False), head(6), head(7), head(8)], HEAD)
    folds = [(1, 1, 3, True), (1, 2, 3, False), (1, 3, 3, False), (2, 4, 3, True), (2, 5, 3, False), (3, 6, 3, True), (4, 7, 3, True), (4, 8, 2, False), (5, 9, 3, True), (5, 6, 3, False)]
    done = L.fold(heads, spark.createDataFrame([(*f, 12) for f in folds], "fold long, id long, expected long, survives boolean, at long"))
    got = {(r["fold"], r["id"]): r for r in done.collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {(1, 1): "applied", (1, 2): "applied", (1, 3): "applied", (2, 4): "conflict", (2, 5): "conflict", (3, 6): "invalid", (4, 7): "conflict", (4, 8): "conflict", (5, 9): "conflict", (5, 6): "conflict"}
    kept, gone = got[1, 1]["after"], got[1, 2]["after"]
    assert (kept["alive"], kept["class"], kept["mandatory"], kept["important"], kept["refs"], kept["generation"], kept["revision"]) == (True, 4, True, True, [7], 2, 4)
    assert (gone["alive"], gone["refs"], gone["generation"], gone["revision"]) == (False, [], 3, 4)
    assert {r["id"]: r["alive"] for r in L.settled(heads, done).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True, 8: True}


def test_claims(spark):
    heads = spark.createDataFrame([(1, 1, "open", None, 0, None, None, None), (2, 1, "open", "a", 4, 10, 20, 100), (3, 1, "completed", None, 0, None, None, None)], "id long, revision long, status string, owner string, epoch long, claimed_at long, heartbeat_at long, expires_at long")

    def ask(*requests):
        return L.claims(heads, spark.createDataFrame(list(requests), "id long, seq int, kind string, actor string, epoch long, expected long, at long, lease_ms long"))

    done = ask((1, 1, "claim", "a", None, 1, 50, 10), (1, 2, "claim", "b", None, 1, 50, 10), (2, 1, "claim", "b", None, 1, 99, 10), (2, 2, "heartbeat", "b", 4, 1, 50, 10), (2, 3, "heartbeat", "a", 3, 1, 50, 10), (2, 4, "heartbeat", "a", 4, 1, 100, 10), (2, 5, "heartbeat", "a", 4, 1, 50, 0), (2, 6, "heartbeat", "a", 4, 1, 15, 10), (2, 7, "release", "a", 4, 1, 200, None), (3, 1, "claim", "a", None, 1, 50, 10), (3, 2, "release", None, 0, 1, 50, 10))
    assert outcomes(done) == {(1, 1): "applied", (1, 2): "conflict", (2, 1): "held", (2, 2): "fenced", (2, 3): "fenced", (2, 4): "expired", (2, 5): "invalid", (2, 6): "backward clock", (2, 7): "applied", (3, 1): "closed", (3, 2): "invalid"}
    now = {r["id"]: tuple(r)[1:] for r in L.settled(heads, done).collect()}
    assert now == {1: (2, "open", "a", 1, 50, 50, 60), 2: (2, "open", None, 4, None, None, None), 3: (1, "completed", None, 0, None, None, None)}
    took = ask((2, 1, "claim", "b", None, 1, 100, 10)).first()  # the lease ends at 100, so at 100 another may claim
    assert (took["outcome"], took["after"]["owner"], took["after"]["epoch"]) == ("applied", "b", 5)


def test_specifications(spark):
    checks = [(1, "acceptance", "x", "passed", "log"), (2, "test", "y", "passed", "log"), (3, "test", "z", "superseded", "old")]
    specs = spark.createDataFrame([(i, 1, "title", "", "task", 2, checks) for i in range(1, 10)] + [(10, 1, "title", "", "task", 2, None)], SPEC)
    command = "id long, seq int, expected long, title string, description string, type string, priority int, actor string, reason string"
    done = L.revise(specs, spark.createDataFrame([(1, 1, 1, " title ", None, None, None, "me", "r"), (2, 1, 1, "new", None, None, None, "me", "r"), (3, 1, 1, None, None, None, 4, "me", "r"), (4, 1, 1, None, None, None, 5, "me", "r"), (5, 1, 1, " ", None, None, None, "me", "r"), (6, 1, 1, "new", None, None, None, "me", " ")], command))
    assert outcomes(done) == {(1, 1): "no change", (2, 1): "applied", (3, 1): "applied", (4, 1): "invalid", (5, 1): "invalid", (6, 1): "invalid"}
    after = {r["id"]: r["after"] for r in done.collect()}
    assert [tuple(c)[3:] for c in after[2]["checks"]] == [("pending", None), ("pending", None), ("superseded", "old")] and [tuple(c) for c in after[3]["checks"]] == checks and after[3]["priority"] == 4
    done = L.verify(specs, spark.createDataFrame([(1, 1, 1, 1, False, " seen ", "me"), (2, 1, 1, 3, True, "e", "me"), (3, 1, 1, 9, True, "e", "me"), (4, 1, 1, 1, True, "", "me"), (10, 1, 1, 1, True, "e", "me")], "id long, seq int, expected long, check int, passed boolean, evidence string, actor string"))
    assert outcomes(done) == {(1, 1): "applied", (2, 1): "superseded check", (3, 1): "unknown check", (4, 1): "invalid", (10, 1): "unknown check"}
    assert tuple(done.where("id = 1").first()["after"]["checks"][0])[3:] == ("failed", "seen")
    done = L.supersede(specs, spark.createDataFrame([(1, 1, 1, 1, "me", "r", None, None, None), (2, 1, 1, 1, "me", "r", 4, None, "w"), (3, 1, 1, 1, "me", "r", 4, "test", "w"), (4, 1, 1, 2, "me", "r", 4, None, "z"), (5, 1, 1, 2, "me", "r", 3, None, "w"), (6, 1, 1, 2, "me", "", 4, None, "w"), (7, 1, 1, 3, "me", "r", 4, None, "w")], "id long, seq int, expected long, check int, actor string, reason string, new_check int, new_kind string, new_text string"))
    assert outcomes(done) == {(1, 1): "missing kind", (2, 1): "applied", (3, 1): "missing kind", (4, 1): "repeated check", (5, 1): "repeated check", (6, 1): "invalid", (7, 1): "superseded check"}
    assert [tuple(c)[:4] for c in done.where("id = 2").first()["after"]["checks"]] == [(1, "acceptance", "x", "superseded"), (2, "test", "y", "passed"), (3, "test", "z", "superseded"), (4, "acceptance", "w", "pending")]
