import random
import re

from quarry.llm import secrets


def test_candidates_equal_brute_force(spark, docs_of):
    texts = [None, "", "  ", "short", "x" * 16, 'a b token = "' + "0af9" * 10 + '" c', "k=" + "A" * 20 + ".b=" + "C" * 16 + " é\x0bz", "ü" * 16 + "abc " * 3000 + "f" * 30]
    texts += ['password = "Tr0ub4dor&3x"; next', "password=Tr0ub4dor~3x", "pwd: a.b@c!9,", "api_key :\n 'short1'", "the key = value", "token = abc", "secret == (getpass())", "auth_token: one two", "PASSWORD:" + "y" * 70 + " z", "a = 1 password ="]
    value = re.compile(secrets.ASSIGNED)
    want = set()
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for at, w in enumerate(words):
            found = re.findall(secrets.CANDIDATE, w)
            m = value.search(" ".join([*(x[-40:] for x in ["", "", *words][at : at + 2]), w]))
            if m and not any(m.group(1) in r for r in found):
                found.append(m.group(1))
            for part, m in enumerate(found):
                want.add((i, at, part, m))
    got = {(r.doc_id, r.at, r.part, r.finding) for r in secrets.candidates(docs_of([(i, t, "", "") for i, t in enumerate(texts)]), ["doc_id"]).collect()}
    assert got == want
    assert {f for _, _, _, f in got} >= {"Tr0ub4dor&3x", "Tr0ub4dor~3x", "a.b@c!9", "short1"} and not {f for _, _, _, f in got} & {"value", "abc", "one"}


def test_held_out_findings(spark):
    all_rows = secrets.with_features(secrets.labelled_findings(spark, 2400)).select("finding", "secret", *[f"f_{n}" for n in secrets.FEATURES]).collect()
    test = [r for k, r in enumerate(all_rows) if k % 3 == 0]
    forest = secrets.train_forest([r[1:] for k, r in enumerate(all_rows) if k % 3])

    def score(r):
        total = 0.0
        for t in forest:
            while t.feature is not None:
                t = t.low if r[f"f_{t.feature}"] <= t.limit else t.high
            total += t.share
        return total / len(forest)

    right = sum((score(r) >= 0.5) == bool(r.secret) for r in test)
    assert right >= 0.95 * len(test) and {0, 1} == {r.secret for r in test}


def test_scan(spark, docs_of):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'on anre token = "{key}" tothin', "", ""), (2, f"see commit {key} for more", "", ""), (3, "words like enkeitlichungheitberein und mehr", "", ""), (4, None, "", ""), (5, f'THE TOKEN = "{key.upper()}"!! IT', "", "")]
    rows += [(6, 'set password = "Tr0ub4dor&3x" and go', "", ""), (7, "the token: string, is required", "", ""), (8, "password=changeme", "", ""), (9, "pwd = 'kX81#qpz7' now", "", "")]
    got = {r.doc_id: r for r in secrets.scan(docs_of(rows)).collect()}
    assert got[6].secret and got[9].secret and not got[7].secret and not got[8].secret
    assert got[1].secret and got[5].secret and not got[2].secret and not got[3].secret and 4 not in got
    none = secrets.labelled_findings(spark, 0)
    assert all(not r.secret for r in secrets.scan(docs_of(rows), none).collect())
    assert secrets.scan(docs_of([])).count() == 0


def test_scores_equal_a_walk_over_the_trees(spark, docs_of):
    draw = random.Random(2)
    parts = ["token = ", "commit ", 'key: "', "the ", "/usr/lib/python/site", "A1b2" * 6, "deadbeef" * 5, "enkeitlichungheitberein", '"', "\n", "EXAMPLE", "password", "==" * 9]
    docs = docs_of([(i, " ".join(draw.choice(parts) for _ in range(12)), "", "") for i in range(60)])
    rows = secrets.with_features(secrets.labelled_findings(spark)).select("secret", *[f"f_{n}" for n in secrets.FEATURES]).collect()
    forest = secrets.train_forest(rows)
    found = secrets.with_features(secrets.candidates(docs, ["doc_id"])).collect()

    def walk(tree, r):
        while tree.feature is not None:
            tree = tree.low if r[f"f_{tree.feature}"] <= tree.limit else tree.high
        return tree.share

    want = {(r.doc_id, r["at"], r.part, r.finding): sum(walk(t, r) for t in forest) / len(forest) for r in found}
    got = secrets.scan(docs).collect()
    assert len(got) == len(want) > 100 and all(abs(r.score - want[r.doc_id, r["at"], r.part, r.finding]) < 1e-6 for r in got)
    assert all(r.secret == (r.score >= 0.5) for r in got) and {r.secret for r in got} == {True, False}
