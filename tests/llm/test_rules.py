import math
import random
import re

from quarry.llm import rules
from quarry.llm.textstats import features, text_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts(draw):
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "x y z x y z", "é é é\n" * 5, "line\n\nline\n line\nline", "w " * 3000]
    for _ in range(60):
        out.append("".join(draw.choice(["a", "b", "c ", " ", "\n", "\t", "é", "#", "|", "\x0b", "\r", "\x1c", "😀 "]) for _ in range(draw.randint(0, 200))))
    return out


def test_counts_equal_brute_force(spark, docs_of):
    rows = [(i, t, "", "") for i, t in enumerate(texts(random.Random(2)))]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_counts(docs_of(rows), ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}


def test_learns_a_planted_rule_and_keeps_clean_texts(spark, docs_of):
    draw = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 7))) + ("###" if bad and draw.random() < 0.6 else "") for _ in range(draw.randint(60, 90))]
        rows.append((i, " ".join(words), "", ""))
        if i % 3:
            marks.append((i, int(not bad)))
    marks += [(9999, 0), (1, None), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs_of(rows + [(700, None, "", ""), (701, "a b c " * 40, "", "")]), labels).collect()}
    assert sum(got[i].kept != bool(i % 4) for i in range(600)) <= 3
    assert got[700].base_failed and not got[700].kept and got[701].base_failed
    assert {r.doc_id for r in rules.keep_good(docs_of(rows), labels).collect()} == {i for i in range(600) if got[i].kept}


def test_without_labels_only_the_base_rule_holds(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "", ""), (1, "short", "", "")]
    assert sorted(r.kept for r in rules.judge(docs_of(rows), none).collect()) == [False, True]
    assert rules.judge(docs_of([]), none).count() == 0


def slow_covering(rows, names, precision):
    """rows: (features, label, fold). Sequential covering with counts over all rows for every condition, no bins."""
    marks = sorted([k / rules.BINS for k in range(1, rules.BINS)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995])
    edges = []
    for f in range(len(names)):
        values = sorted(r[0][f] for r in rows)
        q = sorted({values[max(0, math.ceil(m * len(values)) - 1)] for m in marks})
        edges.append(sorted({*q, *((a + b) / 2 for a, b in zip(q, q[1:]))}))
    holds = lambda r, c: (r[0][c[0]] >= c[2]) == c[1]
    left, out = rows, []
    while len(out) < rules.MOST_RULES:
        rule = []
        while len(rule) < rules.MOST_CONDITIONS:
            inside = [r for r in left if r[2] < 2 and all(holds(r, c) for c in rule)]
            p, n = sum(r[1] for r in inside), sum(1 - r[1] for r in inside)
            if not p or not n:
                break
            best = (0.0, None)
            for f in range(len(names)):
                for limit in edges[f]:
                    for above in (True, False):
                        covered = [r for r in inside if holds(r, (f, above, limit))]
                        cp = sum(r[1] for r in covered)
                        if cp >= rules.LEAST_COVER and (g := cp * (math.log2(cp / len(covered)) - math.log2(p / (p + n)))) > best[0] + 1e-9:
                            best = (g, (f, above, limit))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            covered = [r for r in left if r[2] == 2 and all(holds(r, c) for c in rule[:k])]
            cp = sum(r[1] for r in covered)
            worth.append(((2 * cp - len(covered)) / max(1, len(covered)), -k, cp, len(covered)))
        _, k, cp, t = max(worth)
        if cp < 1 or cp < precision * t:
            break
        out.append(rule[:-k])
        left = [r for r in left if not all(holds(r, c) for c in rule[:-k])]
    return [[rules.Condition(names[f], above, limit) for f, above, limit in rule] for rule in out]


def test_learned_rules_equal_a_slow_covering(spark):
    names, learned = ("a", "b", "c"), 0
    for seed in range(4):
        draw = random.Random(seed)
        rows = []
        for _ in range(500):
            x = (float(draw.randrange(12)), draw.random(), float(draw.choice([0, 0, 0, 1, 5])))
            bad = (x[0] >= 9 and x[2] >= 1) or x[1] < 0.08 or draw.random() < 0.02
            rows.append((x, int(bad), draw.randrange(3)))
        frame = spark.createDataFrame([(*x, y, f) for x, y, f in rows], "a double, b double, c double, label int, fold int")
        want = slow_covering(rows, names, 0.8)
        got = rules.learn_rules(frame, names, 0.8)
        assert [[(c.feature, c.above, round(c.limit, 9)) for c in r] for r in got] == [[(c.feature, c.above, round(c.limit, 9)) for c in r] for r in want]
        learned += len(got)
    assert learned >= 6


def test_verdicts_equal_a_walk_over_the_rules(spark, docs_of):
    """kept and rule of judge, by the counts of a plain count and the rules one after another."""
    made = [[rules.Condition("symbols", True, 0.02), rules.Condition("length", True, 4.0)], [rules.Condition("variety", False, 0.5)]]
    rows = [(i, t, "", "") for i, t in enumerate(texts(random.Random(6)) + [" ".join(f"w{i % 70}" for i in range(90)), " ".join(f"w{i}#" for i in range(90)), " ".join(f"w{i}" for i in range(90))])]
    counted = text_counts(docs_of(rows), ["doc_id"])
    marked = counted.select("*", *[c.alias(n) for n, c in features().items()]).withColumn("rule", rules.decision(made)).withColumn("bad", rules.base_failed())
    for r in marked.collect():
        words, _, _, _, repeated = brute(rows[r.doc_id][1])
        assert r.bad == (words < 50 or 100 * repeated > 50 * words)
        first = next((k for k, rule in enumerate(made, 1) if all((r[c.feature] >= c.limit) == c.above for c in rule)), 0)
        assert r.rule == first


def test_repeated_ids_are_judged_by_their_text(spark, docs_of):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "", ""), (1, "short", "", ""), (1, good, "", ""), (None, good, "", ""), (None, None, "", "")]
    got = rules.keep_good(docs_of(rows), None).collect()
    assert sorted((str(r.doc_id), r.text == good) for r in got) == [("1", True), ("1", True), ("None", True)]
