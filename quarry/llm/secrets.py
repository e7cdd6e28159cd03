"""Secret scans: a wide pattern finds candidates, a random forest removes those that aren't secrets.

The forest is trained on labelled findings (the default ones are made by rule, of formats and of common false alarms) by their
length, character transitions, dictionary coverage, path and neighbouring words. Features are one set of expressions for findings
in texts and for labelled ones; the trees become nested when() expressions.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let

CANDIDATE = "[A-Za-z0-9_+/=-]{16,}"
#: A shorter or punctuated value at the end of a text that names a secret and assigns to it; the value is group 1.
ASSIGNED = (
    "(?i)(?:token|secret|passw\\w*|pwd|passphrase|api_?key|auth\\w*|credentials?|(?:private|access)_?key)[\"']?\\s*[:=]{1,2}\\s*[\"'`(]{0,3}"
    "([^\\s\"'`(),;:=]{6,64})[\"'`),;]{0,4}$"
)
#: What such a text looks like anywhere, and characters of each neighbouring word that are read.
NAMES_SECRET, NEAR_CHARS = "(?i)(?:token|secret|passw|pwd|passphrase|api_?key|auth|credential|private_?key|access_?key)", 40
#: Dictionary for coverage: common words, identifiers and syllables of the four languages. Fixed values.
DICTIONARY = (
    "the and that for with this from are was were have has had not but you all can will one our out use any new now how its may see way who get name key file path user data "
    "value token secret password example sample test dummy config index table query string number array object class function method return import export package module server "
    "client request response header content length encoding default version release build target source install local share python java script library site node bin usr lib home "
    "var tmp etc opt http https www com org net html json yaml xml ing tion ment able ness less ent ion est ere her hat his ith ter ers ver ati ons ate ess ous ive ight ould ound "
    "und der die das ein eine nicht mit auf sich den dem des ich ist von keit heit lich schaft ung chen zu ge be que los las del por con para una est les des une dans pour sur pas "
    "eau oux aux elle ette cion ado ida mente"
).split()
SECRET_WORDS = "(?i)(?:^|[^a-z])(?:tokens?|secrets?|passw\\w*|pwd|api|apikey|keys?|auth\\w*|bearer|credentials?|private|access)(?:[^a-z]|$)"
HASH_WORDS = "(?i)(?:^|[^a-z])(?:sha|commit|hash|digest|md|checksum|uuid|etag|revision|blob|fingerprint|rev)(?:[^a-z]|$)"
DUMMY_WORDS = "(?i)(?:xxxx|(?:^|[^a-z])(?:example|sample|dummy|placeholder|changeme|your|redacted|test)(?:[^a-z]|$))"

FEATURES = ("length", "changes", "digits", "upper", "hex", "distinct", "coverage", "path", "secret_near", "hash_near", "dummy_near", "assigned", "vowels")
TREES, DEPTH, LABELLED, THRESHOLD, SEED = 15, 5, 4800, 0.5, 17


def features() -> dict[str, Column]:
    """Of columns finding, word (the word that holds it), before (the two words before) and after."""
    x = F.col("finding")
    n = F.char_length(x)
    lower = F.lower(x)
    # letters, digits and other marks as one letter each; then the places where neighbours differ
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    near = F.concat_ws(" ", "before", F.regexp_replace("word", CANDIDATE, " "), "after")
    keyed = F.concat_ws(" ", "before", F.col("word"))
    share = lambda pattern: F.regexp_count(x, F.lit(pattern)) / n
    return {
        "length": n.cast("double"),
        "changes": let(F.regexp_replace(kinds, "a+|b+|c+|d+", "e"), F.char_length) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hex": F.greatest(F.char_length(F.regexp_extract(x, "[0-9a-f]*", 0)), F.char_length(F.regexp_extract(x, "[0-9A-F]*", 0))) / n,
        "distinct": F.size(F.array_distinct(F.split(lower, ""))) / F.least(n, F.lit(36)),
        "coverage": 1 - F.char_length(F.regexp_replace(lower, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        "path": (F.regexp_count(F.col("word"), F.lit("/|\\.[a-z]|\\\\")) / n) + F.col("word").rlike("://|^[./~]").cast("double"),
        "secret_near": keyed.rlike(SECRET_WORDS).cast("double"),
        "hash_near": near.rlike(HASH_WORDS).cast("double"),
        "dummy_near": F.concat_ws(" ", near, x).rlike(DUMMY_WORDS).cast("double"),
        "assigned": keyed.rlike("[=:]").cast("double"),
        "vowels": F.regexp_count(lower, F.lit("[aeiouyäöüéèêáíóú]")) / F.greatest(F.regexp_count(lower, F.lit("[a-z]")), F.lit(1)),
    }


def with_features(findings: DataFrame) -> DataFrame:
    made = features()
    return findings.select("*", *[made[n].cast("double").alias(f"f_{n}") for n in FEATURES])


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """finding, word, before, after, secret: n made by rule, half of them false alarms. Strings come from hashes of the row number."""
    i = F.col("id").cast("string")
    hex40, hex64, hex32 = F.sha1(i.cast("binary")), F.sha2(i.cast("binary"), 256), F.md5(i.cast("binary"))
    b64 = F.base64(F.unhex(F.concat(hex64, hex32)))
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, *words: F.element_at(F.array(*[F.lit(w) for w in words]), draw(salt, len(words)) + 1)
    syllables = ("th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "keit", "lich", "ung", "ber", "que", "ción", "ment", "tion", "ou", "eau", "ado", "ish", "pf", "ble", "ra", "mo")
    spoken = F.concat(*[pick(100 + k, *syllables) for k in range(9)], F.when(draw(120, 2) == 0, pick(121, *syllables)).otherwise(""))
    spoken = F.regexp_replace(spoken, "[^a-z]", "")
    part = lambda salt: pick(salt, "user", "table", "index", "config", "session", "default", "value", "request", "parser", "module", "python", "cache", "build")
    plain = pick(1, "the und de", "of the", "la que", "and then", "is a")
    named = F.concat(pick(2, "token", "secret", "password", "api_key", "auth_token", "access_key", "client_secret", "TOKEN", "API_KEY"), F.lit(" "), pick(3, "=", ":", "="))
    hashed = F.concat(pick(4, "commit", "sha1", "sha256:", "checksum", "digest", "md5", "revision", "uuid", "etag"), pick(5, " =", " :", "", " is"))
    quoted = lambda x: F.concat(pick(6, '"', "'", "", '"'), x, pick(7, '"', '",', "", '"###', '"!!'))
    maybe_upper = lambda x: F.when(draw(8, 6) == 0, F.upper(x)).otherwise(x)
    rows = [
        (maybe_upper(hex40), named, 1),
        (maybe_upper(pick_of(draw(9, 2), hex64, hex32)), named, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", "Q"), 1, 16))), pick_of(draw(10, 2), named, plain), 1),
        (F.concat(pick(11, "ghp_", "sk-", "xoxb-", "glpat-"), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", "x"), 1, 36)), pick_of(draw(12, 2), named, plain), 1),
        (F.regexp_replace(F.substring(b64, 1, 44), "\n", ""), named, 1),
        (maybe_upper(hex40), F.concat(pick(13, "bearer", "Authorization:", "key", "pwd"), pick(14, "", " ", " =")), 1),
        (maybe_upper(hex40), hashed, 0),
        (maybe_upper(pick_of(draw(15, 2), hex64, hex32)), hashed, 0),
        (maybe_upper(spoken), pick_of(draw(16, 4), plain, plain, plain, named), 0),
        (F.concat(pick(17, "/usr/lib/", "src/", "https/", "/home/user/"), part(18), F.lit("/"), part(19), F.lit("_"), part(20)), pick_of(draw(21, 3), plain, plain, named), 0),
        (F.concat(part(22), F.lit("_"), part(23), pick(24, "_", "-"), part(25), F.lit("_"), part(26)), pick_of(draw(27, 2), plain, named), 0),
        (F.concat(pick(30, "Tr0ub4dor", "S3cure", "hunt3r", "Pa55", "qX9", "Zeb7ra", "mY", "K9"), pick(31, "&", "!", "#", "~", ".", "@", "%", "$"), F.substring(F.regexp_replace(b64, "[+/=]", "7"), 1, 5), pick(32, "", "!", "9")), named, 1),
        (F.concat(F.substring(F.regexp_replace(b64, "[+/=]", "k"), 1, 8), pick(33, "", "_", "!", "-"), F.substring(hex40, 1, 4)), named, 1),
        (pick(34, "string", "required", "undefined", "process.env.KEY", "config.token", "example.com", "changeme", "<password>", "${TOKEN}", "user.name", "settings.auth", "missing", "optional", "redacted", "your-password", "******", "xxxxxxxx"), named, 0),
        (F.concat(F.substring(spoken, 1, 7), pick(35, "", ".", ".name", "_key", "()")), named, 0),
        (pick(28, "xxxxxxxxxxxxxxxxxxxxxxxx", "0000000000000000000000000000", "your-api-key-goes-here", "example_token_value_here", "----------------------", "==================", "1234567890123456"), pick_of(draw(29, 2), named, plain), 0),
    ]
    base = spark.range(n).withColumn("kind", F.pmod(F.col("id"), F.lit(len(rows))))
    choose = lambda k: _cases([(F.col("kind") == j, r[k] if isinstance(r[k], Column) else F.lit(r[k])) for j, r in enumerate(rows)])
    out = base.select("id", choose(0).alias("finding"), choose(1).alias("before"), choose(2).alias("secret"))
    return out.select("finding", quoted(F.col("finding")).alias("word"), "before", plain.alias("after"), "secret").filter(F.char_length("finding") >= 6)


def _cases(parts: list[tuple[Column, Column]]) -> Column:
    out = F.when(*parts[0])
    for condition, value in parts[1:]:
        out = out.when(condition, value)
    return out


def pick_of(which: Column, *values: Column) -> Column:
    return _cases([(which == k, v) for k, v in enumerate(values)])


@dataclass
class Tree:
    """A split (feature, limit, low, high) or, with feature None, a leaf: share of secrets."""

    feature: str | None
    limit: float
    low: Tree | None
    high: Tree | None
    share: float

    def expr(self) -> Column:
        if self.feature is None:
            return F.lit(self.share)
        return F.when(F.col(f"f_{self.feature}") <= self.limit, self.low.expr()).otherwise(self.high.expr())


def _grow(x: np.ndarray, y: np.ndarray, depth: int, draw: random.Random) -> Tree:
    share = float(y.mean())
    leaf = Tree(None, 0.0, None, None, round(share, 6))
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return leaf
    best = (2 * share * (1 - share) - 1e-6, None)
    for f in draw.sample(range(x.shape[1]), max(1, round(x.shape[1] ** 0.5))):
        values = np.unique(x[:, f])
        if len(values) > 33:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            m = int(low.sum())
            if 4 <= m <= len(y) - 4:
                a, b = y[low].mean(), y[~low].mean()
                impurity = (m * 2 * a * (1 - a) + (len(y) - m) * 2 * b * (1 - b)) / len(y)
                if impurity < best[0]:
                    best = (impurity, (f, float(limit)))
    if best[1] is None:
        return leaf
    f, limit = best[1]
    low = x[:, f] <= limit
    return Tree(FEATURES[f], limit, _grow(x[low], y[low], depth - 1, draw), _grow(x[~low], y[~low], depth - 1, draw), share)


def train_forest(rows: list, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    """rows: (secret, features ...), sorted, so the forest is a function of the labelled findings."""
    if not rows:
        return []
    table = np.array(sorted(tuple(map(float, r)) for r in rows))
    draw, out = random.Random(seed), []
    for _ in range(trees):
        at = np.array([draw.randrange(len(table)) for _ in range(len(table))])
        out.append(_grow(table[at, 1:], table[at, 0], depth, draw))
    return out


def forest_score(forest: list[Tree]) -> Column:
    total = F.lit(0.0)
    for t in forest:
        total = total + t.expr()
    return total / max(1, len(forest))


def findings(word: Column, before: Column) -> Column:
    """All runs of CANDIDATE in a word, then the value that the text up to its end assigns to a secret, unless one of them holds it."""
    value = F.regexp_extract(F.concat_ws(" ", before, word), ASSIGNED, 1)
    long = F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0))
    return F.when((value != "") & ~F.exists(long, lambda r: r.contains(value)), F.concat(long, F.array(value))).otherwise(long)


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns with at (number of the word in the text, from 0), part (of the word), finding, word, before, after."""
    text = docs.filter(F.col(text_col).rlike(CANDIDATE) | F.col(text_col).rlike(NAMES_SECRET)).select(*keep, F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("_w"))

    def around(w: Column) -> Column:
        # a value stands in the word that assigns or right behind it; most words are neither that nor long
        assigns = lambda i: F.get(w, i).rlike("[:=].{6}|^[:=]") | F.coalesce(F.get(w, i - 1).rlike("[:=][\"'`(]*$"), F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ((F.octet_length(F.get(w, i)) >= 16) & F.get(w, i).rlike(CANDIDATE)) | ((F.octet_length(F.get(w, i)) >= 6) & assigns(i)))
        short = lambda i: F.coalesce(F.substring(F.get(w, i), -NEAR_CHARS, NEAR_CHARS), F.lit(""))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word"), F.concat_ws(" ", short(i - 2), short(i - 1)).alias("before"), F.coalesce(F.substring(F.get(w, i + 1), 1, NEAR_CHARS), F.lit("")).alias("after")))

    found = text.select(*keep, F.explode(around(F.col("_w"))).alias("_c")).select(*keep, "_c.*")
    return found.select(*keep, "at", F.posexplode(findings(F.col("word"), F.col("before"))).alias("part", "finding"), "word", "before", "after")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a candidate: doc_id, at, part, finding, score, secret (score of 1/2 or more).

    labelled: finding, word, before, after, secret (0 or 1); None takes labelled_findings. Candidates are runs of 16 or more letters,
    digits and _+/=-, and shorter or punctuated values of 6 to 64 characters right behind a secret's name and an assignment. Null, empty
    and wordless texts have none. A very long text is one row of its words; of a neighbouring word the nearest NEAR_CHARS characters are
    read. Splits of equal worth go to the feature drawn first. Rows that repeat a doc_id are scanned each. Without labelled rows all
    scores are 0. An empty table gives no rows. Other columns are ignored.
    """
    labelled = labelled_findings(docs.sparkSession) if labelled is None else labelled
    rows = with_features(labelled.filter("secret in (0, 1)")).select("secret", *[f"f_{n}" for n in FEATURES]).collect()
    forest = train_forest(rows)
    found = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    scored = with_features(found).withColumn("score", F.round(forest_score(forest), 6))
    return scored.select("doc_id", F.col("at").cast("long").alias("at"), F.col("part").cast("long").alias("part"), "finding", "score", (F.col("score") >= THRESHOLD).alias("secret"))
