"""Secret scan [native]: pattern candidates, false positives removed by a random forest.

One pass of one regular expression finds a text's candidates and cuts the text between them: strings of known formats, values
assigned to telling names, and long opaque strings. None has an upper bound, so a candidate is always the whole string.
Each occurrence has features: length, transitions between character classes, distinct characters, shares of digits and of
dictionary words, whether all is hexadecimal, its kind, its path and its neighbouring words. A random forest that is trained from
labelled findings scores them; of a string that occurs more than once the highest probability decides for all its occurrences.
Training is on the driver, on at most ``MAX_FINDINGS`` findings (those with the smallest seeded hash); the trees
then become built-in expressions, so that scanning, scoring and redacting work on one row each: no shuffle, no Python.
Finding and scoring take time in proportion to the text; masking scans it once for each distinct secret.

Edge cases: null and empty texts have no candidates and stay as they are; a null path is an empty one. Repeated
rows each get their row; an empty table gives an empty result. A string is masked wherever the text has it, inside longer words
too; one that is part of another is replaced after the longer one. A private key is its block up to the END line, or to the end of
the text where that is missing. Without findings of both classes the forest gives that class's share to all (0.5 if none).
Columns called findings or redacted are kept as ``findings_input`` and ``redacted_input``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import ascii_lower, free_name, let, set_aside

MAX_FINDINGS, TREES, DEPTH, SEED, CUT, MASK = 20_000, 15, 5, 17, 0.5, "[SECRET]"
BOUND, AFTER = r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])"
#: What a private key's block may follow without a space: it isn't taken for a part of what stands before it.
BEGIN = r"-(?!----BEGIN )"
#: Names that values are assigned to, up to the value.
NAMED = r"(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
#: Kinds of candidates and their patterns (formats are fixed values, public). None has an upper bound but for formats of one length:
#: a candidate is the whole string. Possessive quantifiers keep them linear. The first kind that fits a whole candidate is its kind.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?s:.*?)(?:-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----|\z)",
    "cloud_id": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "prefixed": r"(?:gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}+|xox[abp]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35})",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "assigned": rf"(?!(?i:{NAMED}))(?:[A-Za-z0-9+/=_.!@#$%^&*]|{BEGIN}){{8,}}+",
    "opaque": rf"(?:[A-Za-z0-9+/_]|{BEGIN}){{32,}}+={{0,2}}",
}
#: Any candidate, with the name that it is assigned to.
CANDIDATE = "|".join([PATTERNS["private_key"], *(f"{BOUND}{PATTERNS[k]}{AFTER}" for k in ("cloud_id", "prefixed", "web_token")), rf"(?i:(?<![a-z]){NAMED}){PATTERNS['assigned']}", f"{BOUND}{PATTERNS['opaque']}{AFTER}"])
#: Words of placeholders and of ordinary names (fixed values).
DICTIONARY = "access account admin auth change changeme client code config data default demo development document dummy example fake file foo bar hello here image index insert key link local module my name null number object page password placeholder public replace sample secret server service session string temp test text the this token type user value version world your".split()
SECRET_WORDS = r"(?i)(key|token|secret|passw|pwd|auth|credential|login|bearer)"
PLACEHOLDER_WORDS = r"(?i)(example|sample|dummy|fake|placeholder|demo|your|template|mock)"
DIGEST_WORDS = r"(?i)(commit|checksum|md5|sha1|sha256|digest|hash|revision|etag|integrity|base64,|uuid)"
PATH_WORDS = r"(?i)(test|example|sample|mock|fixture|docs?/|demo)"
FEATURES = ("length", "transitions", "distinct", "digits", "hex", "dictionary", "path", "left_secret", "placeholder", "digest", "kind")


def features(value: Column, kind: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """In the order of ``FEATURES``, as doubles."""
    n = F.greatest(F.length(value), F.lit(1))
    runs = value
    for cls, to in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "1"), ("[^a-zA-Z0-9]+", "-")):
        runs = F.regexp_replace(runs, cls, to)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    share = lambda p, text: 1 - F.length(F.regexp_replace(text, p, "")) / n
    around = F.concat_ws(" ", left, value, right)
    number = F.lit(0.0)
    for i, k in enumerate(PATTERNS):
        number = F.when(kind == k, float(i)).otherwise(number)
    out = [
        n, (F.length(runs) - 1) / n, F.size(F.array_distinct(F.split(value, ""))) / n, share("[0-9]", value), value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        share(words, ascii_lower(value)), F.coalesce(path, F.lit("")).rlike(PATH_WORDS), left.rlike(SECRET_WORDS), around.rlike(PLACEHOLDER_WORDS), left.rlike(DIGEST_WORDS), number,
    ]
    return [x.cast("double") for x in out]


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    share: float = 0.5
    low: Tree | None = None
    high: Tree | None = None


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    t = Tree(share=float(y.mean()))
    if depth == 0 or len(y) < 8 or t.share in (0.0, 1.0):
        return t
    best = (2 * t.share * (1 - t.share) * len(y) - 1e-9, None, None)
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(at):
            n, a, b = len(y), ones[at - 1], ones[-1] - ones[at - 1]
            loss = 2 * (a * (at - a) / at + b * (n - at - b) / (n - at))
            if (k := int(np.argmin(loss))) is not None and loss[k] < best[0]:
                best = (loss[k], f, (v[at[k] - 1] + v[at[k]]) / 2)
    if best[1] is None:
        return t
    t.feature, t.cut = int(best[1]), float(best[2])
    low = x[:, t.feature] <= t.cut
    t.low, t.high = _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)
    return t


def train(findings: DataFrame, most: int = MAX_FINDINGS, trees: int = TREES, depth: int = DEPTH) -> list[Tree]:
    """A forest from findings (value, kind, left, right, path, label)."""
    c = {k: F.coalesce(F.col(k), F.lit("")) for k in ("value", "kind", "left", "right", "path")}
    rows = findings.where("label IS NOT NULL").select(*[f.alias(n) for n, f in zip(FEATURES, features(*c.values()), strict=True)], F.col("label").cast("double").alias("label"), F.xxhash64(*c.values(), F.lit(SEED)).alias("h"))
    got = np.array([tuple(r)[:-1] for r in rows.orderBy("h", "label").limit(most).collect()], np.float64).reshape(-1, len(FEATURES) + 1)
    if not len(got):
        return [Tree()]
    rng = np.random.default_rng(SEED)
    picks = [rng.integers(0, len(got), len(got)) for _ in range(trees)]
    return [_grow(got[p, :-1], got[p, -1], depth, rng) for p in picks]


def probability(forest: list[Tree], x: Column) -> Column:
    """Of an array of features in order: the mean of the trees' shares."""

    def of(t: Tree) -> Column:
        return F.lit(t.share) if t.low is None else F.when(x[t.feature] <= t.cut, of(t.low)).otherwise(of(t.high))

    return sum((of(t) for t in forest[1:]), of(forest[0])) / len(forest)


def occurrences(text: Column, path: Column, forest: list[Tree]) -> Column:
    """array<struct<value, kind, probability>> of all candidates of a text, in its order."""

    def judged(between: Column, found: Column, m: Column, i: Column) -> Column:
        name = F.regexp_extract(m, f"^((?i:{NAMED})){PATTERNS['assigned']}$", 1)
        value = F.substring(m, F.length(name) + 1, F.length(m))
        kind = F.when(name != "", "assigned").otherwise("opaque")
        for k in ("web_token", "prefixed", "cloud_id", "private_key"):
            kind = F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(kind)
        near = lambda j: F.coalesce(F.get(found, j), F.lit(""))
        left = F.right(F.concat(F.right(near(i - 1), F.lit(48)), F.get(between, i), name), F.lit(48))
        right = F.substring(F.concat(F.get(between, i + 1), near(i + 1)), 1, 24)
        of = F.struct(value.alias("value"), kind.alias("kind"), left.alias("left"), right.alias("right"))
        return let(of, lambda c: F.struct(c["value"].alias("value"), c["kind"].alias("kind"), let(F.array(*features(c["value"], c["kind"], c["left"], c["right"], path)), lambda x: probability(forest, x)).alias("probability")))

    cut = F.split(text, F.lit(CANDIDATE), F.lit(-1))
    return let(cut, lambda between: let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.transform(found, lambda m, i: judged(between, found, m, i))))


def scan(df: DataFrame, text: str, path: str | None, forest: list[Tree], cut: float = CUT) -> DataFrame:
    """``df`` with ``findings`` array<struct<value, kind, probability, secret>>, a row for each distinct value in its order, and
    ``redacted``, the text with secrets masked."""
    t, p = F.col(text), F.col(path) if path else F.lit("")
    none = F.array().cast("array<struct<value:string,kind:string,probability:double,secret:boolean>>")
    # The highest probability first, of each value one: equal values are neighbours.
    ranked = F.array_sort(F.transform(occurrences(t, p, forest), lambda o: F.struct(o["value"].alias("value"), (-o["probability"]).alias("less"), o["kind"].alias("kind"))))
    once = let(ranked, lambda r: F.filter(r, lambda o, i: (i == 0) | (o["value"] != F.get(r, F.greatest(i - 1, F.lit(0)))["value"])))
    found = F.transform(once, lambda o: F.struct(o["value"].alias("value"), o["kind"].alias("kind"), (-o["less"]).alias("probability"), (-o["less"] >= cut).alias("secret")))
    name, red = free_name(df, "findings"), free_name(df, "redacted")
    got = df.withColumn(name, F.when(F.coalesce(t.rlike(CANDIDATE), F.lit(False)), found).otherwise(none))
    secrets = F.array_sort(F.transform(F.filter(F.col(name), lambda f: f["secret"]), lambda f: F.struct((-F.length(f["value"])).alias("less"), f["value"].alias("value"))))
    masked = F.aggregate(secrets, t, lambda acc, s: F.replace(acc, s["value"], F.lit(MASK)))
    got = got.withColumn(red, F.when(F.exists(name, lambda f: f["secret"]), masked).otherwise(t))
    return set_aside(got, "findings", "redacted").withColumnsRenamed({name: "findings", red: "redacted"})


def labelled_findings(spark: SparkSession, n: int = 4800) -> DataFrame:
    """Findings with labels, made by rule: half are random strings where a secret stands, half are what scans mistake for one."""
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws("-", F.lit(k), i), 256)
    hexa = lambda k, n: F.substring(h(k), 1, n)
    base = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(h(k), h(k + "+")))), "[+/=]", "x"), 1, n)
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    key = F.element_at(F.array(*map(F.lit, ["token", "api_key", "secret", "password", "access_key", "auth"])), (F.pmod(F.xxhash64(i, F.lit("k")), F.lit(6)) + 1).cast("int"))
    lead = F.element_at(F.array(*map(F.lit, ["", "the text before it ", "const x; ", "config: ", "es la de "])), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    said, quoted = F.concat(lead, key, F.lit("=")), F.concat(lead, key, F.lit(' = "'))
    other = F.concat(lead, F.lit("see "))
    cases = [
        # value, kind, left, label
        (hexa("a", 40), "assigned", quoted, 1), (hexa("b", 18), "assigned", said, 1), (F.concat(F.lit("AKIA"), F.upper(base("c", 16))), "cloud_id", lead, 1), (base("d", 40), "assigned", quoted, 1),
        (F.concat(F.lit("ghp_"), base("e", 36)), "prefixed", lead, 1), (F.concat(F.lit("eyJ"), base("f", 20), F.lit("."), base("g", 40), F.lit("."), base("h", 30)), "web_token", lead, 1), (base("i", 44), "opaque", quoted, 1),
        (F.concat(base("j", 7), F.lit("!"), base("k", 5)), "assigned", said, 1), (F.lit("-----BEGIN RSA PRIVATE KEY-----"), "private_key", lead, 1), (hexa("l", 32), "assigned", said, 1), (F.concat(F.lit("sk_live_"), base("m", 24)), "prefixed", lead, 1), (hexa("n", 40), "opaque", lead, 1),
        (F.concat_ws("_", word("o"), word("p"), word("q")), "assigned", said, 0), (F.concat(F.lit("your_"), word("r"), F.lit("_here")), "assigned", quoted, 0), (F.repeat(F.lit("x"), 8 + F.pmod(i, F.lit(30)).cast("int")), "assigned", said, 0),
        (hexa("s", 40), "opaque", F.concat(lead, F.lit("commit ")), 0), (hexa("t", 32), "opaque", F.concat(lead, F.lit("md5 ")), 0), (F.concat_ws("-", word("u"), word("v"), word("w"), word("x"), word("y")), "opaque", other, 0),
        (F.repeat(F.lit("0"), 32), "opaque", other, 0), (F.concat(word("z"), F.initcap(word("A")), F.initcap(word("B")), F.initcap(word("C")), F.initcap(word("D"))), "opaque", other, 0), (hexa("E", 40), "assigned", F.concat(lead, F.lit('example_token = "')), 0),
        (F.concat(F.lit("AKIA"), F.repeat(F.lit("EXAMPLE"), 2), F.lit("12")), "cloud_id", F.concat(lead, F.lit("sample ")), 0), (base("F", 64), "opaque", F.concat(lead, F.lit("data:image/png;base64,")), 0), (F.concat(word("G"), F.lit("123456")), "assigned", said, 0),
    ]
    rows = F.array(*[F.struct(v.alias("value"), F.lit(k).alias("kind"), left.alias("left"), F.lit('" ').alias("right"), F.lit(y).alias("label")) for v, k, left, y in cases])
    picked = spark.range(n).select(i, F.element_at(rows, (F.pmod(i, F.lit(len(cases))) + 1).cast("int")).alias("c"))
    path = F.when((F.col("c.label") == 0) & (F.pmod(F.xxhash64("id"), F.lit(3)) == 0), "tests/fixtures/sample.txt").otherwise(F.concat(F.lit("src"), F.pmod(i, F.lit(20))))
    return picked.select("c.value", "c.kind", "c.left", "c.right", path.alias("path"), "c.label")
