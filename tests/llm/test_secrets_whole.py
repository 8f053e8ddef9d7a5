import random
import re
import string

import pytest

from pyspark.sql import functions as F

from meshlake.llm import secrets

ALNUM = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def redacted(spark, forest, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.redacted for r in secrets.scan(df, "text", None, forest).orderBy("id").collect()]


def chars(rng, n, of=ALNUM):
    return "".join(rng.choice(of) for _ in range(n))


def test_long_values_are_masked_whole(spark, forest):
    rng = random.Random(5)
    token = f"eyJ{chars(rng, 33)}.{chars(rng, 250)}.{chars(rng, 342)}"
    texts = [f"x {token} y", f"key: {chars(rng, 300, ALNUM + '-_')} z", f"password={chars(rng, 300, ALNUM + '!')} end", f'api_key = "{chars(rng, 700)}" end', f"a sk_live_{chars(rng, 99)} b"]
    assert redacted(spark, forest, texts) == ["x [SECRET] y", "key: [SECRET] z", "password=[SECRET] end", 'api_key = "[SECRET]" end', "a [SECRET] b"]
    image = f"see data:image/png;base64,{chars(rng, 3000)}"
    assert redacted(spark, forest, [image]) == [image]


def test_private_key_blocks_are_masked_whole(spark, forest):
    rng, texts = random.Random(6), []
    for kind in ("RSA ", "", "OPENSSH ", "EC ", "ENCRYPTED ") * 20:
        body = "\n".join(chars(rng, 64, ALNUM + "+/") for _ in range(rng.randrange(3, 50))) + f"\n{chars(rng, 20)}=="
        texts.append(f"a\n-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----\nafter")
    whole, cut = redacted(spark, forest, texts), redacted(spark, forest, [t[: t.index("-----END")] for t in texts])
    assert set(whole) == {"a\n[SECRET]\nafter"} and set(cut) == {"a\n[SECRET]"}


def test_later_occurrences_are_looked_at(spark, forest):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f"see commit {key} and then {'word ' * 20} token = \"{key}\" b", f"see commit {key} and md5 {key}"]
    assert redacted(spark, forest, texts) == [texts[0].replace(key, "[SECRET]"), texts[1]]


def plain(text):
    """Candidates by the same expression, a match at a time."""
    return [m.group() for m in re.finditer(secrets.CANDIDATE.replace("\\z", "\\Z"), text)]


def test_candidates_as_by_plain_python(spark):
    rng = random.Random(9)
    parts = ["token = ", 'secret: "', "password=", "commit ", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "AKIA" + "A1" * 8, "ghp_" + "x" * 36, "a" * 40, "hunter2!secret", "\n", " ", '"', "é", "-", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "auth=token=abcdefgh1", "x" * 31]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", secrets.occurrences(F.col("t"), F.lit(""), [secrets.Tree()]).alias("o")).collect()
    for r in got:
        want = plain(texts[r.id])
        assert len(want) == len(r.o) and all(m.endswith(o.value) for m, o in zip(want, r.o, strict=True)), texts[r.id]


def test_probabilities_as_by_plain_python(spark, forest):
    """The trees' expressions against a walk over the trees, and the highest one of a value's occurrences."""
    rng = random.Random(3)
    values = [chars(rng, 40, "0123456789abcdef") for _ in range(6)]
    texts = [" ".join(rng.choice(["commit", "md5", "token =", "see", "sample"]) + " " + rng.choice(values) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    x = F.array(*secrets.features(F.col("v"), F.lit("opaque"), F.col("l"), F.lit(""), F.lit("")))
    flat = spark.createDataFrame([(v, f"{w} ") for v in values for w in ("commit", "md5", "see")], "v string, l string").select(x.alias("x"), secrets.probability(forest, x).alias("p"))

    def walk(t, x):
        return t.share if t.low is None else walk(t.low if x[t.feature] <= t.cut else t.high, x)

    assert all(abs(r.p - sum(walk(t, r.x) for t in forest) / len(forest)) < 1e-12 for r in flat.collect())
    each = {r.id: r.o for r in df.select("id", secrets.occurrences(F.col("t"), F.lit(""), forest).alias("o")).collect()}
    for r in secrets.scan(df, "t", None, forest).collect():
        best = {}
        for o in each[r.id]:
            best[o.value] = max(best.get(o.value, 0), o.probability)
        assert {f.value: f.probability for f in r.findings} == best
        want = texts[r.id]
        for v in sorted((v for v, p in best.items() if p >= secrets.CUT), key=len, reverse=True):
            want = want.replace(v, secrets.MASK)
        assert r.redacted == want


def test_many_candidates_in_one_text_take_time_in_proportion(spark, forest):
    rng = random.Random(2)
    text = " ".join(f"token={chars(rng, 24)} and words" for _ in range(3000))
    (got,) = redacted(spark, forest, [text])  # the forest takes a few random strings for names
    assert got.count("token=[SECRET] and words") > 2900 and got.count(" and words") == 3000
