import random

import xxhash

from meshlake.llm import simhash


def brute(rows, words, distance):
    def fp(text):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(k, fp(t)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    out = []
    for i, (k, f) in enumerate(prints):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, f, min(same, default=None)))
    return out


def got(spark, rows, words=3, distance=2):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp int")
    return [(r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df, "doc_id", "text", words, distance).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(50)] + ["Ünï", "A-Z", " x"]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 40, 120]))) for _ in range(30)]
    rows = []
    for i in range(160):
        t = r.choice(base)
        w = t.split(" ")
        if r.random() < 0.6 and len(w) > 20:
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        rows.append((i, r.choice([t, t.upper(), t.replace(" ", " \t\n")])))
    rows += [(200, None), (201, ""), (202, "  "), (None, base[-1]), (5, rows[5][1])]
    for distance in (0, 2, 3):
        assert order(got(spark, rows, 3, distance)) == order(brute(rows, 3, distance))


def test_empty_table_and_null_ids(spark):
    assert got(spark, []) == []
    assert order(got(spark, [(None, None), (None, "")])) == [(None, 0, None)] * 2


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_links_lose_no_pair(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(20)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for s in seeds for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert pairs == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
