import itertools
import random

from meshlake.llm import jaccard


def test_links_by_exact_similarity(spark):
    """Pairs of a similarity from 0.8 on count, however far apart their fingerprints; those below don't."""
    rng, rows = random.Random(3), []
    for i in range(60):
        words = [f"w{i}x{rng.randrange(10**6)}" for _ in range(200)]
        for j, cut in enumerate((0, 0, 18, 21, 24, 60)):
            rows.append((len(rows), " ".join(words[: len(words) - cut] + [f"y{i}x{j}x{k}" for k in range(cut)])))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two")]
    sets = [set(jaccard.shingle_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(of(a), of(b))] = min(of(a), of(b))
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.component for r in jaccard.near_duplicates(df, "id", "text").collect()}
    assert got == {i: of(i) for i in range(len(rows))} and len(set(got.values())) < len(rows) - 100
    assert jaccard.near_duplicates(df.limit(0), "id", "text").count() == 0
