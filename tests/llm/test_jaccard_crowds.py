import itertools
import random

from meshlake.llm import jaccard


def test_texts_that_share_a_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """Texts that meet in the same buckets without being similar cost few comparisons, and none of the links between them is lost."""
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(5, 145), 6):
            words[at] = f"x{i}at{at}"
        rows.append((len(rows), " ".join(words)))
        if i % 20 == 0:  # a chain: each a link of the one before
            for j in range(3):
                words[rng.randrange(5, 145)] = f"y{i}x{j}"
                rows.append((len(rows), " ".join(words)))
    sets = [set(jaccard.shingle_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(of(a), of(b))] = min(of(a), of(b))
    compared, similar = [], jaccard.similar
    monkeypatch.setattr(jaccard, "similar", lambda pairs, *a: compared.append(pairs.count()) or similar(pairs, *a))
    got = {r.id: r.component for r in jaccard.near_duplicates(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got == {i: of(i) for i in range(len(rows))} and 250 < len(set(got.values())) < len(rows)
    assert sum(compared) < 20 * len(rows), compared
