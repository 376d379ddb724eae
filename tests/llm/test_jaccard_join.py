import random
from itertools import combinations

import pytest

from millrace.llm import jaccard_join as jj

SPACES = " \t\n\v\f\r"


def brute(rows, j):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in SPACES:
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append({tuple(w[i : i + j.shingle]) for i in range(len(w) - j.shingle + 1)} if len(w) >= j.shingle else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and j.den * common >= j.num * (len(sets[a]) + len(sets[b]) - common):
            up[root(a)] = root(b)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus(seed, n, words, line):
    """Texts of many lengths, copies with a few words changed, copies of copies, and a line that many texts share."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.35:
            w = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif rows and kind < 0.45:
            t = rows[r.randrange(len(rows))][1]
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 4, 8, 9, 10, 12, 15, 25, 60, 150))))
        if t is not None and r.random() < line:
            t += " the common line that very many of the texts here share"
        rows.append((i, t))
    rows += [(None, rows[3][1]), (None, "only null ids here but enough words"), (5, rows[4][1]), (n + 9, None), (n + 10, ""), (n + 11, " \n\t"), (n + 12, "A B\tc D e"), (n + 13, "a b c\nd E"), (n + 14, "one"), (n + 15, "ONE")]
    return rows


def found(spark, rows, j):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jj.groups(df, j).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize(
    "j, seed",
    [(jj.STRICT, 1), (jj.NEAR, 2), (jj.Join(few=2, slack_least=0, slack_every=1000), 3), (jj.Join(few=1, slack_least=0, slack_every=1000, num=80), 4)],
)
def test_components_equal_brute_force(spark, j, seed):
    rows = corpus(seed, 130, [f"w{k}" for k in range(40)], 0.5)
    assert found(spark, rows, j) == brute(rows, j)


def test_crowded_segments_with_few_words(spark):
    """A tiny vocabulary and hardly any full tries: sets lose most of their segments."""
    j = jj.Join(shingle=1, few=1, slack_least=0, slack_every=1000)
    r = random.Random(5)
    rows = [(i, " ".join(f"h{k}" for k in range(12) if r.random() < 0.95) + " " + " ".join(f"r{r.randrange(60)}" for _ in range(r.randrange(0, 6)))) for i in range(120)]
    assert found(spark, rows, j) == brute(rows, j)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, code string")
    assert jj.groups(df).collect() == []


def test_levels_bound_every_linked_pair():
    for j in (jj.STRICT, jj.NEAR):
        levels = jj.Levels(j)
        for a in range(1, 400):
            for b in range(a, a * j.den // j.num + 1):
                common = -(-j.num * (a + b) // (j.num + j.den))
                differ = a + b - 2 * common
                if common <= a and differ and j.den * common >= j.num * (a + b - common):
                    level = min(levels.of(a))
                    assert max(levels.of(a)) in levels.of(b) or level in levels.of(b)
                    assert differ <= levels.difference(max(levels.of(a)))
