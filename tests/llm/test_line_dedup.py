import random

from cabmart.llm import line_dedup as L
from conftest import SF_SMALL
from plain import dedup_lines


def corpus(seed, variants=60):
    """Random lines with exact copies, near copies of one hot line, and lines that share many words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    hot = [f"hot{i}" for i in range(20)]
    lines = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 25))) for _ in range(150)]
    for i in range(variants):                             # more than HOT sets share these words
        words = hot[:]
        for _ in range(rnd.choice((1, 1, 2, 5))):
            words[rnd.randrange(20)] = f"own{i}x{rnd.randrange(99)}"
        lines.append(" ".join(words))
    lines += [rnd.choice(lines).upper() for _ in range(80)]
    lines += [" ".join(rnd.sample(line.split(), len(line.split()))) for line in rnd.sample(lines, 60)]
    rnd.shuffle(lines)
    docs = []
    while lines:
        take, lines = lines[:rnd.randrange(1, 9)], lines[9:] if rnd.random() < 0 else lines[1:]
        docs.append("\n".join(take[:3] + ["", "short line"]))
    return [(i, t) for i, t in enumerate(docs)]


def test_against_plain_python(spark):
    for seed, percent in ((1, 80), (2, 80), (3, 90)):
        rows = corpus(seed)
        out = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=percent)
        got = {r.doc_id: r for r in out.collect()}
        want = dedup_lines(rows, percent)
        assert [got[i].text for i, _ in rows] == want
        for (i, t), w in zip(rows, want):
            assert got[i].n_lines == t.count("\n") + 1
        assert sum(r.n_removed for r in got.values()) > 100


def test_query(spark, queries, small):
    rows = small("documents", "doc_id, text")
    got = {r.doc_id: r.text for r in queries["op7_line_dedup"](spark, SF_SMALL).collect()}
    assert [got[i] for i, _ in rows] == dedup_lines(rows)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(corpus(4)[:20], "doc_id long, text string")
    plan = L.dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_edge_cases(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(3, f"{a}\n{b}"), (1, a), (None, b), (4, None), (5, ""), (6, "\n\n"), (7, a), (7, a), (8, " ".join(f"l{i}" for i in range(30_000))),
            (9, f"{b}\t!\n{a}"), (2, "a b c d\na b c d"), (7, b + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS n_lines", "1 AS l_doc", "2 AS line")
    out = L.dedup(df)
    assert out.columns == ["doc_id", "text", "n_lines", "l_doc", "line", "_n_lines", "n_removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == [a] and got[3] == [b] and got[None] == [""] and got[4] == [None] and got[5] == [""] and got[6] == ["\n\n"]
    assert sorted(got[7]) == ["", "", ""] and got[9] == [""] and got[2] == ["a b c d"] and len(got[8][0]) > 100_000
    assert L.dedup(df.filter("false")).count() == 0


def test_short_lines_and_small_sets(spark):
    """Lines of any number of words are compared; sets of four and five words can be similar."""
    rows = [(1, "all rights reserved\nx\n\n"), (2, "All rights  reserved\nX\n \t\ny"), (3, "a b c d e"), (4, "a b c d"), (5, "a b c"),
            (6, "reserved all rights"), (7, "- -")]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "all rights reserved\nx\n\n", 2: " \t\ny", 3: "a b c d e", 4: "", 5: "a b c", 6: "", 7: "- -"}
    assert [got[i] for i, _ in rows] == dedup_lines(rows)


def test_frequent_words_and_hot_keys(spark, monkeypatch):
    """With few levels and a low bound, every key is hot and most pairs meet in the second round."""
    monkeypatch.setattr(L, "HOT", 3)
    monkeypatch.setattr(L, "KEPT", 20)
    for seed in (5, 6):
        rows = corpus(seed)
        got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert [got[i] for i, _ in rows] == dedup_lines(rows)


def test_small_plans_and_index_in_parts(spark, monkeypatch):
    """No plan holds the million levels in print, and the index is joined part by part, with the same result."""
    rows = corpus(7)
    names, sizes, cut = [], [], L.cut

    def noted(df, name):
        names.append(name)
        sizes.append(len(df._jdf.queryExecution().toString()))
        return cut(df, name)

    monkeypatch.setattr(L, "cut", noted)
    monkeypatch.setattr(L, "HOT", 8)
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == dedup_lines(rows)
    assert max(sizes) < 200_000 and names.count("met") == L.PARTS > 1


def test_hot_keys_meet_by_a_second_token(spark):
    """Similar sets whose first shared token is hot share a key of two tokens; few others do."""
    rnd = random.Random(8)
    tokens = {i: sorted(rnd.sample(range(400), rnd.randrange(2, 14))) for i in range(1000)}
    for i in range(1000, 1100):                           # some with near copies
        tokens[i] = sorted({*tokens[i - 1000], rnd.randrange(400)})
    rows = [(i, len(t), 0, t[:len(t) - -(-len(t) * 80 // 100) + 2]) for i, t in tokens.items()]
    sets = spark.createDataFrame(rows, "set long, n int, bits long, prefix array<long>")
    hot = spark.createDataFrame([(i, at) for i, n, _, p in rows for at in range(n - -(-n * 80 // 100) + 1)], "set long, at int")
    gone = spark.createDataFrame([(1000,)], "set long")
    held = {}
    for r in L._two_token_keys(hot, sets, gone, 80).collect():
        held.setdefault(r.key, set()).add(r.set)
        assert r.open == (r.set != 1000)
    met = {(a, b) for s in held.values() for a in s for b in s if a < b}
    similar = {(a, b) for a in tokens for b in tokens if a < b and len(tokens[a]) * 100 >= 80 and
               100 * len({*tokens[a]} & {*tokens[b]}) >= 80 * len({*tokens[a]} | {*tokens[b]}) and tokens[a] != tokens[b]}
    assert len(similar) > 50 and similar <= met
    single = {}
    for i, n, _, p in rows:
        for t in p:
            single.setdefault(t, set()).add(i)
    assert 20 * sum(len(s) ** 2 for s in held.values()) < 30 * sum(len(s) ** 2 for s in single.values())
    assert max(map(len, held.values())) * 5 < max(map(len, single.values()))


def test_sets_that_share_one_token_only(spark, monkeypatch):
    """At 50 percent, sets of one and two words are similar by a single token, also on a hot key."""
    monkeypatch.setattr(L, "HOT", 3)
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.sample("abcdefghijkl", rnd.randrange(1, 5)))) for i in range(60)]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()}
    assert [got[i] for i, _ in rows] == dedup_lines(rows, 50)


def test_texts_shuffled_for_verification_go_first(spark, monkeypatch):
    """The shuffle files of the joined texts are given back, the last job's too, before what they brought is compared."""
    rows = corpus(10)
    steps, cut, release = [], L.cut, L.release
    monkeypatch.setattr(L, "cut", lambda df, name: (steps.append(name), cut(df, name))[1])
    monkeypatch.setattr(L, "release", lambda spark, last=False: (steps.append("release") if last else None, release(spark, last))[1])
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == dedup_lines(rows)
    at = steps.index("tokens")
    assert steps[at - 1:at + 3] == ["release", "tokens", "release", "gone"]
