import random

from churnscope.llm import graph, near_dup as N

from . import helpers as H


def family(seed=3, n=300):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, base = [], [word() for _ in range(120)]
    common = " ".join(word() for _ in range(60))
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = " ".join(word() for _ in range(rnd.randint(1, 150)))
        elif kind == 1:
            text = " ".join(base)
        elif kind in (2, 3):  # near copies of one text, some beyond the threshold
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 4:
            text = common + " " + " ".join(word() for _ in range(rnd.randint(0, 40)))
        else:
            text = " ".join(base[:rnd.randint(60, 120)]).upper()
        docs.append((i * 3 + 1, text))
    return docs


EDGE = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two"), (5004, "ONE  two"), (5005, "one two three"),
        (5006, "a b c d e"), (5007, "a b c d e"), (5008, "x " * 20000), (5009, "x " * 30000)]


def run(spark, docs):
    d = spark.createDataFrame([(i, t, 0, "r") for i, t in docs], "doc_id long, text string, n_shingles int, rep string")
    return N.near_duplicates(d.repartition(7))


def test_against_all_pairs(spark):
    docs = family() + EDGE
    want = H.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, docs).collect()}
    assert got == want
    assert sum(1 for i, (_, c) in want.items() if c != i) > 100


def test_kept_one_per_component(spark):
    rows = run(spark, family(n=60)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_null_id_and_repeated_rows(spark):
    docs = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    rows = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in run(spark, docs).collect())
    assert rows == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 260)] + [(300, 300), (400, 401), (401, 400)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 200 for i in range(200, 260)} | {400: 400, 401: 400}
    assert got == want


def test_parity_maps_never_exceed_the_difference():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    col = pa.array([" ".join(rng.choice(list("abcd"), 200)) for _ in range(4)])
    sets = [s for _, s in N.text_sets(col)]
    bits = 64 * N.PARITY_LONGS
    maps = [np.bincount(((s >> np.uint64(40)) & np.uint64(bits - 1)).astype(int), minlength=bits) & 1 for s in sets]
    for a in range(4):
        for b in range(4):
            assert (maps[a] != maps[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))


def subset_sketches(rng, n, m):
    """Sketches of a random set of ``n`` hashes and of a subset of ``m``, stored as ``signatures`` stores them."""
    import numpy as np
    whole = rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True)
    return [(np.sort(s)[:N.SKETCH_SIZE] ^ N.TOP_BIT).view(np.int64).tolist() for s in (whole, rng.permutation(whole)[:m])]


def test_sketches_are_stored_in_the_order_they_are_chosen_by(spark):
    import numpy as np
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(124)))], "doc_id long, text string")
    row = N.signatures(docs).first()
    assert row.n_shingles == 120 and row.sketch == sorted(row.sketch) and len(row.sketch) == N.SKETCH_SIZE
    (_, full), = N.text_sets(docs.toArrow()["text"].combine_chunks())
    assert row.sketch == (full[:N.SKETCH_SIZE] ^ N.TOP_BIT).view(np.int64).tolist()


def test_estimate_keeps_linked_subset_pairs(spark):
    """Texts of 80 to 150 shingles and cuts of them at a similarity of 0.85 to 0.88: no link may be estimated away."""
    import numpy as np
    rng = np.random.default_rng(4)
    sets, pairs = [], []
    for n, m in ((80, 68), (100, 85), (100, 88), (120, 102), (120, 105), (150, 128)):
        for _ in range(500):
            assert 100 * m >= N.LINK_PERCENT * n
            a = len(sets)
            sets += [(a + i, len_, s) for i, len_, s in zip((0, 1), (n, m), subset_sketches(rng, n, m))]
            pairs.append((a, a + 1))
    sketches = spark.createDataFrame(sets, "rep long, n_shingles long, sketch array<long>")
    left = N.estimated(spark.createDataFrame(pairs, "a long, b long"), sketches, N.SKETCH_SIZE, N.LINK_PERCENT)
    assert left.count() == len(pairs)


def test_cut_texts_are_linked(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(400):
        words = [f"{rnd.randrange(10**9):x}" for _ in range(124)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:106]))]  # sets of 120 and 102: similarity 0.85
    got = {r.doc_id: r.component_id for r in run(spark, docs).collect()}
    assert got == {i: i // 2 * 2 for i, _ in docs}
