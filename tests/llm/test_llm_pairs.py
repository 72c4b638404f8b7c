"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.llm import marks, negatives, overlap, simhash, unions, vectors
from palisade.llm.registry import queries


def reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = reachable(range(len(rows)), links)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    return sorted(((key, f"{p:016x}", least.get(root[i])) for i, ((key, _), p) in enumerate(zip(rows, prints))), key=str)


def test_close_pairs_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 5, np.uint64)
    prints = np.array([int(rng.choice(seeds)) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))}) for _ in range(300)], np.uint64)
    first, end = np.repeat([0, 7, 200], [7, 193, 100]), np.repeat([7, 200, 300], [7, 193, 100])
    for radius in (0, 1, 3, 6):
        found = {(int(a), int(b)) for i, j in simhash.close_pairs(prints, first, end, radius) for a, b in zip(i, j)}
        wanted = {(i, j) for i in range(300) for j in range(i + 1, int(end[i])) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
        assert found == wanted


@pytest.mark.parametrize("rows_in_a_piece", [4, 2048])
def test_near_duplicates_like_brute_force(spark, monkeypatch, rows_in_a_piece):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows_in_a_piece)
    r = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    long = [" ".join(r.choices(words, k=200)) for _ in range(4)]
    rows = [(i, r.choice(long)) for i in range(30)]
    for i in range(30, 90):
        own = r.choice(long).split()
        own[r.randrange(200)] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "ONE"), (104, "one"), (105, "one two"), (None, long[0]), (None, "alone here today"), (5, "repeated id with another text"), (5, long[1]), (7, rows[7][1]), (106, "x" * 100_000)]
    docs = spark.createDataFrame([(k, t, 1, "z", 2) for k, t in rows], "doc_id long, text string, fp int, component string, id int").repartition(3)
    found = simhash.near_duplicates(docs).select("id", simhash.hexadecimal("fp").alias("fp"), "component").collect()
    assert sorted(map(tuple, found), key=str) == plain_near(rows)


def test_query_like_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = queries()["op5_simhash_bit_planes"](spark, small)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_near(rows)


def test_one_of_each_keeps_a_row_of_every_group(spark):
    a, b = "the cat sat on the mat " * 30, "another text altogether with more words " * 30
    rows = [(3, a), (1, a), (1, a), (2, b), (None, b), (None, "only without an id here"), (None, "only without an id here"), (9, None), (8, "")]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, fp int, row_0 string").repartition(4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == sorted([(1, a), (2, b), (None, "only without an id here"), (8, "")], key=str)


def plain_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]


@pytest.mark.parametrize("limits", [{}, {"PIECE_ROWS": 4, "COMMON": 10, "COLUMNS": 16}, {"SAMPLED_ROWS": 0, "SAMPLE": 3}])
def test_one_of_each_finds_one_word_edits_like_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(overlap, name, value)
    r = random.Random(6)
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for _ in range(25):
        own = [f"W{r.randrange(400)}é" for _ in range(r.choice([3, 20, 64, 90]))]
        rows.append(" ".join(own))
        for _ in range(r.randrange(5)):
            edited = list(own)
            edited[r.randrange(len(own))] = f"edit{r.randrange(9)}"
            rows.append(" ".join(edited[: r.choice([len(own), len(own) - 2])]) + r.choice(["", "", " " + line]))
    rows += [line, line + " more", None, "", "one", "ONE", "one two three four five", "six seven"]
    sets = plain_sets(rows)
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in alike if (plain_fingerprint(rows[i]) ^ plain_fingerprint(rows[j])).bit_count() > 3]
    root = reachable(range(len(rows)), alike)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert far and {x["doc_id"] for x in simhash.one_of_each(docs).collect()} == {k for k in root if root[k] == k}


def test_one_of_each_searches_the_bit_planes_and_confirms(spark, monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    edited = [*words[:1000], "edit", *words[1001:]]
    rows = [(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join(reversed(words))), (3, None), (4, " ".join(edited[:1999]))]
    monkeypatch.setattr(overlap, "chains", lambda found, similarity: found.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (plain_bits(rows[0][1]) ^ plain_bits(rows[1][1])).bit_count() <= 3
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {0, 2, 3}
    # whole sets decide: fingerprints that agree are candidates, no more
    monkeypatch.setattr(simhash, "close_sets", lambda found: found.where("n > 0").select(F.col("fp").alias("src"), F.min("fp").over(Window.partitionBy()).alias("dst")))
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {0, 2, 3}


def plain_bits(text):
    hashes = [int(h) for h in overlap.shingles(text, 5)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert unions.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_long_path_a_hub_and_loops(spark):
    r = random.Random(8)
    names = r.sample(range(-500, 500), 400)
    links = [*zip(names, names[1:60]), *((names[100], n) for n in names[101:250]), (names[300], names[300]), (names[301], names[302]), (names[302], names[301])]
    found = dict(map(tuple, unions.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()))
    touched = {n for a, b in links if a != b for n in (a, b)}
    wanted = reachable(touched, [(a, b) for a, b in links if a != b])
    least = {}
    for n in touched:
        least[wanted[n]] = min(n, least.get(wanted[n], n))
    assert found == {n: least[wanted[n]] for n in touched}


@pytest.mark.parametrize("rows_in_a_piece", [5, 1024])
def test_vectors_like_brute_force(spark, monkeypatch, rows_in_a_piece):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", rows_in_a_piece)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, 16))
    rows = []
    for i in range(60):
        v = centres[i % 3] + rng.standard_normal(16) * 0.08
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(100 + i, rows[0][1], 0) for i in range(12)] + [(200, [x * 2 for x in rows[0][1]], 0), (0, rows[0][1], 0)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [float("inf")] + [1.0] * 15, 0), (304, rows[0][1], None), (305, [None] + [1.0] * 15, 0), (306, [], 0), (307, rows[0][1][:8], 0)]
    table = spark.createDataFrame([(k, v, label, 1, "x") for k, v, label in rows + odd], "vec_id long, embedding array<float>, label int, n int, node string").repartition(3)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    root = reachable(range(len(rows)), links)
    least = {}
    for i, row in enumerate(rows):
        least[root[i]] = min(row[0], least.get(root[i], row[0]))
    counts = [sum(a == i for a, _ in links) for i in range(len(rows))]
    wanted = sorted([(row[0], counts[i], least[root[i]]) for i, row in enumerate(rows)] + [(row[0], 0, row[0]) for row in odd])
    assert any(counts)
    found = vectors.near_vectors(table).select("id", "n_links", "component")
    assert sorted(map(tuple, found.collect())) == wanted


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    signs = [vectors.signatures(x, vectors.BITS, vectors.TABLES, vectors.SEED) for x in (a, b)]
    assert (signs[0] == signs[1]).any(axis=1).mean() > 0.99


def test_a_hot_group_isnt_expanded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words in every one of these").otherwise(F.concat(F.lit("word "), F.col("id"), F.lit(" more "), F.col("id") * 7)).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.where("component = 0").count() >= 6667


# --- hard negatives


def plain_negatives(rows, anchors, positives=5, count=3, low=50, high=95):
    """Rows (id, label, whole-number vector or None) by comparing every anchor with every row."""
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    found = []
    for key, label, vector in usable:
        if not anchors(key):
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v)), k, other) for k, other, v in usable if k != key and len(v) == len(vector)]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted((m, k) for m, k, other in scored if other != label and low * -minus <= 100 * -m <= high * -minus)
            found += [(key, positive, rank, k, -minus, -m) for rank, (m, k) in enumerate(fits[:count], 1)]
    return sorted(found)


def mined(spark, rows, every, **settings):
    table = spark.createDataFrame([(k, label, v, 1, "x") for k, label, v in rows], "vec_id long, label int, embedding array<double>, cell int, path string").repartition(3)
    return sorted(map(tuple, negatives.mine(table, anchors=F.col("vec_id") % every == 0, scale=1, **settings).collect()))


@pytest.mark.parametrize("cell_rows, piece", [(256, 4096), (2, 3)])
def test_negatives_like_brute_force(spark, monkeypatch, cell_rows, piece):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(negatives, "PIECE", piece)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (6, 8))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 6] + rng.integers(-40, 40, 8)).tolist()) for i in range(300)]
    rows += [(400 + i, i % 2, rows[5][2]) for i in range(30)]  # ties
    rows += [(500, 1, rows[5][2]), (500, 1, rows[5][2]), (505, 0, rows[6][2])]  # repeated rows, an anchor among them
    rows += [(600, 1, [0] * 8), (605, 1, []), (606, 0, []), (607, 1, []), (610, 1, [5, 6]), (611, 1, [5, 7]), (612, 0, [4, 5]), (615, 1, [3]), (616, 1, [3]), (617, 2, [2])]
    odd = [(None, 1, rows[5][2]), (700, None, rows[5][2]), (705, 1, None)]
    wanted = plain_negatives(rows + odd, lambda k: k % 5 == 0)
    floats = [(k, label, None if v is None else [float(x) for x in v]) for k, label, v in rows + odd]
    floats += [(710, 1, [float("nan")] * 8), (715, 1, [float("inf")] + [1.0] * 7), (720, 1, [None] + [1.0] * 7)]
    assert len(wanted) > 100 and {w[0] for w in wanted} >= {500, 610}
    assert mined(spark, floats, 5) == wanted
    assert mined(spark, floats, 5, sample=4) == wanted  # most vectors far from all codewords, widths without any


def test_negatives_of_long_vectors_and_none(spark):
    far = [(i, i % 2, [float((i * 7919 % 1000) << 20), float((i * 104729 % 1000) << 20), 1.0]) for i in range(60)]  # products beyond 2 ** 53
    whole = [(k, label, [int(x) for x in v]) for k, label, v in far]
    assert mined(spark, far, 5) == plain_negatives(whole, lambda k: k % 5 == 0)
    assert mined(spark, [], 5) == [] and mined(spark, [(1, 1, [1.0])], 5) == []
    table = spark.createDataFrame([(0, [0.999, -0.001], 1)], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(table).count() == 0


def test_cells_come_in_falling_order():
    rng = np.random.default_rng(1)
    for a, b in ((1, 1), (1, 7), (6, 1), (5, 9)):
        left, right = rng.integers(0, 6, a).astype(float), rng.integers(0, 6, b).astype(float)
        walked = list(negatives.falling_cells(left, right))
        assert sorted((i, j) for _, i, j in walked) == [(i, j) for i in range(a) for j in range(b)]
        assert [w[0] for w in walked] == sorted((x + y for x in left for y in right), reverse=True)


def test_few_cells_are_read_where_groups_lie_apart():
    """The certificate stops early, and what it returns is still what comparing all rows gives."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 8))
    centres *= 2000 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, i % 2, (centres[i % 30] * (0.8 if i // 30 % 2 else 1) + rng.integers(-9, 9, 8)).astype(int).tolist()) for i in range(1201)]
    rows = [(i, (i + i // 30) % 2, v) for i, _, v in rows]
    books = negatives.Codebooks([v for _, _, v in rows], 60)
    vectors_of = np.array([v for _, _, v in rows], float)
    placed, left, right = books.place(vectors_of)

    class InMemory:
        def __init__(self):
            self.books, self.reads = books, []
            self.reach = {(8, c): (left[placed == c].max(), right[placed == c].max()) for c in set(placed.tolist())}
            self.radius = {8: tuple(np.array([r[codes == k].max(initial=-np.inf) for k in range(len(book))]) for r, codes, book in zip((left, right), (placed // 60, placed % 60), books.of(8)))}

        def read(self, width, cell):
            self.reads.append(cell)
            own = np.flatnonzero(placed == cell)
            yield np.array([rows[i][0] for i in own]), np.array([rows[i][1] for i in own]), vectors_of[own]

    found, reads, cells = [], 0, InMemory()
    for key in range(0, 1201, 100):
        anchor = negatives.Anchor(key, rows[key][1], np.array(rows[key][2]), cells, 5)
        negatives.certify([anchor], cells)
        anchor.windows = [negatives.Window(k, -minus, 50, 95, 3) for minus, k in anchor.held]
        anchor.start()
        negatives.certify([anchor], cells)
        found += [(key, w.positive, rank, k, w.score, -minus) for w in anchor.windows for rank, (minus, k) in enumerate(w.held, 1)]
    assert sorted(found) == plain_negatives(rows, lambda k: k % 100 == 0) and len(found) > 100
    assert len(cells.reads) < 13 * 2 * len(cells.reach) / 4


def test_negatives_query(spark, small):
    rows = []
    for r in spark.read.parquet(f"{small}/embeddings.parquet").collect():
        label = r["label"] if r["vec_id"] % 7 or r["label"] is None else (r["label"] + 1) % 10
        good = r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])
        rows.append((r["vec_id"], label, [int(np.floor(256 * float(x))) for x in r["embedding"]] if good else None))
    assert sorted(map(tuple, queries()["op11_inverted_multi_index"](spark, small).collect())) == plain_negatives(rows, lambda k: k % 50 == 0)


def test_common_shingles_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON", 1 << 12)
    monkeypatch.setattr(overlap, "SLICE", 1000)
    monkeypatch.setattr(overlap, "SAMPLED_ROWS", 0)
    r = random.Random(4)
    rows = [(k, " ".join(f"w{r.randrange(9)}" for _ in range(30))) for k in range(300)] + [(k, t) for k in range(2) for t in (None, "")]
    plain = np.zeros(1 << 12)
    for _, text in rows:
        for h in overlap.shingles(text or "", 5):
            plain[int(h) % (1 << 12)] += 1
    found = overlap.common_shingles(spark.createDataFrame(rows, "extra long, text string").repartition(5), 5)
    assert found.tolist() == np.minimum(255, np.round(8 * np.log2(plain + 1))).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_chains_join_what_sizes_and_places_allow_and_no_more(spark, seed):
    r = random.Random(seed)
    rows = [(k, n, [r.randrange(9) for _ in range(n + -4 * n // 5 + 1)]) for k, n in enumerate(r.choice([5, 40, r.randrange(20, 90)]) for _ in range(120))]
    rows = [(k, n, list(dict.fromkeys(p + [100 + k * 100 + i for i in range(len(p))]))[: len(p)]) for k, n, p in rows]
    found = spark.createDataFrame(rows + rows[:7], "fp long, n long, prefix array<long>")
    allowed = []
    for a, m, p in rows:
        for b, n, q in rows[:a]:
            for token in set(p) & set(q):
                shared = min(m - p.index(token), n - q.index(token))
                if 9 * shared >= 4 * (m + n):
                    allowed.append((a, b))
    made = [(e.src, e.dst) for e in overlap.chains(found, 0.8).collect()]
    assert {(max(e), min(e)) for e in made} <= set(allowed)
    assert reachable(range(120), made) == reachable(range(120), allowed)


@pytest.mark.parametrize("slots", [1, 8, 1 << 24])
def test_marks_reach_every_row_wanted(spark, monkeypatch, slots):
    monkeypatch.setattr(marks, "SLOTS", slots)
    rows = spark.range(2000).select("id", F.lit("text").alias("text"))
    wanted = spark.range(0, 2000, 40).select(F.xxhash64("id"))
    found = {x["id"]: x["m"] for x in marks.flagged(rows, F.xxhash64("id"), wanted, "m").collect()}
    assert len(found) == 2000 and all(found[k] for k in range(0, 2000, 40))
    assert slots < 1 << 24 or sum(found.values()) < 60
    assert not any(x["m"] for x in marks.flagged(rows, F.xxhash64("id"), wanted.limit(0), "m").collect())


def test_near_copies_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(marks, "SLOTS", 1)
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "x y z"), (None, "x y z"), (3, "other"), (3, "other")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f"), (2, "x y z"), (3, "other")]


def test_cells_that_no_bound_rules_out_are_read_a_few_times_for_all_anchors():
    rng = np.random.default_rng(5)
    vectors_of = rng.integers(-200, 201, (3000, 32)).astype(np.float32)
    labels = np.arange(3000) % 3
    books = negatives.Codebooks(vectors_of[:500].astype(int).tolist(), 20)
    placed, left, right = books.place(vectors_of.astype(float))

    class InMemory:
        def __init__(self):
            self.books, self.reads = books, []
            self.reach = {(32, c): (left[placed == c].max(), right[placed == c].max()) for c in set(placed.tolist())}
            self.radius = {32: tuple(np.array([r[codes == k].max(initial=-np.inf) for k in range(len(book))]) for r, codes, book in zip((left, right), (placed // 20, placed % 20), books.of(32)))}

        def read(self, width, cell):
            self.reads.append(cell)
            own = np.flatnonzero(placed == cell)
            yield own, labels[own], vectors_of[own]

    cells = InMemory()
    anchors = [negatives.Anchor(k, labels[k], vectors_of[k].astype(np.int64), cells, 5) for k in range(60)]
    negatives.certify(anchors, cells)
    wide = vectors_of.astype(np.int64)
    for a in anchors:
        rest = np.flatnonzero((labels == a.label) & (np.arange(3000) != a.key))
        assert a.held == sorted((-int(wide[a.key] @ wide[k]), int(k)) for k in rest)[:5]
    assert len(cells.reach) > 200 and len(cells.reads) < 12 * len(cells.reach)


@pytest.mark.parametrize("most", [100, 1 << 20, 1 << 33])
def test_scores_are_whole_numbers(most):
    rng = np.random.default_rng(most)
    rows, anchors = rng.integers(-most, most, (50, 4)), rng.integers(-(most >> 8), 1 + (most >> 8), (7, 4))
    kept = rows.astype(np.float32 if most < 1 << 23 else np.float64)
    length = float(np.sqrt((anchors.astype(float) ** 2).sum(axis=1).max()))
    assert (negatives.scores(kept, anchors, length).astype(np.int64) == anchors @ rows.T).all()
