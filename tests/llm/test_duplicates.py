import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from fixtures import documents, frame, lower, words
from tidemill.llm import repeats, sliced, subspace
from tidemill.llm.components import components, forest
from tidemill.llm.fingerprints import compare_edits, near_counts
from tidemill.llm.repeats import remove_repeats
from tidemill.llm.sliced import near_duplicates
from tidemill.llm.subspace import near_vectors


def plain_print(text, width=4):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < width else [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    labels = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = labels[i], labels[j]
                labels = [min(a, b) if x in (a, b) else x for x in labels]
    return labels


def test_simhash_components_against_brute_force(spark):
    rows = documents()
    found = near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = [plain_print(t) for _, t, *_ in rows]
    labels = classes(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (i, *_), c in zip(rows, labels):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted(((i, p, least[c]) for (i, *_), p, c in zip(rows, prints, labels)), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found), key=str) == want


def test_simhash_on_an_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_bit_sliced_links_for_any_number_of_blocks_and_split_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(sliced, "TILE", 20)
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) for b in base for _ in range(15)}
    prints = sorted(near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = sliced.links(spark.createDataFrame([(p,) for p in signed], "fp long"), "fp", 4, blocks).collect()
    labels = np.arange(len(prints))
    place = {p: k for k, p in enumerate(signed)}
    if links:
        forest(labels, np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert labels.tolist() == classes(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)


def test_near_masks_counts_every_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    prints[40:60] = prints[0] ^ (np.uint64(1) << np.arange(20, dtype=np.uint64))
    sliced_, valid = sliced.planes(prints), sliced.planes(np.concatenate((np.full(130, sliced.ALL), np.zeros(62, dtype=np.uint64))))[0]
    for radius in (0, 1, 2, 4, 7):
        for block in range(3):
            items, masks = sliced.near_masks(sliced_, valid, prints, np.full(130, block), radius)
            got = {(int(i), 64 * block + b) for i, m in zip(items, masks) for b in range(64) if int(m) >> b & 1}
            assert got == {(i, j) for i in range(130) for j in range(64 * block, min(130, 64 * block + 64)) if int(prints[i] ^ prints[j]).bit_count() <= radius}


def test_components_of_chains_hubs_and_rings(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (7, 6)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_removal(rows, n):
    texts = [(i, words(t)) for i, t, *_ in rows]
    least = {}
    for i, w in texts:
        for p in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[p:p + n])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if i is not None and least[tuple(w[p:p + n])] < i:
                gone[p:p + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [50, 8])
def test_substring_dedup_against_brute_force(spark, width):
    rows = documents()
    if width == 8:
        # nearly everything repeats, at every offset: few distinct words
        rng = random.Random(5)
        rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), None, None) for k in range(60)] + [(None, "a b " * 20, None, None)]
    found = remove_repeats(frame(spark, rows), width)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_removal(rows, width)


def test_substring_dedup_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_WORDS", 30)
    rows = documents(4)
    assert sorted((tuple(r) for r in remove_repeats(frame(spark, rows), 10).collect()), key=str) == plain_removal(rows, 10)
    assert remove_repeats(frame(spark, [])).count() == 0


def plain_edit(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t, *_ in order]
    out = {}
    for k, (i, *_) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest(), t, t[:len(t) - cut] + after[:cut], after)
    return out


@pytest.mark.parametrize("chars", [4_000_000, 3_000])
def test_fingerprints_and_edits(spark, monkeypatch, chars):
    from tidemill.llm import fingerprints

    monkeypatch.setattr(fingerprints, "RANGE_CHARS", chars)  # one id range, and many
    rows = [r for n, r in enumerate(documents()) if r[0] is not None and r[0] not in [x[0] for x in documents()[:n]]] + [(None, "last one", None, None)]
    found = {r["doc_id"]: r for r in compare_edits(frame(spark, rows)).collect()}
    want = plain_edit(rows)
    assert found.keys() == want.keys()

    def sign(text):
        w = words(text.lower())
        terms = list(zip(w, w[1:])) if len(w) > 1 else [(x, x) for x in w]
        hashes = [pair_hash(*t) for t in terms]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    def pair_hash(a, b):
        return xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))

    for i, (n, sha, text, edited, after) in want.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        if text.isascii() and edited.isascii() and after.isascii():
            assert r["fp"] & (1 << 64) - 1 == sign(text) and r["edited_fp"] & (1 << 64) - 1 == sign(edited)
            assert abs(r["near_edited"] - (1 - (sign(text) ^ sign(edited)).bit_count() / 64)) < 1e-12
            assert abs(r["near_next"] - (1 - (sign(text) ^ sign(after)).bit_count() / 64)) < 1e-12


def test_fingerprints_of_repeated_ids_one_row_and_none(spark):
    assert compare_edits(frame(spark, documents())).count() == len(documents())
    one = compare_edits(frame(spark, [(1, "abcdef", None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert compare_edits(frame(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [4, 5])
def test_block_tables_find_all_fingerprints_in_the_radius(spark, blocks):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(10)] + base * 2
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["fp"]: r["n_near"] for r in near_counts(df, df, 3, blocks).collect()}
    assert found == {p: sum((p ^ q).bit_count() <= 3 for q in prints) for p in set(prints)}


def plain_links(rows, least=0.93):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def link(a, b):
        (_, v, k), (_, w, m) = rows[a], rows[b]
        if not good(v, k) or not good(w, m) or k != m or len(v) != len(w):
            return False
        x, y = np.float32(v).astype(float), np.float32(w).astype(float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= least

    n = len(rows)
    links = [sum(link(a, b) for b in range(n) if b != a) for a in range(n)]
    labels = classes(n, link)
    root = {}
    for (i, *_), c in zip(rows, labels):
        root[c] = min((x for x in (root.get(c), i) if x is not None), default=None)
    return sorted(((i, k, root[c], i == root[c]) for (i, *_), k, c in zip(rows, links, labels)), key=str)


@pytest.mark.parametrize("tile", [4_096, 6])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(subspace, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 20))
    rows = [(k, (centres[k % 6] + rng.standard_normal(20) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32).tolist(), int(k % 6 > 2)) for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)] + [(200, rows[0][1], rows[0][2])]
    rows += [(300, None, 0), (301, [0.0] * 20, 0), (302, [float("nan")] * 20, 0), (303, [float("inf")] + [1.0] * 19, 1), (304, [None] + [1.0] * 19, 1),
             (305, rows[0][1], None), (None, rows[5][1], rows[5][2]), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0), (309, (2 * np.float32(rows[7][1])).tolist(), rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS n", "3 AS cell", "4 AS home", "5 AS grp")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == plain_links(rows)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert isinstance(pd.DataFrame(), pd.DataFrame)
