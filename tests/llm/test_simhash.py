import random
import re

import numpy as np
import pytest
import xxhash

from tidewright.llm import simhash
from tidewright.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute(rows):
    fps = [(i, brute_fp(t)) for i, t in rows if i is not None]
    pairs = [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 3]
    label = brute_components(pairs, [i for i, _ in fps])
    return sorted((i, f"{x:016x}", label[i]) for i, x in fps)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["Alpha", "beta", "gamma,", "délta", "EPS", "zeta", "eta", "theta", "iota", "Κappa"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(3000))
    out += [(100 + i, long.replace(" ", "\t", i).replace("beta1", f"x{i}", 2)) for i in range(8)]
    return out + [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "ONE"), (-5, "one two"), (None, "lost"), (3, out[3][1])]


def test_fingerprint(rows):
    assert all(simhash.fingerprint(t) == brute_fp(t) for _, t in rows)


def test_components_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_manhattan_equals_the_embedding(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    fps = np.concatenate((rng.integers(0, 1 << 64, (40, 2), dtype=np.uint64), np.array([[0, (1 << 64) - 1], [1, 2], [3, 0]], np.uint64)))
    want = [int(np.abs(a.astype(int) - b.astype(int)).sum()) for a, b in zip(simhash.embedding(fps[:, 0]), simhash.embedding(fps[:, 1]), strict=True)]
    rows = [(i, *map(int, r)) for i, r in enumerate(fps.view(np.int64).tolist())]
    out = spark.createDataFrame(rows, "i long, a long, b long").select("i", simhash.manhattan(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in out] == want


@pytest.mark.parametrize("groups", [6, 7, 9])
def test_near_fingerprints_share_a_cell(groups):
    import pandas as pd

    rng = np.random.default_rng(groups)
    for _ in range(20):
        fp = int(rng.integers(1 << 62))
        near = fp
        for b in rng.choice(63, 3, replace=False):
            near ^= 1 << int(b)
        rows = pd.concat(simhash._cells(groups)([pd.DataFrame({"fp": np.array([fp, near])})]))
        shared = rows.groupby("cell")["fp"].nunique()
        assert shared.max() == 2
        large = rows[rows["cell"] == shared.idxmax()]
        small = pd.concat(simhash._smaller_cells(groups)([large]))
        assert small.groupby(["cell", "part"])["fp"].nunique().max() == 2
    assert simhash.groups_for(10**5) == 6 < simhash.groups_for(10**7) <= 8 <= simhash.groups_for(10**9) <= 11


def test_links_keep_components_of_dense_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))} | {int(x) for x in rng.integers(1 << 62, size=100)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "CELL_ROWS", 40)
    monkeypatch.setattr(simhash, "PAIR_ROWS", 6)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = [(r.src, r.dst) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert brute_components(found, fps) == brute_components(pairs, fps)
    assert len(found) < len(pairs)


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + rng.randint(1, 50)) for _ in range(60)] + [(5, 5), (7, 6)]
    label = brute_components(pairs, {n for p in pairs for n in p})
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == label
    assert connected_components(edges.limit(0)).count() == 0


def test_representatives(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, c in brute(rows) if i == c} | {None}
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want
