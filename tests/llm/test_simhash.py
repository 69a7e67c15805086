"""SimHash near-dedup against a plain version."""
import numpy as np
import pytest
import xxhash
from brute import BLANK_WORDS, LOWER
from odd_rows import ODD, PASSAGE, SF

from emberledger.llm import queries, simhash
from emberledger.llm.components import components


def plain_print(text, size=4):
    w = BLANK_WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or (
        [" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def plain(docs, radius=4):
    prints = {d: plain_print(t) for d, t in docs}
    root = {x: x for x in prints.values()}
    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(root, b)] = find(root, a)
    low = {}
    for d, x in prints.items():
        low[find(root, x)] = min(low.get(find(root, x), d), d)
    return {d: (f"{x:016x}", low[find(root, x)]) for d, x in prints.items()}


def rows(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def test_over_documents(spark, given):
    want = plain(given)
    assert rows(queries.op13_simhash_near_dedup(spark, SF)) == want
    assert len({v[1] for v in want.values()}) < len(want)


@pytest.mark.parametrize("chunk", [5, 128 << 10])
def test_prints_of_texts_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    for _doc, text in [*ODD, (0, PASSAGE * 30)]:
        assert simhash.simhash((text or "").encode().lower()) == plain_print(text)


def family(rng, center, n, flips):
    out = np.full(n, center, np.uint64)
    for i in range(n):
        for bit in rng.choice(64, int(rng.integers(0, flips + 1)), replace=False):
            out[i] ^= np.uint64(1) << np.uint64(bit)
    return out


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
@pytest.mark.parametrize("groups", [1, 5, 200])
@pytest.mark.parametrize("sides", [False, True])
def test_groups_are_joined_as_by_all_pairs(radius, groups, sides):
    rng = np.random.default_rng(radius * 100 + groups)
    prints = np.unique(np.concatenate([
        rng.integers(0, 1 << 63, 150).astype(np.uint64),
        family(rng, rng.integers(0, 1 << 63), 120, 6), family(rng, 5, 50, 3)]))
    rng.shuffle(prints)
    group = np.sort(rng.integers(0, groups, len(prints)))
    side = rng.integers(1, 3, len(prints)) if sides else np.zeros(len(prints), np.int64)
    want, got = {i: i for i in range(len(prints))}, {i: i for i in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            if group[i] == group[j] and (not sides or side[i] != side[j]) and (
                    int(prints[i]) ^ int(prints[j])).bit_count() <= radius:
                want[find(want, j)] = find(want, i)
    i, j = simhash.group_links(group, side, prints, radius)
    assert len(i) < len(prints)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        assert find(got, a) != find(got, b)
        got[find(got, b)] = find(got, a)
    pairs = {(find(want, x), find(got, x)) for x in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_some_choice_of_blocks_holds_every_near_pair():
    rng, masks = np.random.default_rng(1), simhash.block_keys()
    assert len(masks) == 35
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & mask == 0 for mask in masks)


def test_tiles_of_any_size_find_the_same(spark):
    rng = np.random.default_rng(4)
    prints = np.unique(np.concatenate([family(rng, c, 150, 5) for c in (1 << 60, 77, 1 << 40)]))
    classes = spark.createDataFrame(
        [(int(p), n) for n, p in enumerate(prints.view(np.int64))], "fp long, node long")
    whole, tiled = (sorted(map(tuple, components(
        simhash.near_links(classes, tile=tile)).collect())) for tile in (simhash.TILE, 7))
    assert whole == tiled and len({r for _n, r in whole}) <= 10 < len(whole)


def test_no_rows_null_ids_repeats_long_texts_and_clashing_columns(spark):
    schema = "doc_id long, text string, fp string, node string, component_id string"
    assert simhash.near_groups(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"w{i % 977}" for i in range(150_000)) + " " + "x" * 400_000
    docs = [(None, long), (9, long), (9, long), (9, "other words here now"), (12, None), (11, ""),
            (3, "other words here now"), (40, "alone among all these documents")]
    got = sorted(tuple(r) for r in simhash.near_groups(spark.createDataFrame(
        [(d, t, "a", "b", "c") for d, t in docs], schema)).fillna(-1).collect())
    want = [(-1 if d is None else d, f"{plain_print(t):016x}",
             {None: 3, 9: 3, 3: 3, 12: 11, 11: 11, 40: 40}[d]) for d, t in docs]
    assert got == sorted(want)
