"""Near-duplicates against unrestricted containment, in code of its own: sets of word tuples, all pairs."""

import numpy as np
import pytest

from mnemoloom.llm import neardup

RNG = np.random.default_rng(21)
WORD = lambda n: [f"w{i}" for i in RNG.integers(0, 10**6, n)]


def tuples(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def all_links(rows):
    """(smaller, larger) of every two texts of which one contains 80 % of the other."""
    sets = {k: tuples(t) for k, t in rows}
    ids = sorted(sets, key=lambda k: (len(sets[k]), k))
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a]) - 1e-9], sets


def planted():
    """Bases with near copies, excerpts of all sizes, texts that quote a license, texts that are little more than it."""
    rows, license_ = [], WORD(12)
    for _ in range(15):
        base = WORD(int(RNG.integers(60, 900)))
        rows.append(base)
        for size in (8, 20, 60, 150, 400):
            if size < len(base) / 1.3:
                at = int(RNG.integers(0, len(base) - size))
                rows.append(base[at : at + size])
        near = list(base)
        near[int(RNG.integers(0, len(base)))] = "edit"
        rows.append(near)
        rows.append(base[: len(base) // 2] + WORD(int(RNG.integers(200, 500))) + base[len(base) // 2 :])
    rows += [WORD(80) + license_ + WORD(80) for _ in range(25)] + [WORD(1) + license_, license_ + WORD(1)]
    return [(i * 3, " ".join(r)) for i, r in enumerate(rows)]


def test_no_link_is_lost_and_no_stranger_joins(spark):
    rows = planted()
    links, sets = all_links(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    both = [(a, b) for a, b in links if len(sets[b]) <= 1.25 * len(sets[a])]
    inside = {}
    for a, b in links:
        if len(sets[b]) > 1.25 * len(sets[a]):
            inside.setdefault(a, []).append(b)
    assert len(inside) > 50 and max(map(len, inside.values())) >= 25
    found = sum(got[a] == got[b] for a, b in both) + sum(any(got[a] == got[b] for b in bs) for a, bs in inside.items())
    assert found >= 0.97 * (len(both) + len(inside))
    # what is in one class hangs together by links
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    members = {}
    for k, c in got.items():
        members.setdefault(c, set()).add(find(k))
    assert all(len(m) == 1 for m in members.values())
    # the texts that quote the license stay apart, but for the one that the license's class is joined to
    quoting = {got[k] for k in list(sets)[-27:-2]}
    assert len(quoting) == 25 and got[rows[-1][0]] == got[rows[-2][0]] in quoting


def test_the_containing_text_stays(spark):
    base = WORD(300)
    rows = [(1, " ".join(base[100:160])), (2, " ".join(base)), (3, " ".join(base + ["more"])), (4, " ".join(WORD(50)))]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4]


def test_containers_that_the_first_try_misses_are_found(spark):
    """Many larger texts hold the first probes, one alone contains the query."""
    part = WORD(20)
    rows = [(0, " ".join(part)), (1, " ".join(WORD(30) + part + WORD(30)))]
    for i in range(12):
        pieces = [w for at in range(0, 20, 7) for w in part[at : at + 7] + WORD(1)]
        rows.append((10 + i, " ".join(WORD(120) + pieces + WORD(40))))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[1] == 1 and len(set(got.values())) == 13


@pytest.mark.parametrize("bits", [15, 29])
def test_every_container_is_listed(spark, monkeypatch, bits):
    """Also of texts that barely have one, and where the filters are full."""
    monkeypatch.setattr(neardup, "FILTER_BITS", bits)
    rows = [t for _, t in planted()]
    for n in RNG.integers(9, 200, 60).tolist():
        part = WORD(n)
        least = -(-4 * (n - 4) // 5)
        rows += [" ".join(part), " ".join(WORD(n) + part[n - least - 4 :] + WORD(n)), " ".join(WORD(n) + part[n - least - 3 :] + WORD(n))]
    rows = [(i, t) for i, t in enumerate([*rows, *rows[:40]])]
    sets = {k: frozenset(tuples(t)) for k, t in rows}
    least = {}
    for k, x in sets.items():
        least.setdefault(x, k)
    want = {(least[a], least[b]) for a in least for b in least if len(b) > 1.25 * len(a) and len(a & b) >= 0.8 * len(a) - 1e-9}
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.set_id for r in found} == {k: least[x] for k, x in sets.items()}
    listed = [(a, r.doc_id) for r in found for a in r.contains or []]
    assert len(found) == len(rows) and len(listed) == len(set(listed)) and set(listed) == want and len(want) > 300


@pytest.mark.parametrize("bits", [15, 29])
def test_filter_lets_all_of_its_hashes_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(neardup, "FILTER_BITS", bits)
    held = RNG.integers(-(2**63), 2**63 - 1, 5000)
    n, bitmap = neardup._filter(spark.createDataFrame([(int(h),) for h in held], "h long"))
    other = RNG.integers(0, 2**63, 20000).astype(np.uint64)
    assert n <= bits and len(neardup._passes(held.view(np.uint64), n, bitmap)) == 5000
    assert len(neardup._passes(other, n, bitmap)) < (2000 if bits == 29 else 20001)


@pytest.mark.parametrize("group", [1, 40, 1 << 17])
def test_texts_hashed_together_are_as_each_alone(monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    blanks = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    texts = [None, "", " \t", "x", "a b c d e", " a  b\x1fc d e f ", blanks.join("abcdefg"), "é\u2019 ü \u00a1 b\u0085c \u3001 d\u3000e", None, "\x00 \x00\x00 a", "\ud800 b", "a b " * 300, blanks]
    texts += [" ".join(WORD(int(n))) for n in RNG.integers(1, 60, 20)] + ["e", "a b c d e"]
    found = list(neardup.sets_of(texts))
    assert [len(x) for x in found] == [len(tuples(t)) for t in texts]
    names = {}
    for t, x in zip(texts, found):
        assert names.setdefault(frozenset(tuples(t)), x.tobytes()) == x.tobytes() == neardup.shingles(" ".join((t or "").split())).tobytes()
    assert len(set(names.values())) == len(names)
    several = np.array([neardup.minhash(x) for x in found if len(x)])
    assert all(np.array_equal(keys, neardup.band_keys(one, 9)) for one, keys in zip(several, neardup.band_keys(several, 9)))


def test_a_check_reads_the_texts_once(spark, tmp_path):
    base = WORD(50)
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(5)] + [(9, " ".join(WORD(50)))]
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/texts")
    pairs = spark.createDataFrame([(i, 0) for i in (1, 2, 3, 4, 9)] + [(0, 4), (9, 4)], "a long, b long")
    checked = neardup._check(pairs, spark.read.parquet(f"{tmp_path}/texts"))
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {(r.a, r.b) for r in checked.collect()} == {(i, 0) for i in (1, 2, 3, 4)} | {(0, 4)}


def test_buckets_of_the_same_members_meet_once(spark):
    members = {1: (10, 11, 12), 2: (10, 11, 12), 3: (10, 11, 13), 4: (20, 21), 5: (10, 11, 12), 6: (20, 22)}
    rows = spark.createDataFrame([(b, i, 9) for b, ids in members.items() for i in ids], "bucket long, id long, size int")
    none = spark.createDataFrame([], "bucket long, hub long")
    labels = spark.createDataFrame([(20, 20), (21, 20)], "id long, label long")
    left = neardup._mixed_buckets(rows, none, labels).collect()
    assert {(r.bucket, r.id, r.label) for r in left} == {(b, i, i) for b in (1, 3, 6) for i in members[b]} and len(left) == 8
