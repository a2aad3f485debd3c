"""Substring, suffix-array, exact and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from molquarry.llm.components import components
from molquarry.llm.exact_dedup import exact_dedup
from molquarry.llm.near_dedup import ROWS, alike, bands_for, estimates, least_estimate, minima, near_dedup, packed, plausible
from molquarry.llm.substring_dedup import substring_dedup
from molquarry.llm.suffix_dedup import suffix_dedup
from molquarry.llm.suffixes import permuted_prefixes, repeated, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, gram long, id string, h string, spans string"


def texts(seed: int = 0) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, repeats inside a text, odd white space, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ma", "so", "été", "Ki", "ru") for b in ("ra", "ne", "lo", "tis", "ß")]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = some(80), some(30)
    rows: list[tuple[int | None, str | None]] = []
    for k in range(12):
        words = base.split()
        words[rng.randrange(80)] = "changed"
        rows.append((k, base if k % 4 == 0 else " ".join(words)))
    rows += [(20 + k, f"{some(20)}\n{passage}\t{some(10)}") for k in range(4)]
    rows += [(30, base.replace(" ", " \n ", 5)), (31, base.upper()), (32, None), (33, ""), (34, " \n\t "), (35, "one"), (36, "One"), (37, "two words"), (38, some(6000)), (39, (some(7) + " ") * 60), (40, "a" * 3000), (41, "a" * 3000), (42, "é" * 900)]
    rows += [(None, some(40)), (None, base), (-5, passage)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", None, "y") for i, t in rows], SCHEMA).repartition(3)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def order(i):
    return (i is None, i)


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_substrings(spark, rows, hot):
    got = by_id(substring_dedup(frame(spark, rows), with_text=True, hot=hot))
    first: dict[tuple, tuple] = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, order(i)), order(i))
    removed = 0
    for i, w in split:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < order(i) for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        removed += len(gone)
        assert (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept) in [(r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got[i]]
    assert removed > 300


@pytest.mark.parametrize("width", [400, 60])
def test_suffixes(spark, rows, width):
    got = by_id(suffix_dedup(frame(spark, [x for x in rows if x[0] is not None]), width))
    raw = [(i, (t or "").encode()) for i, t in rows if i is not None]
    counts = Counter(b[p : p + width] for _, b in raw for p in range(len(b) - width + 1))
    total = 0
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if counts[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        total += sum(gone)
        r = got[i][0]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert total > 1000


def test_suffixes_of_hot_minimisers(spark, monkeypatch):
    """A minimiser of many pieces in shares: copies that meet in one share, in several, and in none."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, longer = some(60), some(150)
    made = [some(70) + common + some(70) for _ in range(40)] + [some(9) + longer + some(9) for _ in range(20)]
    made += [some(k) + made[k][20:170] + some(12) for k in range(12)] + ["ab" * 200, "é" + "ab" * 150]
    rows = [(k, t) for k, t in enumerate(made)]
    monkeypatch.setattr("molquarry.llm.suffix_dedup.SHARD", 1)
    monkeypatch.setattr("molquarry.llm.suffix_dedup.ROWS", 7)
    width = 100
    counts = Counter(t.encode()[p : p + width] for _, t in rows for p in range(len(t.encode()) - width + 1))
    want = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if counts[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 4000
    for hot in (1, 5, 1000):
        assert sorted(map(tuple, suffix_dedup(frame(spark, rows), width, hot=hot).collect())) == want


def test_windows_of_hot_minimisers_are_not_listed(spark, monkeypatch):
    """Where many texts share a line or a passage, the sorted shards don't tell each window of each text."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, passage, width, n = some(60), some(150), 100, 300
    lines = [(k, some(80) + line + some(80)) for k in range(n)]
    passages = [(k, some(90) + passage + some(90)) for k in range(n)]
    told = spark.sparkContext.accumulator(0)

    def counted(self, f, schema, as_it_is=type(frame(spark, lines)).mapInArrow):
        def found(batches):
            for batch in f(batches):
                told.add(batch.num_rows)
                yield batch

        return as_it_is(self, found if "window" in schema else f, schema)

    monkeypatch.setattr(type(frame(spark, lines)), "mapInArrow", counted)
    assert {(r["n_removed"], r["n_spans"]) for r in suffix_dedup(frame(spark, lines), width, hot=50).collect()} == {(0, 0)}
    assert told.value <= n
    before = told.value
    got = suffix_dedup(frame(spark, passages), width, hot=50).collect()
    # Next to the passage a byte or two may agree as well.
    assert all(len(passage) <= r["n_removed"] <= len(passage) + 12 and r["n_spans"] == 1 for r in got)
    assert told.value - before <= 30 * n


def test_suffix_arrays():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))] + [0], np.uint8)
        b = bytes(s)
        order_ = sorted(range(len(b)), key=lambda k: b[k:])
        sa = suffix_array(s)
        assert sa.tolist() == order_
        before, prefix = permuted_prefixes(s, sa)
        for x, y in zip(order_[1:], order_, strict=False):
            n = next(k for k in range(len(b) + 1) if x + k >= len(b) or y + k >= len(b) or b[x + k] != b[y + k])
            assert before[x] == y and prefix[x] == n
    assert repeated([b"abcab", b"xbc"], 2)[0].tolist() == [True, True, False, True, False]


def test_exact(spark, rows):
    twice = rows + [rows[0], rows[0]]
    got = exact_dedup(frame(spark, twice)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in twice:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    assert len(got) == len(twice)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_a_group_spread_over_all_ranges(spark):
    rows = [(k, "same text") for k in range(2000)] + [(5000 + k, f"other {k}") for k in range(50)]
    got = exact_dedup(frame(spark, rows).repartition(8)).collect()
    assert {r["group_size"] for r in got if r["doc_id"] < 2000} == {2000} and {r["keep_id"] for r in got if r["doc_id"] < 2000} == {0}
    assert sum(r["kept"] for r in got) == 51


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near(spark, rows, width, percent):
    got = by_id(near_dedup(frame(spark, rows), width, percent))
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(upper))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= percent * len(x | y) or sets[a][0] is None and sets[b][0] is None:
                label = [label[a] if v == label[b] else v for v in label]
    least = {v: min((sets[k][0] for k in range(len(sets)) if label[k] == v), key=order) for v in label}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            r = got[i][0]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s), least[label[k]], i == least[label[k]])
    assert sum(len(s) > 0 for _, s in sets) > len(set(least.values()))
    assert (1 - (percent / 100) ** 6) ** bands_for(percent) <= 1e-6


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_are_worked_on_in_blocks(spark, monkeypatch, seed):
    """Chains and clouds of copies around the limit: which links hold is decided in stars, cells and blocks."""
    import molquarry.llm.near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 8)
    rng = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"w{family}x{k}" for k in range(120)]
        chain = list(base)
        for k in range(40):
            w = list(base)
            for _ in range(rng.randint(1, 7)):
                w[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
            chain[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
            rows += [(1000 * family + 2 * k, " ".join(w)), (1000 * family + 2 * k + 1, " ".join(chain))]
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label = {i: label[a] if v == label[b] else v for i, v in label.items()}
    least = {v: min(i for i in sets if label[i] == v) for v in label.values()}
    got = near_dedup(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[label[i]] for i in sets}
    assert 6 < len(least) < 200


def test_near_copies_among_rows_with_null_or_shared_ids(spark):
    rng = random.Random(4)
    some = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    edited = lambda w: " ".join([*w[:-1], "edit"])
    groups = [some() for _ in range(12)]
    rows, wanted = [], {}
    for k, w in enumerate(groups):
        # Without an id; one id for all; a pair without ids; a pair of one id, and each row of the pair repeated.
        for i, t in (((None, " ".join(w)), (k, edited(w))), ((-1, " ".join(w)), (k, edited(w))), ((None, " ".join(w)), (None, edited(w))), ((50, " ".join(w)), (50, edited(w)), (50, edited(w))))[k % 4]:
            rows.append((i, t))
            wanted[t] = k
    rows += [(None, None), (None, ""), (50, " ")]
    assert sum(r["kept"] for r in near_dedup(frame(spark, rows)).collect()) == len(groups) + 3
    found = near_dedup(frame(spark, rows), with_hash=True)
    text_of = {r["h"]: r["text"] for r in frame(spark, rows).selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    got = [(r, wanted.get(text_of[r["text_hash"]])) for r in found.collect()]
    assert len(got) == len(rows)
    assert Counter(k for r, k in got if r["kept"] and k is not None) == Counter(range(12))
    for r, k in got:
        if k is not None:
            assert r["component_id"] == (k, -1, None, 50)[k % 4] and (not r["kept"] or r["doc_id"] == r["component_id"])
        else:
            assert r["kept"] and r["n_shingles"] == 0


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, exact_dedup, near_dedup])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (7, 6), (7, 6)]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(400):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert len(got) == len(label) and {r["id"]: r["component"] for r in got} == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_plausible_is_what_a_loop_finds():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < x, rng.integers(0, 1 << 62, 200, dtype=np.uint64), base)) for x in rng.choice([0.01, 0.05, 0.2, 0.6], 40)]
    n = bands_for(85) * ROWS
    signatures, labels, sizes = packed(minima(sets, n)), rng.integers(0, 9, 40), np.array([len(s) for s in sets])
    keep = plausible(signatures, sizes, labels, 85, n)
    for i in range(40):
        close = [j for j in range(40) if labels[i] != labels[j] and estimates(signatures[i], signatures[j : j + 1], n)[0] >= least_estimate(85, n)]
        assert keep[i] == bool(close)
        assert keep[i] or not any(labels[i] != labels[j] and alike(sets[i], sets[j], 85) for j in range(40))


def test_words_that_fool_a_polynomial_hash_differ():
    import numpy as np

    from molquarry.llm.rolling import words_of

    pair = "a", "b"
    for _ in range(11):
        pair = pair[0] + pair[1], pair[1] + pair[0]
    words = [*pair, "a" * 64, "a" * 65, "a" * 63 + "b", "a" * 8, "a" * 9, "a", "A", "é", "e"]
    data = " ".join(words).encode()
    hashes, text = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(hashes.tolist())) == len(words) and not text.any()
    again, _ = words_of(np.frombuffer(b"xx " + data[:-1], np.uint8), np.array([0, len(data) + 2]))
    assert again[1:].tolist() == hashes[:-1].tolist()
    assert words_of(np.frombuffer(b"Ab", np.uint8), np.array([0, 2]), lower=True)[0] == words_of(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0]
