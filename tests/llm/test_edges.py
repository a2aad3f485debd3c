"""Selections, spans and packs against brute force, and rows of odd kinds, for the operators without SQL."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molquarry.llm.chat import chat_format
from molquarry.llm.exact_dedup import exact_dedup
from molquarry.llm.mixing import BUCKET_BITS, mixed
from molquarry.llm.near_dedup import near_dedup
from molquarry.llm.packing import pack, patterns
from molquarry.llm.quality import quality_rules
from molquarry.llm.secret_scan import base_spans, entropy_spans, secret_scan
from molquarry.llm.substring_dedup import substring_dedup
from molquarry.llm.suffix_dedup import suffix_dedup
from molquarry.llm.tokens import Encoder, vocabulary

#: Columns that clash with names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, host string, key string, row string, hash long, told string, node long, band long, bucket string, tokens string, rank long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "a", "b", "c", 2, "d", 3, 4, "e", "f", 5) for i, t, lang, s in rows], DOCS)


def test_the_mix_takes_the_prefix_of_each_leaf(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("x" * rng.randint(1, 9)), rng.choice(["en", "de"]), rng.choice(["src0", "src1"])) for k in range(300)]
    table = docs(spark, rows)
    seed, epochs = 5, 3
    got = mixed(table, fraction=1.2, epochs=epochs, weights={"lang=en": 3.0}, seed=seed).collect()
    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        leaves[lang, source].append((i, len(t.split())))
    taken, whole = defaultdict(Counter), {}
    for r in got:
        taken[r["lang"], r["source"]][r["doc_id"]] = r["n_copies"]
        whole[r["lang"], r["source"]] = r["epoch"]
    for leaf, members in leaves.items():
        n = whole[leaf]
        order = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i, _ in members], "i long").select("i", F.xxhash64(F.lit(seed), F.lit(n), F.col("i")).alias("h")).collect()}
        by_order = sorted(members, key=lambda x: ((order[x[0]] % 2**64) >> (64 - BUCKET_BITS), order[x[0]], x[0]))
        more = [taken[leaf][i] > n for i, _ in by_order]
        assert more == sorted(more, reverse=True) and all(taken[leaf][i] in (n, n + 1) for i, _ in by_order)
    assert {n for n in whole.values()} <= set(range(epochs + 1)) and sum(r["n_copies"] * r["n_tokens"] for r in got) <= 1.2 * sum(len(t.split()) for _, t, _, _ in rows)


def test_weights_of_none_and_names_of_none(spark):
    rows = [(k, "a b c", ("en", "de", None)[k % 3], ("src0", None)[k % 2]) for k in range(60)]
    table = docs(spark, rows)
    assert len({r["doc_id"] for r in mixed(table, fraction=1.0).collect()}) == 60
    left = mixed(table, fraction=1.0, epochs=1, weights={"lang=de": 0.0}).collect()
    assert {r["doc_id"] for r in left} == {k for k in range(60) if k % 3 != 1}
    assert mixed(table, weights={"lang=de": 0.0, "lang=en": 0.0, "lang=": 0.0}).count() == 0
    lost = F.when(F.col("doc_id") % 2 == 0, F.lit("d"))
    assert {r["domain"] for r in mixed(table, fraction=1.0, domain=lost).collect()} == {"d", ""}
    # A child that may take nothing leaves its share to the other branch.
    part = mixed(table, budget=30, epochs=1, weights={"source=src0": 0.0}).collect()
    assert {r["source"] for r in part} == {""} and sum(r["n_tokens"] for r in part) == 27
    with pytest.raises(ValueError, match="negative"):
        mixed(table, weights={"lang=de": -1.0})


def test_long_runs_of_white_space(spark):
    path = vocabulary("byte_bpe_50k.json")
    encode = Encoder(path())
    for text in (" " * 300_000 + "x", "a" + "\n" * 50_000, " " * 19_000 + "x"):
        assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    got = pack(docs(spark, [(1, " " * 1_000_000 + "x", "en", "s")]), path).collect()
    assert sum(r["length"] for r in got) == got[0]["doc_tokens"]


def test_packing_is_shortest_pack_first(spark):
    """Piece by piece, longest first, each on the shortest pack with room: as many packs of each filling."""
    rng = random.Random(1)
    for size in (16, 40):
        histogram = Counter(rng.randint(1, size) for _ in range(200))
        packs: list[int] = []
        for length in sorted(histogram.elements(), reverse=True):
            fits = [k for k, total in enumerate(packs) if total + length <= size]
            if fits:
                packs[min(fits, key=lambda k: packs[k])] += length
            else:
                packs.append(length)
        found = patterns(histogram, size)
        assert sum(n for _, n in found) <= len(packs) + 1
        assert sum(n * sum(p) for p, n in found) == sum(packs)


def brute_base(text):
    """The fixed patterns by hand: one scan for each kind."""
    out, low, ok = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                ends = [i + len(word)]
                # As a matcher that goes back would: with or without the marks.
                ends = [e for x in ends for e in ([x + 1, x] if x < len(text) and text[x] in "\"'" else [x])]
                for e in ends:
                    while e < len(text) and text[e] == " ":
                        e += 1
                    if e < len(text) and text[e] in ":=":
                        e += 1
                        spaces = e
                        while spaces < len(text) and text[spaces] == " ":
                            spaces += 1
                        for s in ([spaces + 1, spaces] if spaces < len(text) and text[spaces] in "\"'" else [spaces]):
                            stop = s
                            while stop < len(text) and text[stop] in ok:
                                stop += 1
                            if stop > s:
                                return s, stop
        return None

    i = 0
    while i < len(text):
        m = assign(i)
        if m:
            if m[1] - m[0] >= 6:
                out.append(("assign", i, m[1]))
            i = m[1]
        else:
            i += 1
    for kind, members, head, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 20), ("hex", set("0123456789abcdef"), "", 24)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text.startswith(head, i) and j < len(text) and text[j] in members:
                while j < len(text) and text[j] in members:
                    j += 1
                if j - i >= least:
                    out.append((kind, i, j))
                i = j
            else:
                i += 1
    return out


def test_secrets_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "APIkey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKI", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef" * 3, "é", "x", ".", "-", "Zx9qW3rT7yU1iO5pA8sD", "\n", "example", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert sorted(base_spans(t)) == sorted(brute_base(t)), t
    got = {r["doc_id"]: r for r in secret_scan(docs(spark, [(k, t, None, None) for k, t in enumerate(texts[:200])])).collect()}
    for k, t in enumerate(texts[:200]):
        spans = brute_base(t)
        r = got[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex"))
        told = [x.rsplit(":", 2) for x in r["spans"].split(",")] if r["spans"] else []
        assert {(a, int(b), int(c)) for a, b, c in told} == {*spans, *entropy_spans(t)}


@pytest.mark.parametrize("text", ["qWeRtYzXcVbNmLpOkJiHuGyFtDrSeAwQ", "key=Zx9qW3rT7yU1iO5pA8sDexampleQ9", "auth-3F2A9B0C4D5E6F708192A3B4C5D6E7F8", "example/Zx9qW3rT7yU1iO5pA8sD"])
def test_secrets_beside_marks_and_placeholders(text):
    assert entropy_spans(text)


def test_prose_and_identifiers_are_no_secrets():
    for text in ("2024-01-15_report-final-version2", "usr/local/share/applications/firefox", "thisIsAVeryLongCamelCaseIdentifierName", "donaudampfschifffahrtsgesellschaft", "+49-30-1234567890123456789"):
        assert not entropy_spans(text)


LONG = "word " * 60_000
ODD = [(1, None, None, None), (1, None, None, None), (2, "", "en", "s"), (None, "a b", "en", None), (None, "c d", None, "s"), (3, LONG, "en", "s"), (3, LONG, "en", "s"), (4, "a b", "de", "s"), (5, "x" * 200_000, "en", "s")]


@pytest.mark.parametrize("name", ["substring", "suffix", "quality", "mix", "packing", "secrets", "near", "exact"])
def test_odd_rows(spark, name):
    path = vocabulary("byte_bpe_50k.json")
    run = {
        "substring": substring_dedup, "suffix": suffix_dedup, "quality": quality_rules, "mix": lambda d: mixed(d, fraction=1.0, epochs=1), "packing": lambda d: pack(d, path),
        "secrets": secret_scan, "near": near_dedup, "exact": exact_dedup,
    }[name]
    got = run(docs(spark, ODD)).collect()
    ids = Counter(r["doc_id"] for r in got)
    if name == "packing":
        assert set(ids) == {1, 2, 3, 4, 5, None} and sum(r["start"] == 0 for r in got) == len(ODD)
    elif name == "mix":
        assert sum(ids.values()) == len(ODD)
    else:
        assert ids == Counter(i for i, *_ in ODD)
    assert run(docs(spark, [])).collect() == []


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on rows with every kind of odd value, against plain Python."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema.add("row", "string").add("told", "string")
    rng = random.Random(11)
    vocabulary_ = [a + b for a in ("ma", "so", "te", "ki", "ru", "lo") for b in ("ra", "ne", "lo", "tis", "da", "ven")]
    some = lambda n: " ".join(rng.choice(vocabulary_) for _ in range(n))
    rows = []
    for k in range(30):
        text = some(80)
        rows.append((k, text, rng.choice(["en", "de", None]), f"src{k % 3}", 1, "r", "t"))
        if k % 3 == 0:
            rows.append((100 + k, text.replace(" ", "\n ", 3), "en", "src1", 1, "r", "t"))
        if k % 3 == 1:
            rows.append((200 + k, text.rsplit(" ", 1)[0] + " edited", "en", "src2", 1, "r", "t"))
    rows += [(0, rows[0][1], "de", "src0", 1, "z", "a"), (300, "too short", "en", "src0", 1, "r", "t"), (301, None, "en", "src0", 1, "r", "t"), (None, some(60), "en", None, 1, "r", "t"), (302, "a b c d e f g h " * 30, "en", "src1", 1, "r", "t")]
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    stage = lambda name, rows: [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, schema), "").collect()]

    good = stage("quality rules", rows)
    assert sorted(good, key=key) == sorted((r for r in rows if r[0] not in (300, 301, 302)), key=key)
    exact, first = stage("exact dedup", good), {}
    for r in sorted(good, key=key):
        first.setdefault(" ".join(r[1].split()), r[0])
    assert sorted((r[0], " ".join(r[1].split())) for r in exact if r[0] is not None) == sorted((i, t) for t, i in first.items() if i is not None) and len(exact) == len(first)
    assert {r[2] for r in exact if r[0] == 0} <= {r[2] for r in good if r[0] == 0} and sum(r[0] == 0 for r in exact) == 1
    near = stage("near dedup", exact)
    shingles = {r[0]: {tuple(r[1].split()[k : k + 5]) for k in range(len(r[1].split()) - 4)} for r in exact}
    label = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            if a != b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                label = {i: label[a] if v == label[b] else v for i, v in label.items()}
    least = {v: min((i for i in label if label[i] == v), key=lambda i: (i is None, i)) for v in label.values()}
    assert {r[0] for r in near} == set(least.values()) and set(near) <= set(exact)
    mix = stage("mixing", near)
    assert set(mix) <= set(near) and len(set(mix)) == len(mix)
    total, used = (sum(len(r[1].split()) for r in x) for x in (near, mix))
    assert used <= corpus_pipeline.FRACTION * total + 1e-6 and used > 0.5 * corpus_pipeline.FRACTION * total
    packed = stages["packing"](spark, spark.createDataFrame(mix, schema), "").collect()
    encode = Encoder(vocabulary("byte_bpe_50k.json")())
    ids = {r[0]: encode(r[1]) + b"\0\0\0\0" for r in mix}
    assert sum(r["length"] for r in packed) == sum(len(b) // 4 for b in ids.values())
    assert all(zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in packed)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], schema), "").count() == 0, name


def test_conversations_of_odd_rows(spark):
    rows = [(None, None, None, None, "x"), (1, 0, "user", LONG, "x"), (1, 1, None, None, "x"), (2, 0, "user", LONG, "x"), (2, 0, "user", LONG, "x")]
    got = {r["conv_id"]: r for r in chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hashes string")).collect()}
    assert set(got) == {1, None} and got[1]["n_snapshots"] == 1 and got[1]["n_turns"] == 2
