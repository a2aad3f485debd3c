"""URL filter, quality rules, mixing, packing, secret scan, chat formatting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from molquarry.llm.chat import chat_format
from molquarry.llm.mixing import mixed
from molquarry.llm.packing import pack, patterns, slots
from molquarry.llm.quality import quality_filter, quality_rules
from molquarry.llm.secret_scan import base_spans, entropy_spans, secret_scan, windows_over
from molquarry.llm.tokens import Encoder
from molquarry.llm.urls import syndicated_keys, url_filter

PAGES = "page_id long, url string, host string, key string, listed string, id string"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "a", "b", "c", "d") for k, u in enumerate(urls)], PAGES)


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://xexample.org/es/", "http://s.com/fr/a", "http://s.com/de/?u=1", "http://org/", "http://org", None, "", "no scheme", "http://h.net/p?utm_source=f", "http://h.net/p", "ftp://x/y\nz?q", "a://b://c/d", "http://h.net/q"]
    got = {r["page_id"]: r for r in url_filter(pages(spark, urls), syndicated_keys(pages(spark, urls))).collect()}
    told = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert told[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert told[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert told[2] == ("xexample.org", "/es/", "org/", "allow")
    assert told[3][2:] == ("com/fr/", "allow") and told[4][2:] == ("com/de/", "block")
    assert told[5] == ("org", "/", "org/", "allow") and told[6] == ("org", "", None, "allow")
    assert all(told[k] == ("", "", None, "allow") for k in (7, 8, 9))
    assert told[10][3] == told[11][3] == "block" and told[14][3] == "allow"
    assert told[12][:2] == ("x", "/y\nz") and told[13][:2] == ("b:", "//c/d")


@pytest.mark.parametrize("max_bits", [1 << 28, 2048])
def test_cascade_is_exact(spark, max_bits):
    rng = random.Random(4)
    urls = [f"http://h{rng.randrange(300)}.net/p{k % 700}" for k in range(3000)]
    df = pages(spark, urls + urls[:5])
    listed = {u.removeprefix("http://") for u in urls if rng.random() < 0.2}
    rows = url_filter(df, spark.createDataFrame([(x,) for x in listed] + [("nowhere",)], "key string"), max_bits=max_bits).collect()
    assert len(rows) == 3005
    for r in rows:
        assert r["listed"] == (r["host"] + r["path"] in listed)
    assert url_filter(df, spark.createDataFrame([], "key string")).where("listed").count() == 0
    assert url_filter(pages(spark, []), spark.createDataFrame([], "key string")).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, host string, ws string, failed string, h long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "a", "b", "c", 2) for i, t, lang, s in rows], DOCS)


def test_quality(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))
    rows = [(k, clean, "en", f"s{k % 3}") for k in range(30)]
    rows += [(100, None, "en", None), (101, "", "en", "s0"), (102, "too short", "en", "s0"), (103, "a b c d e f g h " * 20, "en", "s0"), (104, clean.replace(" ", "### "), "en", "s0"), (105, clean.upper(), "en", "s1"), (106, "\n".join(["a line of words"] * 9) + " " + clean, "en", "s1")]
    rows += [(200 + k, "bad", "en", "spam") for k in range(40)] + [(300, clean, "en", "spam"), (0, clean, "en", "s0")]
    got = [(r["doc_id"], r) for r in quality_rules(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    one = dict(got)
    assert all(r["kept"] for i, r in got if i < 30)
    assert all(not one[i]["kept"] for i in (100, 101, 102, 103, 104, 105, 106, 300))
    assert one[103]["base_failed"] and one[103]["n_repeat_words"] == 160 and not one[104]["base_failed"] and one[104]["n_symbols"] == 177
    assert not one[300]["host_ok"] and one[300]["host_rate"] > 0.5
    assert one[106]["n_dup_lines"] == 7
    kept = quality_filter(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got if r["kept"])
    assert quality_rules(docs(spark, [])).count() == 0 and quality_filter(docs(spark, [])).count() == 0


def filled(budget, weights, caps):
    """Budget shared by weight, no more than each can take."""
    given, open_ = [0.0] * len(caps), list(range(len(caps)))
    while open_ and budget > 1e-9:
        w = sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] <= budget * weights[k] / w + 1e-9]
        if not full:
            for k in open_:
                given[k] = budget * weights[k] / w
            break
        for k in full:
            given[k] = caps[k]
            budget -= caps[k]
            open_.remove(k)
    return given


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("x" * 3 for _ in range(rng.randint(1, 9))), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src22", None])) for k in range(400)]
    weights, epochs = {"lang=en": 3.0, "source=src1": 2.0}, 3
    total = sum(len(t.split()) for _, t, _, _ in rows)
    for budget in (total // 3, total * 2, total * 9):
        got = mixed(docs(spark, rows), budget=budget, epochs=epochs, weights=weights, seed=7).collect()
        leaf = Counter()
        for r in mixed(docs(spark, rows), budget=10**9, epochs=1).collect():
            leaf[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
        assert sum(leaf.values()) == total

        def spread(level, prefix, amount):
            names = sorted({k[level] for k in leaf if k[:level] == prefix})
            caps = [epochs * sum(v for k, v in leaf.items() if k[: level + 1] == (*prefix, n)) for n in names]
            given = filled(amount, [weights.get(f"{('domain', 'lang', 'source')[level]}={n}", 1.0) for n in names], caps)
            if level == 2:
                return {(*prefix, n): g for n, g in zip(names, given, strict=True)}
            return {k: v for n, g in zip(names, given, strict=True) for k, v in spread(level + 1, (*prefix, n), g).items()}

        plan, used = spread(0, (), budget), Counter()
        for r in got:
            used[r["domain"], r["lang"], r["source"]] += r["n_tokens"] * r["n_copies"]
        for k, g in plan.items():
            assert g - 9 - 1 <= used[k] <= g + 1, k
    assert mixed(docs(spark, []), budget=5).count() == 0 and mixed(docs(spark, rows), budget=0).count() == 0
    again = [sorted(map(tuple, mixed(docs(spark, rows).repartition(n), budget=total // 2).collect())) for n in (1, 5)]
    assert again[0] == again[1]


def test_patterns_place_every_length():
    rng = random.Random(5)
    histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    found = patterns(histogram, 64)
    placed = Counter()
    for p, n in found:
        assert sum(p) <= 64 and n > 0
        for x in p:
            placed[x] += n
    assert placed == histogram
    assert patterns({}, 64) == [] and slots([]).shape == (0, 4)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, "tōken text " * (k * 7), "en", "s") for k in range(40)] + [(100, None, "en", "s"), (101, "", "en", "s"), (102, "<|endoftext|> a", "en", "s"), (5, "again", "en", "s")] + [(200 + k, "same", "en", "s") for k in range(30)]
    got = pack(docs(spark, rows), path).collect()
    t = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    for i, text, _, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces[i].append((len(ids), ids.tobytes()))
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        assert any(n == r["doc_tokens"] and zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for n, b in pieces[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: sum(n for n, _ in p) for i, p in pieces.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(seen.values()) / 1024) + 2
    assert pack(docs(spark, []), path).count() == 0


def test_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), Encoder(path)
    assert e.fast is not None
    rng, parts = random.Random(6), [" ", "  ", "\n", "\t", "a", "B", "é", "12", "!", "'s", "<|endoftext|>", "　", "\xa0", "\x1c", "\x85", "the", "\r\n", "日本"]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_windows_are_those_of_the_definition():
    rng = random.Random(8)
    for _ in range(200):
        s, width, limit = "".join(rng.choice("abcdef0123") for _ in range(rng.randint(0, 60))), rng.randint(1, 20), rng.choice([1.0, 2.0, 2.7])
        n = min(width, len(s))
        over = {p for k in range(len(s) - n + 1) if n and entropy(s[k : k + n]) > limit + 1e-9 for p in range(k, k + n)}
        near = any(n and abs(entropy(s[k : k + n]) - limit) < 1e-9 for k in range(len(s) - n + 1))
        assert near or {p for a, b in windows_over(s, width, limit) for p in range(a, b)} == over


def test_secrets(spark):
    key = "Zx9qW3rT7yU1iO5pA8sD"
    assert base_spans(f"the PassWord = '{key}' x") == [("assign", 4, 4 + len(f"PassWord = '{key}"))]
    assert base_spans("token=abc password:12345") == [] and base_spans("secret: abcdef") == [("assign", 0, 14)]
    assert base_spans("AKIA" + "A1B2C3D4E5F6G7H8") == [("access", 0, 20)] and base_spans("AKIAshort") == []
    assert base_spans("x" + "0123456789abcdef" * 2 + "g") == [("hex", 1, 33)]
    assert base_spans("ſecret=abcdefgh") == [] and base_spans("api_key=abcdef apikey=abcdef")[1][1] == 15
    assert entropy_spans(f"a {key} b") and not entropy_spans("internationalization-and-localization " * 3 + "12345678901234567890123 aaaaaaaaaaaaaaaaaaaaaaaaa1")
    assert not entropy_spans("your_api_key_0123456789abcd 123e4567-e89b-42d3-a456-426614174000")
    rows = [(1, f"é {key} token=abcdefgh", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (None, "AKIA" + "B" * 20, "en", "s"), (1, "twice", "en", "s"), (2**60 + 1, "x" * 200_000, "en", "s")]
    got = sorted(secret_scan(docs(spark, rows)).collect(), key=lambda r: (str(r["doc_id"]), r["spans"]))
    assert len(got) == 6 and {r["doc_id"] for r in got} == {1, 2, 3, None, 2**60 + 1}
    assert next(r for r in got if r["doc_id"] is None)["spans"] == "access:0:24"
    first = next(r for r in got if r["n_assign"])
    assert first["spans"].split(",")[0].startswith("entropy_alnum:2:") and first["spans"].split(",")[1] == "assign:23:37"
    assert secret_scan(docs(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, hash string, id long, turns string"


def test_chat(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    convs = {1: a[:2], 2: a, 3: a[:3], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", "hi")], 7: [("system", ""), *a], 8: [("user", "hiassistant")]}
    rows = [(c, k, r, t, "x", 9, "y") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(2, 0, "user", "hi", "x", 9, "y"), (None, 5, "user", "hi", "x", 9, "y"), (None, 0, "user", "lost", "x", 9, "y"), (9, None, None, None, "x", 9, "y")]
    got = {r["conv_id"]: r for r in chat_format(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {2, 5, 7, 8, 9, None} and got[None]["rendered"] == "<|im_start|>user\nlost<|im_end|>\n"
    assert got[2]["n_copies"] == 2 and got[2]["n_snapshots"] == 3 and got[5]["n_snapshots"] == 1
    assert got[2]["rendered"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n") and got[2]["n_turns"] == 4
    assert chat_format(spark.createDataFrame([], TURNS)).count() == 0
