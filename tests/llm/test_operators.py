"""Each operator against brute force, and on hard input: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chaining, decontamination, jaccard, packing, pii, preference, quality, sharding, suffixes, urls
from tidemark.llm.components import connected_components
from tidemark.llm.workspace import Workspace

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, n int, maybe boolean, queue string, kept string, shard int, x1 double, u string, size string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows):
    """Rows (id, text[, lang, source]) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s0")), 1, 5, 5, True, "q", "k", 3, 0.5, "u", "z") for r in rows], SCHEMA)


def corpus(seed=0, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(70)
    rows = []
    for i in range(n):
        t = say(r.randint(0, 160))
        if i % 4 == 0:
            t = f"{say(20)} {passage}\n{say(r.randint(0, 20))}"
        if i % 5 == 1 and rows:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        rows.append((i, t))
    hard = [(100, None), (101, ""), (102, "   \n\t"), (103, "one"), (104, "Two words"), (105, "of " * 400), (106, "x" * 3000), (107, rows[3][1]), (107, rows[3][1]), (108, "of " * 500), (109, say(3000)), (110, "ONE")]
    return rows + hard


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture
def work(spark):
    w = Workspace(spark, "test")
    yield w
    w.drop()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- shared parts


def test_components_match_union_find(spark, work):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(70, None), (71, 71)] + [(80, 81 + i) for i in range(30)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u int, v int"), work).collect()}
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    assert got == {n: find(n) for u, v in edges if v is not None and u != v for n in (u, v)}
    assert connected_components(spark.createDataFrame([], "u int, v int"), work, "none").count() == 0


# ---- 1


def test_preference_pairs(spark):
    t = [
        (1, True, 10, 0, "user", "hi"), (1, True, 10, 1, "assistant", "a"), (1, False, 11, 0, "user", "hi"), (1, False, 11, 1, "assistant", "bb"), (1, False, 11, 2, "user", "more"),
        (2, True, 20, 0, "user", "only"), (3, True, 30, 0, None, None), (3, False, 31, 0, None, None), (None, True, 40, 0, "user", "x"),
        (4, True, 50, 0, "user", "p"), (4, False, 51, 0, "user", "p"), (4, False, 51, 1, "assistant", "q"),
    ]
    got = {r.pair_id: r for r in preference.preference_pairs(spark.createDataFrame(t, "pair_id bigint, chosen boolean, conv_id bigint, turn int, role string, text string").withColumn("c", F.lit(1)).withColumn("n", F.lit(2))).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].n_common == 1
    assert got[1].chosen_completion == "<|assistant|>\na<|end|>\n" and got[1].rejected_completion.endswith("<|user|>\nmore<|end|>\n")
    a, b = map(int, got[1].rejected_mask.split(":"))
    assert got[1].rejected_completion[a:b] == "bb<|end|>\n"
    assert got[2].n_common == 0 and got[2].rejected_id is None and got[2].rejected_completion == ""
    assert got[3].n_common == 1 and got[3].prompt == "<|unknown|>\n<|end|>\n" and got[3].chosen_completion == ""
    assert got[4].chosen_completion == "" and got[4].rejected_mask
    assert preference.preference_pairs(spark.createDataFrame([], "pair_id bigint, chosen boolean, conv_id bigint, turn int, role string, text string")).count() == 0


# ---- 2


def brute_base(t):
    w = SPACED.findall(t or "")
    g = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base_counts(spark, docs, rows, work):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.reject_outliers(docs, work).collect())
    assert got == collections.Counter((r[0], *brute_base(r[1])) for r in rows)
    more = [(1, "a\na\n#b|c\n\x00 d\x0be", None, None)] * 2
    got = quality.reject_outliers(frame(spark, more), Workspace(spark, "t")).collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got] == [brute_base(more[0][1])] * 2
    assert quality.reject_outliers(empty(spark), Workspace(spark, "t")).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark, work):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(120)), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(120)), "en", "s0") for i in range(30)] + [(2000 + i, " ".join(word().upper() for _ in range(120)), "en", "s1") for i in range(30)]
    got = {x.doc_id: x.kept for x in quality.reject_outliers(frame(spark, clean + junk), work).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_quality_rejects_duplicate_lines_and_repeated_words(spark, work):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    say = lambda n: [word() for _ in range(n)]
    clean = [(i, " ".join(say(120)), "en", "s0") for i in range(300)]
    lines = [(1000 + i, "\n".join([*(["ab"] * 19), " ".join(say(160))]), "en", "s0") for i in range(10)]
    phrases = [(2000 + i, " ".join([*say(66), *(say(6) * 9)]), "en", "s0") for i in range(10)]
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.reject_outliers(frame(spark, clean + lines + phrases), work).collect()}
    assert not any(failed for failed, _ in got.values())
    assert all(got[i][1] for i, *_ in clean) and not any(got[i][1] for i, *_ in lines + phrases)


# ---- 3


def test_decontamination_matches_brute_force(spark, docs, rows, work):
    words = {i: ALNUM.findall(lower(t)) for i, t in rows}
    items = [(1, " ".join(words[0][25:60])), (2, " ".join(words[7][3:14])), (3, "Two, WORDS"), (4, ""), (5, None), (None, "two words"), (6, "one"), (7, "no such words at all in any of these texts ok"), (8, " ".join(words[5][2:9])), (1, " ".join(words[0][25:60]))]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), work).collect())
    want = []
    for i, t in rows:
        w, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for item, text in items:
            v = ALNUM.findall(lower(text))
            m = min(10, len(v))
            if item is None or not m:
                continue
            windows = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)}
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in windows:
                    hit |= set(range(p, p + m))
                    ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, none, Workspace(spark, "t")).collect())
    assert decontamination.decontaminate(empty(spark), none, Workspace(spark, "t")).count() == 0


# ---- 4


def check_pieces(pieces, ids, length):
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for key, docs_ in ids.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by[key])
        starts = [g for g in got if g[0] == 0]
        assert len(starts) == len(docs_)
        if len(docs_) == 1:
            at = 0
            for start, n, crc, total in got:
                part = docs_[0][start : start + n]
                assert start == at and n == len(part) > 0 and total == len(docs_[0]) and crc == zlib.crc32(struct.pack(f"<{n}I", *part))
                at += n
            assert at == len(docs_[0])
        assert sum(g[1] for g in got) == sum(map(len, docs_))
    full = 0
    for s in seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        full += at == length
    assert full >= len(seq) - 1


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_places_every_id_once(spark, work, weights):
    texts = [(i, t, "en", [None, "s0", "s1"][i % 3]) for i, t in corpus(3)]
    got = packing.pack(frame(spark, texts).repartition(4), work, length=256, window=256, packet=32, weights=weights).collect()
    ids = collections.defaultdict(list)
    for i, t, *_ in texts:
        ids[i].append([*packing.encode(t or ""), 0])
    check_pieces(got, ids, 256)
    assert packing.pack(empty(spark), Workspace(spark, "t")).count() == 0


def test_packing_mixture_follows_the_shares(spark, work):
    texts = [(i, "ab cd ef gh " * 40, "en", "a" if i % 4 else "b") for i in range(80)]
    got = packing.pack(frame(spark, texts), work, length=256, window=256, packet=32).collect()
    total = collections.Counter()
    per = collections.defaultdict(collections.Counter)
    for p in got:
        total[p.queue] += p.length
        per[p.sequence_id][p.queue] += p.length
    run = collections.Counter()
    for s in sorted(per)[:-1]:
        run += per[s]
        want = sum(run.values()) * total["a"] / sum(total.values())
        assert abs(run["a"] - want) <= 64


def test_fast_reader_gives_the_tokenizer_files_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    hard = ["<|endoftext|> a", " x y　z", "a\x85b\x1cc", "١٢٣ abc ⅷ", "é ñ Ñandú", "😀 ok", "\r\n\n  x", "don't I'LL", "ǅ ʰ ª²", "漢字かな 한글"]
    for _ in range(300):
        hard.append("".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x370, 0x500), r.randrange(0x2000, 0x2100), r.randrange(0x4E00, 0x9FA6), 32, 10, 39])) for _ in range(r.randint(0, 30))))
    for t in hard:
        assert packing.encode(t) == exact.encode(t, add_special_tokens=False).ids, ascii(t)


# ---- 5

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..-+% 0123456789()é\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_long_runs_cost_one_pass():
    assert pii.base_spans("1" * 400_000 + " " + "1." * 100_000 + "@" * 100_000) == pii.base_spans("1" * 400_000 + " " + "1." * 100_000)
    assert pii.base_spans("0" * 5000 + "7.1.2.3") == [(0, 1, 5007)]
    assert [s[1] for s in pii.base_spans("1.2.3.4.5.6.7.8")] == [1, 1]


def test_personal_data_is_whole_and_consistent(spark):
    card = "4845168114407329"
    assert pii.luhn(card)
    filler = [(i, f"call {card} or mail a{i}@b.example.com from 10.1.2.{i} at +1 (555) 123-45{i % 90 + 10} code {i} and pay {card} now") for i in range(120)]
    texts = [*filler, (500, f"first {card} here. Then 7536784127813050 {card} again"), (501, None), (502, ""), (503, "clean words only"), (504, "é" * 50_000 + " x@y.zz"), (503, "clean words only")]
    got = pii.find_personal_data(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = next(t for i, t in texts if i == r.doc_id) or ""
        base = brute_spans(t)
        assert r.base_sha256 == hashlib.sha256(pii.render(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.render(base).split(","))) <= set(filter(None, r.spans.split(",")))
        if r.doc_id == 503:
            assert r.spans == ""
    clean = {r.doc_id: r.text for r in pii.find_personal_data(frame(spark, texts), redact=True).collect()}
    assert clean[501] is None and clean[503] == "clean words only" and "<EMAIL>" in clean[504] and clean[500].startswith("first <CARD> here")
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_skip_edges_carry_a_label_to_a_near_copy():
    card, rows = "4845168114407329", []
    for i in range(200):
        t = f"call {card} or mail a{i}@b.example.com from 10.1.2.{i} id {4000000000000000 + 7919 * i} code {i} and pay {card} now" + f" or {card}" * (i % 2)
        f = pii.Field(t)
        rows.append((f.features, f.labels(pii.base_spans(t)), f.chain, f.skip))
    model = pii.train(rows)
    near = card[:-1] + "8"  # fails the check digit
    alone, both = pii.Field(f"we saw {near} there"), pii.Field(f"first {card} came and much later we saw {near} there")
    assert both.skip == [(0, 1)]
    assert pii.marginals(both, model)[1, 3] > 2 * pii.marginals(alone, model)[0, 3]
    assert pii.added_spans("clean words only", [], model, 0.9) == []


# ---- 6


def brute_components(rows, width, percent):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = SPACED.findall(lower(t))
        sets[i] |= {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 0), (3, 60, 7)])
def test_jaccard_components_match_brute_force(spark, work, width, percent, seed):
    r = random.Random(seed)
    rows = corpus(seed, 30)
    base = [f"w{i}" for i in range(90)]
    for i in range(40):  # one large group of near copies, linked in chains
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(400)}"
        rows.append((300 + i, " ".join(w)))
    got = jaccard.jaccard_components(frame(spark, rows).repartition(3), work, width, percent).collect()
    want = brute_components(rows, width, percent)
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_jaccard_empty(spark, work):
    assert jaccard.jaccard_components(empty(spark), work).count() == 0


# ---- 7


def test_sharding_is_even_gapless_and_whole(spark, docs, rows, work):
    got = sharding.shard_documents(docs, shards=4, tolerance=0.01, part_bytes=2000, work=work).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, size(t)) for i, t in rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    for s in per.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total = sum(r["size"] for r in got)
    biggest = max(r["size"] for r in got)
    for s in per.values():
        assert abs(sum(r["size"] for r in s) - total / 4) <= 2 * biggest
    assert sharding.shard_documents(empty(spark), work=Workspace(spark, "t")).count() == 0


def test_sharding_with_many_parts_and_few_probes(spark, work, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_PROBES", 16)
    monkeypatch.setattr(sharding, "MOST_PARTS", 3)
    r = random.Random(5)
    rows = [(i, "same text" * 9 if i % 3 == 0 else "".join(r.choice("abcdef") for _ in range(r.randint(20, 120)))) for i in range(600)]
    got = sharding.shard_documents(frame(spark, rows).repartition(3), shards=4, part_bytes=512, work=work).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(x.doc_id for x in got) == list(range(600))
    total = sum(x.size for x in got)
    for k in range(4):
        mine = [x for x in got if x.shard == k]
        assert sorted(x.slot for x in mine) == list(range(len(mine)))
        assert abs(sum(x.size for x in mine) - total / 4) <= 0.05 * total


def test_sharding_splits_a_heavy_group_of_copies(spark, work):
    texts = [(i, "the same text" if i % 3 else f"text {i}") for i in range(600)] + [(None, "the same text")]
    got = sharding.shard_documents(frame(spark, texts), shards=8, work=work).collect()
    per = collections.Counter()
    for r in got:
        per[r.shard] += r["size"]
    assert len(got) == 601 and max(per.values()) <= 1.1 * min(per.values())


# ---- 8


@pytest.mark.parametrize("seed", [0, 4])
def test_repeated_strings_match_brute_force(spark, work, seed):
    length, window = 60, 16
    rows = corpus(seed)
    r = random.Random(seed)
    junk = "".join(r.choice("ab") for _ in range(300))
    rows += [(400, junk + "xyz" * 60), (401, "q" + junk[40:200] + "xyz" * 40), (402, "pre" + junk[150:] + junk[:90])]
    got = suffixes.remove_repeats(frame(spark, rows).repartition(3), work, length, window).collect()
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    want = collections.Counter()
    for (i, _), b in zip(rows, texts, strict=True):
        cover = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = [True] * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        want[(i, len(b), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_packets_without_repeats_or_without_single_phrases():
    import numpy as np

    for name in (np.arange(1, 5), np.full(6, 9)):
        rows = suffixes._packed(np.arange(len(name)), np.zeros((len(name), 3), np.int32), name.astype(np.uint64), 4).to_pylist()
        assert sum(len(r["name"]) // 8 for r in rows if r["kind"] < 2) == len(name)


@pytest.mark.parametrize("seed, words", [(0, 12), (4, 51)])
def test_shared_words_match_brute_force(spark, work, seed, words):
    """Passages that other documents have, also those too short to be removed; repeats inside one document are none."""
    rows = corpus(seed)
    r = random.Random(seed + 9)
    say = lambda k: ["".join(r.choice("abcdefghij") for _ in range(3)) for _ in range(k)]
    short, own = say(51), say(120)
    rows += [(300, " ".join(say(70) + short + say(9))), (301, "\n".join(say(5) + short)), (302, " ".join(short[1:])), (303, " ".join(own + say(3) + own)), (304, " ".join(short).upper())]
    rows += [(310 + i, " ".join(say(i) + short[:20] + say(40))) for i in range(30)]  # a common phrase in contexts of its own
    got = suffixes.remove_repeats(frame(spark, rows).repartition(3), work, words=words).collect()
    split = [SPACED.findall(t or "") for _, t in rows]
    of = collections.defaultdict(set)
    for row, w in zip(rows, split, strict=True):
        for p in range(len(w) - words + 1):
            of[tuple(w[p : p + words])].add(row)
    want = collections.Counter()
    for row, w in zip(rows, split, strict=True):
        want[row[0], len({q for p in range(len(w) - words + 1) if len(of[tuple(w[p : p + words])]) > 1 for q in range(p, p + words)})] += 1
    assert collections.Counter((x.doc_id, x.n_shared_words) for x in got) == want
    if words == 51:
        assert {x.doc_id: (x.n_removed, x.n_shared_words) for x in got if 300 <= x.doc_id < 305} == {300: (0, 51), 301: (0, 51), 302: (0, 0), 303: (958, 0), 304: (0, 0)}


def test_repeats_empty(spark, work):
    assert suffixes.remove_repeats(empty(spark), work).count() == 0


# ---- 9


def test_url_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.com/en/x", None), (2, "http://www.example.com/en/x", ""), (3, "http://b.org/p", canonical.format("http://a.example.com/en/x")), (4, "http://c.org/q?z=1#f", '<META HTTP-EQUIV="refresh" content="0; URL=http://b.org/p">'),
        (5, "http://d.org/", canonical.format("http://WWW.example.com/en/x")), (6, "nonsense", canonical.format("http://a.example.com/en/x")), (7, None, None), (8, "http://x.net/es/a", "<link rel=canonical href=/fr/b>"), (9, "http://x.com", None),
        (10, "http://e.org/", canonical.format("http://a.example.com/en/x") + canonical.format("http://www.example.com/en/x")), (3, "http://b.org/p", None), (11, "http://f.org/r", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("h")).withColumn("u", F.lit(1)).withColumn("node", F.lit("n"))
    extra = spark.createDataFrame([("http://f.org/r", "http://x.net/es/a")], "source string, target string")
    got = collections.defaultdict(set)
    for r in urls.filter_urls(df, urls.rule_table(spark), extra).collect():
        got[r.page_id].add((r.rule, r.verdict, r.host, r.path))
    one = {k: next(iter(v)) for k, v in got.items() if len(v) == 1}
    assert len(one) == 11
    assert one[1][:2] == ("example.com/en/", "block") and one[2][:2] == ("www.example.com/en/", "allow")
    # pages 1, 2, 3, 4, 5 and 10 are one class with an allowed member: allow wins there, explicit blocks stay
    assert one[3][:2] == (None, "allow") and one[4][:2] == (None, "allow") and one[10][1] == "allow"
    assert one[11][:2] == (None, "block")  # its only class mates are blocked
    assert one[6] == (None, "allow", "", "") and one[7] == (None, "allow", "", "")
    assert one[8][:2] == ("net/es/", "block") and one[9] == (None, "allow", "x.com", "")
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string"), urls.rule_table(spark)).count() == 0


def test_url_targets_that_are_no_pages_vote(spark):
    canonical = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.org/p", canonical.format("http://x.net/es/1")), (2, "http://b.net/fr/q", canonical.format("http://b.com/")), (3, "http://c.org/r", canonical.format("http://b.net/fr/q")),
        (4, "http://d.org/in/a?x=1&y=2", canonical.format("http://x.net/es/2")), (5, "http://d.org/in/deep/b", canonical.format("../a?x=1&amp;y=2")), (6, "http://d.org/in/c", canonical.format("./deep/b")), (7, "http://d.org/in/a", canonical.format("?x=1&#38;y=2")), (8, "http://d.org", canonical.format("in/a")),
        (9, "http://e.org/z", canonical.format("#top")), (10, "http://e.org/y", canonical.format("mailto:x@x.net/es/")),
    ]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), urls.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "allow"}


# ---- 10


def test_passages_are_found_through_edits(spark, work):
    r = random.Random(9)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    passage = say(80)
    edited = list(passage)
    edited[30] = "changed"
    del edited[55]
    rows = [(i, " ".join(say(100))) for i in range(20)]
    rows += [(50, " ".join(say(30) + passage + say(10))), (51, " ".join(say(5) + edited + say(40))), (52, " ".join(passage)), (53, "of " * 90), (54, "of " * 120), (55, None), (56, ""), (None, " ".join(passage)), (57, " ".join(say(20_000))), (52, " ".join(passage))]
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()
    pairs = {(x.doc_id, x.partner_id) for x in got}
    assert {50, 51, 52, 53, 54} == {i for p in pairs for i in p}
    best = next(x for x in got if (x.doc_id, x.partner_id) == (51, 50))
    assert (best.start, best.end, best.partner_start, best.partner_end) == (5, 84, 30, 110) and best.matches == 78
    assert chaining.fuzzy_passages(empty(spark), Workspace(spark, "t")).count() == 0


def test_chains_match_quadratic_dynamic_programming():
    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 25)
        a, b = np.array([r.randrange(40) for _ in range(n)]), np.array([r.randrange(40) for _ in range(n)])
        k, gap = 6, 0.05
        order = sorted(range(n), key=lambda i: (a[i], b[i]))
        f = {}
        for i in order:
            f[i] = k + max([0.0, *(f[j] - gap * (a[i] + b[i] - a[j] - b[j]) for j in f if a[j] < a[i] and b[j] < b[i])])
        got = chaining.chains(a, b, k, gap, 1)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in zip(c, c[1:], strict=False))
        first = got[0]
        score = 0.0
        for x, y in zip([None, *first], first, strict=False):
            score = k + (max(0.0, score - gap * (a[y] + b[y] - a[x] - b[x])) if x is not None else 0.0)
        assert abs(score - max(f.values())) < 1e-9


@pytest.mark.parametrize("every", [5, 6, 8, 9, 10])
def test_passages_with_evenly_spread_edits_are_found(spark, work, every):
    r = random.Random(every)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i in range(0, 60, 2):
        passage, lead = say(60), r.randrange(every)
        edited = [f"x{r.randrange(10**6)}" if j % every == lead else w for j, w in enumerate(passage)]
        # brute force: some 50 words of the passage agree in 80 %
        assert max(sum(a == b for a, b in zip(passage[s : s + 50], edited[s : s + 50], strict=True)) for s in range(11)) >= 40
        rows += [(i, " ".join(say(40) + passage + say(30))), (i + 1, " ".join(say(20) + edited + say(50)))]
        want.add((i + 1, i))
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()
    assert {(x.doc_id, x.partner_id) for x in got} == want
    assert all(x.end - x.start >= 50 and x.matches >= 0.8 * (x.end - x.start) for x in got)


def test_documents_meet_past_the_hubs_of_their_passage(spark, work):
    r = random.Random(3)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = say(60)
    half = {1: passage[:30], 9: passage[:30], 2: passage[30:], 8: passage[30:]}
    rows = [(i, " ".join(say(20) + half.get(i, passage) + say(20))) for i in (1, 2, 4, 5, 8, 9)]
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()
    assert {(x.doc_id, x.partner_id) for x in got} == {(5, 4)}


def test_passages_meet_where_every_seed_of_them_is_common(spark, work):
    r = random.Random(4)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = say(120)
    rows = [(i, " ".join(say(30) + passage[(i * 7) % 100 : (i * 7) % 100 + 20] + say(30))) for i in [*range(100), *range(900, 1000)]]
    rows += [(500, " ".join(say(40) + passage + say(20))), (501, " ".join(say(10) + passage + say(60)))]
    # two phrases that are common each, together in two texts only, with other words between them
    one, two = say(24), say(24)
    rows += [(i, " ".join(say(40) + (one if i % 2 else two) + say(40))) for i in range(2000, 2080)]
    rows += [(600, " ".join(say(9) + one + say(4) + two + say(30))), (601, " ".join(say(50) + one + say(4) + two + say(3)))]
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()
    assert {(x.doc_id, x.partner_id) for x in got} == {(501, 500), (601, 600)}
    assert next((x.start, x.end, x.partner_start, x.partner_end) for x in got if x.doc_id == 501) == (10, 130, 40, 160)


def test_copies_are_reported_against_their_representative(spark, work):
    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    text, part = say(90), say(70)
    rows = [(i, " ".join(text)) for i in range(300)] + [(7, " ".join(say(20) + text[:60])), (400, "short copy"), (401, "short copy"), (402, " ".join(part + say(9))), (402, " ".join(say(5) + part)), (402, " ".join(say(5)))]
    rows += [rows[-3]] * 3
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()
    found = collections.Counter((x.doc_id, x.partner_id, x.start, x.end) for x in got)
    assert all(found[(i, 0, 0, 90)] == 1 for i in range(1, 300))
    assert found[(7, 0, 20, 80)] == 1
    assert [x for x in got if x.doc_id == 402 and x.partner_id == 402] and len(got) == 301


def test_a_small_corpus_finds_what_all_pairs_find(spark, work):
    import numpy as np

    rows = [(i, t) for i, t in corpus(6, 60) if t]
    got = chaining.fuzzy_passages(frame(spark, rows).repartition(3), work, min_words=30).collect()
    texts = {i: ALNUM.findall(lower(t)) for i, t in rows}
    names = {w: n for n, w in enumerate(sorted({w for t in texts.values() for w in t}))}
    want, classes = set(), {}
    for i in sorted(texts):
        classes.setdefault(dict(rows)[i], i)
    for i in classes.values():
        for j in classes.values():
            if j < i:
                x, y = (np.array([names[w] for w in texts[d]], np.uint16) for d in (i, j))
                a, b = chaining.matches(x, y, 4)
                if any(chaining.align(x, y, a[c], b[c], 4, 30, 0.8) for c in (chaining.chains(a, b, 4, chaining.GAP, 1) if len(a) else [])):
                    want.add((i, j))
    rep = {(i, classes[dict(rows)[i]]) for i in texts if classes[dict(rows)[i]] != i and len(texts[i]) >= 30}
    assert {(x.doc_id, x.partner_id) for x in got} == want | rep


# ---- 5: the field against planted mistakes


def test_cores_one_character_apart_match_brute_force():
    r = random.Random(8)
    for _ in range(60):
        cores = list({"".join(r.choice("ab1") for _ in range(r.choice([6, 7, 300]))) for _ in range(12)})
        for c in cores[:6]:
            j = r.randrange(len(c))
            cores.append(c[:j] + "z" + c[j + 1 :])
        cores = list(dict.fromkeys(cores))
        apart = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        want = {(i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if apart(cores[i], cores[j])}
        got = set(pii.one_apart(cores))
        assert got <= want
        reach = lambda edges: {frozenset(g) for g in groups(edges, len(cores))}
        assert reach(got) == reach(want)


def groups(edges, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for i in range(n):
        out[find(i)].add(i)
    return out.values()


def test_mistyped_repeats_of_personal_data_are_added(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))

    def card():
        while True:
            d = "".join(r.choice("0123456789") for _ in range(16))
            if pii.luhn(d):
                return d

    number = lambda n: "".join(r.choice("123456789") for _ in range(n))
    other = [n for n in (number(16) for _ in range(200)) if not pii.luhn(n)]
    once = [card() for _ in range(150)]
    rows = [(i, f"{say(20)} {c} {say(10)} {other[i]} {say(5)} {c if i % 3 == 0 else number(4)}") for i, c in enumerate(once)]
    rows += [(200 + i, f"{say(20)} {number(9)} {say(10)} user{i}@mail.example.com") for i in range(60)]
    typos = {}
    for i in range(100):
        c, j = card(), r.randrange(16)
        bad = c[:j] + str((int(c[j]) + r.randint(1, 9)) % 10) + c[j + 1 :]
        typos[1000 + i] = f"{say(30)} {c} {say(40)} "
        rows.append((1000 + i, typos[1000 + i] + f"{bad} {say(9)}"))
    got = {x.doc_id: x.spans for x in pii.find_personal_data(frame(spark, rows)).collect()}
    caught = sum(f"card:{len(t)}:{len(t) + 16}" in got[i] for i, t in typos.items())
    assert caught >= 90  # every base span stays, 9 of 10 mistyped repeats are added
    assert sum(got[i].count("card") > 1 + (i % 3 == 0) for i in range(150)) <= 5  # other long numbers are left alone


# ---- 2: the estimate against all subsets


def test_concentration_reaches_the_exact_minimum_determinant(spark, work):
    import itertools

    import numpy as np

    floor = np.diag((np.array(quality.FLOOR) * quality.UNIT) ** 2)

    def logdet(x):
        return np.linalg.slogdet(np.cov(x.T, bias=True) * quality.CONSISTENCY + floor)[1]

    r = np.random.default_rng(3)
    rows, exact, plain = [], {}, {}
    for g in range(6):
        x = np.rint(r.normal(0, [400, 300, 250, 250, 200], (15, 5)))
        x[:3] += r.choice([-1, 1], (3, 5)) * (0 if g == 0 else 2500 if g < 4 else 900)
        h = -(-3 * len(x) // 4)
        exact[f"g{g}"] = min(logdet(x[list(c)]) for c in itertools.combinations(range(len(x)), h))
        plain[f"g{g}"] = logdet(x)
        rows += [(f"g{g}", *map(int, v)) for v in x]
    rows += [("constant", 5, 5, 5, 5, 5)] * 20 + [("few", 1, 2, 3, 4, 5)] * 3
    df = spark.createDataFrame(rows, "grp string, x1 bigint, x2 bigint, x3 bigint, x4 bigint, x5 bigint")
    got = {x.grp: x for x in quality.fit_mcd(df, work, least=10).collect()}
    assert set(got) == set(exact) | {"constant"}  # groups below the least size have no estimate
    assert got["constant"].c0 == 5.0
    for g, best in exact.items():
        assert best - 1e-9 <= got[g].logdet  # no subset is better
        assert got[g].logdet <= best + 0.25 * (plain[g] - best) + 0.3, g
    assert quality.fit_mcd(df.limit(0), work, least=10).count() == 0


def test_small_groups_are_pooled_and_a_small_pool_rejects_nothing_by_distance(spark, work):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80)), "en", f"s{i % 9}") for i in range(40)] + [(99, "#$%& " * 10 + " ".join(r.choice(words) for _ in range(80)), "en", "s1")]
    got = {x.doc_id: x for x in quality.reject_outliers(frame(spark, rows), work).collect()}
    assert all(x.kept and x.distance is None for x in got.values())
    more = rows + [(1000 + i, " ".join(r.choice(words) for _ in range(80)), "en", f"t{i}") for i in range(60)]
    got = {x.doc_id: x for x in quality.reject_outliers(frame(spark, more), work).collect()}
    assert all(x.distance is not None for x in got.values()) and not got[99].kept and sum(not x.kept for x in got.values()) <= 3


# ---- 4: more sources than queues


def test_named_sources_keep_their_queue_among_many(spark, work):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(40)), "en", "big" if i % 2 else f"s{i}") for i in range(60)]
    got = packing.pack(frame(spark, rows), work, length=64, window=64, packet=8, weights={"big": 0.5}, max_queues=8).collect()
    assert {x.doc_id for x in got if x.queue == "big"} == {i for i in range(60) if i % 2} and len({x.queue for x in got}) <= 8
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), work, weights={f"s{i}": 1.0 for i in range(8)}, max_queues=8)


@pytest.mark.parametrize(("values", "documents"), [(3, 600), (4, 600)])
def test_variants_of_a_form_letter_meet(spark, work, values, documents):
    """Every seed is in dozens of texts, and two variants differ every eight words: no link is lost for that."""
    import numpy as np

    r = random.Random(values)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    fixed, letters = say(64), []
    for f in range(documents // 2):
        one = [r.randrange(values) if i % 2 == 0 else -1 for i in range(64)]
        two = [(v + 1) % values if i % 8 == 6 else v for i, v in enumerate(one)]
        letters += [one, two]
    body = lambda slots: [fixed[i] if v < 0 else f"s{i}v{v}" for i, v in enumerate(slots)]
    rows = [(d, " ".join(say(30) + body(slots) + say(30))) for d, slots in enumerate(letters)]
    x = np.array(letters)
    want = set()
    for d in range(documents):
        agree = np.cumsum(np.concatenate((np.zeros((d, 1), int), (x[:d] == x[d]).astype(int)), 1), 1)
        want |= {(d, p) for p in np.flatnonzero((agree[:, 50:] - agree[:, :-50]).max(1) >= 40).tolist()} if d else set()
    found = {(g.doc_id, g.partner_id) for g in chaining.fuzzy_passages(frame(spark, rows).repartition(3), work).collect()}
    named = {d for p in want for d in p}
    assert named <= {d for p in found for d in p}
    assert {(2 * f + 1, 2 * f) for f in range(documents // 2)} <= want
    recall = len(want & found) / len(want)
    print(values, len(want), recall)
    assert recall >= 0.9


def test_the_url_sql_resolves_and_votes_like_the_code(spark, tmp_path):
    import duckdb

    link = lambda to: f"<link rel=canonical href='{to}'>"
    refresh = lambda to: f'<META http-equiv="refresh" content="0; URL={to}">'
    targets = ["/fr/a", "../fr/./b", "./c?x=1&amp;y=2", "d/../../e/..", "..", ".", "?q=1", "#top", "//cdn.NET/es/z", "http://other.org/es/k#f", "HTTP://a.net/fr/1", "mailto:x", "a//b/../c", "/../../x/.", "e.html", "javascript:void(0)"]
    rows = [(i, f"http://site{i % 3}.org/dir/sub/page{i}.html", "<p>" + (link if i % 2 else refresh)(t)) for i, t in enumerate(targets)]
    rows += [(100, "http://a.org/x", link("http://hidden.org/1")), (101, "http://b.org/x", link("http://hidden.org/1") + refresh("http://gone.net/es/1")), (102, "http://c.org/y", link("http://gone.net/es/2") + link("http://www.example.com/en/1")), (103, None, link("/a")), (104, "no scheme", None), (105, "http://d.org/dir/sub/page.html?a=1", refresh("?a=2")), (106, "http://d.org/dir/sub/page.html?a=2", link("http://x.net/fr/9"))]
    rows += [(200 + i, f"http://site{i % 3}.org/{p}", None) for i, p in enumerate(["fr/a", "dir/fr/b", "dir/sub/c?x=1&y=2", "dir/", "dir/sub/", "dir", "e/", "dir/sub/a/c", "x/"])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(repr, (tuple(r) for r in urls.filter_urls(df, urls.rule_table(spark)).select(*columns).collect())))
    assert got == sorted(map(repr, con.sql(urls.ORACLE).select(", ".join(columns)).fetchall()))
    assert sum("'block'" in g for g in got) > 3


def test_every_document_of_a_shared_passage_has_its_own_row(spark, tmp_path):
    """A passage in more texts than link all their pairs: whichever are the hubs, no document is named as a partner only."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(40)) + f" {passage} " + f"z{i}") for i in range(20)] + [(20, " ".join(f"c{j}" for j in range(70))), (21, " ".join(f"c{j}" for j in range(70)))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in chaining.op10_collinear_chaining(spark, str(tmp_path)).collect()]
    assert {r[0] for r in got} == set(range(22))
    assert all((r[1], r[0], r[4], r[5], r[2], r[3], r[6], r[7]) in got for r in got) and len(set(got)) == len(got)


def test_exact_links_lose_no_pair_of_a_hot_seed(spark, work, monkeypatch):
    """Variants of a form letter in hundreds of texts: hubs and longer seeds find most pairs, the exact mode all of them, over several blocks."""
    import numpy as np

    r = random.Random(3)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    fixed, documents = say(64), 240
    slots = np.array([[r.randrange(3) if i % 2 == 0 else -1 for i in range(64)] for _ in range(documents)])
    slots[1::2] = np.where(np.arange(64) % 8 == 6, (slots[::2] + 1) % 3, slots[::2])
    rows = [(d, " ".join(say(30) + [fixed[i] if v < 0 else f"s{i}v{v}" for i, v in enumerate(s)] + say(30))) for d, s in enumerate(slots.tolist())]
    rows += [(1000 + d, " ".join(say(20) + fixed[:12] + say(20))) for d in range(60)]
    want = set()
    for d in range(1, documents):
        agree = np.cumsum(np.concatenate((np.zeros((d, 1), int), (slots[:d] == slots[d]).astype(int)), 1), 1)
        want |= {(d, p) for p in np.flatnonzero((agree[:, 50:] - agree[:, :-50]).max(1) >= 40).tolist()}
    monkeypatch.setattr(chaining, "BLOCK", 32)
    found = {(g.doc_id, g.partner_id) for g in chaining.fuzzy_passages(frame(spark, rows).repartition(3), work, exact=True).collect()}
    assert len(want) > 200 and want <= found


def test_exact_links_count_every_shared_seed(spark, work, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK", 4)
    postings = [(s, d) for s, n in ((1, 30), (2, 17), (3, 16)) for d in range(n)]
    got = collections.Counter((r.row, r.partner) for r in chaining._met(work.save(spark.createDataFrame(postings, "seed bigint, row bigint"), "p"), work).collect())
    assert got == {(a, b): 1 + (b < 17) for b in range(30) for a in range(b)}


def test_a_common_phrase_is_no_tasks_burden():
    """Of a phrase that repeats in a packet, one mention goes to its bucket; its suffixes are dealt over others."""
    import numpy as np

    name = np.array([5 << 40] * 1000 + [7 << 40, 9 << 40], np.uint64)
    rows = suffixes._packed(np.arange(1002), np.zeros((1002, 3), np.int32), name, 64).to_pylist()
    held = lambda kind: [len(r["name"]) // 8 for r in rows if r["kind"] == kind]
    assert sum(held(0)) == 2 and held(2) == [1] and sum(held(1)) == 1000 and max(held(1)) <= 63
    assert len({r["bucket"] for r in rows if r["kind"] == 1}) >= 16


def test_shared_matches_are_those_of_every_gram():
    """Of periodic, short, equal and unrelated texts: the n-th occurrence of a gram in one meets the n-th in the other."""
    import numpy as np

    r = np.random.default_rng(5)
    texts = lambda: [r.integers(0, v, n).astype("<u2") for v, n in ((3, 40), (9, 200), (60000, 300), (5, 3), (2, 4), (7, 0))]
    xs, ys = texts() + [np.arange(50, dtype="<u2")], texts() + [np.arange(50, dtype="<u2")]
    want = []
    for t, (x, y) in enumerate(zip(xs, ys, strict=True)):
        places = []
        for text in (x, y):
            nth, at = collections.Counter(), {}
            for i in range(len(text) - 3):
                g = tuple(text[i : i + 4].tolist())
                at[g, nth[g]] = i
                nth[g] += 1
            places.append(at)
        want += [(t, i, places[1][g]) for g, i in places[0].items() if g in places[1]]
    got = list(zip(*map(np.ndarray.tolist, chaining.shared_matches(xs, ys, 4)), strict=True))
    assert got == sorted(want) and len(got) > 60
    assert not len(chaining.shared_matches([xs[3]], [ys[3]], 4)[0])


@pytest.mark.parametrize("many", [64, 16])
def test_common_seeds_lose_no_link(spark, work, monkeypatch, many):
    """Form letters whose every seed is common, a line and two halves of a passage in many texts: each pair is found that the exact mode finds."""
    import numpy as np

    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    fixed, line, documents = say(64), say(13), 200
    slots = np.array([[r.randrange(3) if i % 2 == 0 else -1 for i in range(64)] for _ in range(documents)])
    slots[1::2] = np.where(np.arange(64) % 8 == 6, (slots[::2] + 1) % 3, slots[::2])
    rows = [(d, " ".join(say(30) + [fixed[i] if v < 0 else f"s{i}v{v}" for i, v in enumerate(s)] + say(30))) for d, s in enumerate(slots.tolist())]
    rows += [(1000 + d, " ".join(say(20) + line + say(40))) for d in range(80)]
    # around the line, 27 of 37 words agree and never four in a row: no seed beyond the line is shared
    near = say(37)
    spoilt = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(near)]
    rows += [(2000, " ".join(say(50) + line + near + say(5))), (2001, " ".join(say(3) + line + spoilt + say(60)))]
    monkeypatch.setattr(chaining, "MANY", many)
    monkeypatch.setattr(chaining, "NEAR_BLOCK", 40)
    docs = frame(spark, rows).repartition(3)
    found, exact = (sorted(map(tuple, chaining.fuzzy_passages(docs, Workspace(spark, "t"), exact=e).collect())) for e in (False, True))
    assert found == exact and len(found) > 200
    assert (2001, 2000) in {f[:2] for f in found} and not {i for f in found for i in f[:2] if 1000 <= i < 2000}


def test_pairs_that_share_trigrams_match_brute_force():
    import numpy as np

    r = np.random.default_rng(1)
    for trial in range(40):
        n = int(r.integers(2, 40))
        texts = [r.integers(0, r.choice([2, 5, 40]), r.integers(0, 60)).astype(np.uint8) for _ in range(n)]
        place, before, least = np.array([r.integers(0, len(t) + 1) for t in texts]), r.integers(0, 3, n), int(r.integers(1, 8))
        half = int(r.integers(1, n)) if trial % 2 else None
        held = [collections.Counter((*t[i : i + 3].tolist(), i >= p) for i in range(len(t) - 2)) for t, p in zip(texts, place, strict=True)]
        pairs = [(i, j) for j in range(n) for i in range(j) if (before[i] != before[j] or before[i] == 0) and (half is None or i < half <= j)]
        want = [(i, j) for i, j in pairs if sum((held[i] & held[j]).values()) >= least]
        offs = np.cumsum([0, *map(len, texts)])
        tiles = chaining.near_pairs(np.concatenate(texts), offs, place, before, least, half, side=int(r.choice([4, 7, 512])))
        assert sorted(p for tile in tiles for p in zip(*tile, strict=True)) == sorted(want)


def test_distances_match_the_plain_table():
    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        v = r.choice((2, 4, 40))
        x, y = ([r.randrange(v) for _ in range(r.randrange(r.choice((4, 30, 90))))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            new = [i]
            for j, b in enumerate(y):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (a != b)))
            row = new
        assert chaining._distance(np.array(x, np.uint16), np.array(y, np.uint16)) == row[-1]
