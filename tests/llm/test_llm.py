import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from edgeweave.llm import mixing, packing, repetition
from edgeweave.llm.tokens import LONGEST_BLANK, count_text, encoding, vocabulary_path, with_token_counts

rows = lambda df: sorted(tuple(r) for r in df.collect())


# --- tokens


def test_token_counts(spark):
    enc = encoding(vocabulary_path())
    texts = [None, "", "  ", "hello world", "naïve ∑ 漢字", "<|endoftext|>", "a" * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, extra string")
    got = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(df, "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_long_blanks_are_counted_whole():
    enc = encoding(vocabulary_path())
    rng = random.Random(9)
    blanks = " \n\t\r\x0b\x1c\x85\xa0\u2003\u3000"
    for _ in range(400):
        parts = [rng.choice(["a", "foo's", "12", "漢", "!?", " x"]) + "".join(rng.choice(blanks) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["", " ", "\n\n\n\n"]) + "".join(parts) + rng.choice(["", "z"])
        assert count_text(enc, text, rng.randint(0, 4)) == len(enc.encode_ordinary(text))
    for text in ("a\t" + "\n" * (LONGEST_BLANK + 10_001) + "b", " " * (2 * LONGEST_BLANK) + "x", "x" + " \t" * LONGEST_BLANK):
        assert count_text(enc, text) == len(enc.encode_ordinary(text))
    assert count_text(enc, "a" + " " * 3_000_000 + "b") > 1000


# --- p6


def brute_place(counts, capacity, size):
    """Every way to place an item, by the resulting sum of squares; ties to the fullest level."""
    best = None
    for level in [0, *[h for h in range(1, capacity - size + 1) if counts[h]]]:
        after = Counter(counts)
        if level:
            after[level] -= 1
        if level + size < capacity:
            after[level + size] += 1
        cost = sum(v * v for v in after.values())
        if best is None or cost < best[0] or (cost == best[0] and level > best[1]):
            best = (cost, level, after)
    return best


def test_packing_places_by_least_squares():
    rng = random.Random(1)
    packer, counts = packing.LevelPacker(20), Counter()
    for _ in range(400):
        size = rng.randint(1, 20)
        _, level, counts = brute_place(counts, 20, size)
        window = packer.place(size)
        assert packer.fill[window] == level + size
        assert {h: n for h, n in counts.items() if n} == {h: int(n) for h, n in enumerate(packer.counts) if n}


def check_packing(got, sizes, capacity):
    whole, windows = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["start_in_doc"], r["tokens"], r["piece"], r["pieces"]))
        windows[r["shard"], r["window"]].append((r["start_in_window"], r["tokens"]))
    assert {d: sum(t for _, t, *_ in p) for d, p in whole.items()} == sizes
    for d, p in whole.items():
        assert len(p) == max(1, -(-sizes[d] // capacity)) == p[0][3]
        at = 0
        for start, tokens, *_ in sorted(p):
            assert start == at
            at += tokens
    for w in windows.values():
        at = 0
        for start, tokens in sorted(w, key=lambda x: (x[0], x[1])):
            assert start == at
            at += tokens
        assert at <= capacity
    return len(windows)


def first_fit_decreasing(sizes, capacity):
    """Windows that the offline heuristic needs, which sees all pieces beforehand."""
    pieces = [min(capacity, n - k * capacity) for n in sizes for k in range(-(-n // capacity))]
    room = []
    for p in sorted(pieces, reverse=True):
        k = next((i for i, r in enumerate(room) if r >= p), None)
        if k is None:
            room.append(capacity - p)
        else:
            room[k] -= p
    return len(room)


def test_pack(spark, monkeypatch):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 99, 100, 101, 250, rng.randint(1, 60)]) for i in range(2000)}
    docs = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(None, 4, "x")], "doc_id bigint, n_tokens bigint, window string")
    spec = spark.createDataFrame([("w100", 100), ("w64", 64), ("none", 0), ("null", None)], "container string, capacity bigint")
    got = packing.pack(docs, spec, shard_docs=500).collect()
    assert {r["container"] for r in got} == {"w100", "w64"}
    for name, capacity in (("w100", 100), ("w64", 64)):
        n = check_packing([r for r in got if r["container"] == name], sizes, capacity)
        assert n <= 1.03 * first_fit_decreasing(sizes.values(), capacity) + 8
    assert packing.pack(docs.limit(0), spec).collect() == []
    assert packing.pack(docs, spec.limit(0)).collect() == []
    # More containers than a plan lists are joined, with the same result.
    monkeypatch.setattr(packing, "MAX_LISTED", 1)
    assert sorted(map(tuple, packing.pack(docs, spec, shard_docs=500).collect())) == sorted(map(tuple, got))


def test_pack_only_empty_documents(spark):
    docs = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    spec = spark.createDataFrame([("w", 10)], "container string, capacity bigint")
    assert rows(packing.pack(docs, spec).select("doc_id", "window", "tokens")) == [(1, 0, 0), (2, 0, 0)]


# --- p7


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big-One", "big_one ", "BIG ONE"]), rng.randint(1, 40)) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(20)] + [(6000, None, 500), (6001, "other", 100), (6002, "small", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").repartition(3).cache()
    targets = spark.createDataFrame([("big_one", 0.5, 3), ("small", 0.2, 4), ("absent", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_plan(df, targets)
    total = sum(n for *_, n in docs)
    plan = {r["source"]: r for r in mix.plan.collect()}
    assert mix.total == total
    assert sorted(n for n, r in plan.items() if r["limited"]) == ["absent", "small"]
    assert plan["big_one"]["exponent"] == 1 and plan["big_one"]["weight"] == 0.5 and plan["small"]["budget"] == 4 * 200
    assert abs(plan["small"]["weight"] * total - 800) < 1e-6 * total  # the bisected exponent stops at the limit
    taken = mixing.select_mix(df, mix).collect()
    by = defaultdict(Counter)
    tokens = Counter()
    for r in taken:
        by[r["source"]][r["doc_id"], r["pass"]] += 1
        tokens[r["source"]] += r["n_tokens"]
    assert all(n == 1 for c in by.values() for n in c.values())
    assert max(Counter(d for d, _ in by["small"]).values()) == 4 and tokens["small"] == 800
    assert 0 <= int(0.5 * total) - tokens["big_one"] <= 1
    report = {r["source"]: r for r in mixing.mix_report(mix, mixing.select_mix(df, mix)).collect()}
    assert abs(report["big_one"]["share_of_all"] - 0.5) < 1e-3 and report["absent"]["share_of_all"] == 0
    assert rows(mixing.select_mix(df, mix)) == sorted(tuple(r) for r in taken)  # the permutation is keyed, not random
    # Smaller blocks take the same documents but for those at the end of the budget.
    fine = mixing.select_mix(df, mix, block_docs=2).collect()
    assert abs(sum(r["n_tokens"] for r in fine if r["source"] == "big_one") - int(0.5 * total)) <= 40
    # A third of the tokens is short of its target: the balanced mix shrinks until all shares hold.
    balanced = mixing.balanced_plan(df, targets)
    got = {r["source"]: r for r in mixing.mix_report(balanced, mixing.select_mix(df, balanced)).collect()}
    assert abs(got["big_one"]["share_of_selection"] - 5 / 7) < 0.01 and abs(got["small"]["share_of_selection"] - 2 / 7) < 0.01 and got["small"]["taken"] == 800


def test_limits_at_the_border(spark):
    """Exactly enough documents is not limited, one token less is."""
    df = spark.createDataFrame([(i, s, 1) for s, n in (("a", 300), ("b", 299), ("c", 401)) for i in range(n)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.8, 2)], "source string, target_share double, max_repeats int")
    assert {r["source"]: r["limited"] for r in mixing.mix_plan(df, targets).plan.collect()} == {"a": False, "b": True, "c": False}


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 3)], "source string, target_share double, max_repeats int")
    for make in (mixing.mix_plan, mixing.balanced_plan, mixing.temperature_plan):
        mix = make(none, targets)
        assert mixing.select_mix(none, mix).collect() == []
        assert mixing.mix_report(mix, mixing.select_mix(none, mix)).first()["share_of_selection"] == 0
        assert make(none, targets.limit(0)).plan.collect() == []
    assert mixing.mix_plan(none, targets).plan.first()["limited"] is False


def test_many_blocks(spark):
    df = spark.createDataFrame([(i, "a", 1 + i % 9) for i in range(20_000)], "doc_id bigint, source string, n_tokens bigint").cache()
    targets = spark.createDataFrame([("a", 0.37, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_plan(df, targets)
    for block in (1, 50, 4096):
        got = mixing.select_mix(df, mix, block).collect()
        assert len({r["doc_id"] for r in got}) == len(got) and 0 <= int(0.37 * mix.total) - sum(r["n_tokens"] for r in got) <= 9


def test_temperature(spark):
    sizes = {"a": 1000, "b": 100, "c": 10}
    df = spark.createDataFrame([(i, s, 1) for s, n in sizes.items() for i in range(n)], "doc_id bigint, source string, n_tokens bigint").cache()
    wide = spark.createDataFrame([(s, 0.25, 10_000) for s in ("a", "b", "c", "none")], "source string, target_share double, max_repeats int")
    for goal in (1.0, 0.5, 0.2):
        plan = {r["source"]: r for r in mixing.temperature_plan(df, wide, goal).plan.collect()}
        w = [plan[s]["weight"] for s in "abc"]
        assert abs(mixing.entropy(w) - goal) < 1e-6 and abs(sum(w) - 1) < 1e-6 and w[0] > w[1] > w[2] and plan["none"]["weight"] == 0
        a = plan["a"]["exponent"]
        assert abs(w[1] / w[0] - (100 / 1000) ** a) < 1e-9 and abs(w[2] / w[0] - (10 / 1000) ** a) < 1e-9
    even = {r["source"]: r for r in mixing.temperature_plan(df, wide).plan.collect()}
    assert abs(even["a"]["exponent"]) < 1e-3  # the targets are even over the three that have tokens
    # With limits, the scarce sources stop and the rest is filled into the others.
    tight = wide.withColumn("max_repeats", wide["max_repeats"] * 0 + 3)
    mix = mixing.temperature_plan(df, tight)
    plan = {r["source"]: r for r in mix.plan.collect()}
    assert plan["c"]["budget"] == 30 and plan["b"]["budget"] == 300 and abs(plan["a"]["budget"] - 780) <= 1 and not plan["a"]["limited"]
    got = {r["source"]: r["taken"] for r in mixing.mix_report(mix, mixing.select_mix(df, mix)).collect()}
    assert got["c"] == 30 and got["b"] == 300 and abs(got["a"] - 780) <= 1
    few = {r["source"]: r["budget"] for r in mixing.temperature_plan(df, wide.withColumn("max_repeats", wide["max_repeats"] * 0)).plan.collect()}
    assert set(few.values()) == {0}


# --- p8


def brute_repetition(text, n=8):
    w = [x.casefold() if len(x.casefold()) == len(x) else x.lower() for x in regex.findall(r"\p{L}+", text or "")]
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            mark[i : i + n] = [1] * n
        seen.add(g)
    return len(w), sum(mark)


def sample_texts():
    rng = random.Random(6)
    words = ["alpha", "Beta", "ГАММА", "гамма", "δέλτα", "x", "naïve", "日本語", "İstanbul", "straße", "ς", "Σ", "a1b", "c_d", "e²f", "٣"]
    texts = [None, "", " \n\t ", "123 456", "one two three four five six seven", "a b c d e f g h " * 2, "A b C d E f G h a B c D e F g H", "a " * 50]
    for _ in range(60):
        part = " ".join(rng.choice(words) for _ in range(rng.randint(5, 12)))
        texts.append(rng.choice([" ", "\n", ", ", "1"]).join([part, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), part.upper()] * rng.randint(0, 3)]))
    return texts


@pytest.mark.parametrize("chars", [1, 200, 1_000_000])
def test_repetition(chars):
    texts, got = sample_texts(), []
    for at, part in repetition._parts(texts, chars):
        assert at == len(got)
        w, r = repetition.measure(part)
        got += list(zip(w.tolist(), r.tolist()))
    assert got == [brute_repetition(t) for t in texts]


def test_repetition_survives_equal_hashes(monkeypatch):
    texts = [t or "" for t in sample_texts()]
    want = [brute_repetition(t) for t in texts]
    monkeypatch.setattr(repetition, "_coefficients", lambda n, seed: np.zeros(n, np.uint64))
    w, r = repetition.measure(texts)
    assert list(zip(w.tolist(), r.tolist())) == want


def test_repetition_query(spark):
    texts = sample_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "a b c d e f g h " * 9, "x")], "doc_id bigint, text string, words string")
    got = rows(repetition.repeated_words(df, "doc_id", "text").select("doc_id", "words", "repeated"))
    assert got == sorted([(i, *brute_repetition(t)) for i, t in enumerate(texts)] + [(0, 72, 64)])
    assert rows(repetition.repeated_words(df.limit(0), "doc_id", "text")) == []


def test_llr_misses_nothing(spark):
    """Every document with the wanted share is flagged, also where all words have one hash; the exact check leaves just these."""
    rng = random.Random(8)
    texts = sample_texts() + ["the same eight words stand here once more " * k for k in range(1, 5)]
    for _ in range(150):
        part = " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randint(8, 40)))
        texts.append(part + " " + " ".join("".join(rng.choice("qrstuvw") for _ in range(4)) for _ in range(rng.randint(0, 200))) + " " + part)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    want = [brute_repetition(t) for t in texts]
    for share in (0.05, 0.3, 0.8):
        got = {r["doc_id"]: r for r in repetition.screened_repetition(df, "doc_id", "text", share).collect()}
        for i, (w, r) in enumerate(want):
            assert got[i]["words"] == w
            if w and r and r >= share * w:
                assert got[i]["flagged"]
            assert got[i]["repeated"] == (r if got[i]["flagged"] else None)
    assert rows(repetition.screened_repetition(df.limit(0), "doc_id", "text", 0.3)) == []


def test_llr_is_the_ratio_of_the_multinomials():
    text = "a b c d e f g h a b c d e f g h x"
    words, stretches, total = repetition.llr_sums([text, "", "a b c"])
    assert words.tolist() == [17, 0, 3] and stretches.tolist() == [10, 0, 0]
    assert abs(total[0] - 2 * np.log(2)) < 1e-12 and total[1] == total[2] == 0


def test_llr_survives_equal_hashes(monkeypatch):
    texts = [t or "" for t in sample_texts()]
    monkeypatch.setattr(repetition, "_coefficients", lambda n, seed: np.zeros(n, np.uint64))
    words, _, total = repetition.llr_sums(texts)
    for t, w, s in zip(texts, words, total):
        r = brute_repetition(t)[1]
        assert not r or s >= 0.3 * w / 8 * np.log(2) or r < 0.3 * w
