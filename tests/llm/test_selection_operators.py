"""Cost-balanced packing, hard negatives and collocations against brute force."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollbook.llm import balance, collocations, negatives
from rollbook.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, ids string, rank int, block int, n long"


def one_by_one(demand, room):
    """The greedy rule for one piece after the other; tokens and cost of each sequence."""
    seqs = [[0, 0, size] for size, many in room for _ in range(many)]
    left = list(demand)
    for n in range(len(left) - 1, 0, -1):
        for _ in range(int(left[n])):
            fits = [s for s in seqs if s[2] - s[1] >= n] or [s for s in seqs if s[2] > s[1]]
            best = min(fits, key=lambda s: s[0])
            take = min(n, best[2] - best[1])
            best[0] += balance.LINEAR * take + balance.QUADRATIC * take * take
            best[1] += take
            if take < n:
                left[n - take] += 1
    return [(s[1], s[0]) for s in seqs]


@pytest.mark.parametrize("seed", range(30))
def test_dealing_ranges_equals_dealing_one_by_one(seed):
    draw = random.Random(seed)
    capacity = draw.choice([8, 16, 64])
    demand = np.zeros(capacity + 1, np.int64)
    for _ in range(draw.randint(1, 12)):
        demand[draw.randint(1, capacity)] += draw.randint(1, 9)
    room = balance.sizes(int((demand * np.arange(capacity + 1)).sum()), capacity)
    used, cost, at = Counter(), Counter(), defaultdict(list)
    for r in balance.deal(demand, room):
        for i in range(r.many):
            at[r.first + i].append((r.offset, r.take))
            used[r.first + i] += r.take
            cost[r.first + i] += balance.LINEAR * r.take + balance.QUADRATIC * r.take**2
    assert [(used[i], cost[i]) for i in range(len(used))] == one_by_one(demand, room)
    for parts in at.values():  # no gap and no overlap
        assert [o for o, _ in sorted(parts)] == [sum(t for _, t in sorted(parts)[:i]) for i in range(len(parts))]
    assert all(n == capacity or n & (n - 1) == 0 for n in used.values())


def test_balanced_packing_keeps_every_id(spark):
    draw = random.Random(5)
    words = ["alpha", "be", "c", "d42", "naïve", "日本", "x<|endoftext|>y", "tab\tbed"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 60, 900]))) for _ in range(60)] + ["", None, "w " * 9000, "same", "same"]
    rows = [(None if i == 7 else min(i, 61), t, None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    packed = balance.pack(spark.createDataFrame(rows, DOCS).repartition(5), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    true = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    pieces, got = defaultdict(list), Counter()
    for p in packed:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        pieces[p.doc_id, p.doc_tokens].append(p)
    for (doc, total), own in pieces.items():
        own.sort(key=lambda p: p.start)
        if len({p.start for p in own}) == len(own):
            assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
            got[doc, tuple(x for p in own for x in p.ids)] += 1
        else:  # repeated documents, each in one piece
            got.update((doc, tuple(p.ids)) for p in own if p.length == total)
    assert got == true
    by_sequence = defaultdict(list)
    for p in packed:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        size = sum(p.length for p in own)
        assert size == 2048 or (size < 2048 and size & (size - 1) == 0)
    assert balance.pack(spark.createDataFrame([], DOCS)).collect() == []


def brute_negatives(rows, n_pos=5, k=3):
    fine = {}
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or not vec or any(x is None or not np.isfinite(x) for x in vec):
            continue
        v = [int(np.floor(256 * float(x))) for x in vec]
        if sum(c * c for c in v) < 1 << 62 and max(map(abs, v)) < 1 << 31:
            key = (str(label), len(v), np.array(v, "<i4").tobytes())
            if vec_id not in fine or key < fine[vec_id][0]:
                fine[vec_id] = (key, label, v)
    out = set()
    for a, (_, label, v) in fine.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, (_, other, w) in fine.items() if b != a and len(w) == len(v))
        for down, p, _ in [s for s in scored if s[2] == label][:n_pos]:
            hits = [s for s in scored if s[2] != label and 50 * -down <= 100 * -s[0] <= 95 * -down][:k]
            out |= {(a, p, i + 1, b, -down, -s) for i, (s, b, _) in enumerate(hits)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (9, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], draw.choice([0, 1, 2])) for i in range(0, 400, 5)]
    rows += [(i, [draw.gauss(0, 1) * 1e6 for _ in range(3)], draw.choice([0, 1])) for i in range(2000, 2600, 25)]
    rows += [(50, [0.5, 0.5, 0.5, 0.5], 0), (50, [0.5, 0.5, 0.5, 0.5], 0), (None, [1.0] * 4, 0), (3, None, 1), (4, [1.0, None, 1.0, 1.0], 1),
             (6, [float("nan")] * 4, 1), (7, [float("inf"), 1.0, 1.0, 1.0], 2), (8, [1e300, 1.0, 1.0, 1.0], 2), (9, [1.0] * 4, None), (10, [], 1),
             (5000, [1.0] * 7, 0), (5050, [0.0] * 7, 0), (5051, [0.0] * 7, 0), (5052, [0.0] * 7, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, anchor string")
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("blocks", [(8192, 1024), (5, 2)])
def test_every_row_takes_part_in_the_query(spark, monkeypatch, tmp_path, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    draw = random.Random(7)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], draw.choice([0, 1])) for i in range(0, 400, 5)]
    rows += [(401 + i, [draw.gauss(0, 1) * 10.0 ** draw.choice([7, 12, 15, 30]), draw.choice([0.0, 0.5]), 0.0, draw.random()], i % 2) for i in range(12)]
    rows += [(450, [1e18, 2.0, -3.0, 0.5], 0), (500, [3e9, -1e9, 1.0, 7.5], 1), (550, [0.5, 0.5, 0.0, 0.0], 1), (550, [0.5, 0.0, 0.5, 0.25], 1),
             (405, [0.75, 0.5, 0.0, 1.0], 0), (405, [0.5, 0.5, 1.0, 1.0], 1), (600, [], 0), (601, [], 0), (603, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_slot_hard_negatives"](spark, str(tmp_path)).collect()
    fine = [(i, [math.floor(256 * Fraction(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    long = lambda s: s if -2**63 <= s < 2**63 else None
    want = []
    for n, (a, v, label) in enumerate(fine):
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for m, (b, w, other) in enumerate(fine) if m != n and len(w) == len(v))
            for down, p, _ in [s for s in scored if s[2] == label][:5]:
                hits = [s for s in scored if s[2] != label and 50 * -down <= 100 * -s[0] <= 95 * -down][:3]
                want += [(a, p, i + 1, b, long(-down), long(-s)) for i, (s, b, _) in enumerate(hits)]
    order = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert any(abs(r[4]) >= 2**62 for r in want if r[4] is not None) or any(r[4] is None for r in want)


def test_blocks_meet_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 9)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], draw.choice([0, 1, 2])) for i in range(0, 400, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert {tuple(r) for r in got} == brute_negatives(rows)


def test_order_keys_follow_numbers():
    numbers = [0, 1, -1, 255, 256, -255, -256, 2**63, -2**63, 10**40, -10**40, 2**200, -2**200]
    assert sorted(numbers, key=negatives.order_key) == sorted(numbers)
    assert [negatives.key_number(negatives.order_key(n)) for n in numbers] == numbers


def test_products_are_exact_beyond_doubles():
    x = np.array([[2**30, 1, 3], [2**30 - 1, 7, 5]], np.int32)
    assert negatives.products(x, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in x]


def test_no_vectors_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def brute_collocations(rows, most, least, top, share=100):
    signs, counts, total = str.maketrans(dict.fromkeys(".,;:!?\n\x0b\x0c\r", "\n")), defaultdict(Counter), Counter()
    for text, lang in rows:
        text = (text or "").encode().lower().decode()
        for piece in text.translate(signs).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang or "und"] += len(words)
            for k in range(1, most + 1):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("most", "share", "top"), [(5, 100, 2000), (5, 60, 12), (2, 100, 2000), (3, 100, 5)])
def test_collocations_equal_brute_force(spark, most, share, top):
    draw = random.Random(11)
    words = ["New", "york", "ÉTÉ", "été", "a", "b", "c's", "日本", "x y", "z\x1c"]
    ends = [" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "  ", "; "]
    rows = [("".join(draw.choice(words[:draw.choice([3, 10])]) + draw.choice(ends) for _ in range(draw.choice([0, 3, 40]))), draw.choice(["en", "fr", None]))
            for _ in range(250)]
    rows += [(None, "en"), ("", None), ("new york " * 3000, "fr"), ("one two three four five six", "en"), ("word", "de")] + [("same line of words", "en")] * 20
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(6)
    got = sorted(tuple(r) for r in collocations.collocations(df, most_words=most, least=4, share=share, top=top).collect())
    assert got == brute_collocations(rows, most, 4, top, share) and got


def test_no_documents_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_trie_bursts_and_spills_sorted_runs():
    draw, true = random.Random(2), Counter()
    trie, known, spilled = collocations.HatTrie(burst=3, depth=2), collocations.Words("en", None), Counter()
    known.ids([bytes([97 + i]) for i in range(9)])

    def spill(room):
        for found, n in trie.spill(room):
            run = collocations.sorted_run(known, found, n).to_pydict()
            assert run["phrase"] == sorted(run["phrase"])
            spilled.update(dict(zip(run["phrase"], run["n"], strict=True)))

    for size in (1, 2, 3, 4, 5) * 40:
        found = np.array([[draw.randint(1, 9) for _ in range(size)] for _ in range(6)])
        counts = np.array([draw.randint(1, 4) for _ in range(6)])
        for g, n in zip(found.tolist(), counts.tolist(), strict=True):
            true[" ".join(known.names[i].decode() for i in g)] += n
        trie.add(found, counts)
        if trie.size > 60:
            spill(30)
            assert trie.size <= 30
    assert type(trie.root) is list and any(type(x) is list for x in trie.root[0].values())
    spill(-1)
    assert spilled == true and trie.size == 0


def test_scores_pass_64_bits(spark):
    draw = random.Random(4)
    rows = [(a := draw.randint(10**9, 10**12), draw.randint(10**15, 10**17), a + draw.randint(0, 10**12), a + draw.randint(0, 10**6)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    assert [x[0] for x in df.select(collocations.cut_score()).collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]
