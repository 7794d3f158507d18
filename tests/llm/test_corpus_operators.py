"""Sharding, packing, search, near-duplicates, repeats, leaks and the pipeline against brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rollbook.llm import ann, decontam, minhash, packing, phrases, repeats, sharding
from rollbook.llm.components import components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def draw(key, name):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
    h = xxhash.xxh64_intdigest(name.encode(), h)
    return ((h >> 11) + 0.5) / 2**53


def brute_shard(key, tree):
    pick = lambda kids: min((-math.log(draw(key, n)) / w, k) for k, (n, w) in enumerate(kids))[1]
    r = pick([(f"region{i}", sum(map(sum, x))) for i, x in enumerate(tree.regions)])
    k = pick([(f"region{r}/rack{i}", sum(x)) for i, x in enumerate(tree.regions[r])])
    s = pick([(f"region{r}/rack{k}/shard{i}", w) for i, w in enumerate(tree.regions[r][k])])
    return sum(len(x) for reg in tree.regions[:r] for x in reg) + sum(map(len, tree.regions[r][:k])) + s


def test_shards_equal_brute_force_and_move_only_inwards(spark):
    tree = sharding.Tree.even(40)
    rows = spark.createDataFrame([(i,) for i in range(3000)], "doc_id long")
    got = sharding.place(sharding.place(rows, "doc_id", tree), "doc_id", tree.grown(), "grown").collect()
    assert all(r["shard"] == brute_shard(r["doc_id"], tree) for r in got[:300])
    assert {r["grown"] for r in got if r["grown"] != r["shard"]} == {40}
    count = Counter(r["shard"] for r in got)
    assert len(count) == 40 and max(count.values()) < 2 * 75
    heavier = sharding.place(sharding.place(rows, "doc_id", tree), "doc_id", tree.reweighted(9, 3.0), "grown").where("shard <> grown").collect()
    assert {r["grown"] // 8 for r in heavier} == {1}  # only into the region of shard 9
    with pytest.raises(ValueError):
        sharding.Tree(((),))


def test_documents_in_shards(spark, docs):
    odd = spark.createDataFrame([(None, None, 1), (None, "", 2), (7, "é", 3), (7, "é", 3)], "doc_id long, text string, slot int")
    got = sharding.shard_documents(odd, sharding.Tree.even(40)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == [(16, 0), (16, 0), (18, zlib.crc32("é".encode())), (18, zlib.crc32("é".encode()))]
    every = sharding.shard_documents(docs, sharding.Tree.even(40)).collect()
    for k in range(40):
        slots = sorted(r["slot"] for r in every if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(odd.limit(0), sharding.Tree.even(3)).count() == 0


def test_words_are_encoded_like_whole_texts():
    e = packing.encoder(packing.TOKENIZER)
    random.seed(4)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", ",", ".", "...", "'s", "99", "\r\n", "\xa0", "日本", "<|endoftext|>", " ", "\x1c", "\0"]
    texts = ["", None, " ", "\n", "a ", " a", *("".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(3000))]
    for text, raw in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_added_tokens_are_those_of_a_fresh_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two\nthree", "a <|endof text|>", "plain words"]
    for text, raw in zip(texts, packing.encoder(packing.TOKENIZER).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == [*fresh.encode(text, add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("low, high, capacity", [(1, 2048, 2048), (300, 1500, 2048), (5, 9, 10), (1, 1, 7)])
def test_configurations_hold_each_piece_once(low, high, capacity):
    demand = np.bincount(np.random.default_rng(2).integers(low, high + 1, 3000), minlength=capacity + 1)
    got = packing.configurations(demand)
    held = Counter()
    for parts, many in got:
        assert sum(n * m for n, m in parts) <= capacity
        for n, m in parts:
            held[n] += m * many
    assert all(held[n] == demand[n] for n in range(capacity + 1))
    fewest = sum(packing.best_fit(demand).values())
    assert sum(m for _, m in got) <= 1.01 * fewest


def test_packed_sequences_have_no_gaps(spark, docs):
    odd = spark.createDataFrame([(900, None), (900, ""), (None, "a"), (901, "word and " * 6000)], "doc_id long, text string")
    packed = packing.pack(docs.select("doc_id", "text").union(odd), with_ids=True)
    rows = packed.toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows.itertuples())
    long = rows[rows["doc_id"] == 901].sort_values("piece")
    assert (long["length"].iloc[1:] == 2048).all() and list(long["start"]) == [0, *np.cumsum(long["length"])[:-1]]
    assert rows["sequence_id"].nunique() <= math.ceil(rows["length"].sum() / 2048) + 2
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == rows["length"].sum()
    assert packing.pack(odd.limit(0)).count() == 0


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 5 == 0:
            near = sorted((-(v @ w) / math.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(16) + 2 * (i % 3)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a vector many times
    rows += [(2000, None), (2005, [0.0] * 16), (2010, [float("nan")] * 16), (2015, [None] * 16), (None, [1.0] * 16), (3000, [1.0, 2.0]), (3005, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 5)
    exact, got = defaultdict(list), defaultdict(list)
    for r in ann.exact(table, F.col("vec_id") % 5 == 0).collect():
        exact[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert exact.keys() == {q for q, near in want.items() if near}
    for q, near in want.items():
        assert np.allclose([s for _, _, s in sorted(exact[q])], [-s for s, _ in near])
    assert [v for _, v, _ in sorted(exact[0])] == [1000, 1001, 1002, 1003, 1004]
    for r in ann.nearest(table, F.col("vec_id") % 5 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert all(len(got[q]) == len(near) for q, near in want.items())
    assert sum(len(set(got[q]) & {v for _, v, _ in exact[q]}) for q in want) >= 0.9 * sum(map(len, exact.values()))
    assert ann.nearest(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_nearest_among_collinear_vectors_have_the_smallest_ids(spark):
    one = [0.5, -1.25, 3.0, 0.75]
    rows = [(0, one), *((100 + k, [x * 2.0**(40 - k) for x in one]) for k in range(41))]
    table = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(6)
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") == 0).collect())
    assert got == [(k + 1, 100 + k) for k in range(5)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


def brute_components(rows, words, percent):
    def own(text):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets, root = [(i, own(t)) for i, t in rows], list(range(len(rows)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]) and find(a) != find(b):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return sorted((i, len(s), min((x for x in least[find(k)] if x is not None), default=None)) if s else (i, 0, i) for k, (i, s) in enumerate(sets)) \
        if all(i is not None for i, _ in rows) else None


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, base = [], [rng.choices(vocabulary, k=80) for _ in range(6)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words) if i % 10 else " ".join(rng.choices(vocabulary, k=rng.randrange(3)))))
    return rows + [(500, ""), (501, None), (502, " \t\n"), (503, "One"), (504, "one")]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, words):
    rows = near_rows(words)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, words, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = spark.createDataFrame([(None, text, 1), (5, text, 2), (5, text, 3), (5, "other words here and there", 4), (3, "other words here and there", 5)], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows, 2, 80).collect())
    assert got == [(-1, 5, False), (3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True)]
    kept = minhash.deduplicated(rows, 2, 80)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(raw[s:s + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_equal_brute_force(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(3)
    shared = ["".join(rng.choices("abcdé ", k=n)) for n in (99, 100, 101, 400)]
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    rows += [(1000 + i, "".join(rng.choices("xyz ", k=rng.randrange(200))) + rng.choice(shared) + "".join(rng.choices("xyz ", k=rng.randrange(200)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 5000), (2003, "ab" * 3000), (2004, "a" * 150)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_repeats_of_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 2), (9, text[50:200], 3)], "doc_id long, text string, n_bytes int")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in repeats.without_repeats(rows, with_text=True).collect())
    assert got == [(4, 0), (4, 0), (9, 150), (99, 300)]
    assert repeats.without_repeats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 2**63 - 1])
def test_repeats_of_many_texts_under_one_id(spark, doc_id):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh", k=rng.randrange(90, 300))) for _ in range(4000)]
    early = texts[7][:100].ljust(100, "x")
    rows = [(doc_id, t, k) for k, t in enumerate(texts)] + [(1, early, -1), (doc_id, "y" + early + "z", -2)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(7), with_text=True).collect()
    assert sorted(bytes(r["kept"]).decode() for r in got) == sorted([*(t[100:] if t[:100] == early else t for t in texts), early, "yz"])


def test_repeats_order_string_ids(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=120))
    got = repeats.without_repeats(spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "z", r["n_removed"]) for r in got) == [("a", 0), ("b", 120), ("z", 120)]


def test_phrases_of_long_texts_cross_chunks(monkeypatch):
    raw = np.frombuffer(bytes(random.Random(5).choices(b"abcd", k=5000)), np.uint8)
    _, _, start, many = phrases.phrases(raw)
    assert start[0] == 0 and (start[1:] == start[:-1] + many[:-1]).all() and start[-1] + many[-1] == len(raw) - 99
    monkeypatch.setattr(phrases, "CHUNK", 700)
    _, _, start, many = phrases.phrases(raw)
    assert (start[1:] == start[:-1] + many[:-1]).all() and start[-1] + many[-1] == len(raw) - 99
    s, h, _ = phrases.window_hashes(raw, start, many)
    monkeypatch.setattr(phrases, "CHUNK", 1 << 20)
    assert (s == np.arange(len(raw) - 99)).all() and (h == phrases.window_hashes(raw, start, many)[1]).all()


def test_leaks(spark):
    items = spark.createDataFrame([(1, "Then Tom has 3 apples and gives 3 apples to Ann who had 12 km to walk with her old dog Rex home."), (2, "short one here"),
                                   (3, None), (4, ""), (5, "short one here")], "item_id long, text string")
    filled = "Then {0} has {1} apples and gives {2} apples to Eve who had 90 mi to walk with her old dog Max home."
    rows = [(10, "Junk junk. " + filled.format("Bob", 7, 7) + " more"), (11, filled.format("Bob", 7, 8)), (12, "this is SHORT, one here ok"), (13, ""), (14, None),
            (15, "foo then tom has 3 apples and gives 3 apples to ann who had 12 km to walk with her old dog rex home bar"), (15, "nothing"),
            (16, "1 2 3 4 5 6 7 8 9 10 11 12 Tom Ann Rex"), (17, "word " * 30_000), (None, "short one here")]
    got = decontam.leaks(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string"), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["templated"]) for r in got) == [
        (-1, 2, False), (-1, 5, False), (10, 1, True), (12, 2, False), (12, 5, False), (15, 1, False)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.decontaminated(table, items).collect()) == [11, 13, 14, 16, 17]
    clashing = table.selectExpr("*", "1 AS _leaks", "2 AS item", "3 AS key", "4 AS row")
    assert sorted(decontam.decontaminated(clashing, items).select("doc_id", "_leaks", "row").collect()) == [(i, 1, 4) for i in (11, 13, 14, 16, 17)]
    assert decontam.leaks(table.limit(0), items).count() == 0 and decontam.decontaminated(table, items.limit(0)).count() == len(rows)


def test_leaks_of_the_benchmark_equal_a_window_search(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    index, size, want = defaultdict(set), {}, defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        size[r["item_id"]] = len(w) - 7
        for k in range(len(w) - 7):
            index[tuple(w[k:k + 8])].add((r["item_id"], k))
    for r in docs.collect():
        w = words(r["text"])
        for k in range(len(w) - 7):
            for item, at in index.get(tuple(w[k:k + 8]), ()):
                want[r["doc_id"], item].add(at)
    want = {k for k, v in want.items() if 2 * len(v) >= size[k[1]]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_leaks_of_names_at_sentence_starts_and_of_short_items(spark, sent, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", sent)
    items = [(1, "Maria has 5 boxes with 12 pens each. Maria sells 20 pens. How many pens are left?"), (2, "Nora buys 4 red cups"), (3, "What is 12 plus 30"), (4, "Add 7"),
             (5, "The old man and Tom saw 3 ships in the bay. The ships left Ann at 9.")]
    rows = [(10, "Peter has 8 boxes with 9 pens each. Peter sells 11 pens. How many pens are left?"), (11, "Peter has 8 boxes with 9 pens each. Paul sells 11 pens. How many pens are left?"),
            (12, "so it was. Omar buys 9 red cups"), (13, "What is 7 plus 8?"), (14, "what was 7 plus 8? Add 9"), (15, "A old man and Bob saw 5 ships in the bay. The ships left Eve at 2.")]
    table, bench = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((rows, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"], r["templated"]) for r in decontam.leaks(table, bench).collect()}
    assert got == {(10, 1, True), (12, 2, True), (13, 3, True), (14, 4, True), (15, 5, True)}


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL).cache()
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids <= before and (ids == before) == (name == "pii") or name == "decontamination"
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]
