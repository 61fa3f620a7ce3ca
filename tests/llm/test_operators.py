"""Each operator against a brute-force version on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywatch.llm import ann, components, decontam, langid, pieces, quality, repeats, secrets, simhash, tokenfiles, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 300)
    near = base.split()
    near[10], near[200] = "other", "words"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "a", 1), (4, words(4, 50), "de", "a", 1),
        (5, "", "en", "a", 0), (6, None, None, "a", None), (7, "one", "en", "b", 3), (7, "one", "en", "b", 3), (8, words(8, 3000), "en", "b", 1),
        (9, "  \n\t ", None, "b", 1), (10, "É ÀB ▁x 你好  z\n\n end ", "fr", "b", 1), (None, words(11, 30), "en", "b", 1), (12, "ab ab " * 300, "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def fingerprint(text: str | None, size: int) -> int:
    parts = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + size]), 42) for i in range(max(1, len(parts) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs):
    rows = docs.collect()
    prints = [fingerprint(r.text, 4) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r.doc_id for r, x in zip(rows, group) if x == g and r.doc_id is not None), default=None) for g in group}
    want = Counter((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    for shard_rows in (2, simhash.SHARD_ROWS):
        found = simhash.similar_groups(docs, shard_rows=shard_rows).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id")
        assert Counter(map(tuple, found.collect())) == want
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_forest_finds_every_pair():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64)) for _ in range(4))]))
    groups = np.sort(draw.integers(0, 3, len(values)))
    found = {(int(a), int(b)) for q, v in simhash.Forest(groups, values).search(groups, values, 4) for a, b in zip(q, v)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= 4}


@pytest.mark.parametrize("rows", [10, 10**6, 10**9])
def test_keys_meet(rows):
    masks = simhash.key_masks(4, rows)
    draw = random.Random(3)
    for _ in range(300):
        flips = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (60, 50)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 60: 50, 50: 50}


def test_near_copies_leave_one(spark, docs):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter([1, 4, 5, 7, 8, 10, None, 12])  # 2 and 3 copy 1; 6 and 9 are as empty as 5; 7 stays once


def shingle_set(text: str) -> set[tuple[str, ...]]:
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def jaccard(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def groups_by_all_pairs(texts: dict[int, str]) -> set[frozenset[int]]:
    parent = {i: i for i in texts}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and jaccard(texts[i], texts[j]) >= 0.8:
                parent[root(i)] = root(j)
    return {frozenset(i for i in texts if root(i) == r) for r in map(root, texts)}


def groups_found(spark, texts: dict[int, str]) -> set[frozenset[int]]:
    rows = simhash.near_copy_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    return {frozenset(r.doc_id for r in rows if r.component == c) for c in {r.component for r in rows}}


def test_near_copies_that_gained_or_lost_a_passage(spark):
    rng, texts = random.Random(11), {}
    fresh = lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    for n in (40, 100, 300):
        for part in (0.1, 0.15, 0.2):
            for _ in range(4):
                own, m = fresh(n), int(part * n)
                spots = set(rng.sample(range(0, n, 10), max(1, m // 10)))
                changed = [w + "x" if i in spots else w for i, w in enumerate(own)]
                for copy in (own, own + fresh(m), own[m:], changed):
                    texts[len(texts)] = " ".join(copy)
    want = groups_by_all_pairs(texts)
    assert sum(len(g) > 1 for g in want) >= 30
    assert groups_found(spark, texts) == want


def test_near_copies_beside_an_unrelated_text_of_the_same_words(spark):
    rng, texts = random.Random(12), {}
    for _ in range(12):
        own = [f"w{rng.getrandbits(48):x}" for _ in range(100)]
        for text in (own + own[:5], own + own[5:10], rng.sample(own, 100)):
            texts[len(texts)] = " ".join(text)
    want = groups_by_all_pairs(texts)
    assert sorted(map(len, want)) == [1] * 12 + [2] * 12
    assert groups_found(spark, texts) == want


def test_cells_of_a_frequent_shingle_hold_every_pair(spark):
    firsts = spark.createDataFrame([(5, i, i // 2, 4, 0, False) for i in range(30)], "token bigint, id bigint, part bigint, size int, place int, often boolean")
    want = [(i, j) for i in range(30) for j in range(i + 1, 30) if i // 2 != j // 2]
    for rows, cell_rows in ((firsts, 4), (firsts.withColumn("often", F.col("id") >= 0), 4), (firsts, 100), (firsts.unionByName(firsts), 100)):
        shared = simhash.shared_firsts(rows, cell_rows=cell_rows)
        assert {r.n for r in shared.collect()} == {None if cell_rows == 4 else 30}
        found = [(r.a, r.b) for r in simhash.pairs_apart(shared, None, 0.8, cell_rows=4).collect()]
        assert sorted(found) == want


def test_signs_differ_in_no_more_bits_than_texts_in_shingles(spark):
    draw = np.random.default_rng(2)
    pairs = []
    for _ in range(60):
        n, gone, new = draw.integers(1, 3000), draw.integers(0, 300), draw.integers(0, 900)
        x = draw.integers(-(1 << 63), 1 << 63, n)
        y = np.r_[x[gone:], draw.integers(-(1 << 63), 1 << 63, new)]
        pairs.append((simhash.text_sign(x).tolist(), simhash.text_sign(y).tolist(), len(set(x.tolist()) ^ set(y.tolist()))))
    rows = spark.createDataFrame(pairs, "x array<bigint>, y array<bigint>, apart long")
    rows = rows.withColumn("bits", simhash.differing_bits(F.col("x"), F.col("y"))).collect()
    assert all(r.bits <= r.apart for r in rows) and sum(r.bits > 0.4 * r.apart for r in rows) > 20
    assert all(r.bits == 0 for r in rows if r.apart == 0)


def test_a_large_group_is_joined_by_way_of_a_few(spark):
    rows = [(t, i, i, 20, t, False) for t in range(3) for i in range(30)]
    shared = simhash.shared_firsts(spark.createDataFrame(rows, "token bigint, id bigint, part bigint, size int, place int, often boolean"))
    found = {(r.a, r.b) for r in simhash.pairs_apart(shared, None, 0.8, True).collect()}
    assert {(0, i) for i in range(1, 30)} <= found and len(found) < 5 * 30
    moved = spark.createDataFrame([(i, 0) for i in range(1, 28)], "part bigint, now bigint")
    assert {(r.a, r.b) for r in simhash.pairs_apart(shared, moved, 0.8).collect()} == {(i, j) for j in (28, 29) for i in range(j)}


def test_heads_are_the_rows_that_share_most(spark):
    """Copies of one text, each with edits of its own, are near that text only; it is found wherever it stands in the group."""
    rows = [(t, i, i, 50, t, False) for i in range(30) for t in range(10) if i == 5 or (t - i) % 10 > 3]
    shared = simhash.shared_firsts(spark.createDataFrame(rows, "token bigint, id bigint, part bigint, size int, place int, often boolean"))
    found = {(r.a, r.b) for r in simhash.pairs_apart(shared, None, 0.8, True).collect()}
    assert {(min(5, i), max(5, i)) for i in range(30) if i != 5} <= found and len(found) < 5 * 30


def test_unshared_first_shingles_count_as_gone():
    """The first shingles of 20 alone are each row's own: what is left is too short, wherever the shared ones stand."""
    sizes, held = np.full(2, 146), np.array([30, 15])
    ids, none, group = np.arange(2), np.full(2, -1), np.zeros(2, np.int64)
    for places, want in (([0, 0], 1), ([14, 14], 1), ([17, 0], 0), ([29, 10], 0)):
        assert len(simhash.cell_pairs(group, ids, sizes, np.array(places), ids, held, none, 0.8)[0]) == want


def test_frequent_shingles_stand_last_by_their_number(spark):
    text = " ".join(f"w{i}" for i in range(14))
    tokens = np.unique(simhash.shingle_hashes(text, 5)).view(np.int64)
    frequent = pa.table({"token": tokens[[3, 0, 1, 2, 4, 5, 7, 8]], "n": [40, 50, 60, 70, 80, 90, 100, 3000]})
    rows = simhash.prefixes(spark.createDataFrame([(1, text, 1)], "id bigint, text string, part bigint"), 0.8, 5, frequent).orderBy("place").collect()
    assert [r.token for r in rows[:2]] == tokens[[6, 9]].tolist() and rows[2].token == tokens[3] and not any(r.often for r in rows)
    short = simhash.prefixes(spark.createDataFrame([(1, text, 1)], "id bigint, text string, part bigint"), 0.0, 5, frequent).collect()
    assert {r.token for r in short if r.often} == {tokens[8]}


def test_shingles_of_many_texts_are_found_in_a_sample(spark):
    texts = spark.createDataFrame([(i, "a b c d e " + " ".join(f"w{i}x{j}" for j in range(6)), i) for i in range(400)], "id bigint, text string, part bigint")
    found = simhash.frequent_shingles(texts).to_pydict()
    assert found == {"token": simhash.shingle_hashes("a b c d e", 5).view(np.int64).tolist(), "n": [400]}


def test_firsts_of_one_part_go(spark):
    rows = [(t, 10 * t + i, 10 * t + (i if t % 3 else 0), 10, 0, False) for t in range(40) for i in range(t % 5 + 1)]
    shared = simhash.shared_firsts(spark.createDataFrame(rows, "token bigint, id bigint, part bigint, size int, place int, often boolean"))
    want = {(t, i, t % 5 + 1) for t, i, *_ in rows if t % 3 and t % 5}
    assert {(r.token, r.id, r.n) for r in shared.collect()} == want and shared.count() == len(want)


def test_cell_pairs_by_size():
    sizes = np.array([8, 9, 10, 12, 15, 30])
    ids, none = np.arange(6), np.full(6, -1)
    a, b, *_ = simhash.cell_pairs(np.zeros(6, np.int64), ids, sizes, np.zeros(6, np.int64), ids, np.full(6, 9), none, 0.8)
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(i, j) for i in range(6) for j in range(i + 1, 6) if sizes[i] >= 0.8 * sizes[j]}


def test_near_copies_share_enough_first_shingles():
    draw = random.Random(8)
    for _ in range(3000):
        n, m = draw.randint(0, 60), draw.randint(0, 60)
        pool = draw.sample(range(10**6), n + m)
        common = draw.randint(0, min(n, m))
        a, b = sorted(pool[:n]), sorted(pool[n - common : n - common + m])
        both = len(set(a) & set(b))
        if both >= 0.8 * (len(a) + len(b) - both) and both:
            firsts = [set(x[: len(x) - int(np.ceil(0.8 * len(x) - 1e-9)) + 1]) for x in (a, b)]
            assert len(firsts[0] & firsts[1]) >= simhash.least_common(np.array([len(a)]), np.array([len(b)]), 0.8)[0]


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    """The keys of the nodes' masks go through a shuffle, whatever size Spark takes them for."""
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(40)]
    values = {x ^ (1 << draw.randrange(64)) for x in base} | set(base)
    spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(sorted(values))], "id long, fp long").write.parquet(f"{tmp_path}/nodes")
    found = simhash.fingerprint_links(spark.read.parquet(f"{tmp_path}/nodes"), 6)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert len({(min(r), max(r)) for r in found.collect()}) >= 35


def test_overlaps_with_substitutions(spark):
    item = words(50, 30).split()
    inside = words(51, 20).split() + item[5:25] + words(52, 20).split()
    swapped = list(item[:13])
    swapped[4] = swapped[9] = "zzz"
    broken = list(item[:13])
    broken[2] = broken[6] = broken[10] = "zzz"
    texts = [(1, " ".join(inside).upper()), (2, ", ".join(swapped)), (3, " ".join(broken)), (4, words(53, 40)), (5, None), (6, ""), (7, "short item of six words here"), (7, "short item of six words here"), (None, " ".join(item))]
    bench = [(1, " ".join(item)), (2, "short item of six words"), (3, "of six"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    found = decontam.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.best) for r in found.collect()} == {
        (1, 1): (20 - 2, 40 + 2, 13), (2, 1): (0, 13, 11), (7, 2): (0, 5, 5), (None, 1): (0, 30, 13)}
    left = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontam.overlaps(docs.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_overlaps_hold_pieces_of_texts_only(spark, monkeypatch):
    """Hits carry a bounded part of the text, items of equal words are searched once, and seeds in lots or joined blocks find the same."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    bodies = [[draw.choice(vocabulary) for _ in range(n)] for n in (5, 12, 13, 64, 65, 76, 90, 300)]
    bench = [(i, " ".join(x)) for i, x in enumerate(bodies)] + [(100 + i, " ".join(x).upper()) for i, x in enumerate(bodies)] + [(3, " ".join(bodies[0])), (None, " ".join(bodies[1]))]
    texts = []
    for k in range(60):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        for x in draw.sample(bodies, 2):
            a = draw.randint(0, max(0, len(x) - 13))
            piece = x[a : a + draw.randint(10, 200)]
            for _ in range(draw.randint(0, 4)):
                piece[draw.randrange(len(piece))] = "zzz"
            text += piece * draw.randint(1, 3)
        texts.append((k, " ".join(text)))
    want = {}
    for doc, text in texts:
        d = text.split()
        for item, body in bench:
            b = body.lower().split()
            w = min(13, len(b))
            need = w if w < 13 else 11
            for shift in range(-len(b) + w, len(d) - w + 1):
                for s in range(max(0, -shift), min(len(b), len(d) - shift) - w + 1):
                    agree = sum(b[j] == d[j + shift] for j in range(s, s + w))
                    if agree >= need:
                        was = want.get((doc, item), (10**9, 0, 0))
                        want[doc, item] = (min(was[0], s + shift), max(was[1], s + shift + w), max(was[2], agree))
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = {}
    hits = decontam._hits
    seen = []
    monkeypatch.setattr(decontam, "_hits", lambda *a: seen.append(hits(*a)) or seen[-1])
    for seeds, blocks in ((10**6, 10**6), (200, 0)):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", seeds)
        monkeypatch.setattr(decontam, "BROADCAST_BLOCKS", blocks)
        found = {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.best) for r in decontam.overlaps(docs, items).collect()}
        assert found == want and len(want) > 100
    assert len(seen) > 3
    assert max(seen[0].select(F.max(F.size("piece"))).first()) <= decontam.BLOCK_WORDS + 2 * (decontam.WINDOW - 1)
    assert decontam.decontaminate(docs, items).count() == len(texts) - len({doc for doc, _ in want})


def test_masks_cover_every_pair_of_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(all(s + p not in (a, b) for p in m) for m in decontam.MASKS for s in range(13 - max(m)))


def test_pieces_round_trip_and_best_path(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs, path)
    for r in pieces.decode(coded, path).collect():
        assert r.decoded == (r.text or "") and bool(r.piece_ids) == bool(r.text)
    vocabulary = pieces.Pieces(path)

    def best(word: str) -> float:
        top = [0.0]
        for end in range(1, len(word) + 1):
            top.append(max([top[end - 1] + vocabulary.unknown_score] + [top[s] + vocabulary.pieces[word[s:end]][0] for s in range(end) if word[s:end] in vocabulary.pieces]))
        return top[-1]

    marked = sorted({pieces.MARK + w for r in docs.collect() for w in (r.text or "").split()[:60]})
    score = {i: s for s, i in vocabulary.pieces.values()}
    for word, ids in zip(marked, pieces.viterbi(marked, vocabulary)):
        if all(i in score for i in ids):
            assert sum(score[i] for i in ids) == pytest.approx(best(word))


def test_language_models(spark):
    def text(seed: int, letters: str) -> str:
        draw = random.Random(seed)
        return " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(40))

    rows = [(i, text(i, "aeioulmn" if i % 2 else "kstrxyzw"), "one" if i % 2 else "two") for i in range(60)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text"))
    asked = spark.createDataFrame([(1, text(900, "aeioulmn"), 5.0), (2, text(901, "kstrxyzw"), 5.0), (3, None, 5.0), (4, "", 5.0), (5, "12 34 !", 5.0), (6, "LUMEN" * 4000, 5.0)], "doc_id long, text string, score double")
    found = {r.doc_id: r for r in langid.identify(asked, models).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["one", "two", "und", "und", "und", "one"]
    assert all(0 <= r.score <= 1 for r in found.values())
    # Probabilities of all symbols after a context sum to one, the floor for unseen ones included.
    symbols = np.unique(langid.ngrams([r[1] for r in rows], 4)[0] & 0xFFFF)
    context = int(langid.ngrams([rows[1][1]], 4)[0][10]) >> 16 << 16
    p = np.exp2(-models.bits(np.array([context | int(s) for s in symbols])))[0]
    assert p.sum() + models.floor * 0.5 >= 0.99 - models.floor and p.sum() <= 1 + 1e-9
    assert langid.fit(asked.select(F.lit(None).cast("string").alias("lang"), "text")) is None
    assert {r.lang_pred for r in langid.identify(asked, None).collect()} == {"und"}


def test_large_language_models_keep_their_order(spark, docs):
    langs = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    training = docs.where("doc_id IS NOT NULL").select(langs.alias("lang"), "text")
    extra = [(900, None), (901, ""), (902, "123 ..."), (903, "zq"), (903, "zq"), (904, "ÄÖ \U00010400 word w"), (None, "alpha")]
    asked = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    small, large = langid.fit(training), langid.fit(training, max_rows=10)
    assert isinstance(small, langid.Models) and small.order == large.order == langid.ORDER
    order = lambda r: (str(r.doc_id), str(r.text), r.lang_pred)
    want, found = (sorted(langid.identify(asked, m).collect(), key=order) for m in (small, large))
    assert len(want) == len(found)
    for w, f in zip(want, found):
        assert (w.doc_id, w.text, w.lang_pred, w.chars) == (f.doc_id, f.text, f.lang_pred, f.chars)
        assert w.score == pytest.approx(f.score) and (w.bits is None) == (f.bits is None)
        assert w.bits is None or w.bits == pytest.approx(f.bits)


def test_token_store_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = tokenfiles.write_store(docs, str(tmp_path / "store"), path)
    tokenizer = tokenfiles.WordEncoder(path).tokenizer
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfiles.read_store(spark, str(tmp_path / "store"), shards).collect()), key=lambda x: x[1]) == want
    assert tokenfiles.read_store(spark, str(tmp_path / "none"), tokenfiles.write_store(docs.limit(0), str(tmp_path / "none"), path)).count() == 0


def test_encoder_equals_the_library():
    encoder = tokenfiles.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    texts = ["", " ", "a\n b\tc \n\n d", "don't  stop,now!  ok.", "\n\nfoo bar\n", "a <|endoftext|> b", "one.\nTwo three\nfour "]
    texts += ["".join(draw.choice(" \n\tab.,!'é你1  ") for _ in range(draw.randint(0, 30))) for _ in range(500)]
    # Words, line starts and white space that come again in later calls, where they stand in memory.
    parts = ["a", "foo", "x.\n", "don't", "'s", "A's", "é", "1２", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\u3000", "|", ";", "<|endoftext|>"]
    texts += ["".join(draw.choices(parts, k=draw.randint(0, 10))) for _ in range(5000)]
    for start in range(0, len(texts), 250):
        step = texts[start : start + 250]
        assert encoder.encode(step) == encoder.whole(step)
    assert np.frombuffer(encoder.encode(["a foo"])[0], encoder.kind).tolist() == encoder.tokenizer.encode("a foo", add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KNOWN_WORDS", 50)
    encoder = tokenfiles.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for start in range(0, 400, 20):
        step = [f"w{chr(97 + i % 26)}{i} again.\nline {i}" for i in range(start, start + 20)]
        assert encoder.encode(step) == encoder.whole(step)


def test_secrets(spark):
    key = "AKIA" + "Q7" * 8
    odd = "x9Kd82LmQz71PvRt64WnYb35"
    texts = [(1, f'é password = "hunter2hunter" {key}', 0), (2, "token: short", 0), (3, "0123456789abcdef" * 2, 0), (4, f"see {odd} here", 0), (5, None, 0), (6, "", 0), (7, "123e4567-e89b-12d3-a456-426614174000", 0), (4, f"see {odd} here", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, spans int")
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    assert found == {1: [("assign", 2, 27), ("access", 29, 49)], 2: [], 3: [("hex", 0, 32)], 4: [("entropy", 4, 28)], 5: [], 6: [], 7: []}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[4] == "see [SECRET] here" and clean[2] == "token: short" and clean[5] is None


def test_a_key_beside_what_is_allowed():
    key, letters = "x9Kd82LmQz71PvRt64WnYb35", "xQkdRzLmTvQzWpPvKtBgWnYbHs"
    for before in ("backups/2024-01-05/", "123e4567-e89b-12d3-a456-426614174000/", "EXAMPLE/", "0123456789/", "abcdefghijklm/"):
        text = f"see {before}{key} here"
        assert any(a <= text.index(key) and b == text.index(key) + len(key) for a, b, _ in secrets.all_spans(text)), before
    assert secrets.all_spans(f"see {letters} here") == [(4, 4 + len(letters), 3)]
    plain = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "backups/2024-01-05/daily-summary/customers", "getCustomerOrderSummaryByIdentifier", "docs/articles/long-path-names/figures/index"]
    for text in plain:
        assert secrets.all_spans(text) == [], text


@pytest.mark.parametrize("width, least", [(5, 1.5), (8, 2.9)])
def test_entropy_windows_against_plain_count(width, least):
    draw = random.Random(9)
    for _ in range(40):
        text = "".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 40)))
        cells = set()
        for s in range(len(text) - width + 1):
            counts = Counter(text[s : s + width]).values()
            if -sum(c / width * np.log2(c / width) for c in counts) >= least - 1e-9:
                cells |= set(range(s, s + width))
        assert {i for a, b in secrets.entropy_windows(text, width, least) for i in range(a, b)} == cells


def test_url_filter(spark):
    urls = ["http://A.example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/", "example.com/en/", None, "ftp://net", "http://n.net/fr/#a", "http://badnet/es/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    for max_bits in (urlfilter.MAX_BITS, 0):
        found = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, max_bits=max_bits).collect()}
        want = [("a.example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"), ("x.net", "net/es/", "block"), ("x.net", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("net", None, "allow"), ("n.net", "net/fr/", "block"), ("badnet", None, "allow")]
        assert [found[i] for i in range(len(found))] == want * 2
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(4000).selectExpr("CAST(id AS STRING) AS key", "id % 7 = 0 AS listed")
    levels = urlfilter.cascade(universe)
    assert len(levels) > 1
    assert universe.where(urlfilter.member(levels, F.col("key")) != F.col("listed")).count() == 0


def test_levels_stay_small_beside_many_unlisted_keys(spark):
    universe = spark.range(60_000).selectExpr("CAST(id AS STRING) AS key", "id % 2000 = 0 AS listed")
    levels = urlfilter.cascade(universe)
    assert all(level.bits <= levels[0].bits for level in levels[1:]) and levels[0].bits < 1_000
    assert universe.where(urlfilter.member(levels, F.col("key")) != F.col("listed")).count() == 0
    many = spark.range(4000).selectExpr("CAST(id AS STRING) AS key", "id >= 40 AS listed")
    assert urlfilter.cascade(many, max_bits=urlfilter.shape(3960, urlfilter.FIRST_RATE)[1]) is not None
    assert urlfilter.cascade(many, max_bits=urlfilter.shape(3960, urlfilter.FIRST_RATE)[1] - 1) is None


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_repeats(spark, group_rows):
    passage, draw = words(70, 12), random.Random(4)
    rows = [(i, words(100 + i, draw.randint(0, 60)) + " " + passage[: draw.randint(10, len(passage))] + words(300 + i, 10)) for i in range(40)]
    rows += [(40, "ab " * 100), (41, "é" * 60), (42, None), (43, ""), (44, passage), (45, passage), (45, passage), (None, passage[3:40])]
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(x[i : i + 24] for x in data for i in range(len(x) - 23))
    want = Counter()
    for (i, _), x in zip(rows, data):
        gone = bytearray(len(x))
        for s in range(len(x) - 23):
            if counts[x[s : s + 24]] > 1:
                gone[s : s + 24] = b"\1" * 24
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        want[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    found = repeats.remove_repeats(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_spans int"), 24, 6, group_rows=group_rows)
    assert Counter(map(tuple, found.collect())) == want


def test_quality(spark):
    bad = lambda i: " ".join(w.upper() + "!!" for w in words(i, 80).split())
    rows = [(i, words(i, 80) if i % 2 else bad(i), float(i)) for i in range(80)] + [(100, None, 0.0), (101, "", 0.0), (102, words(5, 6000), 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(0, None, 0), (3, 1, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.add_scores(docs, model).collect()}
    assert all(found[i].predicted == i % 2 for i in range(60, 80)) and found[102].predicted == 1
    assert all(0 <= r.score <= 1 for r in found.values()) and found[102].passages == 94
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(1, 80, 2))
    assert quality.add_scores(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_nearest_codes_are_exact(spark):
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((400, 16))
    vectors[10:30] = vectors[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [1.0, None] + [0.0] * 14, 0), (403, [float("nan")] * 16, 0), (404, [float("inf")] + [1.0] * 15, 0), (405, [1.0, 2.0], 0), (500, [2.0, 2.0], 0), (None, [1.0] * 16, 0), (200, vectors[200].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found: dict[int, list] = {}
    for r in ann.nearest_codes(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 100, 300):
        far = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in [*enumerate(vectors), (200, vectors[200])] if i != q)
        assert [i for i, _ in found[q]] == [i for _, i in far[:10]]
        assert [s for _, s in found[q]] == pytest.approx([d for d, _ in far[:10]])
    assert found[500] == [(405, 1.0)]
    assert ann.nearest_codes(table.limit(0), table).count() == 0
    assert len(found[200]) == 10


def test_codes_rule_out_most_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.embedding is not None]
    vectors, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = ann.nearest_codes(table, table.where("vec_id % 100 = 0")).collect()
    found, compared = {}, {r.query_id: r.compared for r in got}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in found:
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    share = sum(compared.values()) / (len(found) * (len(ids) - 1))
    assert hits >= 0.99 * 10 * len(found), hits
    assert share < 0.5, share


def test_helper_columns_do_not_clash(spark):
    fields = ", ".join(f"{c} string" for c in ("_id", "_hash", "_key", "_lang", "_mean", "_spread", "_redacted", "_in", "_listed", "_i", "_h", "row", "id", "key", "own", "sign"))
    base = words(1, 60)
    rows = [(1, base), (2, base + " more"), (3, "token: abcdefgh12345678 stays"), (3, "token: abcdefgh12345678 stays"), (4, None), (None, "x")]
    docs = spark.createDataFrame([(i, t, f"http://a.net/es/{i}", *["kept"] * 16) for i, t in rows], f"doc_id long, text string, url string, {fields}")

    def same(df, n):
        got = df.collect()
        assert len(got) == n and all(r[c] == "kept" for r in got for c in docs.columns[3:])
        return got

    assert sorted(str(r.doc_id) for r in same(simhash.drop_near_copies(docs), 4)) == ["1", "3", "4", "None"]
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in same(decontam.decontaminate(docs, items), 4)) == ["3", "3", "4", "None"]
    assert sum("[SECRET]" in (r.text or "") for r in same(secrets.redact(docs), 2 * 3)) == 2
    for bits in (urlfilter.MAX_BITS, 0):
        assert {r.verdict for r in same(urlfilter.filter_urls(docs, max_bits=bits), 6)} == {"block"}
    taught = spark.createDataFrame([("en", words(5, 90)), ("de", words(6, 90).upper())], "lang string, text string")
    for most in (0, 10**6):
        models = langid.fit(taught, max_rows=most)
        told = langid.identify(docs, models)
        assert {r.rejected for r in same(langid.calibrated(told, told), 6)} <= {True, False}
