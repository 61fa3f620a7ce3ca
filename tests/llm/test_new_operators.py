"""Conversation repair, hard negatives and license scans against brute-force versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.llm import licenses, negatives, queries, repair

CONVERSATIONS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        trimmed = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Dijkstra over (row, what is expected), by cost, then letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(rows) and roles in ("", "ua"):
            return cost, audit, lines
        # What counts of the past: nothing, a system row, an open user row, a closed pair.
        after = lambda x: x if re.fullmatch("s?u?|ua", x) and x not in ("su",) else "u" if x in ("su", "uau") else None
        for role in ("user", "assistant"):
            new = after(roles + role[0])
            if new is not None:
                heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*lines, f"{role}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                new = after(roles + (role[:1] or " "))
                if new is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, new, (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    new = after(roles + other[0])
                    if new is not None:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, new, (*lines, f"{other}:{text}")))


def plain_digest(rows):
    result, convs = [], {r[0] for r in rows}
    left = plain_damage(rows)
    for conv in convs:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = plain_faults(mine)
        cost, audit, lines = plain_repair(mine, faults)
        turns = {r[1] for r in mine if r[1] is not None}
        illegal = sum((a[2][:1] or " ") + (b[2][:1] or " ") not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        result.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def conversations(seed=3):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Hello.", "Yes!", "no", "", None, "  \n", "Why? ", "ends…", "é.\t\x0b", "a.b", "x " * 2000 + "."]
    rows = [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None), (7, None, "user", "q."), (7, None, "user", "q."), (7, 1, "user", "q.")]
    rows += [(8, 2, "user", "same."), (8, 2, "user", "same."), (8, 2, "user", "same."), (8, 5, "assistant", "x.")]
    for conv in range(20, 90):
        rows += [(conv, draw.choice([t, t, t + 1]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.7 else f"{t} said.") for t in range(draw.randint(1, 12))]
    for t in range(160):
        rows.append((5, t, ["user", "assistant"][t % 2] if t % 9 else "system", f"turn {t}."))
    return rows


@pytest.mark.parametrize("segment_rows", [3, repair.SEGMENT_ROWS])
def test_repair_equals_brute_force(spark, segment_rows):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("whole", F.lit("clash")).withColumn("_conv", F.lit(1))
    found = repair.digest(df, repair.repair(repair.damaged(df), segment_rows))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == plain_digest(rows)


def test_search_takes_the_least_of_the_cheapest():
    for text, want in [("", (0, "")), ("u", (3, "KI")), ("a", (3, "IK")), ("s", (4, "D")), ("ss", (6, "KIR")), ("uu", (3, "KR")), ("aua", (3, "IKKK")), ("sua", (0, "KKK")), ("usua", (3, "KRKK"))]:
        assert repair.cheapest_edits([(x, 0) for x in text]) == want, text


def test_search_equals_brute_force_on_every_short_list():
    for n in range(5):
        for initials in itertools.product("sua ", repeat=n):
            for cut in range(2**n):
                rows = [(0, i, {"s": "system", "u": "user", "a": "assistant", " ": " "}[x], f"{i}") for i, x in enumerate(initials)]
                faults = ["truncated" if cut >> i & 1 else None for i in range(n)]
                cost, audit, _ = plain_repair(rows, faults)
                assert repair.cheapest_edits([(x, 3 if f else 0) for x, f in zip(initials, faults)]) == (cost, audit)


def test_repaired_rows_are_well_formed(spark):
    df = spark.createDataFrame(conversations(9), CONVERSATIONS)
    rows = repair.repaired_rows(repair.repair(repair.damaged(df), 4)).orderBy("conv_id", "part", "seq", "place").collect()
    for _, part in itertools.groupby(rows, key=lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in part))


def test_empty_conversations(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert repair.digest(df, repair.repair(repair.damaged(df))).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "x.")], CONVERSATIONS)
    assert [tuple(r) for r in repair.digest(df, repair.repair(repair.damaged(df))).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def plain_negatives(rows):
    kept = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in kept if len(c[2]) == len(a[2])))
        positives = [(p, -s) for s, p, lab in scored if lab == a[1] and p != a[0]][:5]
        for p, score in positives:
            fits = [(-s, c) for s, c, lab in scored if lab != a[1] and 30 * score <= -100 * s <= 90 * score][:10]
            out += [(a[0], p, r, c, score, s) for r, (s, c) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, draw.randint(0, 2), [draw.choice([draw.uniform(-1, 1), 0.5]) for _ in range(11)]) for i in range(240)]
    rows += [(300, 1, [3.0, -2.5]), (301, 1, [100.0, 4.0]), (302, 0, [2.0, 0.0]), (303, 0, [-1.0, 0.0]), (400, 1, [0.0] * 11), (401, 1, [0.25] * 11), (402, 1, [0.25] * 11)]
    rows += [(5, 1, [0.5] * 11), rows[7], rows[7], (None, 1, [0.1] * 11), (500, None, [0.1] * 11), (600, 1, None), (601, 1, [None] * 11), (602, 1, [math.nan] * 11), (603, 1, [math.inf] * 11), (604, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("lot", F.lit(0))
    want = plain_negatives(rows)
    assert len(want) > 20
    for sizes in ((1 << 20, 1 << 23, 32), (900, 3_000, 2)):
        for name, size in zip(("BLOCK_BYTES", "LOT_BYTES", "GROUP_BLOCKS"), sizes):
            monkeypatch.setattr(negatives, name, size)
        found = negatives.hard_negatives(df, F.col("id") % 100 == 0)
        assert sorted(map(tuple, found.collect())) == want
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_lookups_give_exact_scores():
    draw = np.random.default_rng(1)
    for dim, most in ((1, 3), (8, 300), (13, 1 << 25), (64, 256)):
        parts = draw.integers(-most, most, (50, dim))
        planes = negatives.bit_planes(parts, most.bit_length() + 1).astype(np.intp)
        for a, sums in zip(parts, negatives.subset_sums(parts)):
            assert (negatives.scores(sums, planes) == parts @ a).all()


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_licenses(rows, templates, block_words, threshold=0.8):
    out = []
    for doc, text in rows:
        w = plain_words(text)
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        labels, best, step = {x[1] for x in places}, 0.0, block_words // 2
        for label, body in templates:
            need = set(plain_words(body))
            for s in range(0, len(w), step):
                part = len(need & set(w[s : s + 2 * step])) / len(need) if need else 0
                if need and part >= threshold - 1e-9:
                    labels, best = labels | {label}, max(best, part)
        starts = [x[0] for x in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[1] for x in places})), ",".join(sorted(labels)), 1.0 if places else best))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [8, licenses.BLOCK_WORDS])
def test_licenses_equal_brute_force(spark, block_words):
    draw = random.Random(2)
    common = "the of software this work mit is license general rights cc by public all reserved under 2 version é".split()
    rows = [(i, " ".join(draw.choice(common) for _ in range(draw.randint(1, 120)))) for i in range(120)]
    for label, text in licenses.TEMPLATES:
        kept = [x for x in text.split() if draw.random() < 0.95]
        rows.append((200 + len(rows), " ".join([*draw.choices(common, k=draw.randint(0, 70)), *kept, "end"])))
    rows += [(1, None), (2, ""), (3, "CC-BY cc by\nAll  rights, reserved"), (3, "CC-BY cc by\nAll  rights, reserved"), (None, "Released under the MIT License."), (None, None), (4, "word " * 50_000 + "Released under the MIT License"), (5, "K " + "cc\x7fby"), (6, "..."), (7, "Kİ MİT")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("_id", F.lit("x"))
    templates = [*licenses.TEMPLATES, ("none", "..."), ("one", "unencumbered"), ("again", "MIT mit License")]
    found = licenses.digest(licenses.scan_licenses(df, spark.createDataFrame(templates, "label string, text string"), block_words=block_words))
    assert sorted(map(tuple, found.collect()), key=str) == plain_licenses(rows, templates, block_words)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert sorted(map(tuple, licenses.digest(licenses.scan_licenses(df, spark.createDataFrame([], "label string, text string"))).collect()), key=str) == plain_licenses(rows, [], 64)


def test_repair_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_conversation_repair"](spark, path).collect()), key=str) == plain_digest(rows)


def test_text_with_the_mark_and_all_stand_ins():
    import public_tokenizers

    from tallywatch.llm import pieces

    vocabulary = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = "a " + pieces.MARK + "".join(pieces._STAND_INS) + " b"
    ids = np.frombuffer(pieces.Encoder(vocabulary).encode([text])[0], "<i4")
    assert b"".join(vocabulary.content[i] for i in ids)[1:].decode() == text
