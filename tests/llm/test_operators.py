"""Each operator on small tables with nulls, empties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.llm import bpe_codec, chat_quotes, dart_dedup, langid, pii, quality_qda, quality_rules, repeats, rlz_dedup, suffix_dedup, tiling_decontam

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kd long, kt long, node string, __kd string, __text string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 0, 1, 2, "n", "x", "y") for d, t in rows], DOCS)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = [text(60), text(45), text(80)]
    rows = [(i, text(rnd.randrange(0, 150))) for i in range(n)]
    for i in range(n, 2 * n):
        t = rnd.choice(rows)[1] if rnd.random() < 0.3 else text(rnd.randrange(0, 90)) + "\n" + rnd.choice(passage) + " " + text(rnd.randrange(0, 90))
        rows.append((i, t))
    long_ = text(400).split()
    for i in range(2 * n, 2 * n + 12):  # near copies
        w = list(long_)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows + [(10_000, None), (10_001, ""), (10_002, "ab"), (None, passage[0] * 2), (10_003, "x y " * 300), (10_003, "x y " * 300), (10_004, "é" * 500)]


def windows(rows, size, units):
    seen = Counter()
    all_ = [units(t or "") for _, t in rows]
    for x in all_:
        seen.update(x[i : i + size] for i in range(len(x) - size + 1))
    for (d, _), x in zip(rows, all_):
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        yield d, x, gone


@pytest.mark.parametrize("group", [4096, 3])
def test_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus(1)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect())
    want = Counter((d, len(x), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(b for b, f in zip(x, g) if not f)) for d, x, g in windows(rows, 200, str.encode))
    assert got == want


@pytest.mark.parametrize("group", [4096, 3])
def test_words(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus(2)
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in rlz_dedup.remove_repeated_words(frame(spark, rows)).collect())
    want = Counter((d, len(x), sum(g), b" ".join(w for w, f in zip(x, g) if not f)) for d, x, g in windows(rows, 35, lambda t: tuple(t.encode().split())))
    assert got == want


def test_twin_chunks(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    texts = [[word() for _ in range(120)] for _ in range(12)]
    twins = [(i, " ".join(t)) for i, t in enumerate(texts)]
    parts = [(100 + i, " ".join([*(word() for _ in range(60)), *t[30:100], *(word() for _ in range(60))])) for i, t in enumerate(texts)]
    rows = twins + twins + parts
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")  # two partitions of equal rows
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(table).collect())
    assert got == Counter((d, sum(g), bytes(b for b, f in zip(x, g) if not f)) for d, x, g in windows(rows, 200, str.encode))
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in rlz_dedup.remove_repeated_words(table).collect())
    assert got == Counter((d, sum(g), b" ".join(w for w, f in zip(x, g) if not f)) for d, x, g in windows(rows, 35, lambda t: tuple(t.encode().split())))


def test_deep_shallow_order():
    import numpy as np

    rnd = random.Random(4)
    items = [b"ab" * rnd.randrange(0, 40) + bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(0, 9))) for _ in range(300)]
    group = np.array([i % 3 for i in range(300)])
    order, lcp = suffix_dedup.deep_shallow(items, group)
    assert [(group[i], items[i]) for i in order] == sorted(zip(group, items))
    for k in range(1, 300):
        a, b = items[order[k - 1]], items[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_deep_shallow_group_starts_at_the_shallow_depth():
    import numpy as np

    stem = bytes(range(65, 65 + suffix_dedup.SHALLOW))
    items = [stem, stem + b"zz", stem + b"ab", stem + b"abc", stem + b"ab", stem[:-1], stem]
    order, lcp = suffix_dedup.deep_shallow(items, np.zeros(len(items), np.int64))
    assert [items[i] for i in order] == sorted(items)
    assert lcp.tolist() == [-1, 27, 28, 28, 30, 30, 28]


def test_bytes_left_of_a_block_that_starts_at_the_shallow_depth():
    import numpy as np

    rnd = random.Random(8)
    body = bytes(rnd.randrange(256) for _ in range(400))
    q = 150
    # the first holds exactly SHALLOW symbols left of the anchor, the others share 150; all are equal right of it
    p = np.array([suffix_dedup.SHALLOW, q + 1, q + 1])
    contents = [c[: k + suffix_dedup.WINDOW] for c, k in zip([body[q - suffix_dedup.SHALLOW :], b"x" + body, b"y" + body], p)]
    n = p + 1
    marks = suffix_dedup.solve(np.zeros(3, np.int64), np.ones(3, np.int64), n, p, contents)
    seen = Counter(c[i : i + suffix_dedup.WINDOW] for c in contents for i in range(len(c) - suffix_dedup.WINDOW + 1))
    for c, m in zip(contents, marks):
        assert m.tolist() == [seen[c[i : i + suffix_dedup.WINDOW]] > 1 for i in range(len(m))]


@pytest.mark.parametrize("block", [2000, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(dart_dedup, "BLOCK", block)
    rows = corpus(3)
    got = dart_dedup.classes(frame(spark, rows)).collect()
    bag = []
    for d, t in rows:
        w = (t or "").encode().split()
        bag.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, total = sum((bag[i] & bag[j]).values()), sum((bag[i] | bag[j]).values())
            if total and both >= 0.8 * total:
                root[find(i)] = find(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    want = Counter((d, min((x for x in members[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    kept = dart_dedup.deduplicate(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(members) - 0
    assert dart_dedup.classes(frame(spark, [])).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    import numpy as np

    from matchloom.llm.seqanchor import U64, mix

    rnd = np.random.default_rng(5)
    names = mix(np.arange(1, 401, dtype=U64))
    for heavy in (1, 40):
        x, y = rnd.integers(0, heavy + 1, 400), rnd.integers(0, heavy + 1, 400)
        y = np.where(rnd.random(400) < 0.7, x, y)
        agree = []
        for s in range(30):
            e, doc, w = np.concatenate([mix(names + U64(s))] * 2), np.repeat([0, 1], 400), np.concatenate([x, y])
            sig = dart_dedup.signatures(e[w > 0], doc[w > 0], w[w > 0], 2)
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


def test_streams_follow_regions_not_weight():
    import time

    import numpy as np

    one = np.array([7], dtype=np.uint64)
    began = time.process_time()
    dart_dedup.signatures(one, np.array([0]), np.array([50_000_000]), 1)
    assert time.process_time() - began < 2


def test_hot_bucket_of_texts_that_are_not_near(spark):
    """Texts that share most words but are under the threshold: nothing is linked but what should be."""
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    stem = [word() for _ in range(300)]
    rows = [(k, " ".join(stem[:230] + [word() for _ in range(60)])) for k in range(120)]
    rows += [(200 + k, rows[k][1].rsplit(" ", 3)[0]) for k in range(20)]  # near copies of some
    got = {r.doc_id: r.class_id for r in dart_dedup.classes(frame(spark, rows)).collect()}
    bag = {d: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    near = lambda a, b: sum((bag[a] & bag[b]).values()) >= 0.8 * sum((bag[a] | bag[b]).values())
    assert not near(0, 1) and near(0, 200)
    assert got == {d: d - 200 if d >= 200 else d for d, _ in rows}


def test_recall_of_pairs_at_the_threshold():
    """Share of pairs of similarity 0.8 to 0.83 that have a band in common, measured; the formula says 0.9998 at 0.8."""
    import numpy as np

    from matchloom.llm.seqanchor import U64, mix

    found = []
    for s in range(300):
        same, own = mix(np.arange(1, 91, dtype=U64) + U64(1000 * s)), mix(np.arange(1, 21, dtype=U64) + U64(10**9 + 1000 * s))
        e = np.concatenate([same, own[:10], same, own[10:]])
        keys = dart_dedup.band_keys(dart_dedup.signatures(e, np.repeat([0, 1], 100), np.ones(200, np.int64), 2))
        found.append((keys[0] == keys[1]).any())
    assert np.mean(found) >= 0.99


def test_least_possible_id(spark):
    text = "one two three four five six seven"
    rows = [(-(1 << 63), text), (None, text), (5, text), (None, "other words are here and nothing else")]
    got = Counter((r.doc_id, r.class_id) for r in dart_dedup.classes(frame(spark, rows)).collect())
    assert got == Counter([(-(1 << 63), -(1 << 63)), (None, -(1 << 63)), (5, -(1 << 63)), (None, None)])
    assert sorted((r.doc_id is None, r.text) for r in dart_dedup.deduplicate(frame(spark, rows)).collect()) == [(False, text), (True, rows[3][1])]


def test_tiling():
    import numpy as np

    item = np.arange(1, 41, dtype=np.uint64)
    other = np.arange(1000, 1050, dtype=np.uint64)
    text = np.concatenate([other[:10], item[20:], other[10:20], item[:20], other[20:]])
    assert sorted(tiling_decontam.tile(item, text)) == [(0, 40, 20), (20, 10, 20)]
    assert tiling_decontam.tile(item, other) == []
    assert sum(k for _, _, k in tiling_decontam.tile(item, item[:13])) == 13


def test_leaks(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, "a b")], "item_id long, text string")
    rows = [(1, "x y ONE two, three four five six seven eight nine ten eleven twelve z"), (2, "seven eight nine ten eleven twelve q q one two three four five six"), (3, "one two three four five"), (4, None), (5, "a b"), (1, "x y ONE two, three four five six seven eight nine ten eleven twelve z")]
    got = {(r.doc_id, r.item_id): round(r.coverage, 3) for r in tiling_decontam.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0, (5, 3): 1.0}
    assert sorted(r.doc_id for r in tiling_decontam.decontaminate(frame(spark, rows), bench).collect()) == [3, 4]


def plain_tiles(item, text, least=5):
    """Greedy string tiling by definition: again and again the longest common unmarked run, first places first."""
    used_p, used_t, tiles = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and i + k not in used_p and j + k not in used_t:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return tiles
        k, i, j = best
        tiles.append(best)
        used_p |= set(range(i, i + k))
        used_t |= set(range(j, j + k))


def test_leaks_against_plain_tiling(spark):
    rnd = random.Random(31)
    word = lambda: rnd.choice("the of and a to in was it on he".split()) if rnd.random() < 0.5 else "".join(rnd.choices("abcdef", k=3))
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([12, 25, 40, 7, 5, 4, 3, 1, 0, 30, 30])]
    items[7] = (7, ["zyzzy"])
    rows = []
    for d in range(60):
        text = [word() for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 4)):
            source = rnd.choice(items)[1]
            cut = rnd.randrange(0, len(source) + 1)
            text += rnd.choice([source, source[cut:] + source[:cut], source[: cut or 1], source[::2]]) + [word()]
        rows.append((d, text))
    want = {}
    for d, text in rows:
        for k, item in items:
            tiles = plain_tiles(item, text) if len(item) >= 5 else [(len(item), 0, 0)] * any(text[i : i + len(item)] == item for i in range(len(text))) if item else []
            covered = sum(t[0] for t in tiles) / max(1, len(item))
            if covered >= 0.5:
                want[d, k] = covered
    marks = [" ", ", ", " \u2013 ", "\u201d \u201c", "\u2026 "]  # separators of any script
    texts = [(d, "".join(w.upper() * (rnd.random() < 0.1) or w for w in [x + rnd.choice(marks) for x in t])) for d, t in rows]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling_decontam.leaks(frame(spark, texts), bench).collect()}
    assert len(want) > 20 and any(k in (4, 5, 6, 7) for _, k in want)
    # greedy tiling may break ties between equal runs in another order; who leaks must not change
    assert got.keys() == want.keys() and sum(abs(got[x] - want[x]) > 1e-9 for x in want) <= len(want) // 20


def test_quality(spark):
    rnd = random.Random(6)
    good = lambda: ". ".join(" ".join("".join(rnd.choice("etaoinsh") for _ in range(rnd.randrange(2, 8))) for _ in range(12)) for _ in range(6))
    bad = lambda: " ".join(["spam"] * rnd.randrange(30, 90)) if rnd.random() < 0.5 else " ".join(w + "%%%" for w in good().split())
    rows = [(i, good() if i % 2 else bad()) for i in range(300)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality_qda.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id < 300) >= 0.95 * sum(r.held_out and r.doc_id < 300 for r in got)
    assert {r.score for r in quality_qda.classify(frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.5}
    judged = quality_rules.judge(frame(spark, rows)).collect()
    assert all(r.kept for r in judged if r.doc_id < 300 and r.doc_id % 2) and not any(r.kept for r in judged if r.doc_id % 2 == 0)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_scores_against_plain_densities(spark):
    import math

    import numpy as np

    q, sf = quality_qda, "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: q.measure(r.text) for r in docs.collect()}
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in rows}
    known = [(np.array(rows[r.doc_id]), r.quality) for r in labels.collect() if not held[r.doc_id]]
    x, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-5, scale, 1)
    z = (x - centre) / scale
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))

    def density(v, c):
        s = (1 - q.TO_POOLED - q.TO_IDENTITY) * cov[c] + q.TO_POOLED * pooled + q.TO_IDENTITY * np.eye(len(v))
        d = (v - centre) / scale - z[y == c].mean(0)
        return math.log((y == c).mean()) - 0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1]

    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.held_out == held[r.doc_id] and r.predicted == (r.score >= q.THRESHOLD) for r in got)
    for r in got:
        d = density(np.array(rows[r.doc_id]), 1) - density(np.array(rows[r.doc_id]), 0)
        assert abs(r.score - 1 / (1 + math.exp(-max(-700.0, min(700.0, d))))) < 1e-6
    assert {r.doc_id for r in q.keep_good(docs, labels).collect()} == {r.doc_id for r in got if r.predicted}


def test_rule_counts(spark):
    rows = corpus(8) + [(20_000, "a b c a b c\n\na b c\nq\nq\n" * 40 + "#*$ é x"), (20_001, "a b c"), (20_002, "a b c a b c")]
    got = Counter(tuple(r) for r in quality_rules.judge(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for d, t in rows:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[(d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want


def test_language(spark):
    rnd = random.Random(9)
    part = {"xx": ["ba", "ke", "lo", "mi"], "yy": ["schr", "ung", "ein", "zt"]}
    rows = [(i, " ".join("".join(rnd.choices(part["xx" if i % 2 else "yy"], k=3)) for _ in range(20)), "xx" if i % 2 else "yy") for i in range(200)]
    rows += [(900, None, "xx"), (901, "12 34 !", None), (902, "", None), (903, "bakelo" * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, "doc_id % 4 = 2").collect()}
    assert all(got[d].lang_pred == want for d, _, want in rows if d < 900)
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert {r.lang_pred for r in langid.identify(df.where("lang IS NULL"), "false").collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    voc = langid.vocabulary(None)
    prob = np.random.default_rng(1).random(len(voc.pieces))
    at = {p: i for i, p in enumerate(voc.pieces)}

    def total(s):
        sums = [1.0]
        for j in range(1, len(s) + 1):
            arcs = [(i, max(prob[at[s[i:j]]] if s[i:j] in at else 0.0, langid.UNKNOWN if j - i == 1 else 0.0)) for i in range(max(0, j - voc.reach), j)]
            sums.append(sum(sums[i] * p for i, p in arcs))
        return sums[-1]

    words = ["▁the", "▁station", "x", "▁日z", "▁professional", "▁relationship", "▁" + "relationship日" * 6, "=" * 50]
    got = langid.log_probabilities(words, prob[None], voc)[:, 0]
    assert np.allclose(got, [np.log(total(w)) for w in words], rtol=1e-12)


def test_expected_pieces_against_all_segmentations():
    import numpy as np

    voc = langid.vocabulary(None)
    prob = np.random.default_rng(2).random(len(voc.pieces)) * 1e-2
    at = {p: i for i, p in enumerate(voc.pieces)}

    def cuts(s):
        if not s:
            yield []
        for k in range(1, min(len(s), voc.reach) + 1):
            if s[:k] in at or k == 1:
                yield from ([s[:k], *rest] for rest in cuts(s[k:]))

    words, times = ["▁station", "▁the", "▁日abc"], [3.0, 5.0, 2.0]
    want = Counter()
    for w, n in zip(words, times):
        ways = [(c, np.prod([max(prob[at[x]] if x in at else 0.0, langid.UNKNOWN if len(x) == 1 else 0.0) for x in c])) for c in cuts(w)]
        for c, p in ways:
            for x in c:
                want[at.get(x, -1)] += n * p / sum(q for _, q in ways)
    total = np.zeros(len(voc.pieces) + 1)
    for rows, lat in langid.lattices(words, voc):
        langid.expected(lat, np.array(times)[rows], prob, total)
    assert np.isclose(total[-1], want.pop(-1, 0)) and np.isclose(total.sum() - total[-1], sum(want.values()))
    assert all(np.isclose(total[i], x) for i, x in want.items())


def test_language_has_no_letter_in_numbers_and_learns_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    rows = [(None, f"bake lomi bakelo mi{k}", "xx") for k in range(3000)] + [(None, f"schrung einzt ungzt{k}", "yy") for k in range(20)]
    rows += [(1, "12 ½ ² Ⅷ!", None), (2, "12 ³", None), (3, "einzt schrung", None), (4, "bakelo" * 4000, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "false").collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "yy", "xx"] and got[1].score == 0


def test_personal_data(spark):
    lines = [f"Contact Zorblax about it via zed{k % 2}@mail.example.com please {k}" for k in range(8)]
    rows = [(i, f"{line}\nAnd Plain words follow") for i, line in enumerate(lines)] + [(50 + i, "And Plain words follow, Contact us") for i in range(9)]
    rows += [(100, "a@b.c_x@y.zz.q +1 (555) 010-9999x 300.1.1.1 10.0.0.255 x4111 1111 1111 1111 x 4111-1111-1111-1112"), (101, None), (102, ""), (103, "é+49 30 1234567890 x1.1.1.0000000000000000000001"), (104, "9 " * 4000), (0, rows[0][1])]
    got = pii.find(frame(spark, rows)).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s"), "text").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].b == "email:0:5,email:5:14,phone:15:32,ip:44:54,card:56:75"
    assert by[103].b == "phone:1:18,ip:20:48" and by[101].b == by[102].b == by[104].b == ""
    said = {by[i].text[int(x.split(":")[1]) : int(x.split(":")[2])] for i in range(8) for x in by[i].s.split(",") if x.startswith("term")}
    assert said == plain_terms([x for _, t in rows for x in (t or "").split("\n")]).keys() == set()  # each address has half of few lines
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "<email>" in clean[0] and "@" not in clean[0] and clean[101] is None and clean[104] == rows[-2][1]


def plain_terms(lines):
    """term -> kind, from P(entity | term) over distinct lines, by loops."""
    import math

    import regex

    lines = set(lines)
    entity = regex.compile("|".join([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?<![\w+/=-])(?=(?:[^\s]*\d){5})(?=(?:[^\s]*[A-Za-z]){5})[A-Za-z0-9+/_=-]{20,}"]))
    word, term = regex.compile(pii.WORD), regex.compile(pii.TERM)
    times, both, among, alone, low, mid = Counter(), Counter(), Counter(), Counter(), Counter(), set()
    for x in lines:
        found = set(entity.findall(x))
        times.update(found)
        clean = entity.sub("<mail>", x)
        terms = {w for w in word.findall(clean) if term.match(w)}
        if found:
            among.update(terms)
            both.update((e, t) for e in found for t in terms)
        alone.update(set(word.findall(x)))
        low.update({w for w in word.findall(x) if w == w.lower()})
        last = 0
        for m in (m for m in word.finditer(x) if term.match(m.group())):
            gap = x[last : m.start()]
            if not (regex.search(pii.OPENS, gap) or (last == 0 and regex.search(pii.OPENS_LINE, gap))):
                mid.add(m.group())
            last = m.end()
    out = {}
    for (e, t), n in both.items():
        p = n / max(alone[t], among[t])
        gain = math.log2(p * len(lines) / times[e])
        if n >= pii.SUPPORT and p >= pii.SHARE and (gain >= pii.BITS or (p >= pii.CERTAIN and n * gain >= pii.SUPPORT * pii.BITS)):
            spared = t not in mid and t.lower() != t and low[t.lower()] >= max(pii.SUPPORT, alone[t])
            if not spared:
                out[t] = "term" if p >= pii.CERTAIN or out.get(t) == "term" else "name"
    return out


def disclosed(spark, lines):
    got = pii.find(frame(spark, list(enumerate(lines)))).select(F.explode("spans").alias("x"), "text").where("x.kind IN ('term', 'name')").collect()
    assert all(r.text[r.x["start"] : r.x["end"]] == r.x["value"] for r in got)
    assert {r.x["value"]: r.x["kind"] for r in got} == plain_terms([y for x in lines for y in x.split("\n")])
    return {r.x["value"] for r in got}


def test_disclosure_against_plain_counts(spark):
    rnd = random.Random(21)
    names = ["Zorblax", "Quuxly", "Bramm", "王小明", "ACME", "Dora"]
    lines = []
    for k in range(260):
        who = rnd.randrange(6)
        mail = f"{'abcdef'[who]}@mail.example.com" if rnd.random() < 0.35 else ""
        said = names[who] if rnd.random() < (0.9 if mail else 0.05) else "someone"
        lines.append(f"Thus {said} went home {mail} on day {k}. Then {rnd.choice(names) if rnd.random() < 0.1 else 'nobody'} came")
    found = plain_terms(lines)
    assert found
    assert disclosed(spark, lines) == set(found)


def test_openers_names_and_secrets(spark):
    # `Contact` opens every line of one address, and is an ordinary word by its lower-case form
    lines = [f"Contact a@mail.example.com about {k}" for k in range(4)] + [f"we contact nobody {k}" for k in range(90)]
    assert disclosed(spark, lines) == set()
    assert disclosed(spark, [x.replace("contact", "call") for x in lines]) == {"Contact"}
    # two thirds of Bramm's lines disclose: generalised, not removed; Zorblax's all do
    lines = [f"then Bramm and {k} b@mail.example.com" for k in range(6)] + [f"then Bramm left {k}" for k in range(3)] + [f"so Zorblax {k} token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff" for k in range(4)] + [f"so it went {k}" for k in range(400)]
    assert disclosed(spark, lines) == {"Bramm", "Zorblax"}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, list(enumerate(lines)))).collect()}
    assert (clean[0], clean[7], clean[9]) == ("then <name> and 0 <email>", "then <name> left 1", "so  0 token = <secret>")


def test_long_texts_of_many_spans(spark):
    for sep in ("\n", " "):
        text = sep.join(f"Zorblax zed{k}@mail.example.com said" for k in range(8000))
        r = pii.find(frame(spark, [(1, text)])).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()[0]
        assert r.n == 8000 and text[r.last["start"] : r.last["end"]] == "zed7999@mail.example.com"
        assert pii.sanitise(frame(spark, [(1, text)])).collect()[0].text == sep.join(["Zorblax <email> said"] * 8000)


def test_terms_of_a_frequent_entity(spark):
    hot = [f"Contact Zorblax via hot@mail.example.com about {k}" for k in range(12)]
    rare = [f"Contact Quuxly via rare@mail.example.com about {k}" for k in range(3)]
    rest = [f"Contact us about {k}" for k in range(50)]
    # hot: a third of the lines and 12 of 15 lines with entities, at most 1.6 bits; rare: 3 of 53 lines, 4.1 bits
    assert disclosed(spark, hot + rest[:24]) == {"Zorblax"}
    assert disclosed(spark, rare + rest) == {"Quuxly"}
    assert disclosed(spark, rare + rest[:5]) == disclosed(spark, hot[:3] + rest[:6]) == set()


def test_terms_anywhere_in_the_line_and_of_any_script(spark):
    far = " ".join(["and so it went on"] * 9)
    lines = [f"Zorblax QZX 王小明 Bo {far} far@mail.example.com {far} Ünal {k}\nAbove {k}" for k in range(4)] + [f"And so on other{k}@mail.example.com" for k in range(80)]
    assert disclosed(spark, lines) == {"Zorblax", "QZX", "王小明", "Bo", "Ünal"}
    # the words of an entity are no terms
    assert disclosed(spark, [x.replace("far@mail", "Far@Mail") for x in lines]) == {"Zorblax", "QZX", "王小明", "Bo", "Ünal"}


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there world\nSecond line here"), (1, 1, "assistant", "> Hello there world\n> Second line here\nSure, fine"), (1, 2, "user", "On Monday X wrote:\n>> Hello there world\n> Sure,   FINE\nno way"), (1, 3, "user", "unrelated"), (1, 4, "user", "> Second line here\n> bogus\nhm"), (2, 0, "user", None), (None, 1, "user", "> Sure, fine"), (1, 1, "assistant", "> Hello there world\n> Second line here\nSure, fine")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = Counter((r.conv_id, r.turn, r.text, r.reply_to, r.thread, r.depth) for r in chat_quotes.link(df).collect())
    assert got == Counter([(1, 0, "Hello there world\nSecond line here", None, 0, 0), (1, 1, "Sure, fine", 0, 0, 1), (1, 1, "Sure, fine", 0, 0, 1), (1, 2, "no way", 1, 0, 2), (1, 3, "unrelated", None, 3, 0), (1, 4, "hm", 0, 0, 1), (2, 0, "", None, 0, 0), (None, 1, "", None, 1, 0)])
    assert chat_quotes.link(df.limit(0)).count() == 0


def test_quotes_of_deeper_levels(spark):
    rows = [(1, 0, "first thing said"), (1, 1, "second thing said"), (1, 2, ">> first thing said\nI add this"), (1, 3, ">>> first thing said\n>> unknown words\n> unknown too\nhm"), (1, 4, "> second thing said\n>> first thing said\nyes"), (1, 5, ">> nobody said it\nno")]
    got = {r.turn: r for r in chat_quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: 1, 5: None}
    assert {t: [(x["level"], x["source"]) for x in r.links] for t, r in got.items()} == {0: [], 1: [], 2: [(2, 0)], 3: [(3, 0)], 4: [(1, 1), (2, 0)], 5: []}
    assert {t: (r.thread, r.depth) for t, r in got.items()} == {0: (0, 0), 1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (1, 1), 5: (5, 0)}


def test_long_quotes_of_three_nested_levels(spark):
    lines = [f"line number {k} of the first message" for k in range(50_000)]
    rows = [(1, 0, "\n".join(lines)), (1, 1, "\n".join("> " + x for x in lines) + "\nsecond says this"), (1, 2, "\n".join(">> " + x for x in lines) + "\n> second says this\nthird adds that"), (1, 3, "\n".join(">>> " + x for x in lines[:100]) + "\n>> second says this\n> third adds that\nfourth")]
    got = {r.turn: r for r in chat_quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).select("turn", "text", "reply_to", "thread", "depth", "links").collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: 0, 2: 1, 3: 2}
    assert {t: [(x["level"], x["source"]) for x in r.links] for t, r in got.items()} == {0: [], 1: [(1, 0)], 2: [(1, 1), (2, 0)], 3: [(1, 2), (2, 1), (3, 0)]}
    assert [got[t].text for t in (1, 2, 3)] == ["second says this", "third adds that", "fourth"] and [got[t].depth for t in range(4)] == [0, 1, 2, 3]


def plain_links(rows):
    """(conv, turn) -> reply and links, by loops over messages."""
    out = {}
    said = {}

    def parts(text):
        found = []
        for x in text.split("\n"):
            if re.match(chat_quotes.LEAD, x):
                continue
            mark = re.match(chat_quotes.QUOTE, x)
            level = mark.group(0).count(">") if mark else 0
            own = re.sub(chat_quotes.QUOTE + "[ \\t]?", "", x)
            if found and found[-1][0] == level:
                found[-1][1].append(own)
            else:
                found.append((level, [own]))
        return found

    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip(" ")
    for c, t, text in sorted(rows):
        found = parts(text)
        own = [ls for level, ls in found if level == 0]
        for unit in ["\n".join("\n".join(x) for x in own), *("\n".join(x) for x in own), *(y for x in own for y in x)]:
            said.setdefault((c, norm(unit)), t)
        words = {}
        for level, whole in {(level, norm("\n".join(ls))): ls for level, ls in found if level}.items():
            units = {norm(y) for y in ["\n".join(whole), *whole]} - {""}
            got = {}
            for u in units:
                src = said.get((c, u))
                if src is not None and src < t:
                    got.setdefault(src, {})[u] = len(u.split(" "))
            for src, us in got.items():
                words[level[0], src] = words.get((level[0], src), 0) + us.get(level[1], sum(us.values()))
        near = min((level for level, _ in words), default=None)
        out[c, t] = (max(((n, s) for (level, s), n in words.items() if level == near), default=(0, None))[1], sorted((level, s, n) for (level, s), n in words.items()))
    return out


def test_quotes_against_plain_loops(spark):
    rnd = random.Random(11)
    rows = []
    for c in range(30):
        talk = []
        for t in range(8):
            lines = []
            for _ in range(rnd.randrange(1, 5)):
                if talk and rnd.random() < 0.5:
                    lines += ["> " + x for x in rnd.choice(talk).split("\n")][: rnd.choice([1, 2, 9])]
                else:
                    lines.append(" ".join(rnd.choices("alpha beta gamma delta epsilon zeta".split(), k=rnd.randrange(2, 5))))
            talk.append("\n".join(lines))
            rows.append((c, t, talk[-1]))
    got = {(r.conv_id, r.turn): (r.reply_to, [tuple(x) for x in r.links]) for r in chat_quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == plain_links(rows)


def test_tokens(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    rows = [(1, None), (2, ""), (3, "a" * 5000 + " " * 3000 + "=" * 4000), (4, "x<|endoftext|>y <|endoftext|>"), (5, "naïve日本語 café's\n\n  end ")]
    for k in range(40):
        rows.append((10 + k, "".join(rnd.choice("abcdefgthein") for _ in range(rnd.choice([3000, 9000]))) + " tail" * (k % 3)))
    for r in bpe_codec.digests(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_trees_of_texts_and_pieces(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    library.encode_special_tokens = False
    monkeypatch.setattr(bpe_codec, "LEAF", 8)
    monkeypatch.setattr(bpe_codec, "NEAR", 1)
    codec = bpe_codec.Codec(public_tokenizers.path(bpe_codec.RANKS), public_tokenizers.PATTERN)
    bits = ["the", " ", "  ", "\n", "\n\n ", "'re", "it's", "'", "é", "日本", "😀", "12", "$$", " a", "\t", "\x1c", "\xa0", "hello", "ing", "aaaaaaaa", "<|endoftext|>", "=", "٣"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(0, 60))) for _ in range(1500)] + ["".join(rnd.choices("abcde", k=700)), " " * 600 + "x", "日本" * 300, "😀" * 400 + " end"]
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert codec.joins > 5000


def test_repeats_over_many_answering_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ENTRIES", 1)  # as many groups as entries: over a thousand
    monkeypatch.setattr(repeats, "GROUP", 3)
    rows = corpus(5, 40)
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect())
    assert got == Counter((d, sum(g), bytes(b for b, f in zip(x, g) if not f)) for d, x, g in windows(rows, 200, str.encode))
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in rlz_dedup.remove_repeated_words(frame(spark, rows)).collect())
    assert got == Counter((d, sum(g), b" ".join(w for w, f in zip(x, g) if not f)) for d, x, g in windows(rows, 35, lambda t: tuple(t.encode().split())))


def test_multikey_quicksort():
    import numpy as np

    rnd = np.random.default_rng(3)
    keys, group = rnd.integers(0, 4, (500, 4)).astype(np.uint64), rnd.integers(0, 7, 500)
    order, seg = suffix_dedup._multikey_quicksort(keys, group)
    rows = [(int(group[i]), *map(int, keys[i])) for i in order]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(seg, seg[1:])] == [a == b for a, b in zip(rows, rows[1:])]


def test_factor_is_the_longest_of_all_places():
    import numpy as np

    rnd = np.random.default_rng(4)
    stem = rnd.integers(1, 1 << 60, 60).astype(np.uint64)
    other = lambda: rnd.integers(1, 1 << 60, 60).astype(np.uint64)
    blocks = [np.concatenate([stem[:k], other()])[:60] for k in (36, 40, 55, 35, 55)]
    n = np.full(5, 26)
    size, words = np.full(5, 60), np.stack(blocks)
    assert rlz_dedup._longest(words, size, 0, 0, [(k, 0) for k in range(5)]) == 36
    assert rlz_dedup._longest(words, size, 2, 0, [(k, 0) for k in range(5)]) == 55
    marks = rlz_dedup.solve(np.zeros(5, np.int64), np.ones(5, np.int64), n, np.zeros(5, np.int64), blocks)
    assert [int(m.sum()) for m in marks] == [2, 6, 21, 1, 21]


def plain_em(patterns, rounds=40):
    import numpy as np

    q = quality_rules
    votes, n = np.array([p for p, _ in patterns]), np.array([k for _, k in patterns], float)
    r = votes.shape[1]
    bad, good = (votes == q.BAD).astype(float), (votes == q.GOOD).astype(float)
    share0 = np.r_[q.PRIOR, np.full(r, (1 - q.PRIOR) / r)]
    p0 = np.vstack([np.full(r, q.ALARM), np.full((r, r), q.ELSE) + np.eye(r) * (q.HIT - q.ELSE)])
    share, p = share0, p0
    for _ in range(rounds):
        like = share * np.exp(bad @ np.log(p).T + good @ np.log(1 - p).T)
        resp = like / like.sum(1, keepdims=True) * n[:, None]
        share = (resp.sum(0) + q.WEIGHT * share0) / (n.sum() + q.WEIGHT)
        p = np.maximum(q.LEAST, (resp.T @ bad + q.WEIGHT * p0) / (resp.T @ (bad + good) + q.WEIGHT))
        p = np.minimum(np.r_[q.MOST_ALARM, np.full(r, q.MOST)][:, None], p)
    like = share * np.exp(bad @ np.log(p).T + good @ np.log(1 - p).T)
    return share, p, like[:, 0] / like.sum(1)


def test_weak_supervision_against_plain_em(spark):
    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_rules.judge(docs).collect()
    names = [f"v_{k}" for k in quality_rules.rules()]
    patterns = sorted(Counter(tuple(r[c] for c in names) for r in rows).items())
    share, p, good = plain_em(patterns)
    model = quality_rules.expectation_maximisation(patterns, len(names))
    assert np.allclose(model.share, share) and np.allclose(model.bad, p)
    want = {v: g for (v, _), g in zip(patterns, good)}
    assert all(abs(r.posterior - want[tuple(r[c] for c in names)]) < 1e-9 for r in rows)
    assert all(r.kept == (not r.base_failed and want[tuple(r[c] for c in names)] >= quality_rules.KEEP) for r in rows)
    # some verdicts are not what all-must-pass says, and none of the rules gives them alone
    verdict = [r.posterior >= quality_rules.KEEP for r in rows]
    assert verdict != [all(r[c] != quality_rules.BAD for c in names) for r in rows]
    assert all(verdict != [r[c] != quality_rules.BAD for r in rows] for c in names)


def test_agreement_overrules_a_lone_rule():
    good, bad, none = quality_rules.GOOD, quality_rules.BAD, quality_rules.ABSTAIN
    # the last rule accuses one document in six that all others praise; the first two accuse together
    patterns = [((good, good, good, good), 600), ((good, good, good, bad), 120), ((bad, bad, good, good), 80), ((bad, bad, none, bad), 20)]
    model = quality_rules.expectation_maximisation(patterns, 4)
    assert model.classes((good, good, good, bad))[0] > 0.5 > model.classes((bad, bad, good, good))[0]
    assert model.classes((bad, bad, none, bad))[0] < 0.5 and model.bad[0][3] > 3 * model.bad[0][0]
    assert quality_rules.expectation_maximisation([], 4) == quality_rules.Model.before(4)
