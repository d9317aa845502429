import random
import sys
from pathlib import Path

import numpy as np
import pytest
from delvework.llm import leakage, mixing, reading_level

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

# leakage

ITEM = "On the second day Naxnaxmon moves its drawer behind the emblem, which skips 1050 of the 2455 pending names. Suppose that 2956 readers ask Naxnaxmon for the same drawer while Lanheplan skips the footer of a closed margin."
OTHER = "On the second day Velobtir moves its drawer behind the emblem, which skips 3111 of the 1872 pending names. Suppose that 4001 readers ask Velobtir for the same drawer while Kuslanqua skips the footer of a closed margin."
ZH = "邮差Telrinpos在Naxkusvel的仓库里数出233枚蜡烛，到了傍晚却正好少了729枚卡片。Naxkusvel一关上口袋，Telrinpos就把编号为729的木箱推进花园。"
ITEMS = leakage.Items([(1, ITEM), (2, ZH), (3, "Why does the lamp of Gorfelnax burn?")])


def ids(text):
    return sorted(i for i, *_ in leakage.leaks(text, ITEMS))


def quote(n, at=0):
    return " ".join(ITEM.split()[at : at + n])


@pytest.mark.parametrize(
    "text, want",
    [
        (ITEM, [1]), ("intro " + ITEM.upper() + " outro", [1]), (quote(20, 5), [1]), (quote(19, 5), []), (quote(12), []), (OTHER, []), ("", []), ("x", []),
        ("> " + ITEM.replace("behind", "be-\n> hind").replace("which", "**which**"), [1]), (ITEM.replace("skips", "<b>skips</b>").replace(" ", "&#32;"), [1]), ("".join(f"\\u{ord(c):04x}" for c in ITEM), [1]),
        (ZH, [2]), (ZH.replace("，", ",").replace("。", ". "), [2]), (ZH[:20], []), (ZH[30:75], [2]), ("Ask: why does the lamp of Gorfelnax burn", [3]), (ITEM + "\n" + ZH, [1, 2]), ((ITEM + " ") * 3, [1]),
    ],
)
def test_leaks(text, want):
    assert ids(text) == want


@pytest.mark.parametrize("seed", range(20))
def test_one_word_in_eight_altered(seed):
    rnd, ws = random.Random(seed), ITEM.split()
    few, many = list(ws), list(ws)
    for k in range(3, len(ws), 9):
        few[k] = rnd.choice(["zzz", few[k] + "x"])
    for k in range(0, len(ws), 4):
        many[k] = "zzz"
    assert ids(" ".join(few)) == [1] and ids(" ".join(many)) == []
    k = rnd.randrange(5, 20)
    assert ids(" ".join([*ws[:k], "added", *ws[k:]])) == [1]


def test_longest_by_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 45)
        m = np.array([rnd.random() < 0.85 for _ in range(n)])
        w = np.array([rnd.randrange(1, 4) for _ in range(n)])
        least = min(20, -(-int(w.sum()) * 9 // 10))
        want = max([int(w[i:j].sum()) for i in range(n) for j in range(i + 1, n + 1) if m[i] and m[j - 1] and 8 * (~m[i:j]).sum() <= j - i and w[i:j].sum() >= least], default=0)
        assert leakage.longest(m, w, 20)[0] == want


def test_quoted_by_brute_force():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 45)
        m, s = np.array([rnd.random() < 0.88 for _ in range(n)]), np.array([rnd.random() < 0.3 for _ in range(n)])
        m &= ~s | np.array([rnd.random() < 0.7 for _ in range(n)])
        w = np.array([rnd.randrange(1, 4) for _ in range(n)])
        least, want = min(20, -(-int(w.sum()) * 9 // 10)), 0
        for i in range(n):
            for j in range(i + 1, n + 1):
                right, inside = int((m & s)[i:j].sum()), int(s[i:j].sum())
                if m[i] and m[j - 1] and 8 * (~m[i:j]).sum() <= j - i and w[i:j].sum() >= least and (right >= 0.7 * inside or inside - right <= 1 and right >= 2):
                    want = max(want, int(w[i:j].sum()))
        assert leakage.quoted(m, s, w, 20) == want


def test_quotes_beside_other_values():
    item = "Whenever the clerk of the archive opens a drawer, a small lamp above the shelf turns green and stays lit until somebody has closed every box that was left open behind it, and a bell near the gate rings. "
    tail = "After that, Naxnaxmon counts 41 lamps, Lanheplan 72 shelves and 93 doors of the hall."
    its = leakage.Items([(1, item + tail), (2, "Naxnaxmon")])
    got = lambda text: [(i, q) for i, q, *_ in leakage.leaks(text, its)]
    # words quoted as they are, then a text with other values
    other = tail.replace("Naxnaxmon", "Velobtir").replace("41", "17").replace("72", "28").replace("Lanheplan", "Kuslanqua").replace("93", "55")
    assert got(item + other)[0][0] == 1
    # three slots, of which one is altered
    short = "The clerk Naxnaxmon opens the drawer behind the emblem, skips 1050 pending names of the archive and then closes the other 2455 boxes in the hall."
    its = leakage.Items([(1, short), (2, "see Naxnaxmon")])
    assert got(short.replace("1050", "1051")) and not got(short.replace("1050", "3").replace("2455", "4").replace("Naxnaxmon", "Velobtir"))


def test_leaks_edges(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, OTHER, None), (3, None, None), (None, ITEM, None), (4, "", None), (5, "filler words " * 50_000 + ITEM, None)], "doc_id long, text string, item_id string")
    its = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM)], "item_id long, prompt string")
    assert sorted(map(tuple, leakage.found(leakage.contaminated(docs, its)).collect())) == [(1, 1), (5, 1)]
    assert sorted(map(tuple, leakage.found(leakage.contaminated(docs, its, sent_chars=0)).collect())) == [(1, 1), (5, 1)]
    kinds = {(r.doc_id, r.item_id): r.kind for r in leakage.contaminated(docs, its).collect()}
    assert kinds == {(1, 1): "quote", (5, 1): "quote", (2, 1): "likeness"}
    assert leakage.contaminated(docs, its.where("false")).count() == 0 and leakage.contaminated(docs.where("false"), its).count() == 0


def test_items_are_judged_by_themselves(spark):
    """Neither other items nor the way they reach the documents change what is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(10_000 + k, t) for k, t in enumerate([ITEM, OTHER, ITEM.lower(), ITEM.replace("Naxnaxmon", "the clerk"), "12 34 56 78 90 " * 20, ZH])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).persist()
    its = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet").select("item_id", "prompt")
    its = its.unionByName(spark.createDataFrame([(-1, ITEM), (-2, ZH), (-3, "Suppose the clerk of Velobtir and Naxnaxmon counts 12 34 56 78 90 12 34 and 17 again.")], "item_id long, prompt string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    all_at_once = rows(leakage.contaminated(docs, its))
    assert {"quote", "likeness"} == {r[2] for r in all_at_once} and len(all_at_once) >= 8
    assert rows(leakage.contaminated(docs, its, sent_chars=0)) == all_at_once
    for chars in (0, 10**9):
        assert rows(leakage.contaminated(docs, its, False, chars).drop("differing")) == [r[:-1] for r in all_at_once if r[2] == "quote"]
    for part in ("item_id < 0", "item_id = -1", "item_id % 7 = 3"):
        keep = {r.item_id for r in its.where(part).collect()}
        assert rows(leakage.contaminated(docs, its.where(part))) == [r for r in all_at_once if r[1] in keep]


# mixing


@pytest.mark.parametrize("seed", range(10))
def test_flight_keeps_both_sums(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(0, 300)
    pi, size = [rnd.choice([0.0, 1.0, rnd.random()]) for _ in range(n)], [float(rnd.randrange(1, 500)) for _ in range(n)]
    got = mixing.flight(pi, size, rnd)
    assert sum(mixing.EPS < p < 1 - mixing.EPS for p in got) <= 2
    assert abs(sum(got) - sum(pi)) < 1e-5 and abs(sum(p * s for p, s in zip(got, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-2
    out = mixing.landing(got, size, pi)
    assert set(out) <= {0.0, 1.0}


def test_flight_is_unbiased():
    rnd, n = random.Random(1), 12
    pi, size = [0.3] * n, [float(i + 1) for i in range(n)]
    mean = np.mean([mixing.flight(pi, size, rnd) for _ in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_mix(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(9999)) for _ in range(rnd.randrange(3, 40)))
    rows = [(i, text(), s) for i, s in enumerate(["a"] * 900 + ["B "] * 300 + ["c"] * 40)]
    rows += [(5000 + i, rows[0][1], "c") for i in range(400)] + [(9001, None, "a"), (9002, "x", None), (None, "x", "a"), (9003, "", "a"), (9004, "x", "nowhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 1), ("C", 0.2, 3), ("d", 0.1, 9), (None, 0.5, 1), ("e", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, block=64).persist()
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got) and max(r.copies for r in got if r.source == "c") <= 3 and max(r.copies for r in got if r.source == "b") <= 1
    assert 0 in {r.doc_id for r in got if r.source == "a"} or not any(r.doc_id >= 5000 for r in got)  # equal texts are one
    sh = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, p in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(sh[s].actual_share - p / 0.9) < 0.01
    assert sh["d"].actual_share == 0 and sh["d"].tokens == 0 and set(sh) == {"a", "b", "c", "d", "e"}
    # the least source is used to the full
    assert sum(r.copies for r in got if r.source == "c") == 120
    small = mixing.mix(docs, targets, total=2000)
    assert abs(sum(r.tokens * r.copies for r in small.collect()) - 2000) < 200
    assert mixing.mix(docs.where("false"), targets).count() == 0 and mixing.mix(docs, targets.where("false")).count() == 0
    assert sorted(map(tuple, mixing.mix(docs, targets, block=64).collect())) == sorted(map(tuple, got))


# reading level

LEVELS = {
    1: "the cat can see a red box now . do not send the map . then you find it",
    2: "most people search the folder before they change the missing report and wait for a moment",
    3: "operators should normalise the aggregated tokenizer before they enable the retention window since otherwise entries are computed again",
    4: "notwithstanding the ostensible indeterminacy of hermeneutic monotonicity any formalisation presupposes metatheoretical heterogeneity and complementarity",
}


def prose(level, rnd, n=80):
    ws = LEVELS[level].split()
    return " ".join(rnd.choice(ws) for _ in range(n)) + "."


def test_levels_by_held_out_documents(spark):
    rnd = random.Random(6)
    docs, truth = [], {}
    for i in range(400):
        lv = rnd.randrange(1, 5)
        minor = prose(rnd.randrange(1, 5), rnd, 20) if rnd.random() < 0.3 else ""
        docs.append((i, f"# head\n\n{prose(lv, rnd)}\n\n{prose(lv, rnd, 30)}\n\n{minor}\n\n```\ncode(x)\n```\n| a | b |"))
        truth[i] = lv
    labels = [(i, f"r{k}", truth[i] if rnd.random() < 0.9 else rnd.randrange(1, 5)) for i in range(0, 400, 4) for k in range(3)]
    labels += [(0, None, None), (None, "r", 2), (99999, "r", 1), (1, "r", 9)]
    got = reading_level.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, rated_level int")).collect()
    held = [r for r in got if r.doc_id % 4]
    assert len(got) == 400 and sum(r.reading_level == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_what_counts_as_prose():
    text = "# A heading of many words that does not count\n\nshort title\n\n```py\nprint(1)\n```\n\n| a | b |\n| - | - |\n\n- An item is prose as well.\n- Another one (`x_y`) in a_b.c too.\n\nRun `z` now."
    got = [" ".join(p.split()) for p in reading_level.paragraphs(text)]
    assert got == ["An item is prose as well. Another one ( ) in too.", "Run now."]


def test_levels_edges(spark):
    rnd = random.Random(1)
    rows = [(1, prose(2, rnd, 59)), (2, prose(2, rnd, 61)), (2, prose(2, rnd, 61)), (3, None), (None, prose(1, rnd)), (4, ""), (5, "猫" * 119 + "。"), (6, "猫在床上睡觉" * 20 + "。"), (7, prose(2, rnd, 100_000))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    none = spark.createDataFrame([], "doc_id long, rater string, rated_level int")
    got = {r.doc_id: r.reading_level for r in reading_level.reading_levels(docs, none).collect()}
    assert got == {2: 2, 6: 2, 7: 2}
    assert reading_level.reading_levels(docs.where("false"), none).count() == 0


def test_step_by_brute_force():
    rnd = np.random.default_rng(1)
    ids, starts = rnd.integers(0, 50, 40), np.array([0, 10, 25])
    value, weight = rnd.random(50), rnd.random(50)
    label, size = np.array([np.nan, 3.0, np.nan]), np.array([5.0, 6.0, 7.0])
    score, n, s, q, c = reading_level.propagate_step(ids, starts, label, size, value, weight)
    for k, (a, b) in enumerate(((0, 10), (10, 25), (25, 40))):
        w = weight[ids[a:b]]
        assert np.isclose(score[k], (w * value[ids[a:b]]).sum() / w.sum())
    used = np.where(np.isnan(label), score, label)
    for j in range(50):
        at = [k for k, (a, b) in enumerate(((0, 10), (10, 25), (25, 40))) for i in ids[a:b] if i == j]
        assert c[j] == len(at) and np.isclose(n[j], sum(size[k] for k in at)) and np.isclose(s[j], sum(size[k] * used[k] for k in at)) and np.isclose(q[j], sum(size[k] * used[k] ** 2 for k in at))


def test_cuts_and_moves():
    bins = [(1.0, 1.2, 5), (1.0, 3.9, 2), (2.0, 2.1, 9), (4.0, 3.5, 1), (4.0, 3.7, 1)]
    assert reading_level.cuts(bins) == pytest.approx([1.65, 2.45, 3.15]) and reading_level.cuts([]) == [1.5, 2.5, 3.5]
    x, all_ = np.array([1.0, 2.0, 3.0, 4.0]), np.ones(4, bool)
    assert reading_level.moved(x, 0.9 * x + 0.3, all_, all_) < 1e-9 and reading_level.moved(x, x[::-1] ** 2, all_, all_) > 0.1
    assert reading_level.moved(x, x, ~all_, all_) == float("inf")


def test_each_word_is_a_node_of_its_own(spark):
    """Many words, of which only a few tell the level: none shares its node with another."""
    rnd = random.Random(8)
    rare = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20_000)]
    plain, arcane = "cat bed red box now you map see".split(), "ostensible hermeneutic recondite monotonicity indeterminacy presupposes heterogeneity metatheoretical".split()
    docs = [(i, " ".join([*rnd.sample(rare, 20), *rnd.choices(plain if i % 2 else arcane, k=60)]) + ".") for i in range(300)]
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 4) for i in range(60)], "doc_id long, rater string, rated_level int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.reading_level for r in reading_level.reading_levels(frame, labels).collect()}
    assert all((got[i] <= 2) == bool(i % 2) for i in range(60, 300))
    # words under the share are left out, the others still tell
    few = {r.doc_id: r.reading_level for r in reading_level.reading_levels(frame, labels, share=1e-3).collect()}
    assert all((few[i] <= 2) == bool(i % 2) for i in range(60, 300))


def test_invariants_equal_sql(spark):
    from delvework.llm.queries import QUERIES, SQL
    from verify import compare, duck

    con = duck("/root/testdata/sf0.001")
    for name, sql in SQL.items():
        assert compare(spark, con, "/root/testdata/sf0.001", name, QUERIES[name], sql) == "", name


def test_registered_queries_run(spark):
    from delvework.llm.queries import QUERIES

    for name, f in QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name
    for name, cols in {"p1_found": ["file_path", "lang"], "p2_found": ["id", "cut_line"], "p3_found": ["id", "line_no"], "p4_found": ["file_path"], "p5_found": ["id", "function_name"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "reading_level"]}.items():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns == cols
