import random

import pytest

from conftest import rows
from tallyforge.llm import leak

rnd = random.Random(5)
VOCAB = [f"{a}{b}" for a in ("ba", "ke", "mi", "so", "tu", "ra", "lo") for b in ("nor", "vel", "tis", "dan", "gor", "lum", "pex")]


def passage(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


ITEMS = [(i, f"Read the passage and choose one option. {passage(30).capitalize()}. Who was right?") for i in range(40)]


def docs(spark, data):
    return spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, item_id string")


def run(spark, data, items=ITEMS):
    return rows(leak.leaks(docs(spark, data), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id")


def words(i):
    return leak.passages(ITEMS)[i].split()


def test_whole_part_and_changed(spark):
    w = words(3)
    swapped = [x if k % 7 else "changed" for k, x in enumerate(w, 1)]
    inserted = [y for k, x in enumerate(w) for y in ([x, "then"] if k % 8 == 4 else [x])]
    data = [
        (1, "intro " + " ".join(w) + " end"), (2, "intro " + " ".join(w[5:21]) + " end"), (3, " ".join(swapped)), (4, " ".join(inserted)), (5, " ".join(w[5:19])),
        (6, "Read the passage and choose one option. Who was right?"), (7, "<i>" + "</i> <i>".join(w) + "</i>"), (8, None), (9, ""), (10, " ".join(reversed(w))),
        (11, " ".join(w[:16]) + " middle part here " + " ".join(words(8)[10:])), (1, "intro " + " ".join(w) + " end"),
    ]
    assert run(spark, data) == sorted([(1, 3), (2, 3), (3, 3), (4, 3), (7, 3), (11, 3), (11, 8)], key=str)


def test_empty_sides(spark):
    assert run(spark, []) == [] and run(spark, [(1, "text")], []) == []
    assert run(spark, [(1, " ".join(words(1)))], [(None, ITEMS[1][1]), (2, None), (3, "")]) == []


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    data = [(k, " ".join(words(k))) for k in range(12)]
    whole = run(spark, data)
    monkeypatch.setattr(leak, "BLOCK_WORDS", 400)
    assert run(spark, data) == whole == [(k, k) for k in sorted(range(12), key=str)]


def test_same_as_brute_force(spark):
    def best(p, d):
        row, top = [(0, 0)] * (len(d) + 1), (0, 0)
        for i, x in enumerate(p):
            new = [(0, i)]
            for j, y in enumerate(d):
                fresh = row[j] if row[j][0] > 0 else (0, i)
                cands = [(fresh[0] + (1 if x == y else -1), fresh[1]), (row[j + 1][0] - 2, row[j + 1][1]), (new[j][0] - 1, new[j][1])]
                s = max(cands)
                new.append(s if s[0] > 0 else (0, 0))
                if s[0] > top[0]:
                    top = (s[0], i + 1 - s[1])
            row = new
        return top

    data = []
    for k in range(60):
        w = words(k % 40)
        a, n = rnd.randrange(0, 12), rnd.randrange(8, 19)
        part = [rnd.choice(VOCAB) if rnd.random() < 0.08 else x for x in w[a : a + n]]
        data.append((k, f"{passage(20)} {' '.join(part)} {passage(20)}"))
    want = set()
    for k, t in data:
        for i in range(40):
            s, span = best(words(i), t.split())
            if s >= leak.MIN_SCORE and span >= leak.MIN_SPAN:
                want.add((k, i))
    got = set(run(spark, data))
    assert len(want) > 10 and len(want & got) / len(want) >= 0.95 and len(got - want) <= 1


def test_alignment_scores():
    import numpy as np

    p = np.arange(1, 21, dtype=np.uint64) * np.uint64(97)
    cost = np.ones(20, np.int64)
    score, span, stop = leak.best_alignments([p, p[:5]], [cost, cost[:5]], [np.concatenate([p[:10], p[11:]]), p[:0]])
    assert score.tolist() == [17, 0] and span.tolist() == [20, 0]
    assert stop.tolist()[0] == 19 and leak.best_alignments([], [], [])[0].size == 0
    assert pytest.approx(leak.SHARED) == 2


def test_changed_words_of_a_short_part(spark):
    # words that few passages share, so that a change falls on a telling one
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + ".") for i in range(12)]
    data, want = [], []
    for n, changes in ((15, (7,)), (15, (5, 9)), (15, (2,)), (15, (2, 12)), (18, (4, 9, 14))):
        for i in range(12):
            w = items[i][1].rstrip(".").split()[4 : 4 + n]
            data.append((len(data), "before it " + " ".join("changed" if k in changes else x for k, x in enumerate(w)) + " after it"))
            want.append((len(data) - 1, i))
    far = items[0][1].split()[:20]
    data.append((len(data), " ".join("changed" if k % 3 == 2 else x for k, x in enumerate(far))))
    assert run(spark, data, items) == sorted(want, key=str)


def test_a_verbatim_part_stays_beside_a_better_match(spark):
    shared = [f"s{k}" for k in range(16)]
    a = [*(f"a{k}" for k in range(10)), *shared, *(f"b{k}" for k in range(10))]
    b = [*(f"c{k}" for k in range(10)), *shared, *(f"d{k}" for k in range(10))]
    items = [(1, " ".join(a) + "."), (2, " ".join(b) + ".")]
    assert run(spark, [(1, " ".join(a))], items) == [(1, 1), (1, 2)]


MOULD = [(i, " ".join(f"under clause {k + 7 * i} of the charter the two clerks moved all ledgers to the old mill" for k in range(4)) + ".") for i in range(12)]


def test_a_part_whose_windows_many_items_share(spark):
    run_of = " ".join(f"s{k}" for k in range(16))
    items = [(i, f"{' '.join(f'a{i}x{k}' for k in range(9))} {run_of} {' '.join(f'b{i}x{k}' for k in range(9))}.") for i in range(4)]
    assert run(spark, [(1, f"then {run_of} again"), (2, run_of.replace("s7", "else"))], items) == [(d, i) for d in (1, 2) for i in range(4)]


def test_blocks_do_not_show(spark, monkeypatch):
    w = words(2)
    data = [(1, "Read the passage and choose one option. " * 3), *[(k + 2, " ".join(words(k)[3:22])) for k in range(12)], (20, " ".join(w[:20]) + " and " + " ".join(words(30)[:20]))]
    items = ITEMS + [(50, ITEMS[2][1].replace(" " + w[5] + " ", " else ", 1)), *[(60 + i, t) for i, t in MOULD]]
    data += [(100 + i, " ".join(leak.passages(MOULD)[i].split()[3:40])) for i in range(12)]
    whole = run(spark, data, items)
    monkeypatch.setattr(leak, "BLOCK_WORDS", 80)
    assert len(whole) >= 25 and run(spark, data, items) == whole


def test_scripts_without_spaces(spark):
    passage = "夜间登记员在河边的旧磨坊里检查了三百份许可证，而潮汐表在送达时已经湿透。"
    docs = spark.createDataFrame([(1, f"前言。{passage}后记。"), (2, "完全不同的一段文字，谈的是另一件事情，与前面的内容毫无关系。"), (3, passage[:12])], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"请阅读。{passage}")], "item_id long, text string")
    assert rows(leak.leaks(docs, items), "doc_id", "item_id") == [(1, 7)]


@pytest.mark.parametrize("words", [2_000, 2_000_000])
def test_blocks_of_the_real_items_do_not_show(spark, data, monkeypatch, words):
    monkeypatch.setattr(leak, "BLOCK_WORDS", words)
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    got = rows(leak.leaks(docs, items), "doc_id", "item_id")
    monkeypatch.setattr(leak, "BLOCK_WORDS", 50_000)
    assert got and got == rows(leak.leaks(docs, items), "doc_id", "item_id")
