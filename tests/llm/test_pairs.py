"""Line dedup, n-gram join and decontamination against brute force and on odd rows."""

import random

import numpy as np
import pytest
import xxhash

from chronoset.llm import decontam, line_dedup, ngram_join
from chronoset.llm.common import WordHashes, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, h1 string, node string, score string"


def frame(spark, rows):
    """Rows of documents with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "\n\n"), (None, "one two three four five six"), (None, None), (5, "a"), (5, "a"), (6, "b b b b b b b b b b " * 30000), (7, "\x00 ﻿ ☃ é\n"), (8, "   ")]


def test_line_dedup_by_hand(spark):
    rows = [(k, f"  COMMON Ä\t\nown {k}\n\n\ncommon ä\n") for k in range(9)] + [(9, "common Ä\nx"), (10, "common Ä"), (11, None), (12, "rare\nrare")]
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    # Ä is not folded: the key "common Ä" is in 11 documents, "common ä" in 9
    assert got[0] == (6, 1, "own 0\n\n\ncommon ä\n")
    assert got[9] == (2, 1, "x") and got[10] == (1, 1, "") and got[11] == (1, 0, "") and got[12] == (2, 0, "rare\nrare")


def test_line_runs_are_compacted_and_joined_without_shuffles(spark):
    rows = frame(spark, [(k, f"l{k % 3}\nl{k % 7}\nl{k}") for k in range(60)])
    runs = line_dedup.LineRuns(spark)
    for part in range(5):
        runs.add(rows.where(rows.doc_id % 5 == part))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 batches, as a binary number
    a, b = (spark.table(x) for x in runs.runs())
    for how in ("full", "left_anti"):
        joined = a.join(b.hint("merge"), line_dedup.HASHES, how)
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in plan
    merged = runs.frequent()
    assert len(runs.runs()) == 1 and len(runs.made) == 5 + 3 + 1  # batches, merges on the way, the last merge
    a = line_dedup.drop_lines(rows, merged)
    b = line_dedup.drop_lines(rows, merged, broadcast_rows=0)
    pick = lambda df: sorted((r.doc_id, r._kept, r._n_dropped) for r in df.collect())
    found = pick(a)
    assert found == pick(b) and any(r[2] for r in found)
    runs.close()
    for batches in (1, 4, 7):
        assert pick(line_dedup.dedup_lines(rows, batches=batches)) == found
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_that_keeps_one(spark, batches):
    hashed = lambda k: int.from_bytes(xxhash.xxh64_digest(k.to_bytes(8, "little"), seed=42), "big", signed=True)
    rows = [(k, "\n".join(["all hold this", f"one in three {k % 3}", f"own {k}"])) for k in range(45)]
    got = {r.doc_id: r._kept for r in line_dedup.dedup_lines(frame(spark, rows), batches=batches, keep_one=True).collect()}
    first = min(range(45), key=hashed)
    thirds = {min(range(k, 45, 3), key=hashed) for k in range(3)}
    assert got == {k: "\n".join(["all hold this"] * (k == first) + [f"one in three {k % 3}"] * (k in thirds) + [f"own {k}"]) for k in range(45)}
    same = frame(spark, [(k, "a text\nthat twelve\nhave copied") for k in range(12)])
    texts = [r._kept for r in line_dedup.dedup_lines(same, batches=batches, keep_one=True).collect()]
    assert sorted(texts) == [""] * 11 + ["a text\nthat twelve\nhave copied"]


def test_line_dedup_counts_ids_and_keeps_columns(spark):
    rows = [(k % 9, "seen by nine ids\nown", "a", "b") for k in range(30)] + [(k, "seen by ten ids\nown", "a", "b") for k in range(20, 29)] + [(None, "seen by ten ids", "a", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, row string")
    got = line_dedup.dedup_lines(docs).collect()
    # "own" has 18 ids; the lines of nine ids and a null id are in ten documents
    assert len(got) == len(rows) and {(r._kept, r.row) for r in got if r.doc_id is not None and r.doc_id < 9} == {("seen by nine ids", "b")}
    assert {r._kept for r in got if r.doc_id is None or r.doc_id >= 20} == {""}


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    assert line_dedup.dedup_lines(docs).count() == len(ODD)
    found = ngram_join.jaccard_join(docs).collect()
    assert len(found) == len(ODD)
    assert sorted((r.id, r.n_links, r.copies) for r in found if r.id == 5) == [(5, 1, 2), (5, 1, 2)]
    assert all(r.n_links == 0 for r in found if r.id != 5)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1
    assert decontam.drop_leaks(docs, spark.createDataFrame([(1, "zebra crossing lines over there"), (2, None), (3, ""), (4, "a")], "item_id long, text string")).count() == len(ODD) - 2


def test_empty_tables(spark):
    docs, bench = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 0
    assert ngram_join.jaccard_join(docs).count() == 0
    assert ngram_join.drop_near_copies(docs).count() == 0
    assert decontam.find_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(frame(spark, ODD), bench).count() == 0
    assert decontam.find_leaks(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def near_copies(seed, n):
    """Groups of near copies, exact copies and loners."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice((3, 20, 60, 200)))]
        for _ in range(rnd.choice((1, 1, 2, 5, 30))):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 5))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rnd.shuffle(out)
    return list(enumerate(out))


def brute(rows, threshold=0.8):
    hashes = WordHashes()
    sets = [set(shingles(hashes.of(words(t)), 5).tolist()) for _, t in rows]
    links, label = [0] * len(rows), list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[a]]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return links, label


@pytest.mark.parametrize("block", [1024, 16])
def test_join_against_brute_force(spark, block):
    rows = near_copies(4, 40)
    links, label = brute(rows)
    got = {r.id: (r.n_links, r.class_id) for r in ngram_join.jaccard_join(frame(spark, rows), block=block, recall=0.99999).collect()}
    assert got == {k: (links[k], label[k]) for k, _ in rows}
    kept = {r.doc_id for r in ngram_join.drop_near_copies(frame(spark, rows), recall=0.99999).collect()}
    assert kept == set(label)


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def slow_align(item, window):
    best, table = 0, [[0] * (len(window) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(window, 1):
            row.append(max(0, table[-1][j - 1] + (2 if a == b else -1), table[-1][j] - 1, row[j - 1] - 1))
            best = max(best, row[-1])
        table.append(row)
    return best / (2 * len(item))


def test_alignment_is_smith_waterman():
    rnd = random.Random(3)
    for _ in range(200):
        item, window = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 15))] for _ in range(2))
        assert decontam.align(np.array(item), np.array(window))[0] == slow_align(item, window)


def test_leaks_whole_edited_and_repeated(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(8)]
    text = lambda n: " ".join(word() for _ in range(n))

    def edited(item, every):
        return " ".join(word() if k % every == every - 1 else w for k, w in enumerate(item.split()))

    docs = [(0, text(200)), (1, f"{text(50)} {items[0][1]} {text(50)}"), (2, f"{text(50)} {edited(items[1][1], 6)}"), (3, items[2][1].upper().replace(" ", ", ")), (4, " ".join(items[3][1].split()[:5])), (5, f"{items[4][1]} {text(9)} {items[5][1]} {items[4][1]}")]
    docs += [(100 + k, f"{text(20)} {items[6][1]}") for k in range(300)]  # a passage that most documents share
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 2), (5, 4), (5, 5)} | {(100 + k, 6) for k in range(300)}
    for block_bytes in (4_000_000, 300):  # in one block, and in several
        found = decontam.find_leaks(frame(spark, docs), bench, block_bytes=block_bytes).collect()
        assert {(r.doc_key, r.item_key) for r in found} == want and len(found) == len(want)
    hit = next(r for r in found if r.doc_key == 1)
    assert (hit.first_word, hit.last_word) == (50, 80)
    assert {r.doc_id for r in decontam.drop_leaks(frame(spark, docs), bench).collect()} == {0, 4}


@pytest.mark.parametrize("copies", [1, 300])
def test_leaks_of_edited_copies_against_brute_force(spark, copies):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(6)] + [(6, text(10))]

    def edited(item, every):
        return " ".join(word() if k % every == every - 1 else w for k, w in enumerate(item.split()))

    docs = [(k * 1000 + c, f"{text(20)} {edited(items[k][1], every)} {text(20)}") for k, every in ((0, 4), (1, 5), (2, 4), (3, 5), (6, 4)) for c in range(copies)]
    docs += [(9000 + k, f"{text(20)} {items[k][1]}") for k in (2, 3)]  # beside a verbatim copy, the lost n-grams occur too
    docs += [(9100, f"{' '.join(items[4][1].split()[:14])} {text(30)}"), (9101, f"{text(9)} {' '.join(items[5][1].split()[:16])}")]
    want = {}
    for d, t in docs:
        for i, x in items:
            common = set(x.split()) & set(t.split())
            if len(common) >= 2 and (score := slow_align(x.split(), t.split())) >= 0.5:
                want[d, i] = round(score, 9)
    found = decontam.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_key, r.item_key): round(r.score, 9) for r in found} == want and len(found) == len(want) == 5 * copies + 3


def full_alignment(docs, items):
    """(document, item) -> score wherever the whole text has an alignment of half the item's best score or more."""
    split = [(k, words(t)) for k, t in items]
    ids = {w: k + 1 for k, w in enumerate(sorted({w for _, x in split for w in x}))}
    out = {}
    for d, t in docs:
        window = np.array([ids.get(w, 0) for w in words(t)])
        for k, x in split:
            score = decontam.align(np.array([ids[w] for w in x]), window)[0] if len(window) else 0
            if score >= decontam.THRESHOLD:
                out[d, k] = round(score, 9)
    return out


def found_by(docs, items, n=decontam.N):
    block = decontam.Items.of(items, n)
    seeds = decontam.ranked_seeds(block, {}, decontam.THRESHOLD)
    return {(d, block.ids[m[0]]): round(m[1], 9) for d, t in docs for m in decontam.matches(block, seeds, block.read(t), decontam.THRESHOLD, {})}


def test_leaks_by_kind_and_rate_of_edits():
    """Every copy that full alignment accepts is found, with its full score, whatever the edits."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(4))
    common = [word() for _ in range(8)]  # half of all words are of these
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else word() for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((4, 8, 14, 30, 60, 60, 150, 400))]

    def edited(x, rate, kind):
        out = []
        for w in x:
            if rnd.random() >= rate:
                out.append(w)
            elif kind == "replaced":
                out.append(word())
            elif kind == "inserted":
                out += [w, *text(rnd.choice((1, 1, 3)))]
        return out

    docs = []
    for rate in (0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.9):
        for kind in ("replaced", "inserted", "dropped"):
            docs += [text(rnd.randrange(80)) + edited(x, rate, kind) + text(rnd.randrange(80)) for _, x in items]
    every = lambda x, n: [word() if k % n == n - 1 else w for k, w in enumerate(x)]
    docs += [text(40) + every(x, 3) + text(40) for _, x in items]  # no three words in a row are left
    docs += [[v for w in x for v in (w, word())] for _, x in items]  # a word after each word
    for gap in (60, 90):  # four parts far apart
        docs += [[w for part in range(4) for w in items[7][1][part * 100 : part * 100 + 100] + text(gap)]]
    docs += [x[: len(x) // 2 + 1] for _, x in items] + [text(3000)]
    docs, items = [(k, " ".join(x)) for k, x in enumerate(docs)], [(k, " ".join(x)) for k, x in items]
    want = full_alignment(docs, items)
    assert len(want) > 100 and found_by(docs, items) == want


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_leaks_of_long_seeds_over_a_large_vocabulary(n):
    rnd = random.Random(n)
    vocabulary = [f"w{k}" for k in range(20_000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=40))) for k in range(1000)] + [(1000 + k, f"only {k} {k}") for k in range(3)]
    assert set(found_by([(k, f"before {t} after") for k, t in items], items, n)) >= {(k, k) for k, _ in items}


def test_clashing_columns_are_kept(spark):
    rows = [(k, f"text {k} {k + 1} {k + 2} has some words of its own {k} {k}", "r", "s", "p", "q") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row1 string, _row1 string, Row2 string, has_words string")
    bench = spark.createDataFrame([(1, "nothing alike at all here")], "item_id long, text string")
    assert sorted(decontam.drop_leaks(docs, bench).collect()) == sorted(docs.collect())
    assert sorted(ngram_join.drop_near_copies(docs.union(docs)).collect()) == sorted(docs.collect())


def test_twelve_equal_documents(spark):
    """The join keeps exactly one, whole; beside it, a document that only shares a line."""
    text = "\n".join(f"line {k} of a text that many have copied" for k in range(20))
    docs = frame(spark, [(k, text) for k in range(12)] + [(50, "line 3 of a text that many have copied\nand words of its own here")])
    assert {(r.doc_id, r.text) for r in ngram_join.drop_near_copies(docs).collect()} == {(0, text), (50, "line 3 of a text that many have copied\nand words of its own here")}
