"""Links that must be found, and links that must not, in operators on pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import chains, hashing, nearcopy

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=1_000_000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def passages(spark, rows):
    return chains.fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()


def test_a_shared_passage_is_found_where_its_parts_stand_elsewhere_first(spark):
    rng = random.Random(3)
    p = words(rng, 120)
    rows = [(i, " ".join(words(rng, 30) + p[20 * i : 20 * i + 20] + words(rng, 30))) for i in range(6)]
    rows += [(100, " ".join(words(rng, 20) + p + words(rng, 20))), (101, " ".join(words(rng, 40) + p + words(rng, 9)))]
    got = passages(spark, rows)
    assert [(r.doc_id, r.ref_doc_id, r.start_word, r.end_word, r.ref_start_word, r.ref_end_word, r.n_matches) for r in got] == [(101, 100, 40, 160, 20, 140, 120)]


@pytest.mark.parametrize("tile", [2048, 2])
def test_passages_are_found_whose_seeds_all_have_other_holders_in_front(spark, monkeypatch, tile):
    monkeypatch.setattr(chains, "TILE", tile, raising=False)
    rng = random.Random(6)
    p = words(rng, 72)
    parts = lambda at: [(at + i, " ".join(words(rng, 50) + p[3 * i : 3 * i + 6] + words(rng, 50))) for i in range(23)]
    edited = lambda n: [*words(rng, n), *(w if k % 8 else f"n{n}_{k}" for k, w in enumerate(p)), *words(rng, 40)]
    rows = parts(0) + [(100, " ".join(edited(20)))] + parts(200) + [(300, " ".join(edited(30)))] + parts(400) + [(500, " ".join(edited(33)))]
    rows += [(600 + i, "to " * n) for i, n in enumerate((50, 300, 39))]
    got = passages(spark, rows)
    assert {(r.doc_id, r.ref_doc_id) for r in got} == {(300, 100), (500, 100), (500, 300), (601, 600)}
    assert all(r.n_matches >= 62 and r.percent >= 86 for r in got if r.doc_id < 600)


def test_many_copies_behind_other_holders_are_linked_without_all_their_pairs(spark):
    rng = random.Random(8)
    p, rows = words(rng, 44), []
    for i in range(30):
        before = [(0, p[:20]), (1, p[20:]), (2, ["to"] * 20)]
        rows += [(10 * i + k, " ".join(words(rng, 15) + part + words(rng, 15))) for k, part in before]
        rows += [(10 * i + 5, " ".join(words(rng, 9) + p + words(rng, 12))), (10 * i + 6, " ".join(words(rng, 9) + ["to"] * (60 + 7 * i) + words(rng, 12)))]
    got = passages(spark, rows)
    pairs = {(r.doc_id, r.ref_doc_id) for r in got}
    found = classes([i for i, _ in rows], pairs)
    assert all(found[10 * i + k] == k for i in range(30) for k in (5, 6)) and all(found[10 * i + k] == 10 * i + k for i in range(30) for k in (0, 1, 2))
    assert len(pairs) < 4 * 30 and len(got) < 20 * 30


def test_surroundings_are_kept_only_where_a_stretch_may_begin(spark, monkeypatch):
    rng = random.Random(10)
    p, held, plain = words(rng, 30), {}, chains.written
    monkeypatch.setattr(chains, "written", lambda df, name: held.update({name: plain(df, name)}) or held[name])
    monkeypatch.setattr(chains, "dropped", lambda *tables: None)
    q = words(rng, 80)
    rows = [(i, " ".join(words(rng, 20) + p + words(rng, 25))) for i in range(40)]
    rows += [(100 + i, " ".join(words(rng, 20) + p + words(rng, 4) + q[40 * i : 40 * i + 30] + words(rng, 9))) for i in range(2)]
    rows += [(200, " ".join(q))]
    got = {(r.doc_id, r.ref_doc_id) for r in passages(spark, rows)}
    assert got == set()
    assert len(rows) - 1 <= held["chain-around"].count() <= 2 * len(rows)


def test_rounds_bound_what_is_written_at_once(spark, monkeypatch):
    rng = random.Random(11)
    p = words(rng, 72)
    edited = lambda n: [*words(rng, n), *(w if k % 8 else f"n{n}_{k}" for k, w in enumerate(p)), *words(rng, 40)]
    rows = [(100 * k + i, " ".join(words(rng, 50) + p[3 * i : 3 * i + 6] + words(rng, 50))) for k in range(4) for i in range(23)]
    rows = sorted(rows + [(100 * k + 50, " ".join(edited(20 + k))) for k in range(4)])
    monkeypatch.setattr(chains, "ROUND_SEEDS", 9, raising=False)
    monkeypatch.setattr(chains, "ROUND_PAIRS", 2, raising=False)
    monkeypatch.setattr(chains, "SEEDS_EACH", 0, raising=False)
    monkeypatch.setattr(chains, "PAIRS_EACH", 0, raising=False)
    held, plain = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df, name: held.append(name) or plain(df, name))
    found = classes([i for i, _ in rows], {(r.doc_id, r.ref_doc_id) for r in passages(spark, rows)})
    assert all(found[100 * k + 50] == 50 and found[100 * k + i] == 100 * k + i for k in range(4) for i in range(23))
    assert min(held.count("chain-around"), held.count("chain-rest")) > 1, held


def test_words_of_a_block_come_back():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.3, n).astype(np.uint32) * np.uint32(2654435761) for n in (1, 9, 70_000)] + [np.full(300, 2**32 - 1, np.uint32)]
    packed = [chains._packed(w) for w in blocks]
    assert chains._unpacked(pd.DataFrame({"words": packed}))["words"].tolist() == [w.tobytes() for w in blocks]
    assert len(packed[2]) < 0.6 * blocks[2].nbytes


def test_bounds_let_every_passage_through():
    rng, n = np.random.default_rng(1), 0
    for _ in range(3000):
        size = int(rng.integers(60, 140))
        a = rng.integers(1, 6, size).astype(np.uint8)
        b = np.where(rng.random(size) < rng.choice([0.3, 0.55, 0.7]), a, a % 5 + 1).astype(np.uint8)
        x, z = int(rng.integers(0, size - 30)), int(rng.integers(7, 28))
        b[x : x + z] = a[x : x + z]
        while x > 0 and a[x - 1] == b[x - 1]:
            x, z = x - 1, z + 1
        while x + z < size and a[x + z] == b[x + z]:
            z += 1
        one = np.array([x]), np.array([x]), np.array([z - chains.K + 1])
        s, e, rs, re, m = chains.align(a, b, *one)
        if min(e - s, re - rs) >= chains.MIN_WORDS and 100 * m >= chains.MIN_PERCENT * max(e - s, re - rs):
            n += 1
            around = lambda w, outside: np.array([[w[i] if 0 <= i < size else outside for i in range(x - chains.BACK, x + chains.AHEAD)]], np.uint8)  # noqa: B023, E731
            assert chains._single(around(a, 0), around(b, 255))[0] and chains._possible([[0]], *one, a, b)[0] and chains._may_be(*one, a, b)
    assert n > 500


def test_words_in_common_in_order():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(80))] for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(best[j - 1] + 1 if x == y else max(best[j], row[-1]))
            best = row
        assert chains._gap_matches(np.array(a, np.uint32), np.array(b, np.uint32)) == best[-1]


def test_repeated_ids_take_part_with_one_text(spark):
    rng = random.Random(4)
    p = words(rng, 120)
    rows = [(1, " ".join(words(rng, 50) + p)), (1, " ".join(p + words(rng, 200))), (2, " ".join(p)), (2, " ".join(words(rng, 300) + p)), (None, " ".join(p))]
    assert [(r.doc_id, r.ref_doc_id, r.start_word, r.ref_start_word, r.n_matches) for r in passages(spark, rows)] == [(2, 1, 300, 0, 120)]


def test_copies_of_a_passage_all_meet_its_first_holder(spark):
    rng = random.Random(5)
    p = words(rng, 90)
    got = passages(spark, [(i, " ".join(words(rng, 15) + p + words(rng, 25))) for i in range(40)] + [(50, "x " * 5000)])
    assert {(r.doc_id, r.ref_doc_id) for r in got} == {(i, 0) for i in range(1, 40)}


@pytest.mark.parametrize(("size", "percent"), [(60, 90), (60, 85), (80, 80)])
def test_recall_of_edited_passages(spark, size, percent):
    rng = random.Random(size * percent)
    rows = []
    for j in range(200):
        a = words(rng, size)
        b = list(a)
        for k in rng.sample(range(size), size * (100 - percent) // 100):
            b[k] = words(rng, 1)[0]
        rows += [(2 * j, " ".join(words(rng, 60) + a + words(rng, 60))), (2 * j + 1, " ".join(words(rng, 70) + b + words(rng, 40)))]
    got = {(r.doc_id, r.ref_doc_id) for r in passages(spark, rows)}
    assert got <= {(2 * j + 1, 2 * j) for j in range(200)}
    assert len(got) >= 0.95 * 200


@pytest.mark.parametrize(("size", "percent"), [(80, 70), (60, 70), (120, 70)])
def test_recall_at_the_limit(size, percent):
    rng = random.Random(size * percent)
    rows = []
    for j in range(300):
        a = words(rng, size)
        b = changed(rng, a, size * (100 - percent) // 100)
        rows += [(2 * j, words(rng, 60) + a + words(rng, 60)), (2 * j + 1, words(rng, 70) + b + words(rng, 40))]
    got = in_blocks(rows, 7)
    assert got <= {(2 * j + 1, 2 * j) for j in range(300)}
    assert len(got) >= 0.95 * 300


@pytest.mark.parametrize(("size", "part", "changes"), [(120, 20, 12), (120, 35, 0), (60, 14, 0)])
def test_edited_copies_are_found_where_parts_stand_elsewhere_first(size, part, changes):
    rng = random.Random(size + part)
    for _ in range(10):
        p = words(rng, size)
        rows = [(i, words(rng, 30) + p[part * i : part * i + part] + words(rng, 30)) for i in range(-(-size // part))]
        rows += [(100, words(rng, 20) + p + words(rng, 20)), (101, words(rng, 40) + changed(rng, p, changes) + words(rng, 9))]
        for per in (1, 3, 20):
            assert (101, 100) in in_blocks(rows, per)


def test_links_hang_together_as_all_pairs_do():
    rng = random.Random(9)
    shared = [words(rng, rng.randrange(50, 150)) for _ in range(25)]
    rows = []
    for i in range(150):
        own = [changed(rng, p, len(p) // 12) for p in rng.sample(shared, rng.randrange(2))]
        rows.append((i * 7 % 150, sum(([*words(rng, rng.randrange(60)), *p] for p in own), []) + words(rng, 30)))
    rows += [(500, ["x"] * 3000), (501, []), (502, ["y", "z"])]
    grams = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in rows}
    pairs = {(i, j) for i in grams for j in grams if j < i and len(grams[i] & grams[j]) >= 20}
    for per in (10, 60, 500):
        got = in_blocks(rows, per)
        assert got <= {(i, j) for i in grams for j in grams if j < i and grams[i] & grams[j]}
        assert classes(grams, got) == classes(grams, pairs)


def test_matches_of_other_words_under_one_hash_count_for_nothing():
    a, b = np.arange(60, dtype=np.uint32), np.arange(60, dtype=np.uint32)
    chain = lambda places, refs, sizes: pd.DataFrame({"id": [2], "ref_id": [1], "lo": [0], "ref_lo": [0], "places": [places], "ref_places": [refs], "sizes": [sizes], "words": [a.tobytes()], "ref_words": [b.tobytes()]})
    aligned = lambda c: pd.concat(list(chains._aligned(iter([c])))).values.tolist()
    assert aligned(chain([3], [50], [13])) == []
    assert aligned(chain([3, 20], [3, 55], [13, 13])) == [[2, 1, 0, 3 + 16 + chains.REACH, 0, 43, 43, 100]]


def changed(rng, words_, n):
    out = list(words_)
    for k in rng.sample(range(len(out)), n):
        out[k] = words(rng, 1)[0]
    return out


def classes(nodes, links):
    of = {i: i for i in nodes}
    for i, j in sorted(links):
        a, b = of[i], of[j]
        of = {k: min(a, b) if c in (a, b) else c for k, c in of.items()}
    return of


def in_blocks(rows, per):
    """Pairs of documents that the operator's steps link, with ``per`` documents a block."""
    texts = pd.DataFrame([(i, " ".join(w)) for i, w in rows], columns=["id", "_text"])
    coded = {i: (hashing.word_hashes(hashing.text_bytes(t)) >> np.uint64(32)).astype(np.uint32) for i, t in texts.itertuples(index=False)}
    blocks = []
    for k in range(0, len(texts), per):
        kept = sorted(i for i in texts["id"][k : k + per] if len(coded[i]) >= chains.K)
        if kept:
            blocks.append((k, kept, np.array([len(coded[i]) for i in kept]), np.concatenate([coded[i] for i in kept]).tobytes()))
    blocks = pd.DataFrame(blocks, columns=["block", "ids", "counts", "words"])
    lists = pd.concat(list(chains._lists(3, 48)(iter([blocks]))), ignore_index=True)
    answers = pd.concat([chains._answers(g) for _, g in lists.groupby("range")], ignore_index=True)
    found = pd.concat([chains._chained(3, 48)(blocks[blocks["block"] == b], answers[answers["block"] == b]) for b in blocks["block"]], ignore_index=True)
    found["ref_lo"], found["ref_words"] = 0, [coded[i].tobytes() for i in found["ref_id"]]
    got = pd.concat(list(chains._aligned(iter([found]))))
    return set(zip(got["doc_id"], got["ref_doc_id"]))


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("n", [4, 6, 11])
def test_words_on_which_polynomial_hashes_clash_are_not_linked(spark, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    got = nearcopy.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_word_hashes_tell_words_apart_whatever_their_length():
    rng = random.Random(6)
    known = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 7, 8, 9, 16, 63, 64, 65, 200) for _ in range(300)]
    h = hashing.word_hashes(hashing.text_bytes(" ".join(known)))
    assert len(set(h.tolist())) == len(set(known))
    assert h.tolist() == [int(hashing.word_hashes(hashing.text_bytes(w))[0]) for w in known]
    assert not set(h.tolist()) & set(hashing.word_hashes(hashing.text_bytes(" ".join(known)), 1).tolist())


def test_a_chained_group_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(nearcopy, "BLOCK", 8)
    monkeypatch.setattr(nearcopy, "LEADERS", 1)
    rng = random.Random(7)
    w = words(rng, 3 * 150 + 60)
    rows = [(i, " ".join(w[3 * i : 3 * i + 60])) for i in range(150)] + [(900 + i, " ".join(words(rng, 40))) for i in range(20)]
    got = nearcopy.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 for i in range(150)} | {900 + i: 900 + i for i in range(20)}


def template_pages(rng, n):
    """Pages of one frame of 80 words around 19 of their own, too few for a link, with every tenth page there twice but for 4 words."""
    frame = words(rng, 80)
    own = [words(rng, 19) for _ in range(n)]
    rows = [(i, " ".join(frame[:40] + w + frame[40:])) for i, w in enumerate(own)]
    return rows + [(n + i, " ".join(frame[:40] + changed(rng, own[i], 4) + frame[40:])) for i in range(0, n, 10)]


def test_work_on_pages_of_one_template_follows_their_number(spark, monkeypatch):
    monkeypatch.setattr(nearcopy, "BLOCK", 12)
    monkeypatch.setattr(nearcopy, "LEADERS", 2)
    monkeypatch.setattr(nearcopy, "LEFT", 1)
    held, plain = [], nearcopy._confirmed
    monkeypatch.setattr(nearcopy, "_confirmed", lambda rows, percent: held.append(rows.count()) or plain(rows, percent))
    most = []
    for n in (150, 300):
        held.clear()
        rows = template_pages(random.Random(n), n)
        got = nearcopy.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()
        sets = {i: set(nearcopy.shingle_set(t, 2).tolist()) for i, t in rows}
        links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert {r.doc_id: r.component_id for r in got} == classes(sets, links)
        most.append(sum(held) / len(rows))
    assert len(held) > 2
    assert most[1] <= 1.25 * most[0]


@pytest.mark.parametrize("percent", [80, 65])
def test_linked_sets_have_one_of_their_rarest_shingles_in_common(spark, percent):
    rng = random.Random(percent)
    sets = {}
    for i in range(120):
        own = rng.sample(range(60), rng.randrange(1, 30)) + list(range(100, 100 + rng.randrange(40)))
        sets[2 * i], sets[2 * i + 1] = set(own), set(own[: rng.randrange(len(own) // 2, len(own)) + 1])
    sets |= {900: {5000, 5001}, 901: {7000}}
    rows = [(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    got = {r.id: set(r.bands) for r in nearcopy._rarest(spark.createDataFrame(rows, "id long, _set binary"), percent).collect()}
    assert all(b <= sets[i] for i, b in got.items()) and not got.keys() & {900, 901}
    linked = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert len(linked) > 50
    assert all(got[i] & got[j] for i, j in linked)
    assert sum(map(len, got.values())) < 0.6 * sum(map(len, sets.values()))


def test_links_among_pages_of_one_template_with_few_words_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(nearcopy, "BLOCK", 8)
    monkeypatch.setattr(nearcopy, "LEADERS", 1)
    monkeypatch.setattr(nearcopy, "LEFT", 0)
    held, plain = [], nearcopy._rarest
    monkeypatch.setattr(nearcopy, "_rarest", lambda sets, percent: held.append(sets.count()) or plain(sets, percent))
    rng = random.Random(8)
    frame = words(rng, 80)
    own = [words(rng, 19, 40) for _ in range(90)]
    rows = [(i, " ".join(frame[:40] + w + frame[40:])) for i, w in enumerate(own)]
    rows += [(100 + i, " ".join(frame[:40] + changed(rng, own[i], 5) + frame[40:])) for i in range(0, 90, 3)]
    sets = {i: set(nearcopy.shingle_set(t, 2).tolist()) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = nearcopy.near_duplicates(spark.createDataFrame(rows, DOCS), k=2).collect()
    assert held and links
    assert {r.doc_id: r.component_id for r in got} == classes(sets, links)
