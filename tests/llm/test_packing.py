"""Operators 11 to 13 against plain versions of themselves, whole and edge cases."""

import array
import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import infill, packing, resample

FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéßж漢 .\n") for _ in range(rng.randrange(1, 9)))
    out = [(i, " ".join(word() for _ in range(rng.choice([3, 30, 90, 400])))) for i in range(160)]
    out += [(200 + i, "the same text, thirty words or so, in many copies. " * 3) for i in range(120)]
    out += [(400, ""), (401, None), (402, None), (403, "one"), (403, "one"), (403, "another of that id"), (None, "no id " * 12), (404, "a <|endoftext|>  b"), (405, "   \n\n  x   y\t\t z"), (406, "long " * 9000), (407, "z" * 5000), (408, "\x1c \x85   　 x"), (409, "<P>a\nb\n"), (410, "a<"), (411, "\n\n\n"), (412, "P>\nS>\n<\nM>")]
    return out


@pytest.fixture(scope="module", params=[1, 6])
def docs(spark, request):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows()], "doc_id long, text string, block long, length long, form string").repartition(request.param)


def test_ids_are_the_tokenizers():
    quick = packing.Ids(open(FILE).read())
    assert quick.quick
    for _, t in rows():
        assert quick(t or "").tolist() == ids_of(t)[:-1]
    for base in range(0, 0x20000, 64):  # each character beside letters, digits, marks and white space
        t = "".join(f"a{chr(c)}1{chr(c)}, {chr(c)}{chr(c)} b" for c in range(base, base + 64) if not 0xD800 <= c < 0xE000)
        assert quick(t).tolist() == ids_of(t)[:-1], hex(base)
    for c in (" ", "\n", "a", "7", "!", "ß", " x", "a  ", "　"):  # very long runs
        t = c * 100_000 + "b"
        assert quick(t).tolist() == ids_of(t)[:-1]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, capacity):
    got = packing.pack(docs, FILE, capacity, with_ids=True).collect()
    texts, pieces = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.length <= capacity and r.ids_crc32 == zlib.crc32(array.array("I", r.ids).tobytes())
        pieces[r.doc_id, r.doc_tokens].append(r)
    for i, t in rows():
        ids = ids_of(t)
        texts[i, tuple(ids)] += 1
    for (i, ids), n in texts.items():
        mine = sorted((r.start, tuple(r.ids)) for r in pieces[i, len(ids)])
        want = sorted((a, ids[a : a + capacity]) for a in range(0, len(ids), capacity) for _ in range(n))
        assert all(mine.count(w) >= want.count(w) for w in want)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in texts.items())
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    pad = 0
    for rs in by.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        total = sum(r.length for r in rs)
        assert total <= capacity and all(r.sequence_tokens == total for r in rs)
        to = total if total & (total - 1) == 0 else capacity
        assert all(r.padded_to == to for r in rs)
        pad += to - total
    assert pad <= 0.05 * sum(r.length for r in got) + capacity


def test_sequences(docs):
    packed = packing.pack(docs, FILE, 256, with_ids=True)
    seqs = packing.sequences(packed, pad=9).collect()
    assert collections.Counter(len(s.ids) for s in seqs) == collections.Counter(r.padded_to for r in packed.select("sequence_id", "padded_to").distinct().collect())
    want = collections.Counter(x for _, t in rows() for x in ids_of(t))
    got = collections.Counter(x for s in seqs for x in s.ids)
    got[9] = want[9]
    assert got == want and all(s.starts[0] == 0 and len(s.starts) == len(s.doc_ids) for s in seqs)


def test_plan_is_the_plain_rule():
    rng = random.Random(4)
    for cap in (7, 16, 50):
        lengths = sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 300))), reverse=True)
        packs = []  # one by one: each piece into a shortest pack, or a new one
        for x in lengths:
            k = min(range(len(packs)), key=packs.__getitem__, default=None)
            if k is not None and packs[k] + x <= cap:
                packs[k] += x
            else:
                packs.append(x)
        rows_ = packing.plan(collections.Counter(lengths).items(), cap)
        totals = {s: t for _, a, b, first, _, t in rows_ for s in range(first, first + b - a)}
        assert sorted(totals.values()) == sorted(packs)
        assert sum(b - a for _, a, b, *_ in rows_) == len(lengths)
    assert len(packing.plan([(n, 10**12 + 977 * n) for n in range(1, 2049)])) < 100_000  # counts cost nothing
    assert packing.plan([]) == []


def plain_scores(docs, target, max_n=1, buckets=10_000):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def feats(t):
        w = word.findall((t or "").translate(low))
        return len(w), collections.Counter(" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t, out = collections.Counter(), collections.Counter(), []
    for _, x in docs:
        for f, c in feats(x)[1].items():
            s[bucket(f)] += c
    for x in target:
        for f, c in feats(x)[1].items():
            t[bucket(f)] += c
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    for i, x in docs:
        n, f = feats(x)
        k = sum(f.values())
        weight = sum(gain(bucket(a)) * c for a, c in f.items()) // k if k else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, k, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return collections.Counter((*r, rank.get(id(r))) for r in out)


TARGET = ["the same text in copies", None, "", "d e é ß words that only the target has"]


@pytest.mark.parametrize("max_n,block", [(1, 16 << 20), (3, 300)])
def test_resampling(spark, docs, monkeypatch, max_n, block):
    monkeypatch.setattr(resample, "BLOCK_BYTES", block)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    scored = resample.importance(docs, target, max_n=max_n)
    got = resample.draw(scored).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, got)) == plain_scores(rows(), TARGET, max_n)
    assert resample.draw(scored, percent=100, min_words=0).where("rank IS NOT NULL").count() == len(rows())
    assert resample.draw(scored, percent=0).where("rank IS NOT NULL").count() == 0


def test_resampled_documents(spark, docs):
    some = docs.where("doc_id < 400").dropDuplicates(["doc_id"]).withColumn("rank", F.lit("x"))
    out = resample.resample(some, spark.createDataFrame([(x,) for x in TARGET], "text string"))
    assert {"text", "form", "weight", "score"} <= set(out.columns)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, out.count() + 1))


def test_whole_tables(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    d = [(r.doc_id, r.text) for r in read("documents").collect()]
    got = resample.op12_resampling(spark, SF).collect()
    want = plain_scores(d, [r.text for r in read("benchmark").collect()])
    assert collections.Counter(map(tuple, got)) == collections.Counter({(i, k, w, s, r): c for (i, _, k, w, s, r), c in want.items()})
    packed = packing.op11_packing(spark, SF).collect()
    ids = {i: ids_of(t) for i, t in d}
    assert all(r.ids_crc32 == zlib.crc32(array.array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in packed)
    assert sum(r.length for r in packed) == sum(map(len, ids.values()))


def plain_infill(i, text, s):
    text = text or ""
    u = re.findall(s.unit, text)
    x = hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in (s.prefix, s.suffix, s.middle)) or h[2] % 100 >= s.rate_percent:
        return len(u), "plain", None, None, text
    if h[3] % 100 < s.spm_percent:
        return len(u), "spm", len(p), len(m), f"{s.suffix}{z}{s.prefix}{p}{s.middle}{m}"
    return len(u), "psm", len(p), len(m), f"{s.prefix}{p}{s.suffix}{z}{s.middle}{m}"


@pytest.mark.parametrize("spec", [infill.Infill(), infill.Infill(r"(?s).", "[a]", "{b}", "(c)", 11, 70, 30), infill.Infill(r" *[^ ]+| +")])
def test_infill(docs, spec):
    out = infill.fill_in_middle(docs, spec).withColumn("back", infill.restored(F.col("output"), F.col("form"), spec))
    assert {"block", "length", "text"} <= set(out.columns)
    got = collections.Counter((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
    assert got == collections.Counter((i, *plain_infill(i, t, spec), t or "") for i, t in rows())


def test_infill_sentinels_are_checked():
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "c", "d"), ("<", "<S>", "x")):
        with pytest.raises(ValueError):
            infill.Infill("x", *marks)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, FILE).count() == 0
    assert resample.draw(resample.importance(none, none)).count() == 0
    assert infill.fill_in_middle(none).count() == 0
    one = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    low = math.floor(1000 * math.log(10_002 / (2 * 10_000)))  # a string seen once, against even shares
    assert sorted((r.doc_id, r.weight) for r in resample.importance(one, none).collect()) == [("a", low), ("b", 0)]
