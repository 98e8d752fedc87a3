"""The pipeline against a plain version of all five stages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, lines, mixing, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def bad_line(line, r=quality.LineRules()):
    t, w = line.strip(WHITE), WORDS.findall(line)
    if not t:
        return False
    count = lambda chars: sum(c in chars for c in line)
    return (100 * count(quality.SYMBOLS) > r.symbol_percent * sum(map(len, w)) or count("!") >= 3 and 100 * count("!") > r.shout_percent * len(w) or len(w) <= r.max_unended_words and not re.search(quality.ENDS, t)
            or count("|»›•·") >= r.min_nav_separators and 4 * count("|»›•·") > len(w) or len(w) <= r.max_boilerplate_words and bool(re.search(quality.BOILERPLATE, t.lower())))


def rules(docs):
    r, out = quality.LineRules(), []
    for d in docs:
        t = d["text"] or ""
        w = WORDS.findall(t)
        wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        times = Counter(wins)
        covered = {j + x for j, win in enumerate(wins) if times[win] > 1 for x in range(8)}
        clean = "\n".join(x for x in t.split("\n") if not bad_line(x))
        chars = lambda s: sum(map(len, WORDS.findall(s)))
        if len(w) >= r.min_words and 100 * len(covered) <= r.max_repeat_percent * len(w) and 100 * (chars(t) - chars(clean)) <= r.max_lost_percent * chars(t):
            out.append(d | {"text": clean})
    return out


def spread(docs):
    sites = defaultdict(set)
    for d in docs:
        for x in d["text"].split("\n"):
            if x.strip(WHITE) and d["source"] is not None:
                sites[x].add(d["source"])
    cut = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    return [d | {"text": "\n".join(x for x in d["text"].split("\n") if x not in cut)} for d in docs]


def one_of_copies(docs):
    best = {}
    for d in docs:
        if d["doc_id"] is not None:
            key = (len(d["text"].encode()), hashlib.sha256(d["text"].encode()).hexdigest())
            if d["doc_id"] not in best or key > best[d["doc_id"]][0]:
                best[d["doc_id"]] = (key, d)
    docs = [d for _, d in best.values()] + [d for d in docs if d["doc_id"] is None]
    sets, root = {}, {}
    for d in docs:
        if d["doc_id"] is not None:
            w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]))
            sets[d["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
            root[d["doc_id"]] = d["doc_id"]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [d for d in docs if d["doc_id"] is None or find(d["doc_id"]) == d["doc_id"]]


def without_items(docs, items):
    """Every passage scored against every item, in full."""
    ix = decontaminate.build_index(items)
    bad = set()
    for d in docs:
        w = decontaminate.words(d["text"])
        for lo in range(0, max(1, len(w) - ix.stride), ix.stride):
            passage = w[lo : lo + 2 * ix.stride]
            inside, alone = decontaminate.pairs(passage), set(passage)
            score = Counter()
            for t in alone & ix.terms.keys():
                for item, x in zip(*ix.postings[ix.terms[t]]):
                    score[item] += x
            for item, x in score.items():
                if x >= decontaminate.THRESHOLD - 1e-9 and decontaminate.overlap(ix.question[item], inside, alone) >= decontaminate.QUESTION and decontaminate.overlap(ix.answer[item], inside, alone) >= decontaminate.ANSWER:
                    bad.add(d["doc_id"])
    return [d for d in docs if d["doc_id"] is None or d["doc_id"] not in bad]


def share(budget, nodes):
    """Water filling of ``(name, capacity, weight)``, names deciding ties."""
    out, left, rest = {}, budget, sorted(nodes, key=lambda x: (x[1] * 10**12 // x[2], x[0]))
    while rest:
        total = sum(w for _, _, w in rest)
        name, cap, w = rest[0]
        if cap * total > w * left:
            return out | {n: w * left // total for n, _, w in rest}
        out[name], left, rest = cap, left - cap, rest[1:]
    return out


def mixture(docs):
    rows = []
    for d in docs:
        n = re.search(r"(\d+)$", d["source"] or "")
        rows.append((d, f"domain{(int(n[1]) if n else 0) % 4}", d["lang"] or "", d["source"] or "", len(WORDS.findall(d["text"])), -(1 << 62) if d["doc_id"] is None else d["doc_id"]))
    weight = lambda level, v: mixing.WEIGHTS[level].get(v, 1)
    leaf = Counter()
    for r in rows:
        leaf[r[1:4]] += r[4]
    cap = lambda *k: sum(mixing.MAX_EPOCHS * t for key, t in leaf.items() if key[: len(k)] == k)
    top = share(sum(leaf.values()) * mixing.BUDGET_PERCENT // 100, [(a, cap(a), weight("domain", a)) for a in {k[0] for k in leaf}])
    out = []
    for a, b0 in top.items():
        for lang, b1 in share(b0, [(x, cap(a, x), weight("lang", x)) for x in {k[1] for k in leaf if k[0] == a}]).items():
            for source, b in share(b1, [(x, cap(a, lang, x), 1) for x in {k[2] for k in leaf if k[:2] == (a, lang)}]).items():
                mine, tokens = [r for r in rows if r[1:4] == (a, lang, source)], leaf[a, lang, source]
                full = b // tokens if tokens else 0
                rest, upto, ended = b - full * tokens, 0, False
                place = lambda i: (int(hashlib.md5(f"{mixing.SEED}|{full + 1}|{i}".encode()).hexdigest()[:8], 16), i)  # noqa: B023, E731
                for i in sorted({r[5] for r in mine}, key=place):
                    group = [r for r in mine if r[5] == i]
                    upto += sum(r[4] for r in group)
                    ended = ended or upto > rest
                    times = full + (rest > 0 and not ended)
                    out += [(r[0]["doc_id"], r[0]["text"], r[0]["lang"], r[0]["source"], a, r[4], times) for r in group if times]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(17)
    sentence = lambda n: " ".join(f"word{rng.randrange(2500)}" for _ in range(n)) + "."
    prose = lambda n: "\n".join(sentence(rng.randrange(9, 30)) for _ in range(n))
    items = [(i, f"{sentence(14)} {sentence(12)}") for i in range(30)]
    notice = "A notice that stands on each and every site of the web, again and again."
    docs = []
    for i in range(140):
        text = prose(rng.randrange(3, 12))
        if i % 3 == 0:
            text += f"\n{notice}"
        if i % 4 == 0:
            text += "\nHome | News | Sport | Contact\nRead more\nAll rights reserved."
        if i % 9 == 0:
            text += f"\n{items[i % 30][1]} {sentence(30)}"
        docs.append((i, text, rng.choice(["en", "en", "fr", None]), None if i % 31 == 0 else f"site{i % 13}", len(text)))
    for i in range(25):
        w = docs[i][1].split(" ")
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"word{rng.randrange(2500)}"
        docs.append((200 + i, " ".join(w), "en", f"site{i % 13}", 5))
    docs += [docs[7], (8, prose(9), "en", "site3", 1), (None, prose(6), "en", "site4", 1), (300, None, None, None, None), (301, "", "en", "site1", 0), (302, sentence(5) * 30, "fr", "site2", 9), (303, "<<<< >>>> $$$$\n" * 40 + sentence(25), "fr", "site2", 9)]
    return docs, items


def test_run_equals_the_plain_version(spark, tmp_path, tables):
    docs, items = tables
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in docs]
    kept = [len(now)]
    for stage in (rules, spread, one_of_copies, lambda x: without_items(x, items)):
        now = stage(now)
        kept.append(len(now))
    assert kept[0] > kept[1] > kept[3] > kept[4]
    got = [(r.doc_id, r.text, r.lang, r.source, r.domain, r.n_tokens, r.times) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(mixture(now), key=repr) and len(got) > 40


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_run_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "times"} <= set(out.columns)
