"""Spans, packing, leakage and stuffing against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonflow.llm import fmindex, leakage, packing, spans, stuffing


# --- FM-index and shared spans


def test_suffix_array_and_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    segs = ["".join(rng.choice("AC") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    segs += [segs[0], segs[1] + segs[2], "A" * 70, "", "ACGT" * 12]
    owners = [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13, 14]
    text = np.concatenate([np.append(spans.codes(s), 0) for s in segs]).astype(np.uint8)
    owner = np.concatenate([np.full(len(s) + 1, o) for s, o in zip(segs, owners)])
    index = fmindex.FMIndex(text, owner)
    sa, _ = fmindex.suffix_array(text)
    ends = np.flatnonzero(text == 0)
    key = lambda i: (list(text[i : ends[np.searchsorted(ends, i)]]), -1, i)
    full = lambda i: [(int(c), 0) if c else (0, j) for j, c in enumerate(text[i:], i)]
    assert sa.tolist() == sorted(range(len(text)), key=full)
    begin = np.cumsum([0, *[len(s) + 1 for s in segs]])[:-1]
    got = index.matching_statistics(begin, begin + np.array([len(s) for s in segs]))
    for s, o, b in zip(segs, owners, begin):
        for i in range(len(s)):
            n = 0
            while i + n < len(s) and any(s[i : i + n + 1] in t for t, p in zip(segs, owners) if p != o):
                n += 1
            assert got[b + i] == n, (s, i)
    assert key(0)


def _shared(records, span):
    texts = {}
    for i, t in records:
        if i is not None and t is not None:
            texts[i] = max(t, texts.get(i, t))
    seen = {}
    for i, t in texts.items():
        for p in range(len(t) - span + 1):
            w = t[p : p + span].upper()
            if re.fullmatch("[ACGT]+", w):
                seen.setdefault(w, []).append((i, p))
    cover = {}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                cover.setdefault(i, set()).update(range(p, p + span))
    out = set()
    for i, c in cover.items():
        for p in sorted(c):
            if p - 1 not in c:
                n = 0
                while p + n in c:
                    n += 1
                out.add((i, p, n))
    return out


@pytest.mark.parametrize("hot,letters", [(2000, 600_000), (3, 2_000), (0, 500)])
def test_shared_runs_equal_brute_force(spark, hot, letters):
    rng = random.Random(hot)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = [dna(rng.randint(20, 90)) for _ in range(4)] + ["A" * 80, "AC" * 40]
    recs = []
    for i in range(30):
        t = dna(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            t += (c.lower() if rng.random() < 0.3 else c) + dna(rng.randint(0, 30)) + rng.choice(["", "N", "x"])
        recs.append((i, t))
    recs += [(0, recs[0][1]), (31, None), (None, dna(50)), (32, ""), (33, common[0] * 12), (34, common[0] * 12 + "G")]
    df = spark.createDataFrame(recs, "id long, t string").withColumn("rec", F.lit("q")).withColumn("at", F.lit(1))
    got = {(r["rec"], r["start"], r["length"]) for r in spans.shared_runs(df, "id", "t", span=24, k=9, hot=hot, shard_letters=letters).collect()}
    assert got == _shared(recs, 24)
    share = {r["rec"]: r["n_shared"] for r in spans.shared_share(df, "id", "t", span=24, k=9).collect()}
    assert sum(share.values()) == sum(n for _, _, n in got) and share[32] == 0


@pytest.mark.parametrize("hot", [0, 2000])
def test_shared_runs_of_records_longer_than_a_piece(spark, monkeypatch, hot):
    rng = random.Random(21)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = dna(150)
    recs = [(1, dna(70) + common + dna(90)), (2, common[20:] + dna(200)), (3, dna(33) + common[:60] + "N" + common[60:]), (4, dna(310))]
    monkeypatch.setattr(spans, "RECORD_LETTERS", 40)
    df = spark.createDataFrame(recs, "id long, t string")
    got = {(r["rec"], r["start"], r["length"]) for r in spans.shared_runs(df, "id", "t", span=24, k=9, hot=hot).collect()}
    assert got == _shared(recs, 24) and len(got) >= 4


def test_shared_runs_of_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert spans.shared_runs(df, "id", "t").count() == 0
    with pytest.raises(ValueError):
        spans.shared_runs(df, "id", "t", span=10, k=20)


# --- packing


def _valid(rows, sizes, lengths):
    top = max(lengths)
    per, seqs = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        if r["sequence"] is not None:
            seqs.setdefault(r["sequence"], []).append(r)
    for d, n in sizes.items():
        pieces = sorted(per[d], key=lambda r: r["piece"])
        assert sum(p["n_tokens"] for p in pieces) == n
        assert len(pieces) == max(1, -(-n // top))  # cut only beyond the longest sequence
        assert [p["token_from"] for p in pieces] == [i * top for i in range(len(pieces))]
        assert n > 0 or pieces[0]["sequence"] is None
    for items in seqs.values():
        assert len({r["seq_length"] for r in items}) == 1 and items[0]["seq_length"] in lengths
        at = 0
        for r in sorted(items, key=lambda r: r["seq_start"]):
            assert r["seq_start"] == at
            at += r["n_tokens"]
        assert at <= items[0]["seq_length"]
        assert items[0]["seq_length"] == min(c for c in lengths if c >= at)  # downsized
    return sum(i[0]["seq_length"] for i in seqs.values())


@pytest.mark.parametrize("shard_rows", [50, 10**6])
def test_packing_is_valid_and_tight(spark, shard_rows):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, 1, 64, 100, rng.randint(1, 128), rng.randint(1, 1000)]) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").withColumn("piece", F.lit("a"))
    rows = packing.packed(df, len(sizes), (32, 64, 128), shard_rows).collect()
    room = _valid(rows, sizes, (32, 64, 128))
    assert sum(sizes.values()) / room > 0.94  # items of 100 leave 28 that little can fill
    f = packing.fill(spark.createDataFrame(rows)).collect()
    assert sum(r["n_tokens"] for r in f) == sum(sizes.values())


def test_packing_fills_where_small_items_are_at_hand(spark):
    rng = random.Random(10)
    sizes = {i: rng.randint(1, 90) for i in range(800)}
    rows = packing.packed(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long"), len(sizes), (32, 64, 128)).collect()
    assert sum(sizes.values()) / _valid(rows, sizes, (32, 64, 128)) > 0.99


def test_best_fit_takes_the_least_room():
    where, used = packing.best_fit([8, 7, 3, 2, 2], (10,))
    assert where == [0, 1, 1, 0, 2] and used == [10, 10, 2]


def test_several_lengths_are_opened_and_each_part_of_the_cost_matters(spark, monkeypatch):
    rng = random.Random(9)
    sizes = np.array([rng.randint(20, 400) for _ in range(4000)] + [rng.randint(1100, 4000) for _ in range(300)])
    lengths = (512, 1024, 2048, 4096)

    def opened():
        final = dict(zip(*(x.tolist() for x in packing.pack(sizes, lengths)[::2])))
        return {n: sum(1 for x in final.values() if x == n) for n in lengths}, sum(final.values())

    count, total = opened()
    assert count[1024] and count[2048] and count[4096] and sizes.sum() / total > 0.98
    monkeypatch.setattr(packing, "ATTENTION", 10**9)  # no pairs of places: long sequences cost least
    assert opened()[0][4096] > count[4096]
    monkeypatch.setattr(packing, "ATTENTION", 8192)
    monkeypatch.setattr(packing, "PER_SEQUENCE", 0)  # no fixed part: short ones do
    assert opened()[0][512] > count[512]


def test_validity_tells_wrong_packings(spark):
    counts = spark.createDataFrame([(1, 10), (2, 20), (3, 0)], "doc_id long, n_tokens long")
    good = packing.packed(counts, 3, (16, 32))
    assert tuple(packing.validity(counts, good, 32).first()) == (3, 0, 0, 0, 0)
    assert packing.validity(counts, good.where("doc_id <> 1"), 32).first()["n_wrong_tokens"] == 1
    assert packing.validity(counts, good.withColumn("seq_length", F.lit(8).cast("long")), 32).first()["n_overfull"] == 1
    assert packing.validity(counts, good.withColumn("seq_start", F.col("seq_start") + 1), 32).first()["n_gaps"] == 1


def test_token_counts_of_odd_texts(spark):
    texts = [(1, "def f(x):\n    return x"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "a"), (5, "a" * 60_000), (6, " " * 60_000), (7, "naïve 漢字 🙂")]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit(3))).collect()}
    enc = packing.encoder()
    assert all(got[i] == len(enc.encode_ordinary(t or "")) for i, t in texts) and got[2] == got[3] == 0 and got[4] > 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, n_tokens long"), 0).count() == 0


# --- leakage


def _words(t):
    return re.findall("[a-z0-9]+", t.lower())


def _leaks(docs, items, span):
    out = set()
    for d, t in docs:
        for i, q in items:
            if None in (d, t, i, q):
                continue
            a, b = _words(t), _words(q)
            have = {tuple(a[p : p + span]) for p in range(len(a) - span + 1)}
            if any(tuple(b[p : p + span]) in have for p in range(len(b) - span + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block_bytes", [10**6, 300])
def test_leaks_equal_brute_force(spark, block_bytes):
    rng = random.Random(11)
    vocab = ["alpha", "Beta", "g4mma", "d", "the", "of", "x1"]
    text = lambda n: rng.choice([" ", "\n# ", ", ", "_"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(0, 60))) for i in range(12)] + [(50, None), (None, text(40)), (51, "")]
    items += [(60, items[0][1]), (61, (items[1][1] or "") + " " + (items[2][1] or ""))]
    docs = []
    for d in range(60):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            w = _words(rng.choice(items)[1] or "")
            p = rng.randint(0, max(0, len(w) - 5))
            t += rng.choice(["\n// ", " ", "é"]) + "\n// ".join(w[p : p + rng.randint(5, 40)]).upper() + rng.choice(["", ".", "K"])
        docs.append((d, t))
    docs += [(100, None), (None, docs[3][1]), (101, ""), (102, "word " * 30_000), (103, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("z"))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = leakage.leaks(df, it, span=12, block_bytes=block_bytes).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == _leaks(docs, items, 12)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) and all(r["n_words"] >= 12 for r in got)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert leakage.leaks(docs, items.limit(0), 5).count() == 0
    assert leakage.leaks(docs.limit(0), items, 5).count() == 0
    assert leakage.leaks(docs, items, 5).first()["n_words"] == 7
    with pytest.raises(ValueError):
        leakage.leaks(docs, items, 4)


# --- stuffing


def _salad(rng, n, joiner=" "):
    mods, nouns, brands = ["cheap", "best", "buy", "online", "discount"], ["shoes", "watches", "bags"], ["Velmora", "Tolix"]
    return joiner.join(f"{rng.choice(mods)} {rng.choice(nouns)}" if rng.random() < 0.6 else f"{rng.choice(brands)} {rng.choice(nouns)} {rng.choice(mods)}" for _ in range(n))


def _cases():
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(5, 9))) for _ in range(800)]
    prose = "The reader walks over the list and drops each entry that is older than its own limit, because a late entry would hold the lock. "
    code = "".join(f"def {a}_{b}(x, y):\n    if x > {i}:\n        return {a}[y] + {b}(x)\n    return y\n\n" for i, (a, b) in enumerate(zip(names[:60], names[60:120])))
    url = lambda: f"https://{rng.choice(names)}.example/{rng.choice(['shoes', 'bags', 'watches'])}/{rng.randint(1, 99999)}"
    stuffed = {
        "salad": _salad(rng, 90), "commas": _salad(rng, 90, ", "), "pipes": "# shoes\n\n" + _salad(rng, 90, " | "), "lines": _salad(rng, 90, "\n"),
        "comment": code[:200] + "".join("// " + _salad(rng, 6) + "\n" for _ in range(40)), "urls": "\n".join(url() for _ in range(60)),
        "links": "\n".join(f"* [{_salad(rng, 1)}]({url()})" for _ in range(50)), "html": "<ul>\n" + "\n".join(f'<li><a href="{url()}">{_salad(rng, 1)}</a></li>' for _ in range(50)) + "</ul>",
        "tags": " ".join("#" + _salad(rng, 1).replace(" ", rng.choice(["", "_"])) for _ in range(60)),
        "array": "x = [\n" + "\n".join(f'  "{_salad(rng, 1)}", "{url()}",' for _ in range(50)) + "\n]",
        "disguised": " ".join(rng.choice([w, ".".join(w), "​".join(w), w.replace("e", "3")]) for w in _salad(rng, 90).split()),
        "mostly": prose * 3 + _salad(rng, 90), "cycle": prose + ("shoes bags watches best " * 60),
    }
    plain = {
        "prose": prose * 12, "code": code, "words": "\n".join(names), "little": prose * 20 + _salad(rng, 40), "pins": "\n".join(f"{a}-{b}=={i}.2.1" for i, (a, b) in enumerate(zip(names, names[1:]))),
        "table": "\n".join(f"{n}\t{rng.randint(1, 9999)}\t{rng.choice(names)}" for n in names[:200]), "css": "\n".join(f".shoes-{n} {{ margin: 3px; color: #ff00aa; display: none; }}" for n in names[:80]),
        "changes": "\n".join(f"* The {a} is not taken over from the {b}. ([a1b2c3](https://code.{a}.example/c/{i}))" for i, (a, b) in enumerate(zip(names[:60], names[60:120]))),
        "cases": "CASES = [\n" + "\n".join(f'    ("https://{a}.test/{b}?x=1", {i}, "{a} {b}"),' for i, (a, b) in enumerate(zip(names[:60], names[60:120]))) + "\n]",
        "empty": "", "short": "cheap shoes cheap shoes", "none": None, "long": "x" * 200_000,
    }
    return stuffed, plain


def test_stuffing_is_told_from_lists(spark):
    stuffed, plain = _cases()
    ids = {i: k for i, k in enumerate([*stuffed, *plain])}
    rows = [(i, {**stuffed, **plain}[k]) for i, k in ids.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, stuffed["salad"])], "doc_id long, text string").withColumn("share", F.lit("x"))
    got = [r["doc_id"] for r in stuffing.stuffed(df).collect()]
    assert len(got) == len(set(got))
    assert {ids[i] for i in got} == set(stuffed)
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_recurrence_and_autocorrelation():
    h = np.array([1, 2, 1, 3, 4, 5, 1], np.uint64)
    assert stuffing.recurring(h, np.zeros(7, int), 2).tolist() == [True, False, True, False, False, False, False]
    assert stuffing.recurring(h, np.array([0, 0, 1, 1, 1, 1, 1]), 4).tolist() == [False, False, True, False, False, False, True]
    assert stuffing.autocorrelation(np.array([1, 2] * 50, np.uint64), 2) == 0.5
    assert stuffing.autocorrelation(np.array([1], np.uint64)) == 0.0


def test_disguises_are_undone():
    assert stuffing.undisguised("c.h.e.a.p s​h​o​e​s b3st 2024 v1.2") == "cheap shoes best 2024 vi.2"


def _flagged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    names = list(texts)
    return {names[r["doc_id"]] for r in stuffing.stuffed(df).collect()}


def test_stuffing_of_many_keywords_is_found(spark):
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(5, 9))) for _ in range(1500)})
    rng.shuffle(words)
    trade = ["cheap {} {}", "buy {} {} online", "{} {} sale", "discount {} {}", "{} {} best price"]
    stuffed = {f"mix of {n}": " ".join(rng.choice(words[:n]) for _ in range(10 * n)) for n in (60, 80, 120, 300)}
    stuffed |= {f"cycle of {n}": " ".join(words[:n] * 6) for n in (49, 70, 200)}
    stuffed["offers"] = ", ".join(rng.choice(trade).format(a, b) for a, b in zip(words[:200], words[200:400]))
    column = [rng.choice(words[:30]) for _ in range(900)]
    plain = {
        "words": "\n".join(words), "twice": " ".join(words[:500]), "sorted": "\n".join(sorted(words)),
        "table": "\n".join(f"{rng.choice(words[:100])}\t{rng.randint(1, 9999)}\t{rng.choice(words[100:200])}\t{a}" for a in column),
        "messages": "{\n" + "\n".join(f'  "{a}": "buy {b} {c}",' for a, b, c in zip(words[:90], words[90:180], words[180:270])) + "\n}",
    }
    assert _flagged(spark, {**stuffed, **plain}) == set(stuffed)


def test_lists_of_bare_links_are_found(spark):
    rng = random.Random(14)
    names = sorted({"".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(5, 9))) for _ in range(300)})
    rng.shuffle(names)
    prose = "The reader walks over the list and drops each entry that is older than its own limit, because a late entry would hold the lock.\n"
    hosts = [f"https://{n}.example" for n in names]
    stuffed = {
        "hosts": "\n".join(hosts[:60]), "few": "\n".join(hosts[:8]), "numbered": "\n".join(f"{i}. https://x.example/{rng.randint(1, 99999)}" for i in range(60)), "row": " ".join(hosts[:50]),
        "titles": "\n".join(f"* [{a} {b}]({h})" for a, b, h in zip(names, names[100:], hosts[:60])), "below prose": prose * 3 + "\n".join(f"- {h}" for h in hosts[:60]),
        "html": "<ul>\n" + "\n".join(f'<li><a href="{h}/">{a}</a></li>' for a, h in zip(names[100:160], hosts)) + "\n</ul>",
    }
    plain = {
        "quoted": "URLS = [\n" + "\n".join(f'    "{h}",' for h in hosts[:60]) + "\n]", "explained": "\n".join(f"* [{a}]({h}) - keeps the {b} of a {a}" for a, b, h in zip(names, names[100:], hosts[:60])),
        "lock": "\n".join(f'{a}@^4.1:\n  resolved "{h}/{a}-6.tgz#{rng.getrandbits(64):x}"\n  integrity {rng.getrandbits(90):x}/{b}=' for a, b, h in zip(names, names[100:], hosts[:60])),
        "config": "\n".join(f"{a}: {h}" for a, h in zip(names, hosts[:60])), "references": prose * 20 + "\n".join(hosts[:20]), "one": hosts[0],
    }
    assert _flagged(spark, {**stuffed, **plain}) == set(stuffed)
