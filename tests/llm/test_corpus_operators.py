"""Each operator against brute force or a round trip, and its defined results on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import dartminhash, exactdup, langid, licenses, mixing, ordermin, packing, rlzdup, urlfilter, warc
from tallyforge.llm.batches import Words, utf8
from tallyforge.llm.queries import QUERIES

LONG = "lorem ipsum dolor " * 40_000
#: null id, null text, empty text, repeated rows, ties, a very long text, and columns that clash with those the operators add
ODD = [(1, "alpha beta", "s", "x"), (1, "alpha beta", "s", "x"), (2, None, "s", None), (None, "alpha beta", None, "x"), (3, "", None, "y"), (4, "", "t", "y"), (5, LONG, "t", "z"), (6, LONG, "t", "z"), (7, "%%% ### 123", "t", "q")]
SCHEMA = "doc_id long, text string, source string, language string, copies string, fingerprint string, owner_id string, near_id string, id string, c0 string, text_ string, k0 string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, x, *["clash"] * 8) for i, t, s, x in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1 WARC


def read_back(spark, uri):
    return sorted((r.url, bytes(r.body)) for r in warc.read_warc(spark, uri).collect())


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write_warc(pages, f"file://{tmp_path}/w").collect()
    want = sorted((r.url, r.html.encode()) for r in pages.collect())
    assert read_back(spark, f"file://{tmp_path}/w") == want
    by_id = {r.page_id: r.html.encode() for r in pages.collect()}
    for r in index:  # each record alone: dictionary, then its frame
        data = (tmp_path / "w" / r.file).read_bytes()
        dictionary = data[: 8 + int.from_bytes(data[4:8], "little")] if data[:4] == b"\x5d\x2a\x4d\x18" else b""
        assert dictionary
        (_, made), = list(warc.records_in(dictionary + data[r.offset : r.offset + r.length]))
        assert warc.parse(made)[1] == by_id[r.page_id] and r.payload_sha1 == hashlib.sha1(by_id[r.page_id]).hexdigest()


def test_warc_odd(spark, tmp_path):
    page = spark.createDataFrame([(1, "http://a b/\n", "<p>", "x"), (None, None, "", "x"), (2, "u", None, "x"), (2, "u", None, "x"), (3, None, LONG, "x")], "page_id long, url string, html string, file string")
    got = rows(warc.write_warc(page, f"file://{tmp_path}/w", file_bytes=1000).select("page_id", "file", "record_bytes"))
    assert len(got) == 5 and sum(r[1] is None for r in got) == 2
    assert [b for _, b in read_back(spark, f"file://{tmp_path}/w")] == [b"<p>", LONG.encode(), b""]
    assert {u for u, _ in read_back(spark, f"file://{tmp_path}/w")} == {"http://a%20b/%0A", "urn:record:3", "urn:record:None"}
    assert warc.write_warc(page.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_record_ids_are_unique(spark, tmp_path):
    page = spark.createDataFrame([(1, "u", "same page")] * 30 + [(2, "u", None)], "page_id long, url string, html string").repartition(3)
    warc.write_warc(page, f"file://{tmp_path}/w", file_bytes=800, date="2024-05-06T07:08:09Z")
    heads = [warc.parse(r)[0] for f in sorted((tmp_path / "w").glob("*.zst")) for _, r in warc.records_in(f.read_bytes())]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) > 35
    assert {h["WARC-Date"] for h in heads} == {"2024-05-06T07:08:09Z"}


def test_warc_dictionary_of_all_records():
    """Phrases that only the last records share get into the dictionary."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    phrases = [" ".join(word(7) for _ in range(8)) for _ in range(60)]
    early = [" ".join(word(7) for _ in range(60)) for _ in range(750)]
    late = [" ".join([phrases[i] for i in rng.choice(60, 12, replace=False)] + [word(7)]) for _ in range(250)]
    raw = warc.train([t.encode() for t in early + late])
    assert sum(p.encode() in raw for p in phrases) >= 57


# 2 packing


def slow_pack(sizes, window):
    """The rule itself: try every choice and count the squares."""
    open_, n, out = [], Counter(), []
    for size in sizes:
        best = None
        for level in [*range(window - size, 0, -1), 0]:
            if (level and not n[level]) or size + level > window:
                continue
            after = n.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            cost = sum(v * v for v in after.values())
            if best is None or cost < best[0]:
                best = (cost, level, after)
        _, level, n = best
        if level:
            k = next(i for i, w in enumerate(open_) if w[1] == level)
            at = open_.pop(k)[0]
        else:
            at = slow_pack.count = getattr(slow_pack, "count", -1) + 1
        if level + size < window:
            open_.append((at, level + size))
        out.append((at, level))
    del slow_pack.count
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60))
def test_packing_rule(sizes):
    packer = packing.SumOfSquares(12)
    assert [packer.place(s) for s in sizes] == slow_pack(sizes, 12)


def test_packing_table(docs, odd, none, texts):
    got = packing.pack(docs, window=256).collect()
    windows = defaultdict(list)
    units = Counter()
    for r in got:
        windows[r.shard, r.window].append((r.window_offset, r.window_offset + r.units))
        units[r.doc_id] += r.units
    for spans in windows.values():
        spans.sort()
        assert spans[-1][1] <= 256 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    import regex

    assert units == Counter({d: n for d, t in texts.items() if (n := len(regex.findall(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+", t)))})
    assert Counter(r.doc_id for r in packing.pack(odd).collect()) == {1: 2, None: 1, 5: math.ceil(120_000 / 2048), 6: math.ceil(120_000 / 2048), 7: 1}
    assert packing.pack(none).count() == 0


def test_packing_keeps_ids(spark):
    """Ids that a double can't hold, beside a null one, and a shard that reaches over batches and tasks."""
    big = [9007199254740993, 9007199254740995, None, -(2**63), 2**63 - 1]
    got = packing.pack(spark.createDataFrame([(i, "a b c", 1.5) for i in big], "doc_id long, text string, shard double")).collect()
    assert Counter(r.doc_id for r in got) == Counter(big)


def test_packing_by_shards(spark):
    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(1, 40, 3000))}
    got = packing.pack(spark.createDataFrame([(i, "w " * n) for i, n in sizes.items()], "doc_id long, text string").repartition(7), window=16, shard_units=9000).collect()
    shards = {r.doc_id: r.shard for r in got}
    assert len(set(shards.values())) > 3
    for shard in set(shards.values()):
        mine = [i for i in sorted(sizes) if shards[i] == shard]
        want = packing.SumOfSquares(16)
        pieces = [(i, k, *want.place(min(16, sizes[i] - s)), s) for i in mine for k, s in enumerate(range(0, sizes[i], 16))]
        assert sorted((r.doc_id, r.piece, r.window, r.window_offset, r.doc_offset) for r in got if r.shard == shard) == pieces


# 3 licences


def slow_scan(rows_, threshold=licenses.THRESHOLD):
    """(id, path, text) rows to (id, licence, how, directory) by dictionaries."""
    n = sum(t is not None for _, _, t in rows_)
    vocab = set(licenses.vocabulary(licenses.TEMPLATES))
    df = Counter(w for _, _, t in rows_ if t is not None for w in set(licenses.tokens(t)) & vocab)
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in vocab else 0))) + 1
    vec = lambda s: {w: c * idf(w) for w, c in Counter(licenses.tokens(s)).items()}
    templates = [(name, vec(w)) for name, w in licenses.TEMPLATES]

    def best(segment):
        v = vec(segment)
        norm = math.sqrt(sum(x * x for x in v.values()))
        scored = [(-round(sum(x * v.get(w, 0) for w, x in t.items()) / norm / math.sqrt(sum(x * x for x in t.values())), 9), name) for name, t in templates] if norm else []
        scored = [s for s in scored if -s[0] >= threshold]
        return min(scored) if scored else None

    own, licensed = {}, {}
    for i, path, text in rows_:
        line = min(filter(None, map(best, (text or "").split("\n"))), default=None)
        file = line if path and re.match(licenses.FILE_NAME, path.rsplit("/", 1)[-1]) else None
        own[i] = (file[1], "file") if file else (line[1], "header") if line else None
        if file and path and "/" in path:
            d = path.rsplit("/", 1)[0]
            licensed[d] = min(licensed.get(d, file), file)
    out = set()
    for i, path, _ in rows_:
        if own[i]:
            out.add((i, *own[i], None))
            continue
        d = path.rsplit("/", 1)[0] if path and "/" in path else None
        while d is not None and d not in licensed:
            d = d.rsplit("/", 1)[0] if "/" in d else None
        out.add((i, licensed[d][1], "inherited", d) if d else (i, None, "none", None))
    return out


def test_licenses(spark, texts):
    mit = "Released under the MIT License."
    given_ = [(1, "a/LICENSE", "some words\n" + mit + "\nmore words follow here and there"), (2, "a/b/c.py", "print"), (3, "a/b/d/e.py", None), (4, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (5, "x/y.py", ""), (6, None, "nothing"), (7, "top.py", "x"), (8, "x/z.py", "code\n" + mit), (9, "a/b/f.py", "Licensed under CC BY-NC 4.0."), (10, "a/b/g.py", LONG + "\n" + mit)]
    given_ += [(100 + d, f"docs/{d % 3}/{d}", t) for d, t in texts.items()]
    got = licenses.scan(spark.createDataFrame([(*r, "clash", "clash") for r in given_], "doc_id long, path string, text string, dir string, own string")).collect()
    assert {(r.doc_id, r.license, r.how, r.license_dir) for r in got} == slow_scan(given_)
    assert {r.doc_id: (r.license, r.how, r.license_dir) for r in got}[3] == ("Apache-2.0", "inherited", "a/b")


def test_licenses_in_runs_of_words(spark, texts):
    """Headers that are wrapped or stand inside a line, and every run of words by brute force."""
    prose = "Enst thereat of the onanshat and rethhand thntnd in oredble erinst"
    cases = {
        "Licensed under the Apache License,\nVersion 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License,\nversion 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Released under the MIT License.": "MIT",
        "Licensed under\nthe Apache\n\nLicense, Version 2.0": "Apache-2.0",
        "the terms of the house and the general version of it": None,
    }
    given_ = [(i, t) for i, t in texts.items()] + [(10_000 + 10 * i + j, f"{a}{c}{b}") for i, c in enumerate(cases) for j, (a, b) in enumerate([(prose + "\n", "\n" + prose), (prose + " ", " " + prose), (prose + "\n", "")])]
    got = {r.doc_id: (r.license, r.score) for r in licenses.scan(spark.createDataFrame([(i, f"d/{i}", t) for i, t in given_], "doc_id long, path string, text string")).collect()}
    assert {i: got[i][0] for i, _ in given_ if i >= 10_000} == {10_000 + 10 * i + j: name for i, name in enumerate(cases.values()) for j in range(3)}
    vocab = licenses.vocabulary(licenses.TEMPLATES)
    df = Counter(w for _, t in given_ for w in set(licenses.tokens(t)) & set(vocab))
    idf = lambda w: math.log((1 + len(given_)) / (1 + df[w])) + 1
    templates = [{w: c * idf(w) for w, c in Counter(licenses.tokens(x)).items()} for _, x in licenses.TEMPLATES]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, t in given_:
        w = licenses.tokens(t)
        if len(w) > 120 and i < 10_000:
            continue
        runs = [w[a : a + n] for n in {len(licenses.tokens(x)) for _, x in licenses.TEMPLATES} for a in range(len(w) - n + 1)]
        runs += [v for line in t.split("\n") if (v := licenses.tokens(line))]
        best = max((sum(x * c.get(k, 0) for k, x in v.items()) / norm(v) / norm(c) for v in ({k: n * idf(k) for k, n in Counter(r).items()} for r in runs) for c in templates), default=0)
        assert (got[i][1] or 0) >= round(best, 4) - 1e-4 if best >= licenses.THRESHOLD + 1e-9 else got[i][0] is None, (i, best, got[i])


def test_licenses_of_source_files(spark, texts):
    """A short source file with a header is no licence file, and nothing inherits from it; tags are read as such."""
    apache, gpl = "Licensed under the Apache License, Version 2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    given_ = [(i, f"docs/{i}", t) for i, t in texts.items()]
    given_ += [(10_000, "e/short.py", f"# {apache}\nimport os"), (10_001, "e/other.py", "print"), (10_002, "g/s.c", f"/* {gpl} */"), (10_003, "g/t.c", "int x;"), (10_004, "h/a.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"), (10_005, "h/b.rs", "fn f() {}")]
    given_ += [(10_006, "i/a.c", "/* SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) */"), (10_007, "i/LICENSE", "SPDX-License-Identifier: ISC."), (10_008, "i/j/b.c", "int y;"), (10_009, "k/w.c", "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met: */")]
    got = {r.doc_id: (r.license, r.how, r.license_dir) for r in licenses.scan(spark.createDataFrame(given_, "doc_id long, path string, text string")).collect()}
    assert [got[10_000 + i] for i in range(10)] == [
        ("Apache-2.0", "header", None), (None, "none", None), ("GPL-3.0", "header", None), (None, "none", None), ("MIT", "header", None),
        (None, "none", None), ("GPL-2.0", "header", None), ("ISC", "file", None), ("ISC", "inherited", "i"), ("BSD-3-Clause", "header", None),
    ]


def test_licenses_full_texts(spark, texts):
    """Complete licence files without a telling name, with a copyright line, give their licence to their directory."""
    full = dict(licenses.full_texts())
    given_ = [(i, f"docs/{i}", t) for i, t in texts.items()] + [(10_000 + i, f"p/{name}/{i}", f"Copyright (c) 2019 The Erinst Authors\n\n{t}") for i, (name, t) in enumerate(full.items())] + [(20_000 + i, f"p/{name}/src/a.py", "print") for i, name in enumerate(full)]
    given_ += [(30_000, "q/1", " ".join(sorted(set(w.decode() for w in licenses.tokens(full["GPL-3.0"])))[:300])), (30_001, "q/2", "the of and to or a " * 200)]
    got = {r.doc_id: (r.license, r.how, r.license_dir) for r in licenses.scan(spark.createDataFrame(given_, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(full):
        assert got[10_000 + i] == (name, "file", None) and got[20_000 + i] == (name, "inherited", f"p/{name}")
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= set(full)
    assert got[30_000][1] == got[30_001][1] == "none"


def test_licenses_odd(odd, none):
    from pyspark.sql import functions as F

    assert licenses.scan(none, path=F.col("source")).count() == 0
    got = licenses.scan(odd, path=F.concat_ws("/", "source", "doc_id")).collect()
    assert len(got) == len(ODD) and {r.how for r in got} == {"none"}


# 4 mixing


def slow_draw(rows_, total=None):
    """The sample by sorting, in Python."""
    size = lambda t: 0 if t is None else max(len(bin(len(t))) - 2, 1)
    by = defaultdict(list)
    for i, t, s in rows_:
        by[s].append((i, size(t)))
    weight = {s: math.sqrt(sum(a for _, a in v)) for s, v in by.items()}
    n, all_ = len(rows_) if total is None else total, sum(weight.values())
    exact = {s: w * n / all_ for s, w in weight.items()}
    target = {s: math.floor(x) for s, x in exact.items()}
    order = sorted((s for s in weight if weight[s] > 0), key=lambda s: (-(exact[s] - target[s]), s is not None, s or ""))
    for s in order[: n - sum(target.values())]:
        target[s] += 1
    out = Counter()
    for s, v in by.items():
        m = sum(a for _, a in v)
        ranked = []
        for i, a in v:
            e = target[s] * a / m if m else 0
            out[i] += math.floor(e)
            p, u = e - math.floor(e), (int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if p > 0:
                ranked.append((u / (1 - u) / (p / (1 - p)), i))
        for _, i in sorted(ranked)[: target[s] - sum(math.floor(target[s] * a / m) for _, a in v) if m else 0]:
            out[i] += 1
    return +out


def test_mixing(docs):
    want = slow_draw([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {r.doc_id: r.copies for r in mixing.drawn(docs, columns=["doc_id"]).collect()} == want
    many = mixing.mixed(docs, total=700)
    assert many.columns == docs.columns
    assert Counter(r.doc_id for r in many.collect()) == slow_draw([(r.doc_id, r.text, r.source) for r in docs.collect()], 700)


def test_mixing_weights(docs):
    got = Counter(r.source for r in mixing.mixed(docs, total=100, weights={"src1": 3, "src2": 1}).collect())
    assert got == {"src1": 75, "src2": 25}


def test_mixing_odd(odd, none):
    got = mixing.drawn(odd, total=20).collect()
    assert sum(r["copies_"] for r in got) == 20 and all(r.text is not None for r in got)
    assert mixing.mixed(none).count() == 0
    same = mixing.drawn(odd.where("doc_id in (5, 6) or doc_id = 1"), total=3).collect()
    assert sum(r["copies_"] for r in same) == 3


def test_mixing_null_source(spark):
    rows_ = [(i, "text", s) for i, s in enumerate([None] * 6 + ["\0null"] * 10 + [""] * 4 + ["="] * 8)]
    got = mixing.drawn(spark.createDataFrame(rows_, "doc_id long, text string, source string"), weights={None: 1.0, "\0null": 2.0, "": 1.0, "nowhere": 1.0}, total=16)
    counts = Counter()
    for r in got.collect():
        counts[r.source] += r.copies
    assert counts == {None: 4, "\0null": 8, "": 4}


# 5 exact dedup


def test_exact(docs, texts):
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert {(r.doc_id, r.owner_id, r.is_owner) for r in exactdup.owners(docs).collect()} == {(d, first[t], first[t] == d) for d, t in texts.items()}
    kept = exactdup.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(first.values())


def test_exact_odd(odd, none):
    got = [(r.doc_id, r.owner_id, r.is_owner) for r in exactdup.owners(odd).collect()]
    assert Counter(got) == Counter([(1, 1, True), (1, 1, False), (2, 2, True), (None, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True)])
    kept = exactdup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7]
    assert exactdup.owners(none).count() == 0 and exactdup.deduplicated(none).count() == 0


@pytest.mark.parametrize("subtree_bytes", [0, 1 << 20])
def test_exact_hot(spark, subtree_bytes):
    """Texts above the bound of copies are settled apart, with the same result; among them equal rows and null ids."""
    rng = np.random.default_rng(4)
    rows_ = [(int(i) if i else None, t) for i, t in zip(rng.integers(0, 400, 3000), rng.choice(["", "hot text", "hotter", "rare é", None, *(f"t{k}" for k in range(900))], 3000, p=[0.2, 0.2, 0.2, 0.01, 0.09, *[0.3 / 900] * 900]))]
    rows_ += [(None, "of nobody")] * 30 + [(7, "all one row")] * 30
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(6)
    want, first = [], {}
    for i, t in sorted(rows_, key=lambda r: (r[0] is None, r[0] or 0)):
        new = t is None or t not in first
        first.setdefault(t, i)
        want.append((i, i if t is None else first[t], new))
    got = exactdup.owners(df, hot_rows=20, subtree_bytes=subtree_bytes).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    kept = exactdup.deduplicated(df, hot_rows=20, subtree_bytes=subtree_bytes).collect()
    assert Counter(map(tuple, kept)) == Counter((i, t) for (i, t), w in zip(sorted(rows_, key=lambda r: (r[0] is None, r[0] or 0)), want) if w[2])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40))
def test_trie(keys):
    trie, first = exactdup.Trie(), {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
        assert trie.insert(k, i) == first[k]
    assert trie.size == len(first)
    assert all(trie.find(k) == i for k, i in first.items()) and all(trie.find(k + b"x") == first.get(k + b"x") and trie.find(k[:-1]) == first.get(k[:-1]) for k in keys)


# 6 URLs


def test_urls_held_out():
    """Five folds by host: all six forms of a host are judged by a model that never saw it."""
    hosts = sorted({u.split("/")[2] for u, _ in urlfilter.LABELLED})
    assert len(hosts) > 0.95 * len(urlfilter.LABELLED) > 500
    order = np.random.default_rng(1).permutation(len(hosts))
    right, total = 0, 0
    for fold in range(5):
        test = {hosts[i] for i in order[fold::5]}
        model = urlfilter.train([x for x in urlfilter.LABELLED if x[0].split("/")[2] not in test])
        held = urlfilter.varied([x for x in urlfilter.LABELLED if x[0].split("/")[2] in test])
        right += ((model.scores([u for u, _ in held]) >= 0.5) == np.array([y for _, y in held])).sum()
        total += len(held)
    print("held-out accuracy", right / total)
    assert right / total > 0.8


def test_urls_of_pages(spark):
    """Hosts of the given pages, none of which is in the labelled table."""
    pages = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    host = lambda u: re.sub(r"^(www|m|blog)\.", "", u.split("/")[2]).split(".")[0]
    assert not {host(u) for u in pages} & {host(u) for u, _ in urlfilter.LABELLED}
    bad = {"casino-win", "adult-x", "cheap-pills", "free-bets", "spam-farm", "ads-track"}
    score = urlfilter.train().scores(pages)
    is_bad = np.array([host(u) in bad for u in pages])
    print("pages", ((score >= 0.5) & is_bad).sum(), is_bad.sum(), ((score >= 0.5) & ~is_bad).sum(), (~is_bad).sum())
    assert (score[is_bad] >= 0.5).mean() > 0.8 and (score[~is_bad] < 0.5).mean() > 0.97


def test_urls_training_by_hand():
    """The regression with explicit features and loops over them."""
    table = [("https://a.test/x", 1), ("https://bb.test/yy", 0), ("https://abc.test/", 1)]
    rows_ = urlfilter.varied(table)
    vectors = []
    for u, _ in rows_:
        _, place, value = urlfilter.features([u])
        vectors.append(dict(zip(place.tolist(), value.tolist())))
    w, b = defaultdict(float), 0.0
    for _ in range(20):
        step, bias = defaultdict(float), 0.0
        for v, (_, y) in zip(vectors, rows_):
            error = (1 / (1 + math.exp(-(sum(x * w[k] for k, x in v.items()) + b))) - y) / 2 / sum(z == y for _, z in rows_)
            bias += error
            for k, x in v.items():
                step[k] += error * x
        for k in {*w, *step}:
            w[k] -= 3.0 * (step[k] + 0.01 * w[k])
        b -= 3.0 * bias
    model = urlfilter.train(table, steps=20, rate=3.0, penalty=0.01)
    assert np.allclose([model.weights[k] for k in w], list(w.values()), atol=1e-12) and np.isclose(model.intercept, b) and np.count_nonzero(model.weights) <= len(w)


def test_urls_features_by_hand():
    url = "https://user@www.Spam-Farm.test:80/en/1#x"
    row, place, value = urlfilter.features([url])
    grams = {(side, n, t[i : i + n]) for side, t in enumerate(("^spam-farm.test$", "^/en/1$")) for n in urlfilter.GRAMS for i in range(len(t) - n + 1)}
    assert len(place) <= len(grams) and len(place) > 0.95 * len(grams)
    assert math.isclose(float((value**2).sum()), 1)


def test_urls_odd(spark):
    page = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "https://casino-win.test/slots", "x"), (3, "https://casino-win.test/slots", "x"), (4, "https://www.library.test/" + "guide/" * 50_000, "x")], "page_id long, url string, score string")
    got = {r.page_id: (r["score_"], r.blocked) for r in urlfilter.scored(page).collect()}
    assert got[1] == (None, False) and got[3][1] and not got[4][1]
    assert urlfilter.scored(page.limit(0)).count() == 0


# 7 order MinHash


def slow_fingerprint(text, k, l, m, seed):  # noqa: E741
    h = ordermin.kmer_hashes(np.frombuffer(text, np.uint8), k).tolist()
    seen, pairs, mask = Counter(), [], (1 << 64) - 1
    mixed = lambda x: int(ordermin.mix(np.array([x & mask], np.uint64))[0])
    for x in h:
        pairs.append(mixed(x + seen[x] * 0x9FB21C651E98DF25))
        seen[x] += 1
    out = []
    for j in range(m):
        a, b = mixed(2 * j + seed), mixed(2 * j + 1 + seed) | 1
        least = sorted(sorted(range(len(h)), key=lambda i: (((pairs[i] ^ a) * b) & mask, i))[: min(l, len(h))])
        value = mixed(j)
        for i in least:
            value = mixed(value + h[i])
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


@pytest.mark.parametrize("text", [b"abracadabra abracadabra", b"a", b"short", b"aaaaaaaaaaaaaaaaaaaaaa", "größer als überall".encode()])
def test_order_minhash(text):
    assert ordermin.fingerprint(np.frombuffer(text, np.uint8), 4, 3, 16, 7).tolist() == slow_fingerprint(text, 4, 3, 16, 7)


def test_occurrences_by_all_bits():
    """k-mers whose hashes agree on 40 bits, or on all but the last, are different k-mers."""
    a, b = 0xABCDEF0123000001, 0xABCDEF0123000002
    h = np.array([a, b, a, b, b, 5, a, 4, 5], np.uint64)
    assert ordermin.occurrences(h).tolist() == [0, 0, 1, 1, 2, 0, 2, 0, 1]
    h = np.random.default_rng(1).integers(0, 40, 5000).astype(np.uint64) << np.uint64(3)
    seen = Counter()
    for x, n in zip(h.tolist(), ordermin.occurrences(h).tolist()):
        assert n == seen[x]
        seen[x] += 1


def test_order_minhash_feels_order():
    a = ("one two three four five six seven eight nine ten " * 3).encode()
    words = a.decode().split()
    moved = " ".join(words[15:] + words[:15]).encode() + b" "
    edited = a.replace(b"seven", b"sevem", 1)
    f = lambda x: np.array(ordermin.fingerprint(np.frombuffer(x, np.uint8), 6, 3, 64, 3))
    assert (f(a) == f(edited)).mean() > (f(a) == f(moved)).mean()


def test_order_minhash_odd(odd, none, spark):
    got = {(r.doc_id, None if r["fingerprint_"] is None else len(r["fingerprint_"])) for r in ordermin.fingerprints(odd, columns=["doc_id", "fingerprint"]).collect()}
    assert got == {(1, 32), (2, None), (None, 32), (3, 0), (4, 0), (5, 32), (6, 32), (7, 32)}
    assert ordermin.fingerprints(none).count() == 0


# 8 copied passages


def covered(spans):
    by = defaultdict(set)
    for d, a, b, *_ in spans:
        by[d].update(range(a, b))
    return by


def slow_windows(texts_, least):
    """Bytes covered by runs of ``least`` words that a document with a smaller id has too."""
    seen, out = set(), defaultdict(set)
    for d in sorted(texts_):
        b = texts_[d].encode()
        w = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)]
        mine = []
        for i in range(len(w) - least + 1):
            s = b[w[i][0] : w[i + least - 1][1]]
            mine.append(s)
            if s in seen:
                out[d].update(range(w[i][0], w[i + least - 1][1]))
        seen.update(mine)
    return out


def check_spans(got, texts_):
    for d, a, b, r, at in got:
        assert r < d and texts_[d].encode()[a:b] == texts_[r].encode()[at : at + b - a]


def slow_factors(texts_, least):
    """A parser that goes through the documents one by one, with the index in a dictionary: seed -> (id, places) of its first occurrence."""
    index, out = {}, []
    for d in sorted(texts_):
        b = texts_[d].encode()
        w = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b)]
        seen, factors = defaultdict(list), []
        for i in range(len(w) - least + 1):
            start, end = w[i][0], w[i + least - 1][1]
            seed = b[start:end]
            seen[seed].append(start)
            if seed in index:
                ref, places = index[seed]
                there = places[min(len(seen[seed]), len(places)) - 1]
                # A factor goes on while the index knows the next seeds at the next places of the same reference.
                old = next((f for f in factors if f[2] == ref and f[3] - f[0] == there - start and f[0] <= start <= f[1]), None)
                if old:
                    old[1] = max(old[1], end)
                else:
                    factors.append([start, end, ref, there])
        for seed, places in seen.items():
            index.setdefault(seed, (d, places))
        at = 0
        while True:
            open_ = [f for f in factors if f[0] <= at < f[1]]
            if open_:
                start, end, ref, there = min(open_, key=lambda f: (-f[1], f[2]))
                out.append((d, at, end, ref, there + at - start))
                at = end
            elif any(f[0] > at for f in factors):
                at = min(f[0] for f in factors if f[0] > at)
            else:
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [rlzdup.HOT_ROWS, 2])
def test_spans(docs, texts, hot_rows):
    got = rows(rlzdup.duplicate_spans(docs, hot_rows=hot_rows))
    check_spans(got, texts)
    assert got == slow_factors(texts, rlzdup.MIN_WORDS)
    assert covered(got) == slow_windows(texts, rlzdup.MIN_WORDS)


@pytest.mark.parametrize("hot_rows", [rlzdup.HOT_ROWS, 1])
def test_spans_of_repetitive_texts(spark, hot_rows):
    """Few words, so that factors meet, overlap and repeat in every way."""
    rng = np.random.default_rng(5)
    gaps = [" ", ", ", " " * 300]
    texts_ = {d: "".join("abc"[x] + gaps[int(y == 0) + int(z == 0)] for x, y, z in rng.integers(0, [2, 9, 40], (int(rng.integers(10, 80)), 3))) for d in range(40)}
    got = rows(rlzdup.duplicate_spans(spark.createDataFrame(list(texts_.items()), "doc_id long, text string"), min_words=8, run_words=3, hot_rows=hot_rows))
    check_spans(got, texts_)
    assert got == slow_factors(texts_, 8) and len(got) > 100


def test_spans_of_ids_with_several_texts(spark):
    passage, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    got = rows(rlzdup.duplicate_spans(spark.createDataFrame([(1, passage), (2, "zzzz " + passage), (2, other), (3, other), (3, other), (3, passage)], "doc_id long, text string")))
    n, m = len(passage), len(other)
    assert got == sorted([(2, 5, 5 + n, 1, 0), (3, 0, m, 2, 0), (3, 0, n, 1, 0)], key=str)


@pytest.mark.parametrize("query", [lambda d: rlzdup.duplicate_spans(d), lambda d: exactdup.owners(d), lambda d: dartminhash.near_duplicates(d), lambda d: packing.pack(d), lambda d: warc.write_warc(d, "file:///nowhere", "doc_id", "text", "text")])
def test_ids_that_are_no_numbers_are_refused(spark, query):
    with pytest.raises(ValueError, match="whole numbers"):
        query(spark.createDataFrame([("u-1", "some text")], "doc_id string, text string"))


def test_spans_of_parts(spark):
    """A short part that an early document has must not hide a passage that later ones share."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    left, middle, right = word(25), word(20), word(25)
    texts_ = {1: f"{word(30)} {middle} {word(30)}", 2: f"{word(40)} {left} {middle} {right} {word(40)}", 3: f"{word(5)} {left} {middle} {right}", 4: f"{left} {middle} {word(60)} {middle} {right}", 5: f"{right} {word(3)} {left} {middle} {right} {word(2)}"}
    got = rows(rlzdup.duplicate_spans(spark.createDataFrame(list(texts_.items()), "doc_id long, text string")))
    check_spans(got, texts_)
    assert covered(got) == slow_windows(texts_, 50) and {g[0] for g in got} == {3, 5}


def test_spans_odd(odd, none):
    got = rows(rlzdup.duplicate_spans(odd))
    assert got == [(6, 0, len(LONG) - 1, 5, 0)]
    assert rlzdup.duplicate_spans(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20), st.integers(0, 5)), min_size=1, max_size=12))
def test_greedy_parse(items):
    spans = [(a, a + n, r, a) for a, n, r in items]
    got = rlzdup.parse(spans)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert covered([(0, *g) for g in got])[0] == covered([(0, *s) for s in spans])[0]


# 9 near duplicates


def slow_jaccard(texts_, k=dartminhash.SHINGLE):
    sets = {}
    for d, t in texts_.items():
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        sets[d] = {g: 1 + math.log(c) for g, c in Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))).items()} if w else {}
    inv = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inv[g].append(d)
    out = {}
    for a, b in {(min(a, b), max(a, b)) for ds in inv.values() for a in ds for b in ds if a != b}:
        m = sum(min(v, sets[b].get(g, 0)) for g, v in sets[a].items())
        out[a, b] = m / (sum(sets[a].values()) + sum(sets[b].values()) - m)
    return out


def test_near_recall(docs, texts):
    group = {r.doc_id: r.group_id for r in dartminhash.near_duplicates(docs).collect()}
    similar = slow_jaccard(texts)
    near = [p for p, j in similar.items() if j >= dartminhash.SIMILARITY]
    assert sum(group.get(a, -1) == group.get(b, -2) for a, b in near) >= 0.9 * len(near)
    alone = set(texts) - {d for p, j in similar.items() if j >= 0.3 for d in p}
    assert alone and not alone & set(group)


def test_sketch_is_unbiased():
    text = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"w{i}" if i % 4 else f"v{i}" for i in range(0, 400))
    words = Words(*utf8(pa.array([text, other])))
    doc, el, wt = dartminhash.weighted_sets(words, 1)
    s = dartminhash.sketches(doc, el, wt, 2, t=1024)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.05


def slow_sketch(elements, t, seed):
    """Darts of each element of {hash: weight}, cell by cell, until each coordinate has one."""
    mask = (1 << 64) - 1
    mixed = lambda x: int(dartminhash.mix(np.array([x & mask], np.uint64))[0])
    unit = lambda x: (x >> 11) * 2.0**-53
    best, level = [math.inf] * t, dartminhash._LEVEL_0
    while math.inf in best:
        low, width = (0.0, 2.0**level) if level == dartminhash._LEVEL_0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        for element, weight in elements.items():
            for unit_no in range(math.ceil(weight)):
                start = mixed(element + seed)
                start = mixed(start + unit_no) if unit_no else start
                here = mixed(start ^ mixed(level + 1000))
                darts, total, p = 0, math.exp(-width), math.exp(-width)
                while total < unit(here):
                    darts += 1
                    p *= width / darts
                    total += p
                for number in range(darts):
                    place = mixed(here + (number + 1) * 0xD6E8FEB86659FD93)
                    bits = t.bit_length() - 1
                    if unit((place << bits) & mask) < weight - unit_no:
                        rank = low + width * unit(mixed(place ^ 0xA5A5A5A5A5A5A5A5))
                        best[place >> (64 - bits)] = min(best[place >> (64 - bits)], rank)
        level += 1
    return best


def test_sketch_against_single_darts():
    sets = [{3: 1.0}, {3: 1.0, 99: 2.7}, {i * i: 1 + i / 7 for i in range(1, 9)}]
    doc, element, weight = zip(*((d, e, w) for d, s in enumerate(sets) for e, w in s.items()))
    got = dartminhash.sketches(np.array(doc), np.array(element, np.uint64), np.array(weight), 3, 16, 5)
    assert np.allclose(got, [slow_sketch(s, 16, 5) for s in sets], rtol=1e-12)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(2, 5))
def test_connected_parts(seed, n, letters):
    """The triangle inequality rules out no pair: the parts are those of all pairs."""
    s = np.random.default_rng(seed).integers(0, letters, (n, 8)).astype(np.uint32)
    part = list(range(n))
    for i in range(n):
        for j in range(i):
            if (s[i] == s[j]).mean() >= 0.5:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    assert dartminhash.connected(s, 0.5).tolist() == part


def test_near_of_ids_with_several_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b + " x"), (4, "other words altogether"), (5, a)], "doc_id long, text string")
    assert rows(dartminhash.near_duplicates(df)) == [(i, 1) for i in (1, 2, 3, 5)]


def test_names_with_dots_and_columns_of_maps(spark):
    df = spark.createDataFrame([(1, "some words here", "en", {"a": 1}), (1, "some words here", "en", {"a": 1}), (2, "other words there", "en", None)], "`doc.id` long, `te.xt` string, `la.ng` string, extra map<string,int>")
    got = dartminhash.one_of_each(df, "doc.id", "te.xt")
    assert got.columns == df.columns and sorted(r[0] for r in got.collect()) == [1, 2]
    profiles = langid.train_profiles(df, "doc.id", "te.xt", "la.ng")
    assert langid.identify(df, profiles, "te.xt").count() == 3
    assert mixing.mixed(df, id_col="doc.id", text_col="te.xt", source_col="la.ng").count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.root for r in dartminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_near_odd(odd, none):
    got = {(r.doc_id, r.group_id) for r in dartminhash.near_duplicates(odd).collect()}
    assert got == {(5, 5), (6, 5)}
    kept = dartminhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert dartminhash.near_duplicates(none).count() == 0 and dartminhash.one_of_each(none).count() == 0


def test_near_is_the_same_for_any_split(docs):
    one = rows(dartminhash.near_duplicates(docs.repartition(1)))
    assert one == rows(dartminhash.near_duplicates(docs.repartition(5)))


# 10 languages


def test_languages_held_out(docs):
    seen = docs.where("doc_id % 2 = 0")
    held = docs.where("doc_id % 2 = 1")
    got = langid.identify(held, langid.train_profiles(seen), columns=["doc_id", "lang"]).collect()
    print("held-out accuracy", sum(r.lang == r.language for r in got), len(got))
    assert sum(r.lang == r.language for r in got) >= 0.97 * len(got)


def test_languages_by_hand():
    p = langid.Profiles.train({"a": ["the cat sat on the mat"], "b": ["der hund lief weg"]}, dimensions=256)
    text = "the hat"
    total = np.zeros(256)
    framed = " the hat "
    for i in range(len(framed) - 2):
        g = np.ones(256)
        for j in range(3):
            g = g * np.roll(langid._letter_vector(ord(framed[i + j]), 256, langid.SEED), 2 - j)
        total += g
    want = p.prototypes @ (total / np.linalg.norm(total))
    assert np.allclose(p.cosines([text])[0], want, atol=1e-5)


def test_languages_odd(odd, none, docs):
    profiles = langid.train_profiles(docs)
    got = langid.identify(odd, profiles).collect()
    assert {(r.doc_id, r.accepted, r.cosine) for r in got if r["language_"] is None} == {(2, False, 0.0), (3, False, 0.0), (4, False, 0.0), (7, False, 0.0)}
    assert len({(r["language_"], r.cosine) for r in got if r.doc_id in (5, 6)}) == 1
    assert all(r.accepted == (r.cosine >= langid.MIN_COSINE) for r in got)
    kept = langid.identify(odd, profiles, accepted_only=True)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in got) > 0
    assert langid.identify(none, profiles).count() == 0
    untaught = langid.train_profiles(none.withColumnRenamed("source", "lang"))
    assert {r.accepted for r in langid.identify(odd, untaught).collect()} == {False}


RIGHTS = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "vi": "Tat ca moi nguoi sinh ra deu duoc tu do va binh dang ve nhan pham va quyen. Moi con nguoi deu duoc tao hoa ban cho ly tri va luong tam va can phai doi xu voi nhau trong tinh bang huu.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_languages_untaught(spark, size):
    import base64

    profiles = langid.train_profiles(spark.read.parquet(f"/root/testdata/{size}/documents.parquet").where("doc_id % 2 = 0"))
    held = [(r.lang, r.text) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").where("doc_id % 2 = 1").collect()]
    noise = np.random.default_rng(4).bytes
    junk = {f"base64 of {n}": base64.b64encode(noise(n)).decode() for n in (150, 3000, 60_000)}
    short = {f"{n} words of {i}": " ".join(t.split()[3 : 3 + n]) for n in (5, 8) for i, (_, t) in enumerate(held) if len(set(t.split())) > 40}
    given_ = [*RIGHTS.items(), *((f"{k} again", f"{t} " * 3) for k, t in RIGHTS.items()), *junk.items(), *short.items(), *held]
    got = langid.identify(spark.createDataFrame(given_, "name string, text string"), profiles).collect()
    assert {r.name[:2] for r in got[: 2 * len(RIGHTS)] if r.accepted} == {"en", "de", "fr"}
    assert all(r.accepted and r.language == r.name[:2] for r in got[: 2 * len(RIGHTS)] if r.name[:2] in ("en", "de", "fr"))
    assert not any(r.accepted for r in got if r.name in junk)
    few = [r.accepted for r in got if r.name in short]
    assert sum(few) >= 0.98 * len(few) > 0
    assert sum(r.accepted for r in got[-len(held) :]) >= 0.98 * len(held)


# queries and pipeline


def test_every_query_has_a_number():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, docs, texts, sf_dir):
    import corpus_pipeline as cp

    stage = dict(cp.STAGES)
    known = stage["language_id"](spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() == docs.count()
    single = stage["exact_dedup"](spark, known, sf_dir)
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == set(first.values())
    apart = stage["near_dedup"](spark, single, sf_dir)
    left = {r.doc_id for r in apart.collect()}
    similar = slow_jaccard({d: texts[d] for d in first.values()})
    near = [p for p, j in similar.items() if j >= 0.6]
    assert sum(a in left and b in left for a, b in near) <= 0.1 * len(near)
    assert set(first.values()) - {d for p, j in similar.items() if j >= 0.3 for d in p} <= left
    mix = stage["mixing"](spark, apart, sf_dir)
    assert mix.columns == docs.columns and mix.count() == apart.count()
    want = slow_draw([(r.doc_id, r.text, r.source) for r in apart.collect()])
    assert Counter(r.doc_id for r in mix.collect()) == want
    packed = stage["packing"](spark, mix, sf_dir).collect()
    pieces = Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == want
    assert rows(cp.run(spark, sf_dir)) == sorted((tuple(r) for r in packed), key=str)
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_stages_on_odd_rows(spark, docs, odd, none, sf_dir):
    import corpus_pipeline as cp

    odd, none = odd.withColumnRenamed("k0", "lang"), none.withColumnRenamed("k0", "lang")
    # The two long texts are nearly all that the language is taught from, and "alpha beta" is unlike them.
    ids = {"language_id": [5, 6], "exact_dedup": [1, 2, 3, 5, 7], "near_dedup": [1, 2, 3, 4, 5, 7, None]}
    whole = {tuple(r) for r in odd.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and stage(spark, none, sf_dir).count() == 0, name
        got = [tuple(r) for r in out.collect()]
        # Extra columns are as they were, whatever they are called.
        assert set(got) <= whole
        if name == "mixing":
            assert len(got) == len(ODD) and not any(r[1] is None for r in got)
        else:
            assert sorted((r[0] for r in got), key=lambda i: (i is None, i)) == ids[name]
    packed = cp.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == {1: 2, None: 1, 5: 1, 6: 1, 7: 1}
    assert cp.STAGES[-1][1](spark, none, sf_dir).count() == 0
