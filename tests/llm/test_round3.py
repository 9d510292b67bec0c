"""Alignment, hard negatives and shared lines against brute force; licence notices, scripts and linear costs."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import align, decontaminate, language, licenses, line_dedup, negatives, pii, secrets
from pagequarry.llm.common import apart

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

TEXTS = [
    "the quick brown fox", "", None, "the quick  brown\n\n fox ", " leading and trailing ", "naïve café – 東京 🙂 <|endoftext|>", "a▁b odd", "x" * 300 + " y", "   ", "\ttab\r\nline",
    "it's I'll we've 1234567 3.14", "the quick brown fox", "zero\x00byte and  nbsp", "ภาษาไทย no spaces", " ".join(["token"] * 500),
]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pair, a, b = align.Pair(A, B), Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    rows, count = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        own = (" " + (t or "")).encode()
        if b"".join(pair.bytes_a[i] for i in x) != own or b"".join(pair.bytes_b[i] for i in y) != own:
            x, y = [], []
        out, i, j, p, q, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if p <= q:
                ga.append(x[i])
                p, i = p + len(pair.bytes_a[x[i]]), i + 1
            else:
                gb.append(y[j])
                q, j = q + len(pair.bytes_b[y[j]]), j + 1
            if p == q and ga and gb:
                out.append((ga, gb))
                ga, gb = [], []
        links = [(u, v) for g, h in out for u in g for v in h]
        count.update(set(links))
        rows.append((len(x), len(y), out, links))
    best = {}
    for (u, _), n in count.items():
        best[u] = max(best.get(u, 0), n)
    told = lambda g: ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
    return [(na, nb, len(g), len(k), sum(count[x] == best[x[0]] for x in k), sum(count[x] for x in k), hashlib.sha256(told(g).encode()).hexdigest() if na else "") for na, nb, g, k in rows]


@pytest.mark.parametrize("bound", [500_000, 20])
def test_alignment_matches_plain(spark, monkeypatch, bound):
    monkeypatch.setattr(align, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(align, "PART_CHARS", 40)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    got = {r[0]: tuple(r[1:]) for r in align.align(spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(3), A, B).collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain_alignment(TEXTS)
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_links_and_texts_are_made_by_whole_arrays(spark, monkeypatch):
    monkeypatch.setattr(align, "SENT_LINKS", 3)  # so a block's texts come in many batches
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    ids_b = len(align.Pair(A, B).bytes_b)
    found = align.groups(df, A, B)
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("MapInArrow") == 1 and "lambda" not in told  # none that goes value by value
    got = {r.doc_id: r for r in found.collect()}
    for i, (n_a, n_b, n_groups, n_links, _, _, sha) in enumerate(plain_alignment(TEXTS * 3)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, len(r.links), hashlib.sha256(r.groups.encode()).hexdigest() if n_a else r.groups) == (n_a, n_b, n_groups, n_links, sha)
        said = [[[int(x) for x in side.split(",")] for side in g.split("|")] for g in r.groups.split(";") if g]
        assert r.links == [x * ids_b + y for u, v in said for x in u for y in v]


def test_quick_encoder_and_words_equal_the_library():
    from tokenizers import Tokenizer

    rng, own, pair = np.random.default_rng(3), Tokenizer.from_file(A), align.Pair(A, B)
    own.encode_special_tokens = True
    signs = list("abcdeXYZ  \n\t 0129.,'!-éß東🙂ก") + ["'ll", "  ", " the", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(signs, rng.integers(1, 60)))
        whole = own.encode(f" {text}", add_special_tokens=False).ids
        assert pair.a(f" {text}") == whole
        parts = pair.words(text)
        assert [i for w in parts for i in own.encode(f" {w}", add_special_tokens=False).ids] == whole
        assert [i for w in parts for i in pair.b.encode(w)] == pair.b.encode(text)


def plain_negatives(rows):
    own = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    own = list({(i, lab, tuple(v)): (i, lab, v) for i, lab, v in own}.values())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in own:
        if a[0] % 100 == 0:
            near = sorted([(-dot(a[2], x[2]), x[0], x[1]) for x in own if x is not a])
            for s, p, _ in [x for x in near if x[2] == a[1]][:5]:
                fits = [x for x in near if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
                out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("pivots, size", [(1, 4096), (7, 8)])
def test_negatives_match_plain(spark, monkeypatch, pivots, size):
    monkeypatch.setattr(negatives, "ROWS", size)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)]) for i in range(0, 1500, 5)]
    rows += [(i, 1, rows[3][2]) for i in range(2001, 2040)]  # copies of one vector: ties
    rows += [(100, 2, rows[0][2]), rows[20], (None, 1, rows[0][2]), (300, None, rows[0][2]), (301, 1, None), (400, 1, [1.0, None]), (401, 1, [float("nan"), 1.0]), (402, 1, [float("inf")]), (403, 1, []), (500, 9, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("vec", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, pivots=pivots).collect())
    want = plain_negatives(rows)
    assert [r for r in got if r[0] != 100] == [r for r in want if r[0] != 100] and len(got) == len(want)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_far_cells_are_pruned(spark):
    """Of clusters far apart only near rows go to another cell."""
    rng = np.random.default_rng(1)
    centres = 40 * np.eye(8)
    rows = [(i, i % 8 % 2, [float(x) for x in centres[i % 8] + rng.normal(size=8) * 0.01]) for i in range(800)]
    cells = negatives.Cells([[int(256 * x) for x in c] for c in centres], 256 * 41.0)
    data = negatives.vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    placed = negatives._placed(data, cells, False)
    assert negatives._served(placed, cells, {0: 10.0}).count() == 0
    assert negatives._served(placed, cells, {0: float("inf")}).count() == 700


@pytest.mark.parametrize("few", [500_000, 0])
def test_lines_match_plain(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", few)
    long, near = "This line is shared by very many of the documents here", "  this LINE is shared by very many of the documents HERE\t"
    rows = [(i, f"own {i}\n{long if i % 2 else near}\n\nshort\n{long}") for i in range(12)]
    rows += [(None, f"{long}\nnull id"), (3, long), (20, None), (21, ""), (22, "\n\n"), (23, "ü" * 39), (24, "ü" * 40), (11, rows[11][1])]
    rows += [(i, "four only, although it is longer than forty code points") for i in (30, 31, 32, 33, 33)]
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("clash")).repartition(4)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(df).collect()), key=order) == sorted(want, key=order)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
BSD = """Copyright (c) 2020, Acme Inc.
Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""


def test_licences_in_comments_and_sentences(spark):
    cases = [("\n".join((sign + line).rstrip() for line in text.split("\n")), want) for text, want in ((MIT, "MIT"), (MIT.split("\n", 2)[2].replace("\n\n", "\n"), "MIT"), (BSD, "BSD-3-Clause"), (GPL, "GPL-2.0-only")) for sign in ("", "# ", "// ", " * ", "-- ")]
    cases += [
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("MIT License", "MIT"),
        ('{"name": "x", "license": "Apache-2.0"}', "Apache-2.0"),
        ("see https://opensource.org/licenses/MIT.", "MIT"),
        ("The code is available under the terms of the GNU General Public License v2.0.", "GPL-2.0"),
        ("It is released under the GPLv3 or later, as you like", "GPL-3.0-or-later"),
        ("licensed under mit-0 terms", ""),
        ("permission slips are distributed under the table", ""),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: w for i, (_, w) in enumerate(cases)}


@pytest.mark.parametrize("item, copy", [
    ("ภาษาไทยเป็นภาษาที่มีเสียงวรรณยุกต์", "กกกภาษาไทยเป็นภาษาที่มีเสียงวรรณยุกต์ขขข"),
    ("ភាសាខ្មែរជាភាសាផ្លូវការ", "កកកភាសាខ្មែរជាភាសាផ្លូវការខខខ"),
    ("𠀀𠀁𠀂𠀃𠀄𠀅𠀆", "𠀇𠀈𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀉"),
    ("l'école était fermée à midi par ordre", "x L'ÉCOLE ÉTAIT FERMÉE À MIDI PAR ORDRE y"),
    ("ο δρόμος ήταν κλειστός χθες", "Ο ΔΡΌΜΟΣ ΉΤΑΝ ΚΛΕΙΣΤΌΣ ΧΘΕΣ"),
])
def test_items_of_any_script_and_case_are_found(spark, item, copy):
    docs = spark.createDataFrame([(1, copy), (2, "nothing of the kind stands in this text")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1}


def test_spans_apart_match_plain():
    rng = np.random.default_rng(0)
    for _ in range(200):
        spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 50, 5), rng.integers(1, 9, 5))]
        free = apart(spans)
        for s in range(0, 55, 3):
            assert free(s, s + 4) == all(s + 4 <= a or b <= s for a, b in spans)
    assert apart([])(0, 1)


def _seconds(f):
    began = time.process_time()
    f()
    return time.process_time() - began


def test_costs_are_linear(spark):
    made = lambda n: "auth_key Zq8xT1vB4nM6kL0p " + "a1b2c3d4e5f60718293a4b5c6d7e8f9012345678 " * n
    assert _seconds(lambda: secrets.all_spans(made(10_000))) < 12 * max(0.05, _seconds(lambda: secrets.all_spans(made(1_000))))
    began = time.time()
    pages = spark.createDataFrame([(1, "http://a.de/", "<script" * 200_000), (2, "http://a.de/", "<script>" * 200_000), (3, "http://a.de/", "<html " * 200_000 + "x < y"), (4, "http://a.de/", "<p>one<script>two</script >three x < y")], "page_id long, url string, html string")
    got = {r.key: r.text.split() for r in language.page_rows(pages).collect()}
    assert got["1"] == got["2"] == [] and got["4"] == ["one", "three", "x", "<", "y"] and time.time() - began < 60


def test_long_addresses_are_read_to_their_end():
    address = "jane at " + " dot ".join(["department"] * 40 + ["org"])
    text = f"write to {address} today"
    assert any(a <= text.index("jane") and b >= text.index(" today") for a, b in pii.stretches(text))


def test_rows_of_one_id_are_not_mixed(spark, monkeypatch):
    """What is fitted of rows that share an id is one of them."""
    from pagequarry.llm import rule_ensemble

    seen = []
    monkeypatch.setattr(rule_ensemble, "fit", lambda x, y: seen.append((x, y)))
    docs = [(1, "short words"), (1, "a much longer text " * 40 + "!"), (2, "other"), (2, "other"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rule_ensemble.train(df, spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (1, None)], "doc_id long, quality int"))
    x, y = seen[0]
    own = {tuple(r)[1:] for r in rule_ensemble.statistics(df.where("doc_id = 1")).collect()}
    assert x.shape == (2, len(rule_ensemble.STATS)) and tuple(x[0]) in own and list(y) == [1.0, 1.0]
