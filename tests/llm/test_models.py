"""Quality, rules, licences, URLs, chat and mixing on small cases."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeloom.llm import chat_format as H
from changeloom.llm import license_scan as L
from changeloom.llm import mixing as M
from changeloom.llm import quality_classifier as Q
from changeloom.llm import quality_rules as R
from changeloom.llm import textstats as S
from changeloom.llm import url_filter as U

GOOD = "The house stands by the river and {} people walk there, every {} morning, to see the old mill {}.\n"
BAD = "BUY!! NOW!! {} CHEAP!! {} $$$ %%% "


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdefgilmnorstu") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        line = GOOD if good else BAD
        docs.append((i, "".join(line.format(word(), word(), word()) for _ in range(rng.randint(2, 9))), "s", 1))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "w " * 60_000, None, None), (0, docs[0][1], "s", 1)]
    return docs, [*labels, (None, 1, 0), (5000, 0, 0), (3, None, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, n_words string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def count_by_hand(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "é ", "#", "\n", "\u00a0", "\x1c", "\t", "日 ", "$ "]) for _ in range(rng.randint(0, 60)))
        assert S.counts(text.encode())[:5] == count_by_hand(text)


def test_base_rules(spark):
    rows = [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "p q r s t " * 3 + "x y z"), (4, None), (5, "")]
    out = {r.doc_id: r for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert [out[i].base_failed for i in range(1, 6)] == [True, False, True, True, True]
    assert out[2].kept and not out[3].kept and out[3].n_repeat_words == 15


def test_quality(tables):
    docs, labels = tables
    model = Q.train(docs, labels)
    found = Q.score(docs, model).collect()
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = Q.accepted(docs, model)
    assert kept.schema == docs.schema and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if r.predicted)
    assert Q.train(docs, labels.where("quality = 1")) is None and Q.score(docs, None).first().score == 0.5
    assert Q.score(docs.where("false"), model).count() == 0


def test_densities_are_gaussian():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 500, (300, len(S.COUNTS)))
    labels = (rng.random(300) < 0.5).astype(float)
    model = Q.fit(counts, labels)
    x = np.clip((S.features(counts)[1] - model.centre) / model.scale, -Q.CLIP, Q.CLIP)
    logs = []
    for k in (0, 1):
        root = np.linalg.inv(model.factors[k])
        cov = root @ root.T
        d = x - model.means[k]
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(counts), logs[1] - logs[0])


def test_rules(tables):
    docs, labels = tables
    trees = R.train(docs, labels)
    out = {r.doc_id: r for r in R.judge(docs, trees).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    judged = [r for d, r in out.items() if d in truth]
    assert sum((r.probability >= R.KEEP) == truth[r.doc_id] for r in judged) >= 0.95 * len(judged)
    assert not any(r.kept and r.base_failed for r in judged)


def test_trees_are_monotone():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 300, (800, len(S.COUNTS)))
    names, x = S.features(counts)
    trees = R.fit(counts, (rng.random(800) < 1 / (1 + np.exp(3 * np.sin(4 * x[:, names.index("symbols")])))).astype(float))
    for name, sign in R.MONOTONE.items():
        k = names.index(name)
        for row in x[:20]:
            grid = np.repeat(row[None], 40, axis=0)
            grid[:, k] = np.linspace(x[:, k].min(), x[:, k].max(), 40)
            assert (sign * np.diff(trees.margin(grid)) >= -1e-9).all()


def test_licences(spark):
    model = L.model()
    fresh = L.examples(99, 4)
    wrong = sum((k not in ({f for _, f, _, _ in model.scan(t)} or {"none"})) for k, t in fresh)
    assert wrong <= 0.1 * len(fresh)
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under the Quux Public License, version 3."), (4, "He lost his driving license at the river."), (5, None), (6, ""), (7, "a " * 100_000), (8, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.")]
    out = {r.doc_id: r for r in L.documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, families int")).collect()}
    assert [out[i].families for i in range(1, 9)] == ["MIT", "CC-BY-NC", "unknown", "", "", "", "", "Apache-2.0,GPL"]
    assert out[1].first_line == 1 and [r.line for r in L.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 8").collect()] == [0, 1]


WRAPPED = {
    "MIT": "MIT License\n\nCopyright (c) 2020 Ann Example\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "BSD": "BSD 3-Clause License\n\n# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that the following conditions\r\n# are met:\n#\n# 1. One.",
    "GPL": "                    GNU GENERAL PUBLIC LICENSE\n\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
}


def test_wrapped_licences():
    scan = L.model().scan
    for family, text in WRAPPED.items():
        assert [x[1] for x in scan(text.encode()) if x[1] != "unknown" or family != "LGPL"] == [family] * (1 if family == "LGPL" else 2), family
    assert [x[0] for x in scan(WRAPPED["MIT"].encode())] == [0, 4]
    for family, headings in L.HEADINGS.items():
        for heading in headings:
            assert [x[:2] for x in scan(f"a house\n{heading.upper()}\n".encode())] == [(1, family)]
    # two copies in one block, and another statement on the line where a wrapped one begins
    half = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met\n"
    assert [x[:2] for x in scan((half * 2).encode())] == [(0, "BSD"), (2, "BSD")]
    assert [x[:2] for x in scan(b"Released under the MIT License. This work is licensed under a Creative\nCommons Attribution 4.0 International License")] == [(0, "MIT"), (0, "CC-BY")]
    assert [x[:2] for x in scan(b"der den mit.\nEiner im dem.\nLicensed under the Apache License, Version 2.0.")] == [(2, "Apache-2.0")]


URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://net": ("net", "", None, None), "HTTPS://WWW.Example.NET/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://example.com/DE/": ("example.com", "/DE/", None, None), "x.net/a": ("", "", None, None), "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "ftp://u@a.org:80/fr/#z": ("u@a.org:80", "/fr/", None, None), "http://b.org/fr/x": ("b.org", "/fr/x", "org/fr/", "allow"), "http://É.org?x://y": ("É.org", "", None, None), "": ("", "", None, None), "http://": ("", "", None, None),
}


def test_urls(spark):
    rows = [(i, u, "n") for i, u in enumerate(URLS)] + [(99, None, "n"), (0, "http://a.net/x", "n"), (98, "http://z.test/" + "q" * 20_000, "n")]
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule) and out[i].verdict == (verdict or out[i].verdict)
    w, bias = U.weights()
    for i, url in enumerate(URLS):
        found = U.grams(out[i].host, out[i].path)
        found = [g for g in found if len(g) > 1 and not (out[i].host == "" and g[0] == "h" or out[i].path == "" and g[0] == "p")]
        expected = bias + sum(w[U.bucket(g)] for g in found) / math.sqrt(len(found)) if found else bias
        assert abs(out[i].score - expected) < 1e-3, url
    hosts = spark.createDataFrame([(1, "http://hot-casino-win.test/bonus"), (2, "http://www.erthing.example.com/en/55")], "page_id long, url string")
    assert [r.verdict for r in U.judge(hosts).orderBy("page_id").collect()] == ["block", "allow"]
    assert "Python" not in U.judge(hosts)._jdf.queryExecution().toString()


def call(i, name, **args):
    return {"id": i, "name": name, "arguments": args}


TURNS = [
    (1, 0, "user", "hi ü"), (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "weather", city="X", unit="c"), call("a", "search", query={"$result": "b"})]})),
    (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": [1]})), (1, 3, "tool", json.dumps({"content": "late", "tool_call_id": "b"})),
    (1, 4, "assistant", json.dumps({"tool_calls": [call("c", "calculate", expression="1")]})), (2, 0, "tool", json.dumps({"tool_call_id": "c", "content": 1})),
    (2, 1, "assistant", json.dumps({"tool_calls": [call("p", "search", query="q", limit={"$result": "q"}), call("q", "search", query={"$result": "p"})]})), (2, 2, "tool", json.dumps({"tool_call_id": "p"})), (2, 3, "tool", json.dumps({"tool_call_id": "q"})),
    (3, 5, "assistant", json.dumps({"tool_calls": [call("d", "weather", city="Y")]})), (3, 4, "tool", json.dumps({"tool_call_id": "d", "content": "early"})), (3, 6, "assistant", json.dumps({"tool_calls": [call("d", "weather", city="Y")]})),
    (4, 0, None, None), (4, 1, "user", "{broken"), (4, 2, "assistant", json.dumps({"tool_calls": [call("u", "nope")]})), (None, None, "user", "x"), (5, 0, "user", "y" * 300_000), (5, 0, "user", "y" * 300_000), (6, 0, "user", '{"content": "' + "\\ud800" + '"}'),
]


#: Notices of licences that the training doesn't have.
FURTHER = [
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)", "This is free software; you can redistribute it and/or modify it under\nthe terms of the Artistic License 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
    "This data is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2", "Licensed under the Universal Permissive License v 1.0 as shown at https://oss.oracle.com/licenses/upl.",
    "# This software is governed by the CeCILL license under French law and\n# abiding by the rules of distribution of free software.", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "This is free and unencumbered software released into the public domain.",
]
PROSE = ["All rights reserved seats were taken.", "The apache tribe version 2.0 of the story.", "Her license expired in {}.", "The {} public was not amused by the GNU in the zoo.", "They granted permission to cross the {} bridge.", "MIT students met at the {} fair.", "The source of the {} river is protected by law.", "He released the {} bird under an open sky.", "The terms of the {} deal stayed secret.", "A {} foundation gave its software away.", "Copies of the {} map were distributed by hand.", "The author of the {} novel kept the rights to the film.", "Version 2 of the {} plan was available at noon.", "Creative people and the commons of the {} village.", "Without any warning the {} storm arrived.", "You may use the {} garden with care.", "The work was done under the {} roof.", "The {} report was published by the general.", "A mozilla is no animal of the {} forest.", "Fees of the {} school were waived."]


def test_notices_of_further_licences_and_prose():
    scan = L.model().scan
    for text in FURTHER:
        assert {x[1] for x in scan(text.encode())} == {"unknown"}, text
    rng = random.Random(4)
    words = "old green northern quiet royal famous little broken hidden modern".split()
    prose = [rng.choice(PROSE).format(rng.choice(words)) for _ in range(200)]
    assert [t for t in prose if scan(t.encode())] == []
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    for text in (apache, "\n".join("# " + x for x in apache.split("\n"))):
        assert {x[1] for x in scan(text.encode())} == {"Apache-2.0"}
    both = apache + "\n\nThe fonts are licensed under the SIL Open Font License, Version 1.1."
    assert {x[1] for x in scan(both.encode())} == {"Apache-2.0", "unknown"}


def test_runs_against_all_windows():
    """Runs over lines against a search of every window of a block."""
    m, rng = L.model(), random.Random(8)
    every = [(f, s) for f, all_ in m.sequences.items() for s in all_ if len(s) > 6]
    for _ in range(40):
        family, words = rng.choice(every)
        words = [w for w in words if rng.random() > 0.1]
        flat = [b"zz"] * rng.randrange(4) + words + [b"yy"] * rng.randrange(4)
        cuts = sorted(rng.sample(range(1, len(flat)), min(3, len(flat) - 1)))
        lines = [flat[a:b] for a, b in zip([0, *cuts], [*cuts, len(flat)], strict=True)]
        line_of = [i for i, x in enumerate(lines) for _ in x]
        best = max((m.alike(family, flat[a:b]) for a in range(len(flat)) for b in range(a + 1, len(flat) + 1) if line_of[a] != line_of[b - 1]), default=0.0)
        found = max((x[0] for x in m.runs(lines) if x[3] == family), default=0.0)
        assert found <= best + 1e-9 and (found >= L.ALIKE or best < L.ALIKE + 0.1), (family, flat)


def test_words_in_order():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert L.in_order(a, b) == longest(a, b) / len(a)


def test_trees_against_a_walk():
    """The flat arrays against a walk from node to node, and the bounds of the monotone features."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 400, size=(300, len(R.COUNTS)))
    names, x = R.features(counts)
    labels = (x[:, 0] + rng.normal(size=300) * x[:, 0].std() > np.median(x[:, 0])).astype(float)
    trees = R.fit(counts, labels)

    def walk(t, row):
        at = 0
        while trees.left[t, at] != at:
            at = trees.left[t, at] if row[trees.feature[t, at]] <= trees.threshold[t, at] else trees.right[t, at]
        return trees.value[t, at]

    plain = [trees.base + sum(walk(t, row) for t in range(len(trees.value))) for row in x]
    assert np.allclose(trees.margin(x), plain)
    assert len({round(v, 6) for v in plain}) > 20
    for name, sign in R.MONOTONE.items():
        k = names.index(name)
        if sign:
            low, high = x.copy(), x.copy()
            high[:, k] += abs(x[:, k]).max()
            assert (sign * (trees.margin(high) - trees.margin(low)) >= -1e-9).all(), name


def test_url_weights_against_plain_descent():
    """The trained weights against dense gradient descent over the same table."""
    rows, labels = [], []
    for label, urls in ((1, U.BLOCKED), (0, U.ALLOWED)):
        for url in urls:
            host, slash, path = url.split("?")[0].split("#")[0].partition("/")
            row = np.zeros(U.BUCKETS)
            for g in U.grams(host, slash + path):
                row[U.bucket(g)] += 1
            rows.append(row / np.sqrt(row.sum()))
            labels.append(label)
    x, y, w, b = np.array(rows), np.array(labels), np.zeros(U.BUCKETS), 0.0
    for _ in range(U.PASSES):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        b, w = b - U.STEP * error.mean(), w * (1 - U.RIDGE) - U.STEP * (x.T @ error) / np.sqrt(len(y))
    found, bias = U.weights()
    assert np.allclose(found, w, atol=2e-6) and abs(bias - b) < 2e-6
    assert ((x @ w + b > 0) == y).all()


def test_labelled_counts_of_repeated_ids(spark):
    """Which of the texts of an id trains doesn't depend on how rows are spread."""
    from changeloom.llm import textstats as T

    docs = spark.createDataFrame([(i % 40, f"word{i} " * (i % 7 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = [tuple(x.tolist() for x in T.labelled_counts(docs.repartition(n), labels, 100)) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 20


def test_chat(spark):
    turns = spark.createDataFrame([(*t, "m") for t in TURNS], "conv_id long, turn long, role string, text string, message string")
    rows = H.chat_messages(turns).collect()
    out = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(TURNS)
    assert out[1, 0].message == '{"content":"hi ü","role":"user"}' and out[1, 1].status == "ok"  # a reference stands for a text
    order = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.order_turn, r.level, r.kind, r.turn))
    assert [r.turn for r in order] == [0, 1, 3, 2, 4]  # the call that waits and its result come after the result that it waits for
    assert out[1, 4].status == "no_result" and out[2, 0].status == "no_call" and out[2, 1].status == "cycle"
    assert out[3, 4].order_turn == 5 and out[3, 4].status == "ok" and out[3, 6].status == "duplicate_id"
    assert out[4, 0].message == '{"content":"","role":"user"}' and out[4, 1].message == '{"content":"{broken","role":"user"}' and out[4, 2].status == "unknown_tool"
    tools = {"search": {"type": "object"}, "weather": {"type": "object"}, "calculate": {"type": "object"}}
    out = {(r.conv_id, r.turn): r for r in H.chat_messages(turns, tools).collect()}
    assert out[1, 1].status == "ok" and out[1, 1].level == 1 and out[1, 2].level == 1 and out[1, 3].level == 0 and out[2, 1].status == "cycle"
    assert H.chat_messages(turns.where("false")).count() == 0


def test_chat_waits_against_turn_order(spark):
    said = lambda *calls: json.dumps({"tool_calls": list(calls)})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": i})
    turns = [
        # x (turn 1) waits for y, whose message comes later; z shares x's message, and w waits for z
        (1, 1, "assistant", said(call("x", "search", q={"$result": "y"}), call("z", "search"))), (1, 2, "assistant", said(call("y", "search"))),
        (1, 3, "tool", answer("x")), (1, 4, "tool", answer("y")), (1, 5, "assistant", said(call("w", "search", q={"$result": "z"}))), (1, 0, "tool", answer("z")), (1, 6, "tool", answer("w")),
        # inside one message, the result of a comes too early
        (2, 1, "assistant", said(call("b", "search"), call("a", "search", q={"$result": "b"}))), (2, 2, "tool", answer("a")), (2, 3, "tool", answer("b")),
        # a long way back, and results before their calls
        (3, 1, "assistant", said(call("k", "search", q={"$result": "l"}))), (3, 2, "assistant", said(call("l", "search", q={"$result": "m"}))), (3, 3, "assistant", said(call("m", "search"))),
        (3, 0, "tool", answer("k")), (3, 4, "tool", answer("l")), (3, 5, "tool", answer("m")),
        # no order of the messages: r waits for s, s for t, which shares r's message
        (4, 1, "assistant", said(call("r", "search", q={"$result": "s"}), call("t", "search"))), (4, 2, "assistant", said(call("s", "search", q={"$result": "t"}))),
        (4, 3, "tool", answer("r")), (4, 4, "tool", answer("s")), (4, 5, "tool", answer("t")),
    ]
    rows = H.chat_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), {"search": {"type": "object"}}).collect()
    order = lambda c: [r.turn for r in sorted((r for r in rows if r.conv_id == c), key=lambda r: (r.order_turn, r.level, r.kind, r.turn))]
    assert order(1) == [2, 4, 1, 0, 3, 5, 6]
    assert order(2) == [1, 3, 2]
    assert order(3) == [3, 5, 2, 4, 1, 0]
    assert len(rows) == len(turns) and {r.status for r in rows if r.conv_id < 4} == {"ok"}
    assert {r.turn: r.status for r in rows if r.conv_id == 4 and r.kind == 1} == {1: "cycle", 2: "cycle"}


def test_long_chains_of_calls(spark, monkeypatch):
    """A thousand calls that wait for each other, along the turns, against them, and a cycle that a chain waits for."""
    said = lambda i, *after: json.dumps({"tool_calls": [call(i, "search", query={"$result": after[0]} if after else "x")]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": i})
    n, turns = 1000, []
    for k in range(n):
        turns += [(1, 2 * k, "assistant", said(f"a{k}", *[f"a{k - 1}"] * (k > 0))), (1, 2 * k + 1, "tool", answer(f"a{k}"))]
        turns += [(2, 2 * (n - k), "assistant", said(f"b{k}", *[f"b{k - 1}"] * (k > 0))), (2, 2 * (n - k) + 1, "tool", answer(f"b{k}"))]
    turns += [(3, k, "assistant", said(f"c{k}", f"c{k - 1}" if k else "c1")) for k in range(50)] + [(3, 100 + k, "tool", answer(f"c{k}")) for k in range(50)]
    rounds = []
    monkeypatch.setattr(H, "written", lambda df, tag, f=H.written: (rounds.append(tag), f(df, tag))[1])
    rows = H.chat_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert rounds.count("placed") <= 4
    assert {r.status for r in rows if r.conv_id < 3} == {"ok"} and len(rows) == len(turns)
    assert {r.status for r in rows if r.conv_id == 3 and r.kind == 1} == {"cycle"}  # the first two wait for each other
    for c, i in ((1, "a"), (2, "b")):
        order = [json.loads(r.message) for r in sorted((r for r in rows if r.conv_id == c), key=lambda r: (r.order_turn, r.level, r.kind, r.turn))]
        assert [m["tool_calls"][0]["id"] if "tool_calls" in m else m["tool_call_id"] for m in order] == [f"{i}{k}" for k in range(n) for _ in range(2)]


def test_chat_texts_that_are_hard_to_read(spark):
    said = lambda *calls, **more: json.dumps({"tool_calls": list(calls), **more})
    nest = '{"tool_calls":[{"id":"d","name":"search","arguments":{"query":' + "[" * 100_000 + "]" * 100_000 + "}}]}"
    some = '{"tool_calls":[{"id":"d","name":"search","arguments":{"query":' + "[" * 1500 + "]" * 1500 + "}}]}"
    turns = [
        (1, 0, "assistant", nest), (1, 1, "assistant", some),
        (1, 2, "assistant", '{"tool_calls":[{"id":"n","name":"search","arguments":{"query":NaN}}]}'), (1, 3, "assistant", '{"tool_calls":[{"id":"n","name":"search","arguments":{"query":1e999}}]}'),
        (2, 0, "assistant", said(call("a\n1", "search", query="x"))), (2, 1, "assistant", said(call("b", "search", query="x", after={"$result": "a\n1"}))), (2, 2, "tool", json.dumps({"tool_call_id": "a\n1"})), (2, 3, "tool", json.dumps({"tool_call_id": "b", "content": [1, {"z": 2.5, "a": None}], "extra": 1})),
        (3, 0, "assistant", said(call("c", "search", query="x", after={"$result": "nowhere"}), content=["p", 1], note="kept")), (3, 1, "tool", json.dumps({"tool_call_id": "c"})),
        (None, None, None, None), (4, None, "assistant", said({"name": "search"}, {"id": None, "name": "search", "arguments": "{}"})),
    ]
    rows = H.chat_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), {"search": {}}).collect()
    out = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(turns)
    for turn in range(4):
        assert out[1, turn].kind == 0 and json.loads(out[1, turn].message) == {"role": "assistant", "content": turns[turn][3]}
    assert out[2, 1].level == 1 and out[2, 1].order_turn == 2 and {out[2, t].status for t in range(4)} == {"ok"}
    assert out[2, 3].message == '{"content":[1,{"a":null,"z":2.5}],"extra":1,"role":"tool","tool_call_id":"b"}'
    assert out[3, 0].status == "unknown_result" and json.loads(out[3, 0].message)["content"] == ["p", 1] and json.loads(out[3, 0].message)["note"] == "kept"
    assert out[None, None].message == '{"content":"","role":"user"}' and out[4, None].status == "no_result"


def test_chat_against_brute_force(spark):
    rng = random.Random(12)
    ranks = list(H.FAULTS)
    turns, expected, linked = [], {}, {}
    for conv in range(60):
        messages, results, turn = {}, [], 0
        for _ in range(rng.randint(1, 7)):
            turn += 1
            if rng.random() < 0.55:
                messages[turn] = [(rng.choice([None, *"abcdef"]), rng.choice(["search"] * 9 + ["none"]), rng.sample("abcdefg", rng.choice([0, 0, 1, 1, 2]))) for _ in range(rng.randint(1, 3))]
                turns.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": {"on": [{"$result": w} for w in ws]}} for i, n, ws in messages[turn]]})))
            else:
                results.append((turn, rng.choice("abcdef")))
                turns.append((conv, turn, "tool", json.dumps({"tool_call_id": results[-1][1], "content": turn})))
        first = {}
        for t, calls in messages.items():
            for p, (i, _, _) in enumerate(calls):
                first.setdefault(i, (t, p))
        answered = {i for _, i in results}
        outer = {t: {first[w][0] for _, _, ws in calls for w in ws if w in first} - {t} for t, calls in messages.items()}
        placed = set()
        while more := {t for t in messages if t not in placed and outer[t] <= placed}:
            placed |= more
        for t, calls in messages.items():
            inner = {p: {first[w][1] for w in ws if w in first and first[w][0] == t} for p, (_, _, ws) in enumerate(calls)}
            done = set()
            while more := {p for p in inner if p not in done and inner[p] <= done}:
                done |= more
            faults = []
            for p, (i, n, ws) in enumerate(calls):
                waits = any(w in first for w in ws)
                if n != "search":
                    faults.append("unknown_tool")
                elif any(w not in first for w in ws):
                    faults.append("unknown_result")
                elif i not in answered:
                    faults.append("no_result")
                elif first[i] != (t, p):
                    faults.append("duplicate_id")
                else:
                    faults.append("cycle" if (t in placed and p not in done) or (t not in placed and waits) else "ok")
            expected[conv, t] = min(faults, key=ranks.index)
        if len(placed) == len(messages):
            linked[conv] = (messages, results, first)
        for t, i in results:
            expected[conv, t] = "ok" if i in first else "no_call"
    rng.shuffle(turns)
    rows = {(r.conv_id, r.turn): r for r in H.chat_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), {"search": {}}).collect()}
    assert {k: r.status for k, r in rows.items()} == expected
    assert len(set(expected.values())) >= 6 and len(linked) > 30
    at = lambda c, t: (rows[c, t].order_turn, rows[c, t].level, rows[c, t].kind, t)
    for conv, (messages, results, first) in linked.items():
        for t, i in results:
            if i in first:
                assert at(conv, t) > at(conv, first[i][0])
        for t, calls in messages.items():
            for _, _, ws in calls:
                for w in ws:
                    if w in first and first[w][0] != t:
                        assert at(conv, t) > at(conv, first[w][0])
                        assert all(at(conv, t) > at(conv, r) for r, i in results if i == w)


def test_schemas():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert H.valid({"a": 1, "b": [1, 2], "c": None}, schema)
    for bad in ({}, {"a": True}, {"a": 1.5}, {"a": 1, "b": [3]}, [], None, "x"):
        assert not H.valid(bad, schema)
    assert H.canonical({"b": [1.0, "é\n"], "a": None}) == '{"a":null,"b":[1.0,"é\\n"]}'


def mix_rows():
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 40), "hot") for i in range(900)] + [(1000 + i, "w " * rng.randint(1, 40), "mid") for i in range(300)] + [(2000 + i, "w " * rng.randint(1, 40), None) for i in range(80)]
    return rows + [(3000, None, "void"), (3001, "", "void"), (1, rows[1][1], "hot")]


def test_mixing(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "b", 7) for r in rows], "doc_id long, text string, source string, block string, hash int")
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    total = sum(words.values())
    for target in (M.Target(entropy=1.0, repeats=1.5), M.Target(entropy=1.0, repeats=3.0), M.Target(entropy=0.9, repeats=9.0), M.Target(entropy=1.0, repeats=2.0, budget=total * 0.5)):
        out = M.schedule(docs, target).collect()
        got = Counter()
        for r in out:
            got[r.source] += r.tokens
        a = next(a / 2000 for a in range(2001) if fits(words, a / 2000, target))
        z = sum((n / total) ** a for n in words.values() if n)
        weights = {s: (n / total) ** a / z for s, n in words.items() if n}
        budget = target.budget or max(words[s] / w for s, w in weights.items())
        for s, w in weights.items():
            assert abs(got[s] - w * budget) <= 0.002 * budget + 80, (s, target)
        places = Counter((r.source, r.epoch, r.block, r.place) for r in out)
        assert max(places.values()) == 1
        copies = Counter(r.doc_id for r in out)
        if target.budget is None:
            assert set(copies) == {r[0] for r in rows}
        again = Counter((r.doc_id, r.source) for r in M.mixed(docs.repartition(5), target).collect())
        assert again == Counter((r.doc_id, r.source) for r in out)
    assert M.mixed(docs, M.Target()).columns == docs.columns
    assert M.schedule(docs.where("false"), M.Target()).count() == 0 and M.mixed(docs.where("false"), M.Target()).count() == 0
    assert "Python" not in M.schedule(docs, M.Target())._jdf.queryExecution().toString()


def fits(words, a, target):
    total, full = sum(words.values()), [n for n in words.values() if n]
    z = sum((n / total) ** a for n in full)
    w = [(n / total) ** a / z for n in full]
    entropy = -sum(x * math.log(x) for x in w)
    passes = [x * total / n for x, n in zip(w, full, strict=True)]
    most = max(passes) / min(passes) if target.budget is None else max(passes) * target.budget / total
    return a == 1 or entropy <= target.entropy * math.log(len(full)) + 1e-9 and most <= target.repeats + 1e-9


def test_held_out(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), S.held_out().alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]


def test_mixing_with_very_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    target = M.Target(entropy=0.99, repeats=2.0)
    few = sorted(map(tuple, M.schedule(docs, target).collect()), key=repr)
    monkeypatch.setattr(M, "FEW", 1)  # nothing is collected or broadcast
    monkeypatch.setattr(M, "STEPS", 25)
    many = sorted(map(tuple, M.schedule(docs, target).collect()), key=repr)
    assert abs(len(few) - len(many)) <= 2 and len(set(few) & set(many)) >= len(few) - 4
