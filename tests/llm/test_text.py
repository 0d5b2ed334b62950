"""Chat formatting, language id, decontamination, license scan and the pipeline."""

import json
import random
import time

import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from touchline.llm import chat_format, decontamination, language_id, licenses
from touchline.llm.storage import prepare, table


def records(spark, values):
    return spark.createDataFrame(list(enumerate(map(json.dumps, values))), "conv_id bigint, j string").select(
        "conv_id", F.parse_json("j").alias("record"))


def test_layouts_become_turns(spark):
    found = chat_format.canonical_turns(records(spark, [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "i", "output": "o", "meta": {"text": "no"}},
        {"prompt": "p", "completion": "c"},
        {"something": "else"},
        {"turn": 4, "role": "user", "text": None, "node": [1]}])).orderBy("conv_id", "turn").collect()
    got = [(r.conv_id, r.turn, r.role, r.text) for r in found]
    assert got == [(0, 0, "user", "a"), (0, 1, "assistant", ""), (1, 0, "user", "a"), (1, 1, "assistant", "b"),
                   (2, 0, "user", "i"), (2, 1, "assistant", "o"), (3, 0, "user", "p"), (3, 1, "assistant", "c"),
                   (4, None, "", ""), (5, 4, "user", "")]
    assert [r.conv_id for r in found if r.unknown] == [4]


@pytest.mark.parametrize("text", ["", "<|end|>\n", "\\", "\\\\<|x|>\\|>", "<|>|>", "a|\n<", "é🙂<|assistant|>\n"])
def test_control_strings_come_back(spark, text):
    turns = spark.createDataFrame([(1, 0, text or "r", text), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    pieces = chat_format.formatted_pieces(turns)
    for r in pieces.collect():
        assert r.piece.count("<|") == 2 and r.piece.count("|>") == 2
    back = chat_format.parsed_pieces(pieces).orderBy("turn").collect()
    assert [(r.role, r.text, r.loss) for r in back] == [(text or "r", text, ""), ("assistant", text, text)]


def test_wide_deep_and_unknown_records(spark):
    deep = "x"
    for _ in range(12):
        deep = {"a": [deep]}
    wide = {f"field{i}": {"text": i} for i in range(3000)}
    values = [
        {"messages": [{"role": "Human", "content": "hi", **wide, "deep": deep}]},
        {"messages": [{"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        {"messages": [{"role": "user", "content": "a"}, "loose"]},
        {"prompt": "p", "response": "r", "text": "t"}, {"messages": []}, {"text": ["no"], "role": "user", "turn": 1}]
    turns = chat_format.canonical_turns(records(spark, values))
    got = {r.conv_id: r for r in turns.where("coalesce(turn, 0) = 0").collect()}
    assert [(got[i].role, got[i].text) for i in (0, 1)] == [("user", "hi"), ("assistant", "ab")]
    assert sorted(r.text for r in turns.where("conv_id = 2").collect()) == ["a", "loose"]
    pieces = {r.conv_id: r.piece for r in chat_format.formatted_pieces(turns).collect()}
    for i in (3, 4, 5):
        assert got[i].unknown and json.loads(got[i].raw) == values[i]
        assert json.dumps(values[i], separators=(",", ":"), sort_keys=True) in pieces[i]


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, unknown string")
    assert chat_format.conversation_digests(chat_format.parsed_pieces(chat_format.formatted_pieces(none))).count() == 0


def test_held_out_accuracy(spark, query):
    sf = "/root/testdata/sf0.01"
    found = query["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(spark):
    prepare(spark)
    words = {"aa": "alba banda casa", "bb": "krzy wstrz szcz"}
    rows = [(i, " ".join(random.choices(words[lang].split(), k=20)), lang) for i in range(80) for lang in [random.choice(list(words))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", None), (None, "alba", "aa")], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb"]
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !?") == ("und", 0.0)
    assert model.predict("casa banda")[0] == "aa" and model.predict("szcz" * 200_000)[0] == "bb"
    assert model.predict("日本")[0] in ("aa", "bb")
    empty = language_id.fit(docs.limit(0))
    assert docs.select(language_id.identified(docs, empty)["lang_pred"].alias("l")).distinct().collect()[0].l == "und"


def test_filter_corrects_false_positives():
    import numpy as np
    rng = np.random.default_rng(0)
    slots = (rng.random(1 << language_id.SLOTS_LOG2) < 0.6).astype(np.uint8)
    model = language_id.Model(["x"], np.ones(1), [slots])
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    real = (model.hits(keys) - len(keys) * model.false) / (1 - model.false)
    assert abs(real[0]) < 400


def test_decontamination_finds_all_passages(spark, query):
    sf = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.item_id) for r in query["op7_decontamination"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    real = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert real and real <= found and len(found - real) <= 0.05 * len(found) + 1


def test_paraphrases_and_odd_rows(spark, docs_of):
    prepare(spark)
    random.seed(2)
    vocabulary = [f"word{i}" for i in range(6000)]
    items = [random.sample(vocabulary, 40) for _ in range(20)]
    other = [" ".join(random.sample(vocabulary, 150)) for _ in range(60)]
    near = list(items[3])
    for i in range(0, 30, 3):
        near[i] = random.choice(vocabulary)     # three quarters stay, and the end, which stands for the answer
    texts = other + [" ".join(random.sample(vocabulary, 70) + near + random.sample(vocabulary, 70)), " ".join(items[5]).upper(), None, ""]
    docs = docs_of(list(enumerate(texts)), "words", "item_id")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (98, None), (99, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(60, 3), (61, 5)}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_the_space_is_fitted_on_every_passage(spark, docs_of):
    docs = docs_of([(1, " ".join(f"w{i}" for i in range(95))), (2, None), (3, "?"), (4, "one two"), (4, "one two")])
    bench = spark.createDataFrame([(1, "three four five")], "item_id bigint, text string")
    passages = decontamination.benchmark_passages(bench)
    rows = decontamination.fitted_passages(docs, passages).collect()
    texts = [" ".join(f"w{i}" for i in part) for part in (range(40), range(40, 80), range(80, 95))]
    expected = [("three four five", 1.0), ("one two", 0.25), ("one two", 0.25)] + [(t, 0.25) for t in texts]
    buckets = [decontamination.word_buckets(w) for w in decontamination.word_hashes([t for t, _ in expected])]
    assert sorted((bytes(r.buckets), r.weight) for r in rows) == sorted((b.astype("<u2").tobytes(), w) for b, (_, w) in zip(buckets, expected, strict=True))

    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 5, 1 << decontamination.BUCKETS_LOG2).astype(np.float32)
    basis = rng.standard_normal((1 << decontamination.FEATURES_LOG2, 3)).astype(np.float16)
    dense = np.zeros((len(buckets), len(basis)))
    for i, b in enumerate(buckets):
        np.add.at(dense[i], decontamination.features_of(b), idf[b])
        dense[i] *= expected[i][1] / np.linalg.norm(dense[i])
    got = decontamination.gram_product(decontamination.fitted_passages(docs, passages), idf, 3, basis)
    assert np.allclose(got, dense.T @ (dense @ basis.astype(float)), atol=1e-3)


def test_a_pass_over_few_rows_per_partition_adds_few_tables(spark, docs_of):
    """Runs of rows longer than a piece, and many partitions: the sums are right and come from a core each."""
    rng = np.random.default_rng(3)
    rows, values = rng.standard_normal((9, 4)).astype(np.float32), rng.random(60).astype(np.float32)
    chosen, starts = rng.integers(0, 9, 60), np.array([0, 1, 5, 37, 38])
    expected = [(rows[c] * v[:, None]).sum(axis=0) for c, v in zip(np.split(chosen, starts[1:]), np.split(values, starts[1:]), strict=True)]
    assert np.allclose(decontamination.run_sums(rows, chosen, values, starts, 4), expected, atol=1e-5)

    docs = docs_of([(i, " ".join(rng.choice(["one", "two", "three", "four"], 30))) for i in range(40)]).repartition(40)
    bench = spark.createDataFrame([(1, "three four five")], "item_id bigint, text string")
    matrix = decontamination.fitted_passages(docs, decontamination.benchmark_passages(bench))
    assert matrix.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    idf = rng.uniform(1, 5, 1 << decontamination.BUCKETS_LOG2).astype(np.float32)
    basis = rng.standard_normal((1 << decontamination.FEATURES_LOG2, 3)).astype(np.float16)
    whole = basis.T.astype(float) @ decontamination.gram_product(matrix, idf, 3, basis)
    assert np.allclose(decontamination.projected_gram(matrix, idf, basis), whole, rtol=1e-3, atol=1e-3)


def test_parts_of_documents_are_searched_together():
    """Windows of many documents at once, cut or not, are those of each document alone."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 20, 61, 205, 7)]
    groups = list(decontamination.groups_of_parts(docs, 5))
    assert {d for g in groups for d, _ in g} == {1, 2, 3, 4, 5}
    assert all(len(g) == 1 or sum(len(p) for _, p in g) <= 5 * decontamination.STEP for g in groups)
    rebuilt = {}
    for g in groups:
        for d, part in g:
            rebuilt.setdefault(d, []).append(part[:5 * decontamination.STEP])
    assert all(np.array_equal(np.concatenate(rebuilt[d]), docs[d]) for d in rebuilt)

    lifted = rng.standard_normal((1 << decontamination.BUCKETS_LOG2, 4)).astype(np.float32)
    parts = [p for p in docs if len(p)]
    blocks, first = decontamination.latent_blocks(parts, lifted)
    for at, part in zip(first, parts, strict=True):
        own = decontamination.latent(part, lifted)
        assert np.array_equal(blocks[at:at + len(own)], own)
        assert not blocks[at + len(own):at + len(own) + decontamination.SPAN - 1].any()


def test_short_copies_in_long_windows(spark, docs_of):
    """Copies of short items, with a benchmark of many others; the second word of an item of two is everywhere."""
    prepare(spark)
    random.seed(8)
    vocabulary = [f"word{i}" for i in range(4000)]
    items = [random.choices(vocabulary[:300], k=n) for n in (2, 5, 9, 12, 15, 19, 30)] + [random.choices(vocabulary, k=40) for _ in range(4500)]
    texts = []
    for item in items[:7]:
        for before in (0, 13, 190):
            texts.append(" ".join(random.choices(vocabulary, k=before) + item + random.choices(vocabulary, k=200 - before)))
    docs = docs_of(list(enumerate(texts + ["", None, items[2][0]])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).where("shared = 1").collect()}
    assert found >= {(i, i // 3) for i in range(21)}


def test_common_subsequence():
    mask = {}
    for i, w in enumerate([1, 2, 3, 2, 4]):
        mask[w] = mask.get(w, 0) | 1 << i
    assert decontamination.common_subsequence(mask, 5, [2, 9, 3, 4, 4, 1]) == 3
    assert decontamination.common_subsequence(mask, 5, []) == 0


@pytest.mark.parametrize("text, expected", [
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("x\nReleased under the MIT License.\ny", ["MIT"]),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted:\n1. Redistributions of source"
     " code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.", ["BSD-2-Clause"]),
    ("The license plate said MIT. We left.", []), ("", []), ("licen " * 100_000, [])])
def test_license_rules(text, expected):
    assert [s[0] for s in licenses.scan(text)] == expected


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("text, name", [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (GPL, "GPL-3.0"),
                                        (GPL.replace("General", "Affero General"), "AGPL-3.0"), (APACHE, "Apache-2.0")])
def test_wrapped_notices(text, name, mark):
    text = "\n".join(mark + line for line in text.split("\n"))
    for before in ("", "Copyright (c) 2020 Some One\n", "no full stop\n"):
        found = licenses.scan(before + text + "\n")
        assert [f[0] for f in found] == [name]
        assert found[0][1] <= len(before) + len(mark) and (name == "Apache-2.0" or found[0][2] >= len(before + text) - 1)


@pytest.mark.parametrize("text, expected", [
    ("Licensed under the GPL v3.", ["GPL-3.0"]), ("Licensed under GPLv3", ["GPL-3.0"]), ("License: x\nLicensed under LGPLv2.1", ["LGPL-2.1"]),
    ("Licensed under the Apache License v2.0.", ["Apache-2.0"]), ("Licensed under the Mozilla Public License v2.0.", ["MPL-2.0"]),
    ("This work is licensed under the GNU General\nPublic License, version\n3.", ["GPL-3.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + " and more" * 500 + ".", ["MIT"])])
def test_license_versions_and_lengths(text, expected):
    assert [s[0] for s in licenses.scan(text)] == expected


@pytest.mark.parametrize("words, name", [
    ("AGPL 3.0", "AGPL-3.0"), ("LGPL 3.0", "LGPL-3.0"), ("LGPL 2.1", "LGPL-2.1"), ("GPL 3", "GPL-3.0"), ("GPL 2.0", "GPL-2.0"), ("GPL", "GPL"),
    ("Apache 2.0", "Apache-2.0"), ("MIT", "MIT"), ("Expat", "MIT"), ("BSD 2-Clause", "BSD-2-Clause"), ("new BSD", "BSD-3-Clause"),
    ("MPL 2.0", "MPL-2.0"), ("EPL 2.0", "EPL-2.0"), ("ISC", "ISC"), ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Creative Commons Attribution ShareAlike 4.0", "CC-BY-SA-4.0"),
    ("Creative Commons Attribution 4.0", "CC-BY-4.0"), ("CC0 1.0", "CC0-1.0"), ("Unlicense", "Unlicense")])
def test_grants_without_other_terms(words, name):
    for verb in ("Released", "Distributed", "Available"):
        assert [s[0] for s in licenses.scan(f"A tool.\n{verb} under {words}.\nMore.")] == [name]


def test_every_matcher_has_a_stem():
    samples = {
        "copyright": "Copyright 2020 X", "all-rights": "All rights reserved", "apache-may-not-use": "You may not use this file except in compliance with the License",
        "apache-obtain": "You may obtain a copy of the License at x", "apache-see": APACHE.split(".\n")[-1][:-1],
        "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis",
        "mit-permission": MIT.split("\n\n")[0], "mit-notice": MIT.split("\n\n")[1], "mit-as-is": "The software is provided as is without warranty of any kind",
        "mit-liable": "In no event shall the authors or copyright holders be liable for any claim",
        "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "bsd-redistribution": BSD.split("\n\n")[0], "bsd-source": "Redistributions of source code must retain the above copyright notice",
        "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
        "bsd-endorse": "Neither the name of X may be used to endorse or promote products",
        "bsd-as-is": "This software is provided by X as is and any express or implied warranties", "gpl-warranty": "It is distributed in the hope that it will be useful",
        "gpl-see": "See the GNU General Public License for more details", "gpl-received": "You should have received a copy of the GNU General Public License",
        "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License v. 2.0",
        "public-domain": "This work is dedicated to the public domain", "no-warranty": "It is provided without warranty"}
    assert set(samples) == set(licenses.SENTENCES)
    for name, text in samples.items():
        assert [k[0] for k in licenses.known_parts(licenses.lines_of(text, 0, len(text)))] == [name]


def test_license_query(spark, sf, query):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in query["op9_license_scan"](spark, sf).collect():
        assert r.licences == sorted({name for line, name in lines.items() if line in texts[r.doc_id].split("\n")})


def test_licenses_of_odd_rows(spark, docs_of):
    found = licenses.license_scan(docs_of([(1, None), (1, None), (None, "Released under the MIT License.")], "licences")).collect()
    assert sorted((r.doc_id or 0, len(r.licences)) for r in found) == [(0, 1), (1, 0), (1, 0)]


def test_license_scan_is_linear_in_blanks():
    text = "Licensed" + " " * 300_000 + "under the MIT License." + "\n" + "- " * 150_000 + "\t" * 300_000 + "end"
    started = time.monotonic()
    found = licenses.scan(text)
    assert [name for name, _, _ in found] == ["MIT"] and time.monotonic() - started < 20


def test_wrapped_notice_with_carriage_returns():
    text = ("Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated"
            " documentation files (the \"Software\"), to deal\r\nin the Software without restriction.\r\n")
    assert licenses.scan(text) == [(n, a, b) for n, a, b in licenses.scan(text.replace("\r\n", " \n"))]


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns, name
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]


def test_stages_keep_odd_rows(spark):
    text = "a long enough line of words to be looked at here"
    docs = spark.createDataFrame([(1, None, "x", 0), (1, text, "y", 48), (1, text, "z", 48), (None, "", None, None)],
                                 "doc_id bigint, text string, row_no string, n_chars bigint")
    near = corpus_pipeline.dedup_near(spark, docs, "")
    assert near.count() == 3 and near.columns == docs.columns
    lines = corpus_pipeline.dedup_lines(spark, docs, "")
    assert lines.count() == 3 and lines.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_take_clashing_and_odd_columns(spark, sf):
    text = "a long enough line of words to be looked at here, one that says nothing of note"
    columns = ["__row", "__gone", "__language", "__row_no", "__lines_gone", "row_no"]
    rows = [(1, None, "en", *columns), (2, "", None, *columns), (3, text, "en", *columns), (3, text, "en", *columns)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in columns))
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, sf)
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "packing":
            assert left.columns == docs.columns
            found = left.collect()
            assert all(r[c] == c for r in found for c in columns) and len(found) <= 4
    assert left.where("doc_id in (1, 2)").count() == 2     # an empty text is one end token
