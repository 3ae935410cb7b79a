"""Operators of the llm subpackage against brute force, exact round trips and held-out rows, on small tables with odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from votepanel.llm import bpe, chat, components, grading, licences, mixing, near_dup, outliers, repeats, revisits, topk

DOCS = "doc_id long, text string, lang string, source string, title string"


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    long = " ".join(words(3000, 5))
    base = words(120, 1)
    edited = base[:60] + ["other"] + base[61:]
    return [
        (1, " ".join(base), "en", "a", "x"),
        (2, " ".join(edited), "en", "a", None),
        (3, " ".join(base).upper(), "en", None, "y"),
        (4, None, None, None, None),
        (5, "", "en", "a", ""),
        (6, " \t\n", "en", "b", ""),
        (7, "one two", "de", "b", ""),
        (8, "One  two", "de", "b", ""),
        (9, long, "en", "a", ""),
        (10, long, "en", "a", ""),
        (None, " ".join(base), "en", "a", ""),
        (11, "naïve 日本語 \U0001f642 text", "en", "c", ""),
        (11, "naïve 日本語 \U0001f642 text", "en", "c", ""),
    ]


def group_oracle(rows):
    sets = []
    for _, t, *_ in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for i in live:
        for j in live:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(j)] = find(i)
    low = {}
    for i in live:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return [(r[0], len(sets[i]), low[find(i)] if i in live else r[0]) for i, r in enumerate(rows)]


def test_near_duplicates_odd_rows_and_groups(spark, monkeypatch):
    rows = odd_rows()
    base = words(300, 2)
    for k in range(40):  # copies with own edits, at similarities on both sides of the threshold
        r = random.Random(k)
        w = list(base)
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(300)] = f"edit{k}"
        rows.append((100 + k, " ".join(w), "en", "a", ""))
    want = sorted(group_oracle(rows), key=str)
    for small in (64, 2):  # also the path of large buckets
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "BLOCK", 16)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_at_80_percent(spark, tmp_path):
    import corpus_pipeline

    assert near_dup.layout(85) == (26, 5, 88) and near_dup.layout(80)[:2] == (32, 4)
    with pytest.raises(ValueError):
        near_dup.layout(79)
    rows, far = [], 0
    for k in range(40):  # 204 words are 200 shingles; 4 far edits replace 20 of them: 180 of 220, similarity 0.818
        w = words(204, 1000 + k, 5000)
        rows.append((2 * k, " ".join(w), "en", "a", 0))
        n = 4 if k % 4 else 5  # 5 edits: 175 of 225, similarity 0.778
        far += n == 5
        for at in range(20, 20 + 40 * n, 40):
            w[at] = f"edit{k}"
        rows.append((2 * k + 1, " ".join(w), "en", "a", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert near_dup.near_duplicates(docs).where("kept").count() == 80  # op3 stays at 0.85
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert left == {2 * k for k in range(40)} | {2 * k + 1 for k in range(0, 40, 4)} and len(left) == 40 + far


def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    x, y, z, q = (" ".join(words(150, 2000 + k, 5000)) for k in range(4))  # all over 400 bytes
    near = " ".join(words(150, 2002, 5000)[:-1] + ["edit"])
    rows = [(7, x), (7, x), (None, x), (None, y), (None, y), (9, z), (9, q), (8, near), (None, q), (20, None), (20, None), (21, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(7, x), (None, y), (8, near), (9, q), (20, None), (20, None), (21, " ")], key=str)
    left = {r.text for r in corpus_pipeline.repeated_passages(spark, out, str(tmp_path)).collect()}
    assert {x, y, near, q} <= left


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    got = dict(components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}}


def test_bpe_equals_library_and_round_trip(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    encode, decode = bpe.codec(path, P.PATTERN)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["a" * 3000, " " * 50 + "x", "a \n b\t c  d", "<|endoftext|>", "\r\n\r\n", "ab" * 999]
    r = random.Random(4)
    texts += ["".join(r.choice("abcéü 12\n'sßжя日🙂 ") for _ in range(r.randrange(80))) for _ in range(400)]
    for t in texts:
        assert encode(t) == library.encode_ordinary(t)
        assert decode(encode(t)) == t
    assert decode.feed(b"", b"\xe6\x97") == (b"\xe6\x97", "") and decode.feed(b"\xe6\x97", b"\xa5\xff") == (b"", "日�")
    rows = bpe.encode_documents(spark.createDataFrame(odd_rows(), DOCS), path, P.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(odd_rows())
    for row in rows:
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest() and row.n_tokens == len(row.ids)


def repeats_oracle(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((len(t), sum(cover), sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("collection", [4096, 1])
def test_repeats_against_brute_force(spark, monkeypatch, collection):
    monkeypatch.setattr(repeats, "COLLECTION", collection)
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh é\n") for _ in range(3000))
    rows = [(1, base[:900]), (2, "x" * 200 + base[100:700] + "y" * 300), (3, base[300:1200]), (4, "a" * 3000), (5, "ab" * 500), (6, None), (7, ""), (8, base[1500:1899]), (9, base[1400:2000])]
    rows += [(10, ("a line that repeats %s\n" % base[2000:2100]) * 7), (11, base[2100:2700]), (11, base[2100:2700]), (None, "q" * 100 + base[2500:3000]), (12, "a" * 399)]
    docs = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, key string")
    want = [(d, *x, x[0] - x[1]) for (d, _), x in zip(rows, repeats_oracle([(t or "").encode() for _, t in rows], 400))]
    assert sorted(map(tuple, repeats.repeats_report(docs).collect()), key=str) == sorted(want, key=str)
    left = repeats.remove_repeats(docs)
    assert left.columns == docs.columns and {x.doc_id: x.text for x in left.collect()}[6] is None
    assert repeats.repeats_report(docs.limit(0)).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[i - 150][1]) for i in range(150, 170)]  # ties
    rows += [(200, None), (220, [float("nan")] * 6), (240, [None] * 6), (None, [0.1] * 6), (260, []), (280, [0.5, 0.5]), (300, [0.25, -0.5]), (3, rows[3][1])]
    rows += [(20, rows[7][1]), (20, rows[7][1]), (310, [2.0**22, 1.0]), (400, [1.0, 2.0**23])]  # repeated query ids, large values
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, 20).collect()
    sound = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, a) in enumerate(sound):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(sound) if other != at and len(b) == len(a))[:20]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    with pytest.raises(Exception, match="64-bit"):
        topk.exact_top_k(spark.createDataFrame([(20, [1e12, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()


def test_chat_round_trip_and_mask(spark):
    import public_tokenizers as P

    for t in ["</s>[INST] ok [/INST]", "\\", "<|end|>\\<|", "a\\n", "<<SYS>>", "", "<", "[", "\\\\<\\|x"]:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    rows = [(1, 1, "assistant", " é <|end|> \\"), (1, 0, "user", "hi"), (1, 2, "user", None), (1, 3, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "user", "u"), (3, None, "assistant", "")]
    df = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {x.conv_id: x for x in chat.chat_report(df).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(" é <|end|> \\".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\n é <|end|> \\\nuser\n\n\nx\n".encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[3].loss_chars == 0 and got[None].n_turns == 1


def test_mix_targets_cap_and_repeats(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), "en", r.choice("aaaaaabbc"), "t") for i in range(800)] + odd_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("title", "size")
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    by = collections.defaultdict(list)
    for x in out:
        by[x.source_size, x.target].append(x)
        assert x.taken <= 3 * x["size"]
    for (size, target), xs in by.items():
        assert target <= 3 * size and abs(sum(x.taken for x in xs) - target) <= max([x["size"] for x in xs] + [1])
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6 * max(1, sum(s for s, _ in by))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in out if x.taken)
    unequal = mixing.mix_sources(docs.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)), doc_weight="w").collect()
    even, odd = ([x.taken / x["size"] for x in unequal if x["size"] and x.doc_id is not None and x.doc_id < 800 and x.doc_id % 2 == k] for k in (0, 1))
    assert sum(even) / len(even) > sum(odd) / len(odd)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mix_of_wordless_sources_and_clashing_names(spark):
    names = "doc_id long, text string, source string, target string, source_size int, taken int, size int, copies int, `a.b` string, weight double"
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "abc"[i % 3], f"t{i}", i, i, i, i, "x", 1.0) for i in range(60)]
    empty = [(100 + i, t, "none", "t", 0, 0, 0, 0, "x", 1.0) for i, t in enumerate([None, "", " \n", None])]
    for part in (rows + empty, empty):
        docs = spark.createDataFrame(part, names)
        got = mixing.mix_sources(docs).collect()
        assert len(got) == len(part) and all(x.taken == 0 and x.target == 0 for x in got if x.doc_id >= 100)
        mixed = mixing.mixed_documents(docs, doc_weight="weight")
        assert mixed.columns == docs.columns and mixed.schema.simpleString() == docs.schema.simpleString()
        back = mixed.collect()
        assert sum(x["taken"] for x in got) == sum(len(r.text.split()) for r in back) and all(r.target == f"t{r.doc_id}" and r.taken == r.doc_id for r in back)


def test_licences(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "This work is licensed under the GNU General Public License, version 3; or, at your option, any later version."), (3, None), (4, "license"), (5, "Released under the MIT License. All rights reserved."), (5, "# Licensed under CC BY-NC 4.0.")]
    got = sorted((r.doc_id, r.licences, r.unmatched, r.n_known) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "Apache-2.0", "", 1), (2, "GPL-3.0-or-later", "", 2), (3, "", "", 0), (4, "", "", 0), (5, "CC-BY-NC-4.0", "", 1), (5, "MIT", "AllRights", 2)]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
"""
GPL3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


def test_published_licence_texts(spark):
    cases = {
        1: (MIT, "MIT-text"), 2: (" ".join(MIT.split("\n")), None), 3: (GPL2, "GPL-2.0-or-later-notice"), 4: (GPL3, "GPL-3.0-or-later-notice"), 5: ("Licensed under the Apache License,\nVersion 2.0", "Apache-2.0"),
        6: ("x\n\npublic-domain\n\ny", "public-domain"), 7: ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        8: ("code()\nAll\u00a0rights reserved\nmore()", ""), 9: (MIT.replace("\n", "\n# "), "MIT-text"),
    }
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    assert all(got[k].licences == want for k, (_, want) in cases.items() if want is not None)
    assert got[8].unmatched == "AllRights" and "AsIs" in got[2].sentence_ids


def test_revisits(spark):
    assert spark.range(1).select(revisits.canonical_url(F.lit("HTTP://Ex.com:80/a/?b=2&a=1#f"))).first()[0] == "http://ex.com/a?a=1&b=2"
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "http://e.com/a", 10, 200, h(ETag="t1", X="1", Date="d1"), "D1", 5), (2, "http://e.com/a", 20, 200, h(ETag="t2"), "D2", 6), (3, "http://E.com/a#x", 20, 304, h(etag="W/t1", date="d3", x="9"), None, 0),
        (4, "http://e.com/a", 30, 304, h(etag="t1"), None, 0), (5, "http://e.com/a", 5, 304, h(etag="t1"), None, 0), (6, "http://e.com/a", 31, 304, None, None, 0), (7, None, 1, 304, None, None, 0),
    ]
    rows += [(8, "http://e.com/b", 1, 200, {"ETag": "t", "VARY": "b", "Vary": "a"}, "D3", 1), (9, "http://e.com/b", 2, 304, {"ETag": "t", "etag": "t", "Date": None, "date": "d9"}, None, 0)]
    rows += [(100 + k, "http://e.com/hot", 100 + k, 200 if k % 50 == 0 else 304, h(etag="s"), f"H{k}", 1) for k in range(200)]
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, n_bytes long").repartition(5)).collect()}
    assert got[3].outcome == "resolved" and got[3].response_id == 1 and got[3].headers == "date: d3\netag: W/t1\nx: 1"
    assert (got[4].outcome, got[5].outcome, got[6].outcome) == ("changed", "unmatched", "unchecked") and 7 not in got
    assert got[9].outcome == "resolved" and got[9].headers == "date: d9\netag: t\nvary: b, a"
    assert all(got[100 + k].response_id == 100 + k // 50 * 50 for k in range(200) if k % 50)


def test_outliers(spark):
    r = random.Random(7)
    rows = [(2000 + i, " ".join(words(r.randrange(60, 300), i, 5000)), "en", "a", "") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "%%%" for x in words(150, i, 5000)), "en", "a", "") for i in range(12)] + odd_rows()
    got = {x.doc_id: x for x in outliers.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[2000 + i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(12))
    assert got[4].base_failed and got[4].n_words == 0
    from votepanel.llm.hashing import WordIds

    assert outliers.text_stats("a b c d e a b c d e\n# x\n# x\n\n", WordIds()) == (14, 14, 2, 1, 10, 3)
    assert outliers.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_outliers_in_small_pools(spark):
    r = random.Random(8)
    rows = [(i, " ".join(words(r.randrange(60, 300), i, 5000)), "en", "hot", "") for i in range(200)]
    for k, (lang, source) in enumerate([("en", "small"), ("xx", "s1"), ("xx", "s2")]):  # a pool under 50; a language under 50
        rows += [(1000 + 100 * k + i, " ".join(words(150, 3000 + 10 * k + i, 5000)), lang, source, "") for i in range(6)]
        rows += [(1050 + 100 * k + i, " ".join(x + "%%%" for x in words(150, 4000 + 10 * k + i, 5000)), lang, source, "") for i in range(4)]
    got = {x.doc_id: x for x in outliers.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 230 and all(x.distance is not None for x in got.values())
    assert all(x.kept == (x.doc_id < 1000 or x.doc_id % 100 < 50) for x in got.values())


def test_grades_held_out(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w, kind = words(r.randrange(5, 80), i, 300), i % 5
        if kind == 0:
            w[r.randrange(len(w))] = r.choice(["vile", "awful"])
        if kind == 1:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en", "a", ""))
        if i < 600:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    labels += [(None, 1, 0), (0, None, None), (2, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + odd_rows(), DOCS)
    got = [x for x in grading.grade_documents(docs, lab).collect() if x.doc_id is not None and x.doc_id >= 600]
    assert len(got) == 300 and np.mean([x.kept == (x.doc_id % 5 > 1) for x in got]) > 0.97
    assert grading.keep_good(docs, lab.limit(0)).count() == docs.count() and grading.keep_good(docs, lab).columns == docs.columns


def test_pipeline_keeps_columns_and_effects(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(words(150, i, 4000)), "en", f"s{i % 3}", 0) for i in range(60)] + [(500, " ".join(words(150, 3, 4000)), "en", "s1", 0), (501, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
    ids = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert 500 not in ids and 3 in ids and 501 in ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


def passages_oracle(texts, length):
    """Words left of every text: those under no window of ``length`` words that a different text holds."""
    split = {t: t.encode().split() for t in texts}
    holders = collections.defaultdict(set)
    for t, w in split.items():
        for i in range(len(w) - length + 1):
            holders[tuple(w[i : i + length])].add(t)
    out = []
    for t in texts:
        w = split[t]
        gone = {k for i in range(len(w) - length + 1) if len(holders[tuple(w[i : i + length])]) > 1 for k in range(i, i + length)}
        out.append([x.decode() for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize("collection", [4096, 1])
def test_passages_against_brute_force(spark, monkeypatch, collection):
    monkeypatch.setattr(repeats, "COLLECTION", collection)
    passages = [words(n, 70 + n, 900) for n in (49, 50, 51, 55, 60, 200)]
    rows = []
    for i in range(60):
        w = words(30 + i, 500 + i, 3000)
        for p in range(len(passages)):
            if i % (p + 3) == 0:
                at = (i * 7) % len(w)
                w = w[:at] + passages[p] + w[at:]
        rows.append((i, (" " if i % 2 else "\n\t").join(w)))
    own = words(60, 5, 3000)
    rows += [(100, " ".join(own * 2)), (101, " ".join(words(80, 9, 3000))), (102, " ".join(words(80, 9, 3000))), (103, " ".join(passages[5])), (104, " ".join(passages[5]) + "\n"), (105, "a " * 400), (106, "b a " + "a " * 300 + "é"), (107, None), (108, ""), (109, " \n")]
    docs = spark.createDataFrame([(*x, "t", [1]) for x in rows], "doc_id long, text string, key string, spans array<int>").repartition(3)
    got = {r.doc_id: r.text for r in repeats.remove_passages(docs).collect()}
    want = passages_oracle([t or "" for _, t in rows], 50)
    text = dict(rows)
    for (i, t), left in zip(rows, want, strict=True):
        if t is None or left == t.split():
            assert got[i] == t  # unchanged
        elif left:
            assert got[i].split() == left
        else:
            assert i not in got
    assert got[100] == text[100] and got[101] == text[101] == got[102] and 103 not in got and 104 not in got  # own repeats and whole copies stay
    assert repeats.remove_passages(docs.limit(0)).count() == 0 and repeats.remove_passages(docs).columns == docs.columns


def test_pipeline_passages_of_51_to_60_words(spark, tmp_path):
    import corpus_pipeline

    passage = {n: " ".join(words(n, 90 + n, 400)) for n in range(51, 61)}
    assert all(len(p) < 400 for p in passage.values())
    rows = [(i, " ".join(words(100, 800 + i, 4000)), "en", "a", 0) for i in range(60)]
    rows += [(100 + i, f"{t}\n{passage[51 + i % 10]}\n{t[::-1]}", "en", "a", 0) for i, (_, t, *_) in enumerate(rows[:20])]
    docs = spark.createDataFrame([(i, t, x, y, len(t)) for i, t, x, y, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    whole = {i: t for i, t, *_ in rows}
    assert all(got[i].text == whole[i] for i in range(20, 60))
    assert all(passage[51 + i % 10] not in got[100 + i].text and got[100 + i].text.strip() == whole[i][::-1] and got[100 + i].n_chars == len(got[100 + i].text) for i in range(20))
    assert not any(i in got for i in range(20))  # of these texts all 100 words occur in another text


def test_decoder_joins_closed_runs_and_keeps_open_sequences():
    """Runs of closed tokens, tokens that open a sequence, and malformed bytes, met for the first time and again."""
    from votepanel.llm.bpe import StreamDecoder

    tokens = {0: b"a", 1: "é".encode(), 2: b"\xe2\x82", 3: b"\xac b", 4: b"\xff", 5: b"c\xc3", 6: "€".encode()}
    decode = StreamDecoder(tokens)
    for ids in ([], [0, 1, 0], [0, 2, 3, 1, 0], [2, 3], [5, 0, 1], [0, 2], [4, 0, 6], [1, 5, 2, 3, 0], [3, 2, 2, 3]):
        raw = b"".join(tokens[i] for i in ids)
        for _ in range(2):
            assert decode(ids) == raw.decode("utf-8", "replace")
    assert decode.closed[0] == "a" and decode.closed[6] == "€" and 2 not in decode.closed and 5 not in decode.closed


def test_parts_of_ascii_letters_are_not_pieced_again(monkeypatch):
    import public_tokenizers

    from votepanel.llm import bpe

    pieced, compiled = [], bpe.regex.compile

    class Pattern:
        def __init__(self, pattern):
            self.pattern = compiled(pattern)
            self.search = self.pattern.search

        def findall(self, text):
            pieced.append(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(bpe.regex, "compile", Pattern)
    ranks = {bytes([b]): b for b in range(256)} | {b" a": 256, b"ab": 257}
    monkeypatch.setattr(bpe, "load_ranks", lambda path: ranks)
    encode, decode = bpe.codec("", public_tokenizers.PATTERN)
    text = "x ab cde it's élan ab 12ab"
    merged = [bpe.Merger(ranks)(p.encode()) for p in compiled(public_tokenizers.PATTERN).findall(text)]
    assert encode(text) == [ranks[t] for p in merged for t in p] and decode(encode(text)) == text
    assert " ab" not in pieced and " cde" not in pieced and " it's" in pieced and " élan" in pieced
