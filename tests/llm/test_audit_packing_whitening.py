"""Filter audit, packing and whitening against brute force on small tables with odd rows."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from votepanel.llm import audit, packing, whitening

DOCS = "doc_id long, text string, lang string, source string, part string, ids binary, x int"


def audit_oracle(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    kinds = collections.defaultdict(list)
    for d, t, lang, *_ in rows:
        t = t or ""
        w = t.encode().split()
        failed = {"A"} if len(w) < 100 else set()
        if 100 * len(set(w)) < 80 * len(w):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            failed.add("C")
        if set(t) & set("#$%&*|"):
            failed.add("D")
        if d is not None and d > low[t]:
            failed.add("E")
        kinds[lang or ""].append((failed, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for part, docs in kinds.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out[part, order, k] = [len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_all_orders(spark):
    r = random.Random(1)
    base = [" ".join(f"w{r.randrange(v)}" for _ in range(n)) for n, v in ((150, 10000), (150, 30), (20, 500), (120, 9000))]
    texts = [None, "", " \t", "A", "É" * 9, "x#", "A B C", *base, base[0].upper(), base[1] + " $", base[2].upper() + "|", base[0] + " 50%", "a\x0bb\x0cc d e"]
    rows = [(i if i % 17 else None, r.choice(texts), r.choice(["en", "de", None, ""]), "s", "p", b"", 1) for i in range(300)]
    rows += [(3, texts[7], "en", "s", "p", b"", 1)] * 2 + [(-5, texts[7], "de", "s", "p", b"", 1), (-5, texts[7], "xx", "s", "p", b"", 1)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs, lab = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, lab).collect()
    want = audit_oracle(rows, labels)
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got} == want
    assert len(got) == len(want) == 600 * 4
    assert audit.filter_audit(docs.limit(0), lab).count() == 0 and audit.filter_audit(docs, lab.limit(0)).where("good_lost > 0").count() == 0


def test_potential_of_a_game(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, " ".join(f"w{i}" for i in range(100)), "en")], "doc_id long, text string, lang string")
    row = audit.filter_games(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    # A fails rows 1 and 2, E row 2: v(A) = 2, v(E) = 1, v(AE) = 2; P(AE) = (2 + 2 + 1) / 2
    assert row.rows == 3 and row.removed[1] == 2 and row.removed[16] == 1 and row.removed[17] == 2
    assert row.potential[17] == 60 * 5 // 2 and row.potential[31] == row.potential[17]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return path, library


def test_encoder_equals_library(tokenizer):
    path, library = tokenizer
    encode = packing.TextEncoder(path)
    assert encode.fast is not None
    r = random.Random(1)
    texts = ["", " ", "\n", " a ", "<|endoftext|> x<|endoftext|>", "it's we'll I'M 'S", "a" * 70000 + " b  c" * 30000 + "   ", " \n" * 40000, "日本 語 " * 30000]
    texts += ["".join(r.choice("abcé ü 12\n\n  '\t's\xa0 \x1c\x1d\x85ßжя日🙂​  !.") for _ in range(r.randrange(90))) for _ in range(1500)]
    texts += ["".join(chr(r.randrange(0x250)) for _ in range(r.randrange(60))) for _ in range(3000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == want
        assert "".join(packing.stretches(t, 7)) == t
        if len(t) < 100:
            assert [i for part in packing.stretches(t, 7) for i in library.encode(part, add_special_tokens=False).ids] == want


def test_level_array_takes_the_smallest_sum_of_squares():
    r = random.Random(2)
    levels, counts = packing.Levels(12), collections.Counter()
    for _ in range(2000):
        size = r.choice([1, 3, 5, 7, 11])
        got = levels.best(size)

        def after(h, size=size):
            c = collections.Counter(counts)
            if h:
                c[h] -= 1
            if h + size < 12:
                c[h + size] += 1
            return sum(v * v for v in c.values())

        options = [h for h in range(12 - size + 1) if not h or counts[h]]
        assert got in options and after(got) == min(map(after, options))
        for level, by in ((got, -1), (got + size, 1)):
            levels.change(level, by)
            if 0 < level < 12:
                counts[level] += by


@pytest.mark.parametrize("max_open", [4096, 2])
def test_packing_keeps_every_id(spark, tokenizer, max_open):
    path, library = tokenizer
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 3, 40, 90, 300]))), "en", "s", "p", b"", 1) for i in range(120)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", "", b"", 1), (None, "no id", "en", "s", "", b"", 1), (202, "x y " * 9000, "en", "s", "", b"", 1)] + [(203, "twice", "en", "s", "", b"", 1)] * 2
    length = 128
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3), path, length, max_open=max_open)
    pieces = got.collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        want[d] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    have = collections.Counter()
    text = {d: t or "" for d, t, *_ in rows}
    for d in want:
        ids = library.encode(text[d], add_special_tokens=False).ids + [1]
        mine = [p for p in pieces if p.doc_id == d]
        cover = collections.Counter()
        for p in mine:
            have[d] += p.length
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids) and p.length > 0
            cover.update(range(p.start, p.start + p.length))
        assert set(cover.values()) == {2 if d == 203 else 1} and len(cover) == len(ids)
    assert have == want
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for parts in by.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1]
        total = sum(p.length for p in parts)
        assert total <= length and total & (total - 1) == 0  # no padding at all
    whole = {s.sequence_id: s for s in packing.sequences(got).collect()}
    assert whole.keys() == by.keys() and all(whole[k].ids == b"".join(p.ids for p in v) and whole[k].doc_ids == [p.doc_id for p in v] for k, v in by.items())
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_packing_query_digest(spark, tokenizer, tmp_path):
    spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array(tokenizer[1].encode("hello world").ids + [1], "<u4")
    got = packing.op12_packing(spark, str(tmp_path)).collect()
    assert [r.ids_crc32 for r in got if r.doc_id == 2] == [zlib.crc32(b"\1\0\0\0")]
    assert [r.ids_crc32 for r in sorted(got, key=lambda r: r.start) if r.doc_id == 1] == [zlib.crc32(ids[:2].tobytes()), zlib.crc32(ids[2:].tobytes())]  # 3 ids: 2 and 1


def test_eigenvectors_of_hard_matrices():
    r = np.random.default_rng(0)
    for d in (1, 2, 3, 5, 20, 64):
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        close = np.concatenate([[5, 5, 5, 5.000001], np.ones(max(0, d - 4))])[:d]
        v = r.standard_normal(d)
        for a in (q @ np.diag(r.random(d)) @ q.T, np.eye(d) * 3, (q * close) @ q.T, np.outer(v, v), np.diag(np.arange(d, 0, -1.0)) * 1e9, np.zeros((d, d))):
            a = (a + a.T) / 2
            w, u = whitening.leading_vectors(a, 4)
            k, scale = min(4, d), max(np.abs(a).max(), 1e-300)
            assert np.abs(w - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * scale * d
            assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(a @ u - u * w).max() < 1e-13 * scale * d


def whitening_oracle(rows):
    xs = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = collections.defaultdict(list)
    for d in {len(x) for _, x in xs}:
        mine = [(i, x) for i, x in xs if len(x) == d]
        a = np.array(sorted({tuple(x) for _, x in mine}), object)
        n, s = len(a), a.sum(axis=0)
        c = (n * a - s).astype(float) / n
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        for j in range(min(4, d)):
            if e[-1 - j] > 1e-9 * e[-1] and n > 1:
                for i, x in mine:
                    z = n * np.array(x, object) - s
                    out[i, d, j + 1].append((n, int((z * z).sum()), float(z.astype(float) / n @ u[:, -1 - j] / np.sqrt(e[-1 - j])), e[-1 - j] / np.trace(v)))
    return out


@pytest.mark.parametrize("big", [0.0, 1e9])
def test_whitening_against_eigh(spark, big):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) + big for c in r.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 600)] + [(7, rows[9][1]), (None, rows[3][1]), (700, None), (701, [1.0, None] * 3), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (705, [1.0, 2.0, 3.0])]
    rows += [(800 + i, [float(i), float(i * i % 7)]) for i in range(9)] + [(820, [-0.0, 0.5])]
    df = spark.createDataFrame([(*x, "l", 1) for x in rows], "vec_id long, embedding array<double>, label string, x int").repartition(3)
    got = collections.defaultdict(list)
    length = {i: len(v) for i, v in rows if v}
    for x in whitening.whiten(df).collect():
        assert x.identity_error < 1e-9
        got[x.vec_id, length[x.vec_id], x.component].append(x)
    want = whitening_oracle(rows)
    assert got.keys() == want.keys()
    signs = {}
    for key, values in want.items():
        assert len(got[key]) == len(values)
        for x, (n, deviation, w, explained) in zip(sorted(got[key], key=lambda x: x.deviation or 0), sorted(values, key=lambda v: v[1]), strict=True):
            assert x.n == n and x.deviation == (deviation if deviation < 1 << 63 else None)
            sign = signs.setdefault(key[1:], 1 if w * x.whitened >= 0 else -1)
            assert abs(sign * x.whitened - w) < 1e-7 and abs(x.explained / explained - 1) < 1e-6
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_sums_are_exact():
    r = np.random.default_rng(6)
    for top in (100, 1 << 25, 1 << 45):
        y = r.integers(-top, top, (300, 3))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()
    y = np.array([[3, -4], [1 << 31, 5]])
    space = whitening.Space(1 << 20, np.zeros(2, np.int64), np.array([7, -(1 << 18)]), np.zeros((2, 0)), np.zeros(0))
    true = [sum(((1 << 20) * int(c) - s) ** 2 for c, s in zip(row, (7, -(1 << 18)))) for row in y]
    assert space.deviation(y) == [t if t < 1 << 63 else None for t in true] and true[1] >= 1 << 63
